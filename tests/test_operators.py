import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from karst.operators import chunking as C
from karst.operators import graph as G
from karst.operators import retrieval as R


def test_knn_matches_brute_force_over_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "vec_id long, embedding array<double>")
    got = R.knn(df, df.where("vec_id < 7"), 4, block=3).orderBy("query_id", "rank").collect()
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = [(q, int(i)) for q in range(7) for i in np.lexsort((np.arange(60), -np.round(n @ n[q], 9)))[:4]]
    assert [(r.query_id, r.vec_id) for r in got] == want
    assert R.knn(df.limit(0), df, 3).count() == 0


def test_rrf_weights_and_ties(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int")
    b = spark.createDataFrame([("y", 1), ("x", 2), (None, 3)], "id string, rank int")
    rows = {r.id: r.rrf for r in R.rrf([a, b], "id").collect()}
    assert rows["x"] == pytest.approx(rows["y"]) and set(rows) == {"x", "y"}
    with pytest.raises(ValueError):
        R.rrf([a, b], "id", [1.0])
    with pytest.raises(ValueError):
        R.convex(F.lit(1.0), F.lit(1.0), 2)


def test_minmax_of_equal_scores_is_one(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 3.0)], "id int, s double")
    assert {r.normalised for r in R.minmax(df, "s").collect()} == {1.0}


def test_rerank_keeps_short_lists(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (2, 2, 9.0)], "id int, rank int, s double")
    assert [r.id for r in R.rerank(df, F.col("s"), 2, "id").orderBy("final_rank").collect()] == [1, 2]
    assert [r.id for r in R.rerank(df, F.col("s"), 1, "id").collect()] == [2]


def test_batches_cover_every_item_once(spark):
    sizes = [5, 100, 3, 3, 3, 40, 7]
    df = spark.createDataFrame(list(enumerate(sizes)), "id int, n int")
    rows = R.batches_by_budget(df, "id", "n", 20, 3).collect()
    assert sorted(r.id for r in rows) == list(range(7))
    groups = {}
    for r in rows:
        groups.setdefault(r.batch, []).append(sizes[r.id])
    assert all(len(g) <= 3 and (len(g) == 1 or len(g) * max(g) <= 20) for g in groups.values())


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400), st.integers(10, 60))
def test_recursive_split_bounds_and_words(text, size):
    chunks = C.recursive_split(text, size, size // 3)
    assert all(0 < len(c) <= size for c in chunks)
    joined = "".join("".join(c.split()) for c in C.recursive_split(text, size, 0))
    assert joined == "".join(text.split())


def test_tables():
    text = "intro\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n| odd |\nend"
    tables, rest = C.pipe_tables(text)
    assert tables[0]["rows"] == [["1", "2"], ["3", "4"]] and rest == ["intro", "| odd |", "end"]
    rows = [[str(i), "x" * 20] for i in range(50)]
    for strategy in ("atomic", "per_row", "adaptive"):
        chunks = C.table_chunks(["n", "v"], rows, strategy, 300)
        covered = [i for c in chunks for i in range(c["start"], c["end_inclusive"] + 1)]
        assert covered == list(range(50)) and all(c["text"].startswith("| n | v |") for c in chunks)
    assert len(C.table_chunks(["n"], [])) == 1


def test_markdown():
    text = "# A\n\nintro\n\n## B\n\n- x\n- y\n\n```\ncode | x\n```\n\n![i](u)\n\n> q"
    kinds = [e["type"] for e in C.markdown_elements(text)]
    assert kinds == ["heading", "paragraph", "heading", "list", "code", "image", "quote"]
    assert C.markdown_elements(text)[3]["path"] == ["A", "B"]
    assert [s["path"] for s in C.sections(text)] == [["A"], ["A", "B"]]


def edges(spark, pairs):
    return spark.createDataFrame([(f"e{i}", a, b, "T", float(w)) for i, (a, b, w) in enumerate(pairs)], "id string, src string, dst string, type string, weight double")


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_components_of_a_long_path(spark):
    e = edges(spark, [(f"n{i:03}", f"n{i + 1:03}", 1) for i in range(40)] + [("x", "y", 1), ("z", "z", 1)])
    got = {r.id: r.root for r in G.components(nodes(spark, [f"n{i:03}" for i in range(41)] + ["x", "y", "z"]), e).collect()}
    assert {got[f"n{i:03}"] for i in range(41)} == {"n000"} and got["y"] == "x" and got["z"] == "z"


def test_pagerank_matches_plain_python(spark):
    pairs = [("a", "b", 2), ("b", "c", 1), ("c", "a", 1), ("c", "d", 3)]
    ids = ["a", "b", "c", "d", "lone"]
    got = {r.id: r.score for r in G.pagerank(nodes(spark, ids), edges(spark, pairs), nodes(spark, ["a"]), rounds=12, tolerance=0).collect()}
    w = {i: {} for i in ids}
    for a, b, x in pairs:
        w[a][b] = w[b][a] = x
    p = {i: float(i == "a") for i in ids}
    s = dict(p)
    for _ in range(12):
        loose = sum(s[i] for i in ids if not w[i])
        s = {i: (0.15 + 0.85 * loose) * p[i] + 0.85 * sum(s[j] * w[j][i] / sum(w[j].values()) for j in ids if i in w[j]) for i in ids}
    assert all(got[i] == pytest.approx(s[i], abs=1e-9) for i in ids)
    assert G.pagerank(nodes(spark, ids).limit(0), edges(spark, pairs)).count() == 0


def test_communities_cover_and_beat_singletons(spark):
    block = lambda p: [(f"{p}{i}", f"{p}{j}", 1) for i in range(5) for j in range(i)]
    e = edges(spark, block("a") + block("b") + [("a0", "b0", 0.1)])
    ids = nodes(spark, [f"{p}{i}" for p in "ab" for i in range(5)] + ["z"])
    parts = G.communities(ids, e, rounds=8)
    got = {r.id: r.community for r in parts.collect()}
    assert len(got) == 11 and len({got[f"a{i}"] for i in range(5)}) == 1 and got["z"] == "z"
    assert G.modularity(e, parts).first()[0] > 0.3


def test_expand_and_paths(spark):
    e = edges(spark, [("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("a", "a", 1)])
    assert {r.id: r.hop for r in G.expand(e, nodes(spark, ["a"]), 2).collect()} == {"a": 0, "b": 1, "c": 2}
    assert [r.path for r in G.paths(e, nodes(spark, ["a"]), nodes(spark, ["d"])).collect()] == [["a", "b", "c", "d"]]
    assert G.expand(e, nodes(spark, ["a"]).limit(0), 2).count() == 0


def test_remap_drops_loops_and_repeats(spark):
    canon = spark.createDataFrame([("b", "a")], "id string, root string")
    rows = G.remap(edges(spark, [("a", "b", 1), ("b", "c", 1), ("a", "c", 2)]), canon).collect()
    assert [(r.src, r.dst, r.id) for r in rows] == [("a", "c", "e1")]


def test_near_pairs_loses_no_link(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(70, 4))
    df = spark.createDataFrame([(i * 7 + 1, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 4), (1002, [1.0, 2.0])], "vec_id long, embedding array<double>").repartition(3)
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i * 7 + 1, j * 7 + 1) for i in range(70) for j in range(i + 1, 70) if n[i] @ n[j] > 0.35}
    for block in (2048, 16):
        got = [(r.a, r.b) for r in R.near_pairs(df, 0.35, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert R.near_pairs(df.limit(0), 0.35).count() == 0


def test_near_dup_join_takes_every_id(spark, tmp_path):
    from karst.registry import QUERIES

    v = {1: [1.0, 0.0], 2: [1.0, 0.1], 50: [0.0, 1.0], 49: [0.1, 1.0]}
    spark.createDataFrame(list(v.items()), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {(r.a, r.b) for r in QUERIES["near_dup_all_pairs"](spark, str(tmp_path)).collect()} == {(1, 2), (49, 50)}


def test_timeline_places_days_in_words(spark, tmp_path):
    from karst.registry import QUERIES

    days = ["2026-03-12", "11 marzo 2026", "10/03/2026", None, "1 agosto 2021", "?", "3 May 2026"]
    spark.createDataFrame([(f"n{i}", "person", {"name": f"p{i}"}, "x", ["c"], None) for i in range(2)], "id string, label string, properties map<string,string>, namespace string, source_ids array<string>, import_timestamp timestamp").write.parquet(f"{tmp_path}/graph_nodes.parquet")
    rows = [(f"r{i}", "n0", "n1", "knows", 1.0, t, None) for i, t in enumerate(days)]
    spark.createDataFrame(rows, "relationship_id string, source_id string, target_id string, relationship_type string, amount double, date_text string, created_at timestamp").write.parquet(f"{tmp_path}/graph_relationships.parquet")
    got = QUERIES["timeline_whole"](spark, str(tmp_path)).orderBy("position").collect()
    assert [(r.id, str(r.day)) for r in got] == [("r4", "2021-08-01"), ("r2", "2026-03-10"), ("r1", "2026-03-11"), ("r0", "2026-03-12"), ("r6", "2026-05-03"), ("r3", "None"), ("r5", "None")]


def test_graph_pagerank_is_converged(spark, tmp_path):
    from karst.registry import QUERIES

    n = 60
    spark.createDataFrame([(f"n{i}", "person", {"name": f"p{i}"}, "x", ["c"], None) for i in range(n)], "id string, label string, properties map<string,string>, namespace string, source_ids array<string>, import_timestamp timestamp").write.parquet(f"{tmp_path}/graph_nodes.parquet")
    ends = [(i, i + 1) for i in range(n - 2)] + [(0, i) for i in range(2, 20)]  # one node stays loose
    rows = [(f"r{i}", f"n{a}", f"n{b}", "knows", 1.0, None, None) for i, (a, b) in enumerate(ends)]
    spark.createDataFrame(rows, "relationship_id string, source_id string, target_id string, relationship_type string, amount double, date_text string, created_at timestamp").coalesce(1).write.parquet(f"{tmp_path}/graph_relationships.parquet")
    w = np.zeros((n, n))
    for a, b in ends:
        w[a, b] = w[b, a] = 1
    loose = w.sum(1) == 0
    p = np.where(loose[:, None], 1 / n, w / np.maximum(w.sum(1), 1)[:, None])
    want = np.linalg.solve(np.eye(n) - 0.85 * p.T, np.full(n, 0.15 / n))
    got = {r.id: r.score for r in QUERIES["graph_pagerank"](spark, str(tmp_path)).collect()}
    assert max(abs(got[f"n{i}"] - want[i]) for i in range(n)) < 1.01e-7
