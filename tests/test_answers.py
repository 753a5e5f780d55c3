import math

import pytest
from pyspark.sql import functions as F

from karst.core import session
from karst.functions import vectors as V
from karst.operators import graph as G
from karst.operators import hybrid as H
from karst.operators import layout as L
from karst.operators import reports as P
from karst.operators import retrieval as R
from karst.operators.store import ChunkStore
from karst.plans import plugins


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sparse_score_leaves_other_words_out_before_it_aggregates(spark):
    df = spark.createDataFrame([(1, "Polizza e polizza, mutuo"), (2, None), (3, ""), (4, "altro"), (5, "MUTUO")], "id int, text string")
    got = {r.id: r.sparse for r in R.sparse_score(df, "id", "text", {"polizza": 2.0, "mutuo": 1.0}).collect()}
    assert got == pytest.approx({1: 2 * (1 + math.log(2)) + 1, 5: 1.0})
    assert "array_contains" in plan(R.sparse_score(df, "id", "text", {"polizza": 2.0})) and R.sparse_score(df, "id", "text", {}).count() == 0


def test_hybrid_search_takes_nulls_ties_and_empty_tables(spark):
    rows = [("a", "mutuo casa"), ("b", "mutuo casa"), ("c", None), ("d", ""), ("e", "123"), ("f", "z" * 50_000)]
    df = spark.createDataFrame([(a, b, 0.5) for a, b in rows], "id string, text string, score double")
    args = ("id", "text", V.letter_vector(F.col("text")), V.letters_of("mutuo"), {"mutuo": 1.0})
    assert [r.id for r in H.hybrid_rrf(df, *args).orderBy("rank").collect()] == ["a", "b", "f"]
    assert [r.id for r in H.hybrid_weighted(df, *args, 0.5, 2).orderBy("rank").collect()] == ["a", "b"]
    assert H.hybrid_rrf(df.limit(0), *args).count() == 0
    with pytest.raises(ValueError):
        H.hybrid_weighted(df, *args, 1.5)


def test_added_items_replace_their_chunks(spark):
    store = ChunkStore(spark, session.scratch(spark, "t"))
    items = spark.createDataFrame([(1, "uno due tre"), (2, None), (3, "  ")], "k int, t string")
    halves = lambda t: F.split(t, " ")
    H.add_items(items, "k", "t", halves, V.letter_vector, store, namespace=F.lit("n"))
    H.add_items(items.withColumn("t", F.lit("solo")).where("k = 1"), "k", "t", halves, V.letter_vector, store, namespace=F.lit("n"))
    assert [(r.id, r.text) for r in store.get("n").collect()] == [("1#0", "solo")]


def test_expressions_as_text():
    assert H.expression_of({}) == "true"
    assert H.expression_of({"a`b": "x'y"}) == "(`a``b` = 'x\\'y')"
    with pytest.raises(ValueError):
        H.expression_of({"a": {"$near": 1}})


def test_reports_keep_to_their_budget_and_lone_members(spark):
    m = spark.createDataFrame([("a", "c", 0), ("b", "c", 0), ("z", "d", 0)], "id string, community string, level int")
    n = spark.createDataFrame([("a", "Anna"), ("b", "Bea"), ("z", None)], "id string, name string")
    e = spark.createDataFrame([(f"e{i}", "a", "b", "KNOWS", float(i)) for i in range(40)] + [("x", "a", "z", "KNOWS", 1.0)], "id string, src string, dst string, type string, weight double")
    got = {r.community: r for r in P.reports(m, n, e, budget=100).collect()}
    assert got["c"].title == "Anna" and got["c"].edges == 40 and got["c"].summary.count("\n") == 5 and len(got["c"].summary) <= 100
    assert got["d"].edges == 0 and got["d"].summary == "" and got["d"].size == 1
    assert P.reports(m.limit(0), n, e).count() == 0


def test_modularity_communities_find_two_cliques(spark):
    pairs = [(f"{s}{i}", f"{s}{j}", 1.0) for s in "ab" for i in range(5) for j in range(i)] + [("a0", "b0", 1.0), ("a1", "a1", 9.0)]
    e = spark.createDataFrame(pairs, "src string, dst string, weight double")
    n = spark.createDataFrame([(f"{s}{i}",) for s in "ab" for i in range(5)] + [("lone",)], "id string")
    got = {r.id: r.community for r in G.louvain(n, e).collect()}
    assert len({got[f"a{i}"] for i in range(5)}) == 1 and len({got[f"b{i}"] for i in range(5)}) == 1 and len(set(got.values())) == 3
    assert {r.id for r in G.louvain(n, e, least_size=3).collect()} == set(got) - {"lone"}
    assert G.louvain(n, e.limit(0)).count() == 11


def test_sections_skip_levels(spark):
    rows = [("d", f"e{i}", 0, i, k, t) for i, (k, t) in enumerate([("text", "prima"), ("h", "1 A"), ("h", "1.1.1 B"), ("text", "b"), ("h", "1.1 C"), ("h", "2 D"), (None, "d")])]
    e = L.reading_order(spark.createDataFrame(rows, "doc_id string, element_id string, page int, seq int, element_type string, text string"))
    head, level = F.coalesce(F.col("element_type") == "h", F.lit(False)), F.size(F.split(F.regexp_extract("text", r"^([\d.]+)", 1), r"\."))
    tree = {r.section_id: (r.parent_id, r.depth) for r in L.section_tree(e, head, level).collect()}
    assert tree == {"e1": (None, 0), "e2": ("e1", 1), "e4": ("e1", 1), "e5": (None, 0)}
    assert {r.element_id: r.section_id for r in L.in_section(e, head).collect()}["e6"] == "e5"


def test_workflows_that_never_end_are_stopped():
    with pytest.raises(RuntimeError):
        plugins.run_workflow({"a": lambda s: ("a", s)}, "a", {})


def test_point_lookups_filter_before_they_deduplicate(spark):
    from karst.plans.search import chunks

    path = session.scratch(spark, "lookup")
    spark.createDataFrame([("a", "n", None), ("a", "n", None), ("b", "m", None)], "id string, namespace string, ingested_at timestamp").write.parquet(path + "/chunks.parquet")
    found = chunks(spark, path, "namespace = 'n'")
    assert "EqualTo(namespace,n)" in plan(found) and [r.id for r in found.collect()] == ["a"]


def test_scratch_files_go(spark):
    import os

    df = session.staged(spark.range(3))
    path = session._SCRATCH[-1][1]
    assert df.count() == 3 and os.path.isdir(path.removeprefix("file://"))
    kept, session._SCRATCH[:] = session._SCRATCH[:-1], session._SCRATCH[-1:]
    session.clear_scratch()
    session._SCRATCH.extend(kept)
    assert not os.path.isdir(path.removeprefix("file://"))


def test_mixture_size_finds_three_blobs(spark):
    import numpy as np

    from karst.operators import assist as A

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.3, (80, 2)) for c in ((0, 0), (5, 5), (0, 6))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    assert A.mixture_size(df, "v", most=6, patience=2) == 3
    assert A.mixture_size(df.limit(1), "v") == 1
