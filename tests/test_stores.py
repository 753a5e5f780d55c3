from pyspark.sql import functions as F

from karst.operators import assist as A
from karst.operators.store import AnswerCache, ChunkStore, GraphStore, register_tables


def test_chunk_store(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "chunks"))
    assert store.get().count() == 0
    rows = [("1", "d1", "n", ["a"], "x"), ("2", "d1", "n", None, "y"), ("3", "d2", "n", ["b"], "z"), ("4", "d1", "m", ["a"], "w"), (None, "d1", "n", None, "no"), ("5", "d9", None, None, "q")]
    store.upsert(spark.createDataFrame(rows, "id string, metadata_id string, namespace string, tags array<string>, text string"))
    assert {r.namespace: r.chunks for r in store.namespaces().collect()} == {"n": 3, "m": 1, "default": 1}
    store.upsert(spark.createDataFrame([("6", "d1", "n", ["c"], "new")], "id string, metadata_id string, namespace string, tags array<string>, text string"))
    assert sorted(r.id for r in store.get("n").collect()) == ["3", "6"] and store.get("m").count() == 1
    assert [r.id for r in store.get("n", tags="!b").collect()] == ["6"]
    assert [r.id for r in store.get(where={"metadata_id": "d2"}).collect()] == ["3"] and store.get(ids=["4"], with_text=False).columns.count("text") == 0
    assert {r.metadata_id: r.chunks for r in store.describe("n").collect()} == {"d1": 1, "d2": 1}
    store.delete("n", "d1")
    store.delete("m")
    assert sorted(r.id for r in store.get().collect()) == ["3", "5"]


def test_graph_store(spark, tmp_path):
    g = GraphStore(spark, str(tmp_path / "g"))
    node = "id string, name string, properties map<string,string>, source_ids array<string>, namespace string, label string"
    edge = "id string, src string, dst string, weight double, properties map<string,string>, namespace string, type string"
    g.put_nodes(spark.createDataFrame([("a", "A", None, None, "n", "P"), ("b", "B", None, None, "n", "P")], node))
    g.put_nodes(spark.createDataFrame([("a", "A2", None, None, "n", "P")], node))
    g.put_edges(spark.createDataFrame([("e", "a", "b", 1.0, None, "n", "T"), ("l", "a", "a", 1.0, None, "n", "T")], edge))
    g.put_edges(spark.createDataFrame([("f", "a", "b", 2.0, None, "n", "T")], edge))
    assert {r.id: r.name for r in g.nodes.read().collect()} == {"a": "A2", "b": "B"}
    assert [(r.id, r.weight) for r in g.edges.read().collect()] == [("f", 2.0)]
    g.delete("n")
    assert g.nodes.read().count() == 0 and g.edges.read().count() == 0


def test_answer_cache(spark, tmp_path):
    c = AnswerCache(spark, str(tmp_path / "c"))
    c.store(spark.createDataFrame([("n", "Ciao? ", "1"), ("m", "x", "2")], "namespace string, question string, answer string"))
    c.store(spark.createDataFrame([("n", "ciao?", "3")], "namespace string, question string, answer string"))
    c.store(spark.createDataFrame([("o", "old", "4")], "namespace string, question string, answer string"), hours=-1)
    assert sorted((r.namespace, r.answer) for r in c.live().collect()) == [("m", "2"), ("n", "3")]
    c.invalidate("m")
    assert [r.namespace for r in c.stats().collect()] == ["n"]


def test_catalogue(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert register_tables(spark, spark.createDataFrame([("my_table", str(tmp_path / "t"))], "name string, path string")) == 1
    assert spark.sql("select count(*) from my_table").first()[0] == 3


def test_evidence(spark):
    chunks = spark.createDataFrame([("d", "c1", "the first text of all"), ("d", "c2", "some other words here"), ("e", "c3", "the first text of all")], "doc_id string, chunk_id string, text string")
    quotes = spark.createDataFrame([("q1", "d", "other words"), ("q2", "d", "thx frst txt of al"), ("q3", "d", "zzzz 12345 qqqq"), ("q4", "x", "none")], "quote_id string, doc_id string, quote string")
    got = {r.quote_id: (r.chunk_id, r.how) for r in A.evidence_sources(quotes, chunks).collect()}
    assert got == {"q1": ("c2", "text"), "q2": ("c1", "alike"), "q3": ("c1", "first")}


def test_generated_text():
    assert A.questions_of("Q1: What is it?\n- how is it so\n3) What is it?\nIs it so?\ntext") == ["What is it?", "how is it so?", "Is it so?"]
    assert A.json_of('x {"a": {"b": 1}} y') == {"a": {"b": 1}} and A.json_of("{bad}") is None and A.json_of("") is None
    entities, links = A.extraction_records('entity|Acme|ORG|a firm\nentity|x|far too many words|d\nrelationship|acme|bob|works for|d|0\nrelationship|a|b|t|d|n/a|2024-01-01\nnoise')
    assert [e["name"] for e in entities] == ["ACME"] and [(x["type"], x["weight"]) for x in links] == [("WORKS_FOR", 0.0), ("T", 1.0)]


def test_tree(spark):
    leaves = spark.createDataFrame([("d", i, f"t{i}") for i in range(11)] + [("e", 0, "only")], "doc_id string, position int, text string")
    tree = A.summary_tree(leaves, 3, lambda p: F.array_join(p, "+"))
    assert {(r.level, r.n) for r in tree.where("doc_id = 'd'").groupBy("level").agg(F.count("*").alias("n")).collect()} == {(0, 11), (1, 4), (2, 2), (3, 1)}
    assert tree.where("doc_id = 'd' and parent_id is null").first().text == "+".join(f"t{i}" for i in range(11))
    assert A.tree_errors(tree).count() == 0 and A.tree_errors(tree.where("level <> 1")).count() > 0


def test_requirements(spark):
    df = spark.createDataFrame([("Requisito",), ("first",), (" ",), ("second ",)], "t string").coalesce(1)
    assert [(r.req_id, r.requirement) for r in A.requirements_of(df, "t").orderBy("req_id").collect()] == [("REQ-001", "first"), ("REQ-002", "second")]
