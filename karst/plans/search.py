"""Queries of the chunk store, filters, retrieval and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karst.core.session import table
from karst.functions import filters, vectors
from karst.functions import text as T
from karst.operators import retrieval as R
from karst.registry import query

STEP = 50  # searches: every row whose id is divisible by 50 is a query


def chunks(spark, d, where=None) -> DataFrame:
    """Stored chunks, each id once: a later ingestion replaces an earlier one.

    A repeated id differs in `ingested_at` alone, so a condition `where` on other columns comes
    first: it reaches the scan, and only what it leaves is deduplicated.
    """
    rows = table(spark, d, "chunks")
    return R.first_of(rows if where is None else rows.where(where), "id", [F.desc("ingested_at")])


CHUNKS = "c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) = 1)"
LATEST = f"WITH {CHUNKS}"


def dense(spark, d, k=10, metric="cosine", where=None) -> DataFrame:
    e = table(spark, d, "embeddings")
    rows = e.where(where) if where is not None else e
    return R.knn(rows, e.where(F.col("vec_id") % STEP == 0), k, metric).withColumn("score", F.round("score", 5))


def _knn_sql(score: str, where: str = "true", k: int = 10) -> str:
    return f"""
WITH s AS (SELECT q.vec_id AS query_id, r.vec_id, {score} AS raw
  FROM embeddings q, embeddings r WHERE q.vec_id % {STEP} = 0 AND {where}),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(raw, 5) AS score, rank::INT AS rank FROM k WHERE rank <= {k}"""


COS = "list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[])"


@query("dense_topk", _knn_sql(COS))
def dense_topk(spark, d):
    return dense(spark, d)


@query("dense_topk_filtered", _knn_sql(COS, "r.label IN (1, 3, 5)", 5))
def dense_topk_filtered(spark, d):
    return dense(spark, d, 5, where=F.col("label").isin(1, 3, 5))


@query("metric_dot", _knn_sql("list_dot_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[])", k=5))
def metric_dot(spark, d):
    return dense(spark, d, 5, "dot")


@query("metric_l2", _knn_sql("0.0 - list_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[])", k=5))
def metric_l2(spark, d):
    return dense(spark, d, 5, "l2")


@query(
    "vector_norms",
    "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm, "
    "round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), 5) AS mirrored FROM embeddings",
)
def vector_norms(spark, d):
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(v), 5).alias("norm"), F.round(vectors.cosine(v, F.reverse(v)), 5).alias("mirrored"))


@query("level_search", f"""
WITH s AS (SELECT q.vec_id AS query_id, r.vec_id, r.label, {COS} AS raw FROM embeddings q JOIN embeddings r ON q.vec_id % {STEP} = 0 AND r.label % 2 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, rank::INT AS rank FROM k WHERE rank <= 4""")
def level_search(spark, d):
    return dense(spark, d, 4, where=F.col("label") % 2 == 0).select("query_id", "vec_id", "rank")


_TWO = f"""
WITH s AS (SELECT q.vec_id AS query_id, r.vec_id, {COS} AS c, list_dot_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS p,
  -list_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS l FROM embeddings q, embeddings r WHERE q.vec_id % {STEP} = 0),
a AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, vec_id) AS rank FROM s QUALIFY rank <= 20),
b AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(l, 9) DESC, vec_id) AS rank FROM s QUALIFY rank <= 20)
"""


@query("rrf_two_rankings", _TWO + """
SELECT query_id, vec_id, round(sum(1.0 / (60 + rank)), 8) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL""")
def rrf_two_rankings(spark, d):
    return R.rrf([dense(spark, d, 20), dense(spark, d, 20, "l2")], "vec_id", by=["query_id"]).withColumn("rrf", F.round("rrf", 8))


@query("rrf_weighted", _TWO + """
SELECT query_id, vec_id, round(sum(w / (60 + rank)), 8) AS rrf FROM (SELECT *, 0.7 AS w FROM a UNION ALL SELECT *, 0.3 FROM b) GROUP BY ALL""")
def rrf_weighted(spark, d):
    return R.rrf([dense(spark, d, 20), dense(spark, d, 20, "l2")], "vec_id", [0.7, 0.3], by=["query_id"]).withColumn("rrf", F.round("rrf", 8))


@query("rrf_zero_based", _TWO + """
SELECT query_id, vec_id, round(sum(1.0 / (60 + rank - 1)), 8) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL""")
def rrf_zero_based(spark, d):
    return R.rrf([dense(spark, d, 20), dense(spark, d, 20, "l2")], "vec_id", base=0, by=["query_id"]).withColumn("rrf", F.round("rrf", 8))


@query("rrf_with_metadata", _TWO + """, u AS (SELECT query_id, vec_id, rank, 0 AS src FROM a UNION ALL SELECT query_id, vec_id, rank, 1 FROM b),
f AS (SELECT query_id, vec_id, round(sum(1.0 / (60 + rank)), 8) AS rrf, min_by(src, src * 1000 + rank)::INT AS first_ranking FROM u GROUP BY ALL)
SELECT f.*, label FROM f JOIN embeddings USING (vec_id)""")
def rrf_with_metadata(spark, d):
    a, b = dense(spark, d, 20).withColumn("src", F.lit(0)), dense(spark, d, 20, "l2").withColumn("src", F.lit(1))
    fused = R.rrf([a, b], "vec_id", by=["query_id"]).withColumn("rrf", F.round("rrf", 8))
    first = a.unionByName(b).groupBy("query_id", "vec_id").agg(F.min_by("src", F.struct("src", "rank")).alias("first_ranking"))
    return fused.join(first, ["query_id", "vec_id"]).join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")


@query("minmax_norm", """
WITH b AS (SELECT min(value) AS lo, max(value) AS hi, event_type FROM events GROUP BY event_type)
SELECT event_id, round(CASE WHEN hi = lo THEN 1.0 ELSE (value - lo) / (hi - lo) END, 6) AS normalised FROM events JOIN b USING (event_type)""")
def minmax_norm(spark, d):
    return R.minmax(table(spark, d, "events"), "value", ["event_type"]).select("event_id", F.round("normalised", 6).alias("normalised"))


@query("rank_score", """
WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_id, round((n - rank + 1) / n, 6) AS rank_score FROM r""")
def rank_score(spark, d):
    return R.rank_score(R.ranked(table(spark, d, "events"), "value", "event_id", ["event_type"]), ["event_type"]).select("event_id", F.round("rank_score", 6).alias("rank_score"))


_TERMS = r"""t AS (SELECT doc_id, term, 1 + ln(count(*)) AS weight FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents) WHERE length(term) > 1 GROUP BY ALL)"""


@query("sparse_search", f"""
WITH {_TERMS}, q(term, weight) AS (VALUES ('contratto', 1.0), ('vector', 2.0), ('seguro', 1.5), ('fattura', 0.5)),
s AS (SELECT doc_id, sum(t.weight * q.weight) AS sparse FROM t JOIN q USING (term) GROUP BY doc_id)
SELECT doc_id, round(sparse, 5) AS sparse, row_number() OVER (ORDER BY round(sparse, 9) DESC, doc_id) AS rank FROM s QUALIFY rank <= 50""")
def sparse_search(spark, d):
    """Top 50 by sparse score: a top-k report."""
    s = R.sparse_score(table(spark, d, "documents"), "doc_id", "text", {"contratto": 1.0, "vector": 2.0, "seguro": 1.5, "fattura": 0.5})
    top = s.orderBy(F.desc(F.round("sparse", 9)), "doc_id").limit(50)
    return top.select("doc_id", F.round("sparse", 5).alias("sparse"), F.row_number().over(Window.orderBy(F.desc(F.round("sparse", 9)), "doc_id")).cast("long").alias("rank"))


@query("sparse_maxpool", r"""
WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\n')) AS part FROM documents),
n AS (SELECT doc_id, part, row_number() OVER () AS p FROM w),
t AS (SELECT doc_id, p, term, count(*) AS weight FROM (SELECT doc_id, p, unnest(regexp_split_to_array(part, '[^\p{L}\p{N}]+')) AS term FROM n) WHERE length(term) > 1 GROUP BY ALL)
SELECT doc_id, term, max(weight) AS weight FROM t GROUP BY ALL""")
def sparse_maxpool(spark, d):
    """Greatest count of each term over the lines of a document."""
    parts = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.lower("text"), "\n")).alias("p", "part"))
    words = F.filter(F.split("part", r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1)
    terms = parts.select("doc_id", "p", F.explode(words).alias("term")).groupBy("doc_id", "p", "term").agg(F.count("*").alias("weight"))
    return terms.groupBy("doc_id", "term").agg(F.max("weight").alias("weight"))


@query("hybrid_convex", f"""
WITH {_TERMS}, q(term, weight) AS (VALUES ('contratto', 1.0), ('polizza', 1.0)),
s AS (SELECT doc_id, sum(t.weight * q.weight) AS sparse FROM t JOIN q USING (term) GROUP BY doc_id),
z AS (SELECT vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]) AS dense FROM embeddings)
SELECT doc_id, round(0.6 * coalesce(dense, 0) + 0.4 * coalesce(sparse, 0), 5) AS score FROM z FULL JOIN s USING (doc_id)""")
def hybrid_convex(spark, d):
    """Dense and sparse score of each item, alpha 0.6; vec_id stands for the document's id."""
    sparse = R.sparse_score(table(spark, d, "documents"), "doc_id", "text", {"contratto": 1.0, "polizza": 1.0})
    e = table(spark, d, "embeddings")
    probe = e.where("vec_id = 0").select("embedding")  # the one question's vector
    z = e.withColumn("__q", probe.scalar()).select(F.col("vec_id").alias("doc_id"), vectors.cosine(F.col("embedding"), F.col("__q")).alias("dense"))
    return z.join(sparse, "doc_id", "full").select("doc_id", F.round(R.convex(F.col("dense"), F.col("sparse"), 0.6), 5).alias("score"))


@query("token_estimate", r"SELECT doc_id, floor(1.8 * coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')), 0))::INT AS tokens, "
       r"floor(1.8 * coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')), 0))::INT + 11 AS with_query FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", T.token_estimate(F.col("text")).alias("tokens"), T.pair_token_estimate(F.lit("garanzia?"), F.col("text")).alias("with_query")
    )


@query("maxp_aggregate", r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(text, E' \t\n\r'), '\s+'), lambda x: x <> '') AS ws,
  floor(1.8 * coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')), 0)) AS tok, text FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(CASE WHEN tok > 200 THEN list_transform(range(0, greatest(len(ws) - 22, 1), 89), lambda s: array_to_string(ws[s+1:s+111], ' ')) ELSE [text] END) AS win FROM w)
SELECT doc_id, max(len(regexp_extract_all(lower(win), 'contratto|contract|contrato')))::BIGINT AS score, count(*) AS parts FROM p GROUP BY doc_id""")
def maxp_aggregate(spark, d):
    """Greatest window score of each document: mentions of a contract."""
    docs = table(spark, d, "documents").where("text is not null").withColumn("text", F.col("text"))
    parts = R.maxp_windows(docs, "doc_id", "text")
    hits = F.size(F.regexp_extract_all(F.lower("window"), F.lit("contratto|contract|contrato"), F.lit(0))).cast("long")
    return parts.groupBy("doc_id").agg(F.max(hits).alias("score"), F.count("*").alias("parts"))


@query("word_windows", r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL)
SELECT doc_id, (CASE WHEN len(ws) = 0 THEN 0 ELSE ceil(len(ws) / 300.0) END)::BIGINT AS windows, len(ws)::BIGINT AS words FROM w""")
def word_windows(spark, d):
    """Windows of 300 words a sparse encoder is fed with."""
    docs = table(spark, d, "documents").where("text is not null")
    n = R.word_windows(docs, "doc_id", "text", 300).groupBy("doc_id").agg(F.count("*").alias("windows"), F.sum("words").alias("words"))
    zero = F.lit(0).cast("long")
    return docs.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("windows", zero).alias("windows"), F.coalesce("words", zero).alias("words"))


@query("rerank_topk", f"""
WITH s AS (SELECT q.vec_id AS query_id, r.vec_id, r.label, {COS} AS raw FROM embeddings q, embeddings r WHERE q.vec_id % {STEP} = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, vec_id) AS rank FROM s QUALIFY rank <= 15)
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY (label * 7 + vec_id) % 11 DESC, vec_id) AS final_rank FROM k QUALIFY final_rank <= 5""")
def rerank_topk(spark, d):
    """Three times as many candidates as wanted, a second scorer, the best five."""
    rows = dense(spark, d, 15).join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    return R.rerank(rows, (F.col("label") * 7 + F.col("vec_id")) % 11, 5, "vec_id", ["query_id"]).select("query_id", "vec_id", F.col("final_rank").cast("long"))


@query("rerank_passthrough", _TWO + "SELECT query_id, vec_id, rank FROM a WHERE rank <= 5")
def rerank_passthrough(spark, d):
    """A list no longer than wanted is not reranked."""
    return R.rerank(dense(spark, d, 5), F.col("vec_id"), 5, "vec_id", ["query_id"]).select("query_id", "vec_id", F.col("final_rank").cast("long").alias("rank"))


_TOP = _TWO.rstrip().rstrip(",").split(",\na AS")[0] + """,
x AS (SELECT query_id, vec_id, round(raw, 5) AS score, rank FROM (SELECT query_id, vec_id, c AS raw, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, vec_id) AS rank FROM s) WHERE rank <= 20),
y AS (SELECT a.query_id, a.vec_id AS i, b.vec_id AS j, a.rank AS ri, b.rank AS rj, list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS sim FROM x a JOIN x b ON a.query_id = b.query_id AND a.vec_id <> b.vec_id JOIN embeddings p ON p.vec_id = a.vec_id JOIN embeddings q ON q.vec_id = b.vec_id)"""


@query("redundancy_filter", _TOP.replace("WITH s AS", "WITH RECURSIVE s AS", 1) + """, k(query_id, pos, kept) AS (SELECT DISTINCT query_id, 0::BIGINT, []::BIGINT[] FROM x UNION ALL
SELECT k.query_id, x.rank, CASE WHEN EXISTS (SELECT 1 FROM y WHERE y.query_id = k.query_id AND y.i = x.vec_id AND list_contains(k.kept, y.j) AND y.sim >= 0.9) THEN k.kept ELSE list_append(k.kept, x.vec_id) END FROM k JOIN x ON x.query_id = k.query_id AND x.rank = k.pos + 1)
SELECT x.query_id, x.vec_id, x.rank::INT AS rank FROM (SELECT query_id, max_by(kept, pos) AS kept FROM k GROUP BY query_id) f JOIN x ON x.query_id = f.query_id AND list_contains(f.kept, x.vec_id)""")
def redundancy_filter(spark, d):
    rows = dense(spark, d, 20).join(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id")
    return R.without_redundant(rows, 0.9, "query_id", "vec_id", "rank", "embedding")


@query("mmr_search", _TOP + """, g1 AS (SELECT query_id, vec_id, 1 AS pick FROM x WHERE rank = 1), p2 AS (SELECT query_id, vec_id FROM (SELECT x.query_id, x.vec_id, row_number() OVER (PARTITION BY x.query_id ORDER BY round(0.5 * x.score - 0.5 * (SELECT max(y.sim) FROM y JOIN g1 g ON g.query_id = y.query_id AND g.vec_id = y.j WHERE y.query_id = x.query_id AND y.i = x.vec_id), 9) DESC, x.score DESC, x.vec_id) AS o FROM x WHERE NOT EXISTS (SELECT 1 FROM g1 g WHERE g.query_id = x.query_id AND g.vec_id = x.vec_id)) WHERE o = 1), g2 AS (SELECT * FROM g1 UNION ALL SELECT *, 2 FROM p2), p3 AS (SELECT query_id, vec_id FROM (SELECT x.query_id, x.vec_id, row_number() OVER (PARTITION BY x.query_id ORDER BY round(0.5 * x.score - 0.5 * (SELECT max(y.sim) FROM y JOIN g2 g ON g.query_id = y.query_id AND g.vec_id = y.j WHERE y.query_id = x.query_id AND y.i = x.vec_id), 9) DESC, x.score DESC, x.vec_id) AS o FROM x WHERE NOT EXISTS (SELECT 1 FROM g2 g WHERE g.query_id = x.query_id AND g.vec_id = x.vec_id)) WHERE o = 1), g3 AS (SELECT * FROM g2 UNION ALL SELECT *, 3 FROM p3), p4 AS (SELECT query_id, vec_id FROM (SELECT x.query_id, x.vec_id, row_number() OVER (PARTITION BY x.query_id ORDER BY round(0.5 * x.score - 0.5 * (SELECT max(y.sim) FROM y JOIN g3 g ON g.query_id = y.query_id AND g.vec_id = y.j WHERE y.query_id = x.query_id AND y.i = x.vec_id), 9) DESC, x.score DESC, x.vec_id) AS o FROM x WHERE NOT EXISTS (SELECT 1 FROM g3 g WHERE g.query_id = x.query_id AND g.vec_id = x.vec_id)) WHERE o = 1), g4 AS (SELECT * FROM g3 UNION ALL SELECT *, 4 FROM p4), p5 AS (SELECT query_id, vec_id FROM (SELECT x.query_id, x.vec_id, row_number() OVER (PARTITION BY x.query_id ORDER BY round(0.5 * x.score - 0.5 * (SELECT max(y.sim) FROM y JOIN g4 g ON g.query_id = y.query_id AND g.vec_id = y.j WHERE y.query_id = x.query_id AND y.i = x.vec_id), 9) DESC, x.score DESC, x.vec_id) AS o FROM x WHERE NOT EXISTS (SELECT 1 FROM g4 g WHERE g.query_id = x.query_id AND g.vec_id = x.vec_id)) WHERE o = 1), g5 AS (SELECT * FROM g4 UNION ALL SELECT *, 5 FROM p5) SELECT query_id, vec_id, pick::INT AS pick FROM g5""")
def mmr_search(spark, d):
    rows = dense(spark, d, 20).join(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id")
    return R.diverse(rows, 5, 0.5, "query_id", "vec_id", "score", "embedding")


@query("budget_batches", r"""WITH RECURSIVE t AS (SELECT doc_id, doc_id // 512 AS bucket, floor(1.8 * coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')), 0))::BIGINT AS n FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n, doc_id) AS r FROM t), b(bucket, r, doc_id, batch, size) AS (SELECT bucket, r, doc_id, 0, 1 FROM o WHERE r = 1 UNION ALL
SELECT o.bucket, o.r, o.doc_id, CASE WHEN b.size >= 32 OR (b.size + 1) * o.n > 8000 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.size >= 32 OR (b.size + 1) * o.n > 8000 THEN 1 ELSE b.size + 1 END FROM b JOIN o ON o.bucket = b.bucket AND o.r = b.r + 1)
SELECT bucket, doc_id, batch::INT AS batch FROM b""")
def budget_batches(spark, d):
    """Texts in batches for a scorer: 8,000 estimated tokens, 32 items; a bucket is a request of at most 512 documents."""
    docs = table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("n"))
    return R.batches_by_budget(docs, "doc_id", "n", 8000, 32, F.floor(F.col("doc_id") / 512))


@query("dedupe_first", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY created_at, doc_id) AS n FROM documents WHERE source IS NOT NULL) WHERE n = 1")
def dedupe_first(spark, d):
    return R.first_of(table(spark, d, "documents"), "source", [F.asc_nulls_last("created_at"), "doc_id"]).select("doc_id", "source")


# ---- the chunk store ----


@query("store_latest", LATEST + " SELECT id, ingested_at FROM c")
def store_latest(spark, d):
    return chunks(spark, d).select("id", "ingested_at")


@query("namespace_facet", LATEST + " SELECT namespace, count(*) AS chunks FROM c GROUP BY namespace")
def namespace_facet(spark, d):
    return chunks(spark, d).groupBy("namespace").agg(F.count("*").alias("chunks"))


@query("namespace_description", LATEST + """
SELECT namespace, metadata_id, count(*) AS chunks, min(metadata_source) AS source FROM c GROUP BY ROLLUP (namespace, metadata_id) HAVING namespace IS NOT NULL""")
def namespace_description(spark, d):
    """Chunks of each document and, with a null document, of its namespace."""
    return chunks(spark, d).rollup("namespace", "metadata_id").agg(F.count("*").alias("chunks"), F.min("metadata_source").alias("source")).where("namespace is not null")


@query("chunk_listing", LATEST + " SELECT id, metadata_id, metadata_source, lower(metadata_type) AS metadata_type, date_text, text FROM c WHERE namespace = 'gare-nord'")
def chunk_listing(spark, d):
    return chunks(spark, d, "namespace = 'gare-nord'").select("id", "metadata_id", "metadata_source", F.lower("metadata_type").alias("metadata_type"), "date_text", "text")


@query("chunks_by_source", LATEST + " SELECT id FROM c WHERE metadata_source = 'https://guida.serviziolumen.example/faq/export'")
def chunks_by_source(spark, d):
    return chunks(spark, d, "metadata_source = 'https://guida.serviziolumen.example/faq/export'").select("id")


@query("chunks_by_document", LATEST + " SELECT id, page FROM c WHERE metadata_id = 'md-54' ORDER BY page, id")
def chunks_by_document(spark, d):
    return chunks(spark, d, "metadata_id = 'md-54'").select("id", "page").orderBy(F.asc_nulls_last("page"), "id")


@query("tag_filter_and_or_not", LATEST + """
SELECT id FROM c WHERE (list_contains(coalesce(tags, []), 'OCR') OR list_contains(coalesce(tags, []), 'faq')) AND NOT list_contains(coalesce(tags, []), 'it')""")
def tag_filter_and_or_not(spark, d):
    return chunks(spark, d, filters.tag_filter("tags: (OCR | faq) & !it")).select("id")


@query("tag_negation", LATEST + " SELECT id FROM c WHERE NOT list_contains(coalesce(tags, []), 'interno')")
def tag_negation(spark, d):
    return chunks(spark, d, filters.tag_filter("!interno")).select("id")


@query("tag_list", LATEST + " SELECT id FROM c WHERE list_contains(coalesce(tags, []), 'en') AND list_contains(coalesce(tags, []), 'interno')")
def tag_list(spark, d):
    return chunks(spark, d, filters.tag_filter(["en", "interno"])).select("id")


@query("metadata_range_filter", LATEST + """
SELECT id FROM c WHERE page >= 5 AND page <= 20 AND lower(metadata_type) IN ('pdf', 'docx') AND ingested_at >= TIMESTAMP '2024-06-01' """)
def metadata_range_filter(spark, d):
    where = {"page": {"$gte": 5, "$lte": 20}, "metadata_type": {"$in": ["pdf", "docx"]}, "ingested_at": {"$gte": "2024-06-01"}}
    return chunks(spark, d).withColumn("metadata_type", F.lower("metadata_type")).where(filters.metadata_filter(where)).select("id")


@query("metadata_not_equal", LATEST + " SELECT id FROM c WHERE lower(metadata_type) IS DISTINCT FROM 'url' AND namespace IS NOT NULL")
def metadata_not_equal(spark, d):
    c = chunks(spark, d).withColumn("metadata_type", F.lower("metadata_type"))
    return c.where(filters.metadata_filter({"metadata_type": {"$ne": "url"}}) & F.col("namespace").isNotNull()).select("id")


@query("metadata_map_filter", LATEST + " SELECT id FROM c WHERE metadata['lang'] = 'es'")
def metadata_map_filter(spark, d):
    return chunks(spark, d, filters.metadata_filter({"lang": "es"}, lambda f: F.try_element_at("metadata", F.lit(f)))).select("id")


@query("store_defaults", LATEST + " SELECT id, coalesce(namespace, 'default') AS namespace, coalesce(tags, []) AS tags, coalesce(page, 1)::INT AS page FROM c")
def store_defaults(spark, d):
    """What a write fills in: namespace, empty tags, first page."""
    return chunks(spark, d).select("id", F.coalesce("namespace", F.lit("default")).alias("namespace"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("page", F.lit(1)).alias("page"))


@query("nulls_stripped", LATEST + " SELECT id, map_from_entries(list_filter(map_entries(metadata), lambda e: e.value IS NOT NULL AND e.value <> '')) AS metadata FROM c WHERE metadata IS NOT NULL")
def nulls_stripped(spark, d):
    return chunks(spark, d).where("metadata is not null").select("id", F.map_filter("metadata", lambda k, v: v.isNotNull() & (v != "")).alias("metadata"))


@query("upsert_by_document", LATEST + """, fresh AS (SELECT metadata_id FROM c WHERE ingested_at >= TIMESTAMP '2025-06-01' GROUP BY metadata_id)
SELECT c.id, f.metadata_id IS NOT NULL AS replaced FROM c LEFT JOIN fresh f ON c.metadata_id = f.metadata_id WHERE f.metadata_id IS NULL OR c.ingested_at >= TIMESTAMP '2025-06-01'""")
def upsert_by_document(spark, d):
    """Delete, then insert: documents with a chunk of the new batch lose their old chunks."""
    c = chunks(spark, d)
    new = c.where("ingested_at >= timestamp'2025-06-01'")
    kept = c.where("ingested_at < timestamp'2025-06-01' or ingested_at is null").join(new.select("metadata_id").distinct(), "metadata_id", "left_anti")
    return kept.select("id", F.lit(False).alias("replaced")).unionByName(new.select("id", F.col("metadata_id").isNotNull().alias("replaced")))


@query("delete_document", LATEST + " SELECT id FROM c WHERE metadata_id IS DISTINCT FROM 'md-54' AND namespace IS DISTINCT FROM 'gare-sud'")
def delete_document(spark, d):
    return chunks(spark, d).where(~(F.col("metadata_id").eqNullSafe("md-54") | F.col("namespace").eqNullSafe("gare-sud"))).select("id")


@query("date_filter", LATEST + r""", p AS (SELECT id, coalesce(try_strptime(regexp_extract(date_text, '^(\d{4}-\d{2}-\d{2})', 1), '%Y-%m-%d'), try_strptime(date_text, '%d/%m/%Y'))::DATE AS day FROM c)
SELECT id, day FROM p WHERE day BETWEEN DATE '2025-01-01' AND DATE '2025-03-31' OR day IS NULL""")
def date_filter(spark, d):
    """Rows dated in the quarter, and undated ones."""
    c = chunks(spark, d).select("id", T.calendar_date(F.col("date_text")).alias("day"))
    days = F.when(F.col("day").isNull(), F.array().cast("array<date>")).otherwise(F.array("day"))
    return filters.date_or_undated(c.withColumn("days", days), F.col("days"), "2025-01-01", "2025-03-31").select("id", "day")


@query("exact_cache_hit", r"""
WITH q AS (SELECT doc_id, namespace, sha256(lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))) AS k FROM documents WHERE text IS NOT NULL)
SELECT a.doc_id, count(b.doc_id) AS entries FROM q a LEFT JOIN q b ON a.namespace = b.namespace AND a.k = b.k AND a.doc_id <> b.doc_id GROUP BY a.doc_id""")
def exact_cache_hit(spark, d):
    """Other entries of the namespace under the same cache key; counted per key before the join."""
    q = table(spark, d, "documents").where("text is not null").select("doc_id", "namespace", T.cache_key(F.col("text")).alias("k"))
    n = q.groupBy("namespace", "k").agg(F.count("*").alias("n"))
    return q.join(n, ["namespace", "k"], "left").select("doc_id", F.coalesce(F.col("n") - 1, F.lit(0)).alias("entries"))


@query("semantic_cache_best", f"""
WITH s AS (SELECT q.vec_id AS query_id, r.vec_id, {COS} AS raw FROM embeddings q, embeddings r WHERE q.vec_id % {STEP} = 0 AND r.vec_id <> q.vec_id),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, vec_id) = 1)
SELECT query_id, vec_id, round(raw, 5) AS score, raw >= 0.9 AS hit FROM k""")
def semantic_cache_best(spark, d):
    best = dense(spark, d, 2).where("query_id <> vec_id")
    w = Window.partitionBy("query_id").orderBy("rank")
    return best.withColumn("n", F.row_number().over(w)).where("n = 1").select("query_id", "vec_id", "score", (F.col("score") >= 0.9).alias("hit"))


@query("cache_stats", "SELECT namespace, count(*) AS entries, count(DISTINCT doc_type) AS kinds FROM documents WHERE created_at + INTERVAL 24 HOUR > TIMESTAMP '2025-06-01' GROUP BY namespace")
def cache_stats(spark, d):
    """Entries not yet expired at a point in time, by namespace."""
    live = table(spark, d, "documents").where(F.expr("created_at + interval 24 hours > timestamp'2025-06-01'"))
    return live.groupBy("namespace").agg(F.count("*").alias("entries"), F.countDistinct("doc_type").alias("kinds"))


@query("keyword_filter", """
SELECT doc_id FROM documents WHERE contains(lower(coalesce(text, '')), 'polizza') OR contains(lower(coalesce(text, '')), 'insurance') OR contains(lower(coalesce(text, '')), 'seguro')""")
def keyword_filter(spark, d):
    return table(spark, d, "documents").where(filters.any_word([F.col("text")], ["la", "polizza", "insurance", "seguro"])).select("doc_id")


@query("node_text_search", "SELECT DISTINCT id FROM graph_nodes WHERE contains(lower(properties['name']), 'banca') OR contains(lower(coalesce(properties['role'], '')), 'banca')")
def node_text_search(spark, d):
    get = lambda k: F.try_element_at("properties", F.lit(k))
    return table(spark, d, "graph_nodes").where(filters.any_word([get("name"), get("role")], ["banca"])).select("id").distinct()
