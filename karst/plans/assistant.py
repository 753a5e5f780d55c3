"""Queries of routing, context fusion, evidence and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from karst.core.session import table
from karst.functions import text as T
from karst.operators import assist as A
from karst.operators import retrieval as R
from karst.registry import query

from .search import LATEST, chunks, dense


_KIND = """CASE WHEN regexp_matches(lower(text), 'tell me about|what is|what are|explain|describe|overview|introduction|summarize|give me|show me|parlami di|cos''è|spiega|descrivi') THEN 'exploratory'
 WHEN regexp_matches(lower(text), 'error|code|bug|issue|fix|problem|how to|tutorial|step by step|configure|install|setup|syntax|command|function|errore|codice|problema|come fare|configurare') THEN 'technical'
 WHEN regexp_matches(lower(text), 'relation|relationship|connect|connection|influence|impact|affect|correlate|between|vs|versus|compare|comparison|difference|similar|relazione|connessione|influenza|impatto|confronto|how does|why does|what causes') THEN 'relational' ELSE 'exploratory' END"""


@query("query_weights", f"""SELECT kind, CASE kind WHEN 'technical' THEN 0.5 WHEN 'relational' THEN 1.0 ELSE 1.5 END AS vector, CASE kind WHEN 'technical' THEN 1.8 WHEN 'relational' THEN 1.0 ELSE 0.5 END AS keyword,
CASE kind WHEN 'technical' THEN 0.5 WHEN 'relational' THEN 2.5 ELSE 1.0 END AS graph, CASE kind WHEN 'technical' THEN 0.3 WHEN 'relational' THEN 1.5 ELSE 1.8 END AS community, count(*) AS n FROM (SELECT {_KIND} AS kind FROM documents) GROUP BY ALL""")
def query_weights(spark, d):
    """Search weights by kind of question, over all documents as questions."""
    q = table(spark, d, "documents").select(T.query_kind(F.col("text")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
    return q.withColumn("w", A.search_weights(F.col("kind"))).select("kind", "w.vector", "w.keyword", "w.graph", "w.community", "n")


_STARTS = [
    ("timeline", "cronologia|sequenza|eventi|storia|timeline|when|quando|completa|tutti|intero|full|complete"), ("exposure", "esposizione|debito|importo|quanto|how much|exposure|amount"),
    ("guarantees", "garanzie|collateral|security|guarantee|ipoteca|pegno"), ("payments", "pagamenti|versamenti|payments|transactions|rata|rate"), ("contacts", "contatti|comunicazioni|lettere|email|pec|contacts"),
    ("legal_actions", "legale|precetto|ingiunzione|tribunale|legal|court"), ("debtor_info", "debitore|anagrafica|chi è|who is|debtor|informazioni"),
    ("relationship", "relazione|collegamento|legame|relationship|connected|related|garanti|guarantors|fideiussori|garante"), ("vespro", "vespri|vespro|siciliani|ferdinando|aragona|1282|rivolta"),
]
_HITS = ", ".join("{'hits': " + " + ".join(f"regexp_matches(lower(text), '\\b{w}')::INT" for w in words.split("|")) + f", 'first': {-i}, 'intent': '{name}'}}" for i, (name, words) in enumerate(_STARTS))


@query("intent_scores", f"""WITH h AS (SELECT doc_id, list_max([{_HITS}]) AS b FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN b.hits > 0 THEN b.intent ELSE 'general' END AS intent, round(CASE WHEN b.hits > 0 THEN least(b.hits / 3, 1.0) ELSE 0.5 END, 6) AS confidence FROM h""")
def intent_scores(spark, d):
    return A.intent_scores(table(spark, d, "documents"), "doc_id", "text").withColumn("confidence", F.round("confidence", 6))


@query("context_fusion", """WITH s AS (SELECT q.vec_id AS query_id, r.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS c FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0), t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, vec_id) <= 20),
w AS (SELECT doc_id, term, 1 + ln(count(*)) AS weight FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM documents) WHERE term IN ('polizza', 'insurance', 'seguro') GROUP BY ALL), e AS (SELECT any_value(source_id) AS src FROM graph_relationships GROUP BY relationship_id),
u(kind, key, raw) AS (SELECT 'vectors', CAST(vec_id AS VARCHAR), max(round(c, 5)) FROM t GROUP BY vec_id UNION ALL SELECT 'keywords', CAST(doc_id AS VARCHAR), sum(weight) FROM w GROUP BY doc_id UNION ALL SELECT 'graph', src, count(*) FROM e GROUP BY src),
f AS (SELECT kind, key, CASE WHEN max(raw) OVER (PARTITION BY kind) = min(raw) OVER (PARTITION BY kind) THEN 1.0 ELSE (raw - min(raw) OVER (PARTITION BY kind)) / (max(raw) OVER (PARTITION BY kind) - min(raw) OVER (PARTITION BY kind)) END AS score FROM u)
SELECT kind, key, round(score, 6) AS score FROM f ORDER BY f.score DESC, kind, key LIMIT 40""")
def context_fusion(spark, d):
    """Forty pieces of evidence from vectors, keywords and the graph on one scale."""
    near = dense(spark, d, 20).groupBy("vec_id").agg(F.max("score").alias("score")).select(F.col("vec_id").alias("key"), "score")
    words = R.sparse_score(table(spark, d, "documents"), "doc_id", "text", {"polizza": 1.0, "insurance": 1.0, "seguro": 1.0}).select(F.col("doc_id").alias("key"), F.col("sparse").alias("score"))
    hubs = table(spark, d, "graph_relationships").dropDuplicates(["relationship_id"]).groupBy(F.col("source_id").alias("key")).agg(F.count("*").cast("double").alias("score"))
    return A.fused_context({"vectors": near, "keywords": words, "graph": hubs}, "score", "key", 40).withColumn("score", F.round("score", 6))


@query("evidence_attribution", LATEST + """, q AS (SELECT metadata_id, min(id) AS quote_id FROM c WHERE length(text) > 200 AND metadata_id IS NOT NULL GROUP BY metadata_id),
k AS (SELECT q.quote_id, c.metadata_id, CASE WHEN ascii(right(q.quote_id, 1)) % 2 = 0 THEN substr(c.text, 50, 60) ELSE '§§§§§§§§§§' END AS quote FROM q JOIN c ON c.id = q.quote_id),
h AS (SELECT k.quote_id, min(CASE WHEN contains(c.text, k.quote) THEN c.id END) AS held, min(c.id) AS first FROM k JOIN c ON c.metadata_id = k.metadata_id GROUP BY k.quote_id)
SELECT quote_id, coalesce(held, first) AS chunk_id, CASE WHEN held IS NULL THEN 'first' ELSE 'text' END AS how FROM h""")
def evidence_attribution(spark, d):
    """For each document a passage of one of its chunks, found again, or a passage that none holds, which falls to the first chunk."""
    c = chunks(spark, d)
    pick = c.where("length(text) > 200 and metadata_id is not null").groupBy("metadata_id").agg(F.min("id").alias("quote_id"))
    held = F.ascii(F.right("quote_id", F.lit(1))) % 2 == 0
    quotes = pick.join(c.select(F.col("id").alias("quote_id"), "text"), "quote_id").select("quote_id", F.col("metadata_id").alias("doc_id"), F.when(held, F.substring("text", 50, 60)).otherwise("§" * 10).alias("quote"))
    return A.evidence_sources(quotes, c.select(F.col("metadata_id").alias("doc_id"), F.col("id").alias("chunk_id"), "text"))


@query("summary_tree", LATEST + """, k AS (SELECT metadata_id, count(*) AS n FROM c WHERE metadata_id IS NOT NULL AND text IS NOT NULL GROUP BY metadata_id), t AS (SELECT max(CASE WHEN n <= 1 THEN 0 ELSE ceil(ln(n) / ln(5) - 1e-9) END)::INT AS top FROM k)
SELECT level::INT AS level, sum(greatest(ceil(n / pow(5, level)), 1))::BIGINT AS nodes, CASE WHEN level = any_value(top) THEN sum(greatest(ceil(n / pow(5, level)), 1)) ELSE 0 END::BIGINT AS roots FROM k, t, range(0, 30) r(level) WHERE level <= top GROUP BY level""")
def summary_tree(spark, d):
    """A tree over the chunks of each document; a summary is the heads of its parts."""
    from pyspark.sql import Window

    c = chunks(spark, d).where("metadata_id is not null and text is not null")
    leaves = c.select(F.col("metadata_id").alias("doc_id"), (F.row_number().over(Window.partitionBy("metadata_id").orderBy(F.asc_nulls_last("page"), "id")) - 1).alias("position"), "text")
    tree = A.summary_tree(leaves, 5, lambda parts: F.array_join(F.transform(parts, lambda t: F.substring(t, 1, 80)), " "))
    return tree.groupBy("level").agg(F.count("*").alias("nodes"), F.count_if(F.col("parent_id").isNull()).alias("roots"))


@query("soft_clusters")
def soft_clusters(spark, d):
    return A.soft_clusters(table(spark, d, "embeddings"), "vec_id", "embedding", 5).withColumn("probability", F.round("probability", 4))
