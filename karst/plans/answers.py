"""Queries of hybrid search, ingestion, text search, reports, trees of nodes and composed answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from karst.core.session import scratch, table
from karst.functions import vectors as V
from karst.operators import assist as A
from karst.operators import graph as G
from karst.operators import hybrid as H
from karst.operators import reports as P
from karst.operators import retrieval as R
from karst.operators.chunking import char_windows
from karst.operators.store import ChunkStore
from karst.registry import query

from .graphs import SEEDS, WITH, edges, nodes, seeds
from .search import CHUNKS, chunks

QUESTION = "Quali garanzie e polizze coprono il contratto di mutuo?"
TERMS = {"polizza": 2.0, "contratto": 1.0, "mutuo": 1.5, "garanzia": 1.0}


def _letters(x: str) -> str:
    return "[" + ", ".join(f"(length(lower({x})) - length(replace(lower({x}), '{ch}', '')))::DOUBLE" for ch in V.LETTERS) + "]"


_Q = "[" + ", ".join(f"{x}::DOUBLE" for x in V.letters_of(QUESTION)) + "]"
_SIDES = f"""{CHUNKS}, k AS (SELECT id, text FROM c WHERE text IS NOT NULL),
v AS (SELECT id, list_cosine_similarity({_letters('text')}, {_Q}) AS dense FROM k WHERE regexp_matches(lower(text), '[a-z]')),
q(term, weight) AS (VALUES ('polizza', 2.0), ('contratto', 1.0), ('mutuo', 1.5), ('garanzia', 1.0)),
t AS (SELECT id, term, 1 + ln(count(*)) AS w FROM (SELECT id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM k) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
s AS (SELECT id, sum(t.w * q.weight) AS sparse FROM t JOIN q USING (term) GROUP BY id)"""


def passages(spark, d):
    return chunks(spark, d).where("text is not null").select("id", "text")


@query("hybrid_rrf", f"""WITH {_SIDES},
a AS (SELECT id, row_number() OVER (ORDER BY round(dense, 9) DESC, id) AS rank FROM v QUALIFY rank <= 20), b AS (SELECT id, row_number() OVER (ORDER BY round(sparse, 9) DESC, id) AS rank FROM s QUALIFY rank <= 20),
f AS (SELECT id, sum(1.0 / (60 + rank)) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id)
SELECT id, round(rrf, 8) AS rrf, row_number() OVER (ORDER BY round(rrf, 9) DESC, id) AS rank FROM f QUALIFY rank <= 10""")
def hybrid_rrf(spark, d):
    """Dense and sparse ranking of the same chunks for one question, fused on reciprocal ranks."""
    out = H.hybrid_rrf(passages(spark, d), "id", "text", V.letter_vector(F.col("text")), V.letters_of(QUESTION), TERMS)
    return out.select("id", F.round("rrf", 8).alias("rrf"), F.col("rank").cast("long").alias("rank"))


@query("hybrid_weighted", f"""WITH {_SIDES}, f AS (SELECT id, round(0.6 * coalesce(dense, 0) + 0.4 * coalesce(sparse, 0), 9) AS score FROM v FULL JOIN s USING (id))
SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= 10""")
def hybrid_weighted(spark, d):
    out = H.hybrid_weighted(passages(spark, d), "id", "text", V.letter_vector(F.col("text")), V.letters_of(QUESTION), TERMS, 0.6)
    return out.select("id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("add_item", f"""WITH w AS (SELECT doc_id, coalesce(any_value(namespace), 'default') AS namespace, any_value(text) AS text FROM documents WHERE length(trim(text)) > 0 GROUP BY doc_id),
p AS (SELECT doc_id, namespace, pos, substr(text, pos::INT + 1, 1000) AS part FROM (SELECT doc_id, namespace, text, unnest(range(0, greatest(length(text) - 100, 1), 900)) AS pos FROM w))
SELECT doc_id || '#' || (pos // 900) AS id, namespace, length(part) AS chars, round(sqrt(list_dot_product({_letters('part')}, {_letters('part')})), 3) AS norm FROM p WHERE length(trim(part)) > 0""")
def add_item(spark, d):
    """Every document cut, embedded and stored; what the store then holds."""
    store = ChunkStore(spark, scratch(spark, "chunks"))
    docs = table(spark, d, "documents").dropDuplicates(["doc_id"])
    H.add_items(docs, "doc_id", "text", lambda t: char_windows(t, 1000, 100), V.letter_vector, store, namespace=F.coalesce("namespace", F.lit("default")))
    return store.get().select("id", "namespace", F.length("text").alias("chars"), F.round(V.norm(F.col("embedding")), 3).alias("norm"))


@query("filter_expression", f"WITH {CHUNKS} SELECT id FROM c WHERE (page >= 3 AND page < 12) AND (metadata_type = 'pdf' OR namespace IN ('gare-nord', 'gare-sud')) AND NOT (metadata_id = 'md-54')")
def filter_expression(spark, d):
    """Nested conditions as the text of one SQL expression."""
    where = {"page": {"$gte": 3, "$lt": 12}, "$or": [{"metadata_type": "pdf"}, {"namespace": {"$in": ["gare-nord", "gare-sud"]}}], "$not": {"metadata_id": "md-54"}}
    return chunks(spark, d, F.expr(H.expression_of(where))).select("id")


_NODE_HITS = r"""(SELECT id, len(list_intersect(regexp_split_to_array(lower(coalesce(properties['name'], '')), '[^\p{L}\p{N}]+') || regexp_split_to_array(lower(coalesce(properties['role'], '')), '[^\p{L}\p{N}]+'), ['banca', 'credito', 'srl', 'garante'])) AS hits FROM n)"""


@query("fulltext_nodes", f"""{WITH} SELECT id, hits::INT AS hits, row_number() OVER (ORDER BY hits DESC, id) AS rank FROM {_NODE_HITS} WHERE hits > 0 QUALIFY rank <= 50""")
def fulltext_nodes(spark, d):
    get = lambda k: F.try_element_at("properties", F.lit(k))
    out = H.text_hits(nodes(spark, d), "id", [get("name"), get("role")], ["banca", "credito", "srl", "garante"], 50)
    return out.withColumn("rank", F.col("rank").cast("long"))


_EDGE_HITS = r"""(SELECT id, len(list_intersect(regexp_split_to_array(lower(coalesce(type, '')), '[^\p{L}\p{N}]+') || regexp_split_to_array(lower(coalesce(date_text, '')), '[^\p{L}\p{N}]+'), ['has', 'loan', '2024', 'marzo'])) AS hits FROM (SELECT id, replace(type, '_', ' ') AS type, date_text FROM e))"""


@query("fulltext_relationships", f"""{WITH} SELECT id, hits::INT AS hits, row_number() OVER (ORDER BY hits DESC, id) AS rank FROM {_EDGE_HITS} WHERE hits > 0 QUALIFY rank <= 50""")
def fulltext_relationships(spark, d):
    out = H.text_hits(edges(spark, d), "id", [F.replace(F.col("type"), F.lit("_"), F.lit(" ")), F.col("date_text")], ["has", "loan", "2024", "marzo"], 50)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("keyword_graph_answer", f"""{WITH}, a AS (SELECT 'node' AS kind, id, hits::INT AS hits FROM {_NODE_HITS} WHERE hits > 0 ORDER BY hits DESC, id LIMIT 10), b AS (SELECT 'relationship' AS kind, id, hits::INT AS hits FROM {_EDGE_HITS} WHERE hits > 0 ORDER BY hits DESC, id LIMIT 10)
SELECT * FROM a UNION ALL SELECT * FROM b""")
def keyword_graph_answer(spark, d):
    """What of the graph matches a question by words: ten nodes and ten relationships."""
    a = fulltext_nodes(spark, d).where("rank <= 10").select(F.lit("node").alias("kind"), "id", "hits")
    return a.unionByName(fulltext_relationships(spark, d).where("rank <= 10").select(F.lit("relationship").alias("kind"), "id", "hits"))


@query("node_relevance", f"{WITH} SELECT id, coalesce(list_sum(list_transform(map_values(properties), lambda v: contains(lower(coalesce(v, '')), 'banca')::INT + contains(lower(coalesce(v, '')), 'ca')::INT)), 0)::INT AS hits FROM n")
def node_relevance(spark, d):
    return nodes(spark, d).select("id", F.coalesce(H.relevance(F.col("properties"), ["banca", "ca"]), F.lit(0)).alias("hits"))


@query("node_page", f"{WITH} SELECT id, name FROM n WHERE id > (SELECT id FROM n ORDER BY id LIMIT 1 OFFSET 99) ORDER BY id LIMIT 100")
def node_page(spark, d):
    """The second page of a hundred nodes, by the last key of the first."""
    n = nodes(spark, d).select("id", "name")
    last = H.page_after(n, "id", 100).agg(F.max("id")).first()[0]
    return H.page_after(n, "id", 100, last)


@query("seed_union", f"""{WITH}, {SEEDS}, a AS (SELECT id, row_number() OVER (ORDER BY id) AS position FROM s), b AS (SELECT id, row_number() OVER (ORDER BY id DESC) AS position FROM (SELECT DISTINCT u.dst AS id FROM u JOIN s ON u.src = s.id)),
f AS (SELECT id, min(list * 1000000000 + position) AS p FROM (SELECT id, 0 AS list, position FROM a UNION ALL SELECT id, 1, position FROM b) GROUP BY id)
SELECT id, (row_number() OVER (ORDER BY p))::INT AS position FROM f""")
def seed_union(spark, d):
    """Seeds of two searches, each once where it came first."""
    s = seeds(spark, d)
    a = s.withColumn("position", F.row_number().over(Window.orderBy("id")))
    b = G.neighbours(edges(spark, d), s).withColumn("position", F.row_number().over(Window.orderBy(F.desc("id"))))
    return H.first_seeds([a, b], "id")


# ---- reports of communities: two levels by place, for queries that SQL can state ----

_MEMBERS = "m AS (SELECT id, namespace AS community, 0 AS level FROM n WHERE namespace IS NOT NULL UNION ALL SELECT id, namespace || '/' || label, 1 FROM n WHERE namespace IS NOT NULL AND label IS NOT NULL)"
_REPORTS = f"""{_MEMBERS}, i AS (SELECT e.id, e.src, e.dst, e.type, e.weight, a.community, a.level FROM e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst AND a.community = b.community AND a.level = b.level),
g AS (SELECT community, level, id, count(*) AS degree FROM (SELECT community, level, src AS id FROM i UNION ALL SELECT community, level, dst FROM i) GROUP BY ALL),
h AS (SELECT m.community, m.level, count(*) AS size, first(n.name ORDER BY coalesce(g.degree, 0) DESC, m.id) AS title FROM m LEFT JOIN g USING (community, level, id) LEFT JOIN n ON n.id = m.id GROUP BY ALL),
l AS (SELECT i.community, i.level, i.weight, i.id, concat_ws(' ', x.name, i.type, y.name) AS line FROM i JOIN n x ON x.id = i.src JOIN n y ON y.id = i.dst),
z AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY community, level ORDER BY weight DESC, id ROWS UNBOUNDED PRECEDING) AS run FROM l),
y AS (SELECT community, level, string_agg(line, chr(10) ORDER BY weight DESC, id) AS summary FROM z WHERE run <= 18000 GROUP BY ALL), k AS (SELECT community, level, count(*) AS edges FROM i GROUP BY ALL),
r AS (SELECT community, level, title, size, coalesce(edges, 0) AS edges, ln(1 + coalesce(edges, 0)) AS rating, coalesce(summary, '') AS summary FROM h LEFT JOIN k USING (community, level) LEFT JOIN y USING (community, level))"""


def members(spark, d):
    n = nodes(spark, d).where("namespace is not null")
    a = n.select("id", F.col("namespace").alias("community"), F.lit(0).alias("level"))
    return a.unionByName(n.where("label is not null").select("id", F.concat_ws("/", "namespace", "label").alias("community"), F.lit(1).alias("level")))


def reports(spark, d):
    return P.reports(members(spark, d), nodes(spark, d), edges(spark, d))


@query("community_reports", f"{WITH}, {_REPORTS} SELECT community, level, title, size, edges, round(rating, 6) AS rating, summary FROM r")
def community_reports(spark, d):
    return reports(spark, d).withColumn("rating", F.round("rating", 6))


@query("report_upsert", f"""{WITH}, {_REPORTS} SELECT community, level, CASE WHEN level = 1 THEN 'new' ELSE title END AS title FROM r""")
def report_upsert(spark, d):
    """Reports of level 1 are written again; those of level 0 stay."""
    r = reports(spark, d).select("community", "level", "title")
    return P.upsert(r, r.where("level = 1").withColumn("title", F.lit("new")))


@query("report_keywords", f"""{WITH}, {_REPORTS} SELECT community, level, round(rating, 6) AS rating FROM r WHERE title ILIKE '%banca%' OR summary ILIKE '%banca%' OR title ILIKE '%credito%' OR summary ILIKE '%credito%' ORDER BY r.rating DESC, level, community LIMIT 10""")
def report_keywords(spark, d):
    """Best rating first, then the lowest level: the words over three letters of a question."""
    return P.keyword_search(reports(spark, d), "la Banca di Credito", 10).select("community", "level", F.round("rating", 6).alias("rating"))


@query("report_prefix", f"""{WITH}, {_REPORTS} SELECT community, level FROM r WHERE title ILIKE '%guarantees%' OR summary ILIKE '%guarantees%' ORDER BY level DESC, community LIMIT 5""")
def report_prefix(spark, d):
    return P.prefix_search(reports(spark, d), "GUARANTEES").select("community", "level")


@query("report_search", f"""{WITH}, {_REPORTS}, f AS (SELECT community, level, round(list_cosine_similarity({_letters('summary')}, {_Q}), 9) AS score FROM r WHERE level = 0 AND regexp_matches(lower(summary), '[a-z]'))
SELECT community, level, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, community) AS rank FROM f QUALIFY rank <= 5""")
def report_search(spark, d):
    """Reports nearest to a question."""
    r = reports(spark, d).where("level = 0").withColumn("v", V.letter_vector(F.col("summary"))).where("v is not null")
    out = H.top(r, V.cosine(F.col("v"), F.array(*map(F.lit, V.letters_of(QUESTION)))), 5, "community")
    return out.select("community", "level", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("global_answer", f"""{WITH}, {_REPORTS}, a AS (SELECT * FROM r WHERE level = 1 ORDER BY round(rating, 9) DESC, community LIMIT 20), b AS (SELECT *, row_number() OVER (ORDER BY size DESC, community) AS rank FROM a QUALIFY rank <= 5)
SELECT string_agg(left(summary, 60), chr(10) ORDER BY rank) AS answer, count(*)::INT AS reports FROM b""")
def global_answer(spark, d):
    """Twenty reports, five after a second look, an answer from each, joined."""
    return P.global_answer(reports(spark, d).where("level = 1"), F.col("rating"), F.col("size").cast("double"), lambda s: F.substring(s, 1, 60))


@query("report_questions", f"""{WITH}, {_REPORTS}, w AS (SELECT community, level, title, summary, array_to_string(list_filter(regexp_split_to_array(summary, '\\s+'), lambda x: x <> '')[1:10], ' ') AS words FROM r)
SELECT community, level, (CASE WHEN length(title) > 0 THEN ['What is ' || trim(title) || '?', 'Tell me about ' || trim(title) || '.', 'Can you explain ' || trim(title) || '?'] ELSE [] END || CASE WHEN length(summary) > 0 THEN ['What does this community focus on: ' || words || '?'] ELSE [] END
 || ['What are the main topics covered in this community?'])[1:5] AS questions FROM w""")
def report_questions(spark, d):
    return reports(spark, d).select("community", "level", P.questions_of_report(F.col("title"), F.col("summary")).alias("questions"))


@query("report_index_text", f"""{WITH}, {_REPORTS} SELECT community, level, 'Questions this report answers:' || chr(10) || '1. Chi?' || chr(10) || '2. Come?' || chr(10) || CASE WHEN length(title) > 0 THEN chr(10) || 'Title: ' || title ELSE '' END || CASE WHEN length(summary) > 0 THEN chr(10) || 'Summary: ' || summary ELSE '' END AS text FROM r""")
def report_index_text(spark, d):
    return reports(spark, d).select("community", "level", P.report_text(F.col("title"), F.col("summary"), F.array(F.lit("Chi?"), F.lit("Come?"))).alias("text"))


@query("multimodal_context", f"""{WITH}, {_REPORTS}, {_SIDES.replace("k AS (SELECT id, text FROM c", "kk AS (SELECT id, text FROM c").replace("FROM k ", "FROM kk ").replace("FROM k)", "FROM kk)")},
a AS (SELECT 'report' AS kind, community AS key, rating AS score FROM r WHERE level = 0), b AS (SELECT 'chunk', id, sparse FROM s), g AS (SELECT 'node', src, count(*)::DOUBLE FROM e GROUP BY src),
uu(kind, key, score) AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM g),
f AS (SELECT kind, key, CASE WHEN max(score) OVER (PARTITION BY kind) = min(score) OVER (PARTITION BY kind) THEN 1.0 ELSE (score - min(score) OVER (PARTITION BY kind)) / (max(score) OVER (PARTITION BY kind) - min(score) OVER (PARTITION BY kind)) END AS score FROM uu)
SELECT kind, key, round(score, 6) AS score FROM f ORDER BY round(f.score, 9) DESC, kind, key LIMIT 30""".replace("g AS (SELECT community, level, id", "gg AS (SELECT community, level, id").replace("LEFT JOIN g USING", "LEFT JOIN gg USING").replace("coalesce(g.degree", "coalesce(gg.degree"))
def multimodal_context(spark, d):
    """Thirty pieces of evidence of three kinds on one scale: reports, chunks and nodes."""
    a = reports(spark, d).where("level = 0").select(F.col("community").alias("key"), F.col("rating").alias("score"))
    b = R.sparse_score(passages(spark, d), "id", "text", TERMS).select(F.col("id").alias("key"), F.col("sparse").alias("score"))
    g = edges(spark, d).groupBy(F.col("src").alias("key")).agg(F.count("*").cast("double").alias("score"))
    out = A.fused_context({"report": a, "chunk": b, "node": g}, "score", "key", 30)
    return out.withColumn("score", F.round("score", 6))


@query("graph_answer", f"""{WITH}, {_SIDES}, f AS (SELECT id, round(0.5 * coalesce(dense, 0) + 0.5 * coalesce(sparse, 0), 9) AS score FROM v FULL JOIN s USING (id)), best AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= 200),
mm AS (SELECT id, unnest(source_ids) AS chunk FROM n), sd AS (SELECT DISTINCT id FROM (SELECT mm.id, row_number() OVER (PARTITION BY chunk ORDER BY mm.id) AS p FROM mm JOIN best ON best.id = mm.chunk) WHERE p <= 5),
h1 AS (SELECT u.dst AS id, max(u.weight) AS w FROM u JOIN sd ON u.src = sd.id WHERE u.dst NOT IN (SELECT id FROM sd) GROUP BY u.dst ORDER BY w DESC, 1 LIMIT 25),
h2 AS (SELECT u.dst AS id, max(u.weight) AS w FROM u JOIN h1 ON u.src = h1.id WHERE u.dst NOT IN (SELECT id FROM sd) AND u.dst NOT IN (SELECT id FROM h1) GROUP BY u.dst ORDER BY w DESC, 1 LIMIT 25)
SELECT id, 0 AS hop FROM sd UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2""")
def graph_answer(spark, d):
    """A relational question: equal weights of vector and keyword, graph weight 2.5, so two hops of 25 nodes."""
    a = H.graph_answer(QUESTION, passages(spark, d), "id", "text", V.letter_vector(F.col("text")), V.letters_of(QUESTION), TERMS, nodes(spark, d).withColumn("source_ids", F.coalesce("source_ids", F.array().cast("array<string>"))), edges(spark, d), "relational", k=200)
    return a["nodes"]


_ASKED = ["Mostrami le garanzie di Mario Rossi per la pratica: AB-12", "quali mutui ha Banca Intesa?", "Tutti i pagamenti", None, "contratto X9 e tribunale di Roma Nord Est"]


@query("question_parameters", """SELECT * FROM (VALUES (0, 'Mario Rossi', 'AB-12', false, NULL), (1, 'Banca Intesa', NULL, false, 'HAS_LOAN'), (2, 'Tutti', NULL, true, 'HAS_PAYMENT'), (3, NULL, NULL, NULL, NULL), (4, 'Roma Nord Est', 'X9', false, 'HAS_LEGAL_ACTION')) t(id, name, loan_id, is_full, relationship)""")
def question_parameters(spark, d):
    q = spark.createDataFrame(list(enumerate(_ASKED)), "id int, text string")
    return q.select("id", H.question_parameters(F.col("text")).alias("p")).select("id", "p.*")


@query("intent_template", f"{WITH}, {SEEDS} SELECT id, type FROM e WHERE (src IN (SELECT id FROM s) OR dst IN (SELECT id FROM s)) AND type IN ('GUARANTEES', 'SECURED_BY')")
def intent_template(spark, d):
    """Question -> intent -> parameters -> seeds -> the intent's path."""
    intent = A.intent_scores(spark.createDataFrame([(1, "quali ipoteca e pegno come collateral?")], "id int, text string"), "id", "text").first()["intent"]
    return H.by_template(intent, None, edges(spark, d), seeds(spark, d)).select("id", "type")


@query("typed_paths", f"""{WITH} SELECT type, count(*) AS n, round(sum(coalesce(amount, 0)), 2) AS amount, count(DISTINCT src) AS sources FROM e WHERE type IN ('HAS_LOAN', 'GUARANTEES', 'SECURED_BY', 'HAS_PAYMENT', 'RECEIVED', 'HAS_LEGAL_ACTION') GROUP BY type""")
def typed_paths(spark, d):
    """Exposure, guarantees, payments, contacts and legal actions: the typed relationships, by type."""
    kinds = sorted({t for types in H.TEMPLATES.values() for t in types})
    return edges(spark, d).where(F.col("type").isin(kinds)).groupBy("type").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("amount", F.lit(0.0))), 2).alias("amount"), F.count_distinct("src").alias("sources"))


@query("keyword_template", f"""{WITH}, s AS (SELECT id FROM n WHERE contains(lower(name), 'banca')), w(id, hop) AS (SELECT id, 0 FROM s UNION SELECT u.dst, hop + 1 FROM w JOIN u ON u.src = w.id WHERE hop < 2)
SELECT id, min(hop)::INT AS hop FROM w GROUP BY id""")
def keyword_template(spark, d):
    """From the nodes that a keyword names, two hops along any relationship."""
    start = nodes(spark, d).where(F.contains(F.lower("name"), F.lit("banca"))).select("id")
    return G.expand(edges(spark, d), start, 2)


@query("relative_dates", """SELECT * FROM (VALUES (0, DATE '2026-04-14', DATE '2026-04-14'), (1, DATE '2026-04-15', DATE '2026-04-15'), (2, DATE '2026-04-06', DATE '2026-04-12'), (3, DATE '2026-04-01', DATE '2026-04-15'), (4, DATE '2026-02-01', DATE '2026-02-28'), (5, NULL, NULL), (6, NULL, NULL)) t(id, date_from, date_to)""")
def relative_dates(spark, d):
    """Search parameters of questions asked on a Wednesday."""
    asked = ["Cosa hanno deliberato ieri?", "atti di OGGI", "la settimana scorsa", "riassunto di questo mese", "cosa è successo a febbraio", "chi garantisce il mutuo?", None]
    q = spark.createDataFrame(list(enumerate(asked)), "id int, text string")
    return q.select("id", H.relative_range(F.col("text"), F.lit("2026-04-15").cast("date")).alias("r")).select("id", "r.*")


@query("digest_question", f"""WITH {CHUNKS}, p AS (SELECT id, namespace, ingested_at::DATE AS day, text FROM c WHERE text IS NOT NULL), b AS (SELECT * FROM p WHERE day BETWEEN DATE '2025-02-01' AND DATE '2025-02-28')
SELECT namespace, count(*) AS chunks, min(day) AS first, max(day) AS last FROM b GROUP BY namespace""")
def digest_question(spark, d):
    """A temporal question goes to the chunks of its dates, a semantic one to similarity: here February of 2025."""
    from karst.functions import text as T

    q = spark.createDataFrame([("riassunto di cosa è successo a febbraio",)], "text string")
    asked = q.select(T.temporal_route(F.col("text")).alias("r"), H.relative_range(F.col("text"), F.lit("2025-06-01").cast("date")).alias("d")).first()
    c = chunks(spark, d).where("text is not null").withColumn("day", F.to_date("ingested_at"))
    if asked["r"]["route"] == "semantic":
        return H.top(c, F.lit(1.0), 10, "id").groupBy("namespace").agg(F.count("*").alias("chunks"), F.min("day").alias("first"), F.max("day").alias("last"))
    return c.where(F.col("day").between(asked["d"]["date_from"], asked["d"]["date_to"])).groupBy("namespace").agg(F.count("*").alias("chunks"), F.min("day").alias("first"), F.max("day").alias("last"))


# ---- a tree of three levels: regions, nations, customers ----

_TREE = """t AS (SELECT r_name AS tree, 'r' || r_regionkey AS node_id, NULL AS parent_id, 2 AS level, 0.0 AS score FROM region
UNION ALL SELECT r_name, 'n' || n_nationkey, 'r' || n_regionkey, 1, n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT r_name, 'c' || c_custkey, 'n' || c_nationkey, 0, c_acctbal FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""


def tree(spark, d):
    r, n, c = (table(spark, d, x) for x in ("region", "nation", "customer"))
    node = lambda mark, key: F.concat(F.lit(mark), F.col(key).cast("string"))
    a = r.select(F.col("r_name").alias("tree"), node("r", "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(2).alias("level"), F.lit(0.0).alias("score"))
    nr = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("tree"), "n_nationkey", "n_regionkey")
    b = nr.select("tree", node("n", "n_nationkey").alias("node_id"), node("r", "n_regionkey").alias("parent_id"), F.lit(1).alias("level"), F.col("n_nationkey").cast("double").alias("score"))
    e = c.join(nr, c.c_nationkey == nr.n_nationkey).select("tree", node("c", "c_custkey").alias("node_id"), node("n", "c_nationkey").alias("parent_id"), F.lit(0).alias("level"), F.col("c_acctbal").alias("score"))
    return a.unionByName(b).unionByName(e)


@query("tree_levels", f"WITH {_TREE} SELECT level, count(*) AS nodes, count(*) FILTER (WHERE parent_id IS NULL) AS roots FROM t GROUP BY level")
def tree_levels(spark, d):
    return tree(spark, d).groupBy("level").agg(F.count("*").alias("nodes"), F.count_if(F.col("parent_id").isNull()).alias("roots"))


@query("tree_traversal", f"""WITH {_TREE}, n1 AS (SELECT tree, first(node_id ORDER BY score DESC, node_id) AS node_id FROM t WHERE level = 1 GROUP BY tree), n0 AS (SELECT t.tree, first(t.node_id ORDER BY t.score DESC, t.node_id) AS node_id FROM t JOIN n1 ON t.parent_id = n1.node_id AND t.tree = n1.tree GROUP BY t.tree)
SELECT tree, 0 AS step, node_id FROM t WHERE level = 2 UNION ALL SELECT tree, 1, node_id FROM n1 UNION ALL SELECT tree, 2, node_id FROM n0""")
def tree_traversal(spark, d):
    """From each root down to its best child, and to that one's."""
    return P.traverse(tree(spark, d), F.col("score"), 2)


@query("tree_errors", f"""WITH {_TREE}, b AS (SELECT node_id, CASE WHEN hash_ = 0 THEN 'nowhere' WHEN hash_ = 1 AND level = 0 THEN 'r0' ELSE parent_id END AS parent_id, level FROM (SELECT *, CASE WHEN level = 0 THEN CAST(substr(node_id, 2) AS BIGINT) % 10 ELSE 9 END AS hash_ FROM t))
SELECT b.node_id, CASE WHEN p.level IS NULL THEN 'no parent' ELSE 'wrong level' END AS error FROM b LEFT JOIN t p ON p.node_id = b.parent_id WHERE b.parent_id IS NOT NULL AND (p.level IS NULL OR p.level <> b.level + 1)""")
def tree_errors(spark, d):
    """A tree with planted faults: every tenth customer without a parent, every tenth under a region."""
    n = F.when(F.col("level") == 0, F.substring("node_id", 2, 20).cast("long") % 10).otherwise(9)
    bad = tree(spark, d).withColumn("parent_id", F.when(n == 0, "nowhere").when((n == 1) & (F.col("level") == 0), "r0").otherwise(F.col("parent_id")))
    return A.tree_errors(bad)


@query("tree_crud", f"WITH {_TREE} SELECT tree, count(*) AS nodes FROM t WHERE tree <> 'ASIA' GROUP BY tree")
def tree_crud(spark, d):
    """Trees kept by namespace: written, one deleted, the rest listed."""
    from karst.operators.store import TreeStore

    store = TreeStore(spark, scratch(spark, "trees"))
    store.put(tree(spark, d).select(F.col("tree").alias("namespace"), "node_id", "parent_id", "level", F.col("node_id").alias("text")))
    store.delete("ASIA")
    return store.list().select(F.col("namespace").alias("tree"), "nodes")


# ---- graphs: snapshots, windows, increments ----


@query("snapshot_bridge", """SELECT * FROM (VALUES ('1', 'Banca ABC', 'COMPANY', ['c1', 'c2']), ('2', 'Mario', 'PERSON', []), ('3', 'Boh', 'ENTITY', [])) t(id, name, label, source_ids)""")
def snapshot_bridge(spark, d):
    rows = [("1", "Banca ABC", "company", ["Firm"], '["c1", "c2"]'), ("2", "Mario", " ", ["Person", "Debtor"], None), ("3", "Boh", None, [], "broken")]
    e = spark.createDataFrame(rows, "node_id string, name string, entity_type string, labels array<string>, source_ids string").withColumns({"description": F.lit(""), "namespace": F.lit("n")})
    return P.bridge(e).select("id", "name", "label", "source_ids")


@query("extraction_windows", f"""WITH {CHUNKS}, r AS (SELECT id, namespace, row_number() OVER (PARTITION BY namespace ORDER BY id) - 1 AS position FROM c WHERE text IS NOT NULL AND namespace IS NOT NULL AND page IS DISTINCT FROM 1)
SELECT namespace, position // 20 AS "window", count(*) AS chunks, min(id) AS first FROM r GROUP BY ALL""")
def extraction_windows(spark, d):
    """Windows of twenty chunks that a run still has to read: first pages are done."""
    c = chunks(spark, d).where("text is not null and namespace is not null")
    return P.windows_of(c, "id", "namespace", 20, c.where("page = 1")).groupBy("namespace", "window").agg(F.count("*").alias("chunks"), F.min("id").alias("first"))


@query("incremental_graph", f"""{WITH}, o AS (SELECT * FROM e WHERE right(id, 1) <> '7'), a AS (SELECT src, dst, type, min(id) AS id FROM e WHERE right(id, 1) = '7' AND src <> dst GROUP BY ALL), k AS (SELECT a.* FROM a WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.src = a.src AND o.dst = a.dst AND o.type = a.type))
SELECT 'edges' AS what, (SELECT count(*) FROM o) + (SELECT count(*) FROM k) AS n UNION ALL SELECT 'communities', count(DISTINCT namespace) FROM n WHERE id IN (SELECT src FROM k UNION SELECT dst FROM k) AND namespace IS NOT NULL""")
def incremental_graph(spark, d):
    """Relationships of a new document are added to the graph; the communities they touch are to be reported again."""
    e = edges(spark, d)
    old, new = e.where("right(id, 1) <> '7'"), e.where("right(id, 1) = '7'")
    m = members(spark, d).where("level = 0")
    _, all_edges, touched = P.increment(nodes(spark, d), old, nodes(spark, d), new, m)
    return all_edges.agg(F.lit("edges").alias("what"), F.count("*").alias("n")).unionByName(touched.agg(F.lit("communities").alias("what"), F.count("*").alias("n")))
