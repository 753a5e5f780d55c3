"""Queries over the stored graph and the light graph of chunks and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karst.core.session import cut, table
from karst.functions import text as T
from karst.operators import graph as G
from karst.operators import retrieval as R
from karst.registry import query

from .search import chunks


def nodes(spark, d) -> DataFrame:
    n = table(spark, d, "graph_nodes")
    return n.select("id", F.upper("label").alias("label"), F.try_element_at("properties", F.lit("name")).alias("name"), "properties", "namespace", "source_ids", "import_timestamp").dropDuplicates(["id"])


def edges(spark, d) -> DataFrame:
    r = table(spark, d, "graph_relationships").dropDuplicates(["relationship_id"])
    return r.select(F.col("relationship_id").alias("id"), F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.upper("relationship_type").alias("type"),
                    F.coalesce(F.when(F.isnan("amount"), None).otherwise(F.col("amount")), F.lit(1.0)).alias("weight"), "amount", "date_text", "created_at")


def mentions(spark, d) -> DataFrame:
    """chunk_id, name, type, namespace: entity records of chunks, names normalised."""
    e = table(spark, d, "extracted_entities").dropDuplicates(["entity_id"]).where("source_id is not null and entity_name is not null")
    return e.select(F.col("source_id").alias("chunk_id"), T.collapsed(F.col("entity_name")).alias("name"), F.upper("entity_type").alias("type"), "namespace", "description").where("name <> ''")


NODES = "n AS (SELECT id, upper(any_value(label)) AS label, any_value(properties['name']) AS name, any_value(namespace) AS namespace, any_value(properties) AS properties, any_value(source_ids) AS source_ids FROM graph_nodes GROUP BY id)"
EDGES = """e AS (SELECT relationship_id AS id, any_value(source_id) AS src, any_value(target_id) AS dst, upper(any_value(relationship_type)) AS type,
  coalesce(any_value(CASE WHEN isnan(amount) THEN NULL ELSE amount END), 1.0) AS weight, any_value(CASE WHEN isnan(amount) THEN NULL ELSE amount END) AS amount, any_value(date_text) AS date_text FROM graph_relationships GROUP BY relationship_id)"""
WAYS = "u AS (SELECT src, dst, max(weight) AS weight FROM (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e) WHERE src <> dst GROUP BY ALL)"
WITH = f"WITH RECURSIVE {NODES}, {EDGES}, {WAYS}"
ACC = "translate(x, 'àáâãäåèéêëìíîïòóôõöùúûüñçÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÑÇ', 'aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC')"
MENTIONS = f"""m AS (SELECT chunk_id, name, type FROM (SELECT any_value(source_id) AS chunk_id, upper(any_value(entity_type)) AS type,
  trim(regexp_replace(lower({ACC.replace('x,', 'any_value(entity_name),', 1)}), '[^a-z0-9]+', ' ', 'g')) AS name FROM extracted_entities GROUP BY entity_id) WHERE chunk_id IS NOT NULL AND name <> '')"""


def seeds(spark, d) -> DataFrame:
    """Nodes whose number ends in 50: a stated query set."""
    return nodes(spark, d).where(F.substring("id", 2, 20).cast("long") % 50 == 0).select("id")


SEEDS = "s AS (SELECT id FROM n WHERE CAST(substr(id, 2) AS BIGINT) % 50 = 0)"


@query("graph_totals", f"{WITH} SELECT 'nodes' AS what, label AS kind, count(*) AS n FROM n GROUP BY ALL UNION ALL SELECT 'edges', type, count(*) FROM e GROUP BY ALL")
def graph_totals(spark, d):
    a = nodes(spark, d).groupBy(F.lit("nodes").alias("what"), F.col("label").alias("kind")).agg(F.count("*").alias("n"))
    return a.unionByName(edges(spark, d).groupBy(F.lit("edges").alias("what"), F.col("type").alias("kind")).agg(F.count("*").alias("n")))


@query("nodes_by_property", f"{WITH} SELECT id, name FROM n WHERE label = 'PERSON' AND properties['birth_year'] >= '1980'")
def nodes_by_property(spark, d):
    return nodes(spark, d).where((F.col("label") == "PERSON") & (F.try_element_at("properties", F.lit("birth_year")) >= "1980")).select("id", "name")


@query("nodes_of_chunks", f"{WITH} SELECT id, unnest(source_ids) AS chunk_id FROM n")
def nodes_of_chunks(spark, d):
    return nodes(spark, d).select("id", F.explode("source_ids").alias("chunk_id"))


@query("one_hop", f"{WITH}, {SEEDS} SELECT DISTINCT u.dst AS id FROM u JOIN s ON u.src = s.id")
def one_hop(spark, d):
    return G.neighbours(edges(spark, d), seeds(spark, d))


@query("anti_visited", f"{WITH}, {SEEDS} SELECT DISTINCT u.dst AS id FROM u JOIN s ON u.src = s.id WHERE u.dst NOT IN (SELECT id FROM s)")
def anti_visited(spark, d):
    return G.neighbours(edges(spark, d), seeds(spark, d), seeds(spark, d))


@query("expand_hops", f"""{WITH}, {SEEDS}, w(id, hop) AS (SELECT id, 0 FROM s UNION SELECT u.dst, hop + 1 FROM w JOIN u ON u.src = w.id WHERE hop < 3)
SELECT id, min(hop)::INT AS hop FROM w GROUP BY id""")
def expand_hops(spark, d):
    return G.expand(edges(spark, d), seeds(spark, d), 3)


@query("expand_adaptive", f"""{WITH}, {SEEDS}, h1 AS (SELECT u.dst AS id, max(u.weight) AS w FROM u JOIN s ON u.src = s.id WHERE u.dst NOT IN (SELECT id FROM s) GROUP BY u.dst ORDER BY w DESC, 1 LIMIT 30),
h2 AS (SELECT u.dst AS id, max(u.weight) AS w FROM u JOIN h1 ON u.src = h1.id WHERE u.dst NOT IN (SELECT id FROM s) AND u.dst NOT IN (SELECT id FROM h1) AND (SELECT count(*) FROM h1) >= 3 AND (SELECT count(*) FROM s) + (SELECT count(*) FROM h1) < 200 GROUP BY u.dst ORDER BY w DESC, 1 LIMIT 30)
SELECT DISTINCT id, 0 AS hop FROM s UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2""")
def expand_adaptive(spark, d):
    """Two hops of at most 30 nodes each, heaviest edges first; a hop under 3 new nodes ends it."""
    return G.expand(edges(spark, d), seeds(spark, d), 2, per_hop=30, least_new=3, most=200)


@query("paths_le3", f"""{WITH}, {SEEDS}, t AS (SELECT id FROM n WHERE CAST(substr(id, 2) AS BIGINT) % 50 = 1),
p1 AS (SELECT [s.id, u.dst] AS path, u.dst AS fin FROM s JOIN u ON u.src = s.id),
p2 AS (SELECT list_append(path, u.dst) AS path, u.dst AS fin FROM p1 JOIN u ON u.src = p1.fin WHERE NOT list_contains(path, u.dst)),
p3 AS (SELECT list_append(path, u.dst) AS path, u.dst AS fin FROM p2 JOIN u ON u.src = p2.fin WHERE NOT list_contains(path, u.dst))
SELECT path, len(path)::INT - 1 AS length FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) WHERE fin IN (SELECT id FROM t)""")
def paths_le3(spark, d):
    ends = nodes(spark, d).where(F.substring("id", 2, 20).cast("long") % 50 == 1).select("id")
    return G.paths(edges(spark, d), seeds(spark, d), ends)


@query("node_relationships", f"""{WITH}, {SEEDS} SELECT 'out' AS direction, count(*) AS n FROM e WHERE src IN (SELECT id FROM s)
UNION ALL SELECT 'in', count(*) FROM e WHERE dst IN (SELECT id FROM s) UNION ALL SELECT 'both', count(*) FROM e WHERE src IN (SELECT id FROM s) OR dst IN (SELECT id FROM s)""")
def node_relationships(spark, d):
    e, s = edges(spark, d), seeds(spark, d)
    parts = [G.relationships_of(e, s, x).agg(F.lit(x).alias("direction"), F.count("*").alias("n")) for x in ("out", "in", "both")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("typed_exposure", f"""{WITH} SELECT a.id, a.name, count(*) AS loans, round(sum(e.amount), 2) AS amount FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst
WHERE e.type = 'HAS_LOAN' AND a.id <> b.id GROUP BY a.id, a.name""")
def typed_exposure(spark, d):
    n = nodes(spark, d)
    e = edges(spark, d).where("type = 'HAS_LOAN' and src <> dst")
    e = e.join(n.select(F.col("id").alias("src"), "name"), "src").join(n.select(F.col("id").alias("dst")), "dst", "left_semi")
    return e.groupBy(F.col("src").alias("id"), "name").agg(F.count("*").alias("loans"), F.round(F.sum("amount"), 2).alias("amount"))


@query("guarantors", f"""{WITH} SELECT e.dst AS id, list_sort(list_distinct(list(a.name))) AS names FROM e JOIN n a ON a.id = e.src WHERE e.type = 'GUARANTEES' GROUP BY e.dst""")
def guarantors(spark, d):
    e = edges(spark, d).where("type = 'GUARANTEES'").join(nodes(spark, d).select(F.col("id").alias("src"), "name"), "src")
    return e.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("names"))


@query("two_hop_guarantee", f"""{WITH} SELECT g.src AS guarantor, l.src AS debtor, count(*) AS loans, round(sum(coalesce(l.amount, 0)), 2) AS amount
FROM e g JOIN e l ON g.dst = l.src WHERE g.type = 'GUARANTEES' AND l.type = 'HAS_LOAN' GROUP BY ALL""")
def two_hop_guarantee(spark, d):
    e = edges(spark, d)
    g = e.where("type = 'GUARANTEES'").select(F.col("src").alias("guarantor"), F.col("dst").alias("debtor"))
    loans = e.where("type = 'HAS_LOAN'").select(F.col("src").alias("debtor"), F.coalesce("amount", F.lit(0.0)).alias("amount"))
    return g.join(loans, "debtor").groupBy("guarantor", "debtor").agg(F.count("*").alias("loans"), F.round(F.sum("amount"), 2).alias("amount"))


_DAY = r"coalesce(try_strptime(regexp_extract(date_text, '^(\d{4}-\d{2}-\d{2})', 1), '%Y-%m-%d'), try_strptime(date_text, '%d/%m/%Y'))::DATE"


@query("timeline", f"""{WITH} SELECT e.id, a.name AS source, b.name AS target, e.type, {_DAY} AS day,
row_number() OVER (PARTITION BY a.namespace ORDER BY {_DAY} NULLS LAST, e.id) AS position FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst
WHERE NOT regexp_matches(coalesce(date_text, ''), '^[0-9]+ [a-zA-Zéú]+ [0-9]+$')""")
def timeline(spark, d):
    """Relationships of a namespace in time, undated last, without those of a day with a month name, as the SQL states it; all are in `timeline_whole`."""
    return in_time(nodes(spark, d), edges(spark, d).where(~F.coalesce("date_text", F.lit("")).rlike(r"^[0-9]+ [a-zA-Zéú]+ [0-9]+$")))


def in_time(n: DataFrame, e: DataFrame) -> DataFrame:
    e = e.join(n.select(F.col("id").alias("src"), F.col("name").alias("source"), "namespace"), "src").join(n.select(F.col("id").alias("dst"), F.col("name").alias("target")), "dst")
    e = e.withColumn("day", T.calendar_date(F.col("date_text")))
    w = Window.partitionBy("namespace").orderBy(F.asc_nulls_last("day"), "id")
    return e.select("id", "source", "target", "type", "day", F.row_number().over(w).cast("long").alias("position"))


_NUMBERS = "MAP {" + ", ".join(f"'{m}': {i}" for m, i in sorted({m: i for names in (T.MONTHS_IT, T.MONTHS_EN, T.MONTHS_ES) for i, m in enumerate(names, 1)}.items())) + "}"
_ANY_DAY = rf"""coalesce({_DAY}, try_strptime(regexp_extract(lower(trim(date_text)), '^\d{{1,2}} \p{{L}}+ (\d{{4}})$', 1) || '-' ||
{_NUMBERS}[regexp_extract(lower(trim(date_text)), '^\d{{1,2}} (\p{{L}}+) \d{{4}}$', 1)] || '-' || regexp_extract(trim(date_text), '^\d{{1,2}}'), '%Y-%m-%d')::DATE)"""


@query("timeline_whole", f"""{WITH} SELECT e.id, a.name AS source, b.name AS target, e.type, {_ANY_DAY} AS day,
row_number() OVER (PARTITION BY a.namespace ORDER BY {_ANY_DAY} NULLS LAST, e.id) AS position FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst""")
def timeline_whole(spark, d):
    """All relationships of a namespace in time, days with a month name at their place, undated last."""
    return in_time(nodes(spark, d), edges(spark, d))


@query("entity_info", f"""{WITH}, d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id)
SELECT n.id, n.name, coalesce(d.degree, 0) AS degree FROM n LEFT JOIN d USING (id)""")
def entity_info(spark, d):
    ends = edges(spark, d).select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes(spark, d).join(ends, "id", "left").select("id", "name", F.coalesce("degree", F.lit(0)).alias("degree"))


@query("network_limited", f"""{WITH}, k AS (SELECT id FROM n QUALIFY row_number() OVER (PARTITION BY label ORDER BY id) <= 100)
SELECT DISTINCT src, dst, type FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)""")
def network_limited(spark, d):
    """A picture of the graph: 100 nodes a label is the feature."""
    return G.network(nodes(spark, d), edges(spark, d), 100)[1].select("src", "dst", "type")


@query("resolve_endpoints", f"""{WITH}, k AS (SELECT lower(trim(name)) AS key, min(id) AS id, namespace FROM n GROUP BY ALL)
SELECT e.id, a.id AS source, b.id AS target FROM e JOIN n x ON x.id = e.src JOIN n y ON y.id = e.dst
JOIN k a ON a.key = lower(trim(x.name)) AND a.namespace = x.namespace JOIN k b ON b.key = lower(trim(y.name)) AND b.namespace = y.namespace""")
def resolve_endpoints(spark, d):
    """Ends by normalised name within the namespace; ends without a node are skipped."""
    n = nodes(spark, d).select("id", "namespace", F.lower(F.trim("name")).alias("key"))
    first = n.groupBy("key", "namespace").agg(F.min("id").alias("to"))
    named = n.join(first, ["key", "namespace"]).select("id", "to")
    e = edges(spark, d).select("id", "src", "dst")
    e = e.join(named.select(F.col("id").alias("src"), F.col("to").alias("source")), "src").join(named.select(F.col("id").alias("dst"), F.col("to").alias("target")), "dst")
    return e.select("id", "source", "target")


_CANON = "c AS (SELECT id, first_value(id) OVER (PARTITION BY namespace, lower(trim(name)) ORDER BY id) AS root FROM n)"


@query("duplicate_remap", f"""{WITH}, {_CANON}, r AS (SELECT e.id, coalesce(a.root, src) AS src, coalesce(b.root, dst) AS dst, type FROM e LEFT JOIN c a ON a.id = src LEFT JOIN c b ON b.id = dst)
SELECT src, dst, type, min(id) AS id FROM r WHERE src <> dst GROUP BY ALL""")
def duplicate_remap(spark, d):
    n = nodes(spark, d)
    roots = n.groupBy("namespace", F.lower(F.trim("name")).alias("k")).agg(F.min("id").alias("root"))
    canon = n.withColumn("k", F.lower(F.trim("name"))).join(roots, ["namespace", "k"]).select("id", "root")
    return G.remap(edges(spark, d), canon).select("src", "dst", "type", "id")


@query("node_merge", f"""{WITH}, {_CANON} SELECT c.root AS id, max_by(n.name, length(n.name) * 1000000 - CAST(substr(n.id, 2) AS BIGINT)) AS name, count(*) AS merged,
len(list_distinct(flatten(list(coalesce(n.source_ids, []))))) AS sources FROM n JOIN c USING (id) GROUP BY c.root""")
def node_merge(spark, d):
    """Nodes of one name: longest spelling, union of the source chunks."""
    n = nodes(spark, d).withColumn("k", F.lower(F.trim("name")))
    g = n.groupBy("namespace", "k").agg(
        F.min("id").alias("id"), F.max_by("name", F.length("name") * F.lit(1000000).cast("long") - F.substring("id", 2, 20).cast("long")).alias("name"), F.count("*").alias("merged"),
    )
    sources = n.select("namespace", "k", F.explode("source_ids").alias("s")).groupBy("namespace", "k").agg(F.count_distinct("s").alias("sources"))
    return g.join(sources, ["namespace", "k"], "left").select("id", "name", "merged", F.coalesce("sources", F.lit(0)).alias("sources"))


@query("edge_dedupe", f"{WITH} SELECT src, dst, type, min(id) AS id FROM e WHERE src <> dst GROUP BY ALL")
def edge_dedupe(spark, d):
    return edges(spark, d).where("src <> dst").groupBy("src", "dst", "type").agg(F.min("id").alias("id"))


@query("dup_components", f"{WITH}, r(id, root) AS (SELECT id, id FROM n UNION SELECT u.dst, r.root FROM r JOIN u ON u.src = r.id) SELECT id, min(root) AS root FROM r WHERE id IN (SELECT id FROM n) GROUP BY id")
def dup_components(spark, d):
    return G.components(nodes(spark, d), edges(spark, d).join(nodes(spark, d).select(F.col("id").alias("src")), "src", "left_semi").join(nodes(spark, d).select(F.col("id").alias("dst")), "dst", "left_semi"))


@query("doc_freq", f"WITH {MENTIONS} SELECT name, type, count(DISTINCT chunk_id) AS chunks FROM m GROUP BY ALL")
def doc_freq(spark, d):
    return mentions(spark, d).groupBy("name", "type").agg(F.count_distinct("chunk_id").alias("chunks"))


@query("term_freq", f"WITH {MENTIONS} SELECT chunk_id, name, round(count(*) / sum(count(*)) OVER (PARTITION BY chunk_id), 6) AS tf FROM m GROUP BY chunk_id, name")
def term_freq(spark, d):
    return G.term_frequencies(mentions(spark, d)).withColumn("tf", F.round("tf", 6))


@query("cooccur_npmi", f"""WITH {MENTIONS}, t AS (SELECT DISTINCT chunk_id, name FROM m), n AS (SELECT count(DISTINCT chunk_id) AS n FROM t), s AS (SELECT name, count(*) AS c FROM t GROUP BY name),
p AS (SELECT a.name AS src, b.name AS dst, count(*) AS count FROM t a JOIN t b ON a.chunk_id = b.chunk_id AND a.name < b.name GROUP BY ALL)
SELECT src, dst, count, round(ln((count / n.n) / ((x.c / n.n) * (y.c / n.n))) / -ln(count / n.n + 1e-12), 6) AS npmi FROM p JOIN s x ON x.name = src JOIN s y ON y.name = dst, n
WHERE ln((count / n.n) / ((x.c / n.n) * (y.c / n.n))) / -ln(count / n.n + 1e-12) >= 0.1""")
def cooccur_npmi(spark, d):
    """All pairs that meet at all: the tables' chunks hold few entities."""
    return G.cooccurrence(mentions(spark, d), least=1).withColumn("npmi", F.round("npmi", 6))


@query("entity_merge", f"""WITH {MENTIONS}, k AS (SELECT name, type, count(*) AS n FROM m WHERE type IS NOT NULL GROUP BY ALL),
b AS (SELECT name, type FROM k QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, type) = 1)
SELECT m.name, b.type, count(*) AS records, count(DISTINCT chunk_id) AS chunks FROM m LEFT JOIN b USING (name) GROUP BY ALL""")
def entity_merge(spark, d):
    """One row a name: most common type (ties to the first), records, source chunks."""
    m = mentions(spark, d)
    kinds = G.most_common(F.col("type"), ["name"], m).withColumnRenamed("value", "type")
    return m.drop("type").join(kinds, "name", "left").groupBy("name", "type").agg(F.count("*").alias("records"), F.count_distinct("chunk_id").alias("chunks"))


@query("relationship_merge", f"{WITH} SELECT src, dst, round(sum(weight), 2) AS weight, list_sort(list_distinct(list(type))) AS types, count(*) AS n FROM e GROUP BY src, dst")
def relationship_merge(spark, d):
    return edges(spark, d).groupBy("src", "dst").agg(F.round(F.sum("weight"), 2).alias("weight"), F.array_sort(F.collect_set("type")).alias("types"), F.count("*").alias("n"))


@query("near_dup_pairs", """SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.vec_id % 50 = 0 AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.35""")
def near_dup_pairs(spark, d):
    """Vectors nearer than 0.35 to a stated query set (every id divisible by 50) with a greater id, as the SQL states it; all pairs are in `near_dup_all_pairs`."""
    e = table(spark, d, "embeddings")
    near = R.near_pairs(e, 0.35, queries=e.where("vec_id % 50 = 0"))
    return near.select("a", "b", F.round("score", 5).alias("similarity"))


@query("near_dup_all_pairs", """SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.35""")
def near_dup_all_pairs(spark, d):
    """The near-duplicate join: every vector against every other."""
    near = R.near_pairs(table(spark, d, "embeddings"), 0.35)
    return near.select("a", "b", F.round("score", 5).alias("similarity"))


def _ranks(start: str, nodes_: str, ways: str) -> str:
    """SQL of PageRank in a hundred rounds: w (shares of edges), v (nodes with restart), pr (i, id, score)."""
    return f"""w AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM {ways} WHERE weight IS NOT NULL), v0 AS (SELECT DISTINCT id FROM {nodes_}),
v AS (SELECT id, {start} AS p, id NOT IN (SELECT src FROM w) AS loose FROM v0), pr(i, id, score) AS (SELECT 0, id, p::DOUBLE FROM v UNION ALL
SELECT any_value(x.i) + 1, x.id, any_value(v.p) * (0.15 + 0.85 * any_value(x.hang)) + 0.85 * sum(x.told) FROM (SELECT pr.i, pr.id, 0.0::DOUBLE AS told, sum(CASE WHEN v.loose THEN pr.score ELSE 0 END) OVER () AS hang FROM pr JOIN v USING (id) WHERE pr.i < 100
UNION ALL SELECT pr.i, w.dst, pr.score * w.share, NULL FROM pr JOIN w ON w.src = pr.id WHERE pr.i < 100) x JOIN v ON v.id = x.id GROUP BY x.id)"""


_LIGHT = f"""{MENTIONS}, tm AS (SELECT DISTINCT chunk_id, name FROM m), tn AS (SELECT count(DISTINCT chunk_id) AS n FROM tm), ts AS (SELECT name, count(*) AS c FROM tm GROUP BY name),
tp AS (SELECT a.name AS src, b.name AS dst, count(*) AS count FROM tm a JOIN tm b ON a.chunk_id = b.chunk_id AND a.name < b.name GROUP BY ALL),
co AS (SELECT src, dst, ln((count / tn.n) / ((x.c / tn.n) * (y.c / tn.n))) / -ln(count / tn.n + 1e-12) AS npmi FROM tp JOIN ts x ON x.name = src JOIN ts y ON y.name = dst, tn),
he AS (SELECT 'c:' || chunk_id AS src, 'e:' || name AS dst, count(*) / sum(count(*)) OVER (PARTITION BY chunk_id) AS weight FROM m GROUP BY chunk_id, name),
lu AS (SELECT src, dst, max(weight) AS weight FROM (SELECT * FROM he UNION ALL SELECT dst, src, weight FROM he UNION ALL SELECT 'e:' || src, 'e:' || dst, npmi FROM co WHERE npmi >= 0.1 UNION ALL SELECT 'e:' || dst, 'e:' || src, npmi FROM co WHERE npmi >= 0.1) WHERE src <> dst GROUP BY src, dst),
ln_ AS (SELECT src AS id FROM he UNION SELECT dst FROM he), sd AS (SELECT DISTINCT 'e:' || name AS id FROM m WHERE regexp_matches(name, 'banca|credito')),
{_ranks("CASE WHEN id IN (SELECT id FROM sd) THEN 1.0::DOUBLE / (SELECT count(*) FROM sd) ELSE 0 END", "ln_", "lu")}"""


def light(spark, d):
    nodes_, edges_ = G.light_graph(mentions(spark, d), least=1)
    return cut(nodes_), cut(edges_)


def entity_seeds(spark, d):
    """Entities of firms of credit: what the keywords of a question find."""
    return mentions(spark, d).where(F.col("name").rlike("banca|credito")).select(F.concat(F.lit("e:"), "name").alias("id")).distinct()


@query("light_graph", f"WITH {MENTIONS} SELECT 'entities' AS what, count(DISTINCT name) AS n FROM m UNION ALL SELECT 'chunks', count(DISTINCT chunk_id) FROM m UNION ALL SELECT 'HAS_ENTITY', count(DISTINCT (chunk_id, name)) FROM m")
def light_graph(spark, d):
    n, e = light(spark, d)
    kinds = n.groupBy(F.when(F.col("id").startswith("e:"), "entities").otherwise("chunks").alias("what")).agg(F.count("*").alias("n"))
    return kinds.unionByName(e.where("type = 'HAS_ENTITY'").groupBy(F.col("type").alias("what")).agg(F.count("*").alias("n")))


@query("ppr_topk", f"WITH RECURSIVE {_LIGHT} SELECT substr(id, 3) AS chunk_id, round(score, 7) AS score FROM pr WHERE i = 100 AND id LIKE 'c:%' ORDER BY round(pr.score, 9) DESC, id LIMIT 50")
def ppr_topk(spark, d):
    """The fifty chunks nearest to the seed entities by personalised PageRank."""
    n, e = light(spark, d)
    scores = G.pagerank(n, e, entity_seeds(spark, d)).where(F.col("id").startswith("c:"))
    top = scores.orderBy(F.desc(F.round("score", 9)), "id").limit(50)
    return top.select(F.substring("id", 3, 64).alias("chunk_id"), F.round("score", 7).alias("score"))


@query("graph_pagerank", f"{WITH}, {_ranks('1.0::DOUBLE / (SELECT count(*) FROM n)', 'n', 'u')} SELECT id, round(score, 7) AS score FROM pr WHERE i = 100")
def graph_pagerank(spark, d):
    return G.pagerank(nodes(spark, d), edges(spark, d)).withColumn("score", F.round("score", 7))


@query("graph_communities")
def graph_communities(spark, d):
    n = nodes(spark, d).select("id")
    inside = edges(spark, d).join(n.withColumnRenamed("id", "src"), "src", "left_semi").join(n.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return G.communities(n, inside)


@query("community_sizes")
def community_sizes(spark, d):
    """Communities of three nodes or more and their size."""
    n = nodes(spark, d).select("id")
    parts = G.communities(n, edges(spark, d), least_size=3)
    return parts.groupBy("community").agg(F.count("*").alias("size"))


def inner(spark, d):
    n = nodes(spark, d).select("id")
    return n, edges(spark, d).join(n.withColumnRenamed("id", "src"), "src", "left_semi").join(n.withColumnRenamed("id", "dst"), "dst", "left_semi")


@query("louvain_quality", f"{WITH} SELECT count(*) AS nodes, true AS better, true AS joined FROM n")
def louvain_quality(spark, d):
    """Communities by modularity: every node is in one, quality is at least that of label propagation,
    and no community reaches over two components."""
    n, e = inner(spark, d)
    parts = cut(G.louvain(n, e))
    q = [G.modularity(e, p).first()[0] for p in (parts, G.communities(n, e))]
    split = parts.join(G.components(n, e), "id").groupBy("community").agg(F.count_distinct("root").alias("r")).where("r > 1")
    return parts.agg(F.count("*").alias("nodes"), F.lit(q[0] >= q[1] - 1e-9).alias("better"), F.lit(split.isEmpty()).alias("joined"))


@query("community_levels", f"{WITH} SELECT level, (SELECT count(*) FROM n) AS nodes FROM range(3) r(level)")
def community_levels(spark, d):
    """Three partitions, from coarse to fine; each holds every node."""
    n, e = inner(spark, d)
    return G.community_levels(n, e, rounds=4).groupBy(F.col("level").cast("long").alias("level")).agg(F.count_distinct("id").alias("nodes"))


@query("community_boost")
def community_boost(spark, d):
    """PageRank of chunks, raised for chunks that share communities with the twenty best entities."""
    n, e = light(spark, d)
    scores = cut(G.pagerank(n, e, entity_seeds(spark, d)))
    parts = cut(G.communities(n, e, rounds=4))
    best = scores.where(F.col("id").startswith("e:")).orderBy(F.desc("score"), "id").limit(20)
    own = e.where("type = 'HAS_ENTITY'").join(parts.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "community").distinct()
    out = G.boosted(scores.where(F.col("id").startswith("c:")), own, parts.join(best.select("id"), "id", "left_semi"))
    return out.select("id", F.round("score", 7).alias("score"))


@query("community_chunks")
def community_chunks(spark, d):
    """Up to thirty chunks of each community for its summary, most mentions first."""
    n, e = light(spark, d)
    parts = G.communities(n, e, rounds=4, least_size=3)
    own = e.where("type = 'HAS_ENTITY'").join(parts.withColumnRenamed("id", "dst"), "dst").groupBy("community", F.substring("src", 3, 64).alias("chunk_id")).agg(F.count("*").alias("mentions"))
    w = Window.partitionBy("community").orderBy(F.desc("mentions"), "chunk_id")
    return own.withColumn("n", F.row_number().over(w)).where("n <= 30").select("community", "chunk_id", "mentions")


@query("hybrid_graph_search", rf"""WITH RECURSIVE {_LIGHT}, c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) = 1), k AS (SELECT * FROM c WHERE text IS NOT NULL),
q(term, weight) AS (VALUES ('credito', 1.0), ('mutuo', 1.0), ('banca', 1.0), ('loan', 1.0), ('polizza', 0.5)), t AS (SELECT id, term, 1 + ln(count(*)) AS tw FROM (SELECT id, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+')) AS term FROM k) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
s AS (SELECT id, sum(t.tw * q.weight) AS sparse FROM t JOIN q USING (term) GROUP BY id), a AS (SELECT id, row_number() OVER (ORDER BY round(sparse, 9) DESC, id) AS rank FROM s QUALIFY rank <= 100),
b AS (SELECT substr(pr.id, 3) AS id, row_number() OVER (ORDER BY round(pr.score, 9) DESC, substr(pr.id, 3)) AS rank FROM pr JOIN k ON k.id = substr(pr.id, 3) WHERE pr.i = 100 AND pr.id LIKE 'c:%' QUALIFY rank <= 100),
f AS (SELECT id, sum(1.0 / (60 + rank)) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id), z AS (SELECT f.id, k.namespace, f.rrf, {_ANY_DAY} AS day FROM f JOIN k USING (id))
SELECT id, namespace, day, round(rrf, 7) AS rrf FROM z WHERE day IS NULL OR day >= DATE '2024-01-01' ORDER BY round(z.rrf, 9) DESC, id LIMIT 20""")
def hybrid_graph_search(spark, d):
    """Flagship: keyword ranking of chunks and PageRank from the entities that the question names,
    fused by reciprocal ranks, within a date range or undated, the best twenty."""
    c = cut(chunks(spark, d).where("text is not null").select("id", "text", "namespace", "date_text"))
    words = R.sparse_score(c, "id", "text", {"credito": 1.0, "mutuo": 1.0, "banca": 1.0, "loan": 1.0, "polizza": 0.5})
    first = words.orderBy(F.desc(F.round("sparse", 9)), "id").limit(100)
    first = first.select("id", F.row_number().over(Window.orderBy(F.desc(F.round("sparse", 9)), "id")).alias("rank"))
    n, e = light(spark, d)
    near = G.pagerank(n, e, entity_seeds(spark, d)).where(F.col("id").startswith("c:")).select(F.substring("id", 3, 64).alias("id"), "score")
    near = near.join(c.select("id"), "id", "left_semi").orderBy(F.desc(F.round("score", 9)), "id").limit(100)
    near = near.select("id", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "id")).alias("rank"))
    fused = R.rrf([first, near], "id").join(c, "id").withColumn("day", T.calendar_date(F.col("date_text")))
    kept = fused.where("day is null or day >= date'2024-01-01'")
    return kept.orderBy(F.desc(F.round("rrf", 9)), "id").limit(20).select("id", "namespace", "day", F.round("rrf", 7).alias("rrf"))
