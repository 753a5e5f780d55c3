"""Queries of laid-out documents, chunking by kind, merges, workflows, and streams of messages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from karst.core.session import scratch, table
from karst.functions import text as T
from karst.operators import chunking as C
from karst.operators import graph as G
from karst.operators import layout as L
from karst.operators import retrieval as R
from karst.plans import plugins
from karst.registry import query
from karst.streaming import streams as S

from .documents import bodies, docs
from .graphs import WITH, edges, nodes
from .search import CHUNKS, chunks


def elements(spark, d):
    e = table(spark, d, "text_elements").dropDuplicates(["element_id"]).where("text is not null")
    return L.reading_order(e.select("doc_id", "element_id", "page", "seq", "element_type", "text"))


def head():
    return F.lower("element_type") == "section_header"


def level():
    """Depth of the number a title begins with."""
    return F.size(F.split(F.regexp_extract("text", r"^\s*(\d+(?:\.\d+)*)", 1), r"\."))


_EL = "x AS (SELECT element_id, any_value(doc_id) AS doc_id, any_value(page) AS page, any_value(seq) AS seq, any_value(lower(element_type)) AS kind, any_value(text) AS text FROM text_elements GROUP BY element_id HAVING any_value(text) IS NOT NULL), el AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page NULLS FIRST, seq NULLS FIRST, element_id) AS place FROM x)"
_SEC = rf"""{_EL}, hd AS (SELECT doc_id, element_id AS section_id, text AS title, least(greatest(len(string_split(regexp_extract(text, '^\s*(\d+(?:\.\d+)*)', 1), '.')), 1), 6)::INT AS level, place FROM el WHERE kind = 'section_header'),
sec AS (SELECT h.*, p.section_id AS parent_id FROM hd h LEFT JOIN LATERAL (SELECT section_id FROM hd q WHERE q.doc_id = h.doc_id AND q.place < h.place AND q.level < h.level ORDER BY q.place DESC LIMIT 1) p ON true),
es AS (SELECT *, last_value(CASE WHEN kind = 'section_header' THEN element_id END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS section_id FROM el)"""


@query("reading_order", f"WITH {_EL} SELECT element_id, place::INT AS place FROM el")
def reading_order(spark, d):
    return elements(spark, d).select("element_id", "place")


@query("section_tree", f"WITH {_SEC} SELECT section_id, level, parent_id FROM sec")
def section_tree(spark, d):
    """Each section with the last one before it of a lower level as its parent."""
    return L.section_tree(elements(spark, d), head(), level()).select("section_id", "level", "parent_id")


@query("section_outline", f"WITH RECURSIVE {_SEC}, dp(section_id, depth) AS (SELECT section_id, 0 FROM sec WHERE parent_id IS NULL UNION ALL SELECT sec.section_id, depth + 1 FROM sec JOIN dp ON sec.parent_id = dp.section_id) SELECT doc_id, depth::INT AS depth, count(*) AS sections FROM dp JOIN sec USING (section_id) GROUP BY ALL")
def section_outline(spark, d):
    return L.section_tree(elements(spark, d), head(), level()).groupBy("doc_id", "depth").agg(F.count("*").alias("sections"))


@query("section_elements", f"WITH {_SEC} SELECT element_id, section_id FROM es")
def section_elements(spark, d):
    return L.in_section(elements(spark, d), head()).select("element_id", "section_id")


@query("section_graph", rf"""WITH {_SEC}, nm AS (SELECT DISTINCT doc_id, element_id AS src, unnest(regexp_extract_all(text || ' vedi sezione ' || (place % 4 + 1), '(?i)\b(?:section|sezione|sección)\s+(\d+(?:\.\d+)*)', 1)) AS number FROM es),
tt AS (SELECT doc_id, section_id AS dst, regexp_extract(title, '^\s*(\d+(?:\.\d+)*)', 1) AS number FROM sec),
g AS (SELECT section_id AS src, parent_id AS dst, 'PART_OF' AS type FROM sec WHERE parent_id IS NOT NULL UNION SELECT element_id, section_id, 'IN_SECTION' FROM es WHERE section_id IS NOT NULL AND section_id <> element_id
UNION SELECT src, dst, 'REFERS_TO' FROM nm JOIN tt USING (doc_id, number) WHERE number <> '') SELECT * FROM g""")
def section_graph(spark, d):
    """Structure as edges; a reference to a section of the document is set behind every text."""
    e = L.in_section(elements(spark, d), head())
    named = e.withColumn("text", F.concat("text", F.lit(" vedi sezione "), (F.col("place") % 4 + 1).cast("string")))
    return L.section_graph(named, L.section_tree(e, head(), level()))


@query("section_members", f"WITH {_SEC}, m AS (SELECT section_id, list_sort(list(element_id)) AS elements FROM es WHERE section_id IS NOT NULL AND element_id <> section_id GROUP BY section_id) SELECT sec.section_id, p.title AS parent, m.elements FROM sec LEFT JOIN sec p ON p.section_id = sec.parent_id LEFT JOIN m ON m.section_id = sec.section_id")
def section_members(spark, d):
    """Sections with their parent's title and the elements in them."""
    e = L.in_section(elements(spark, d), head())
    s = L.section_tree(e, head(), level())
    m = e.where("section_id is not null and element_id <> section_id").groupBy("section_id").agg(F.array_sort(F.collect_list("element_id")).alias("elements"))  # the elements of one section
    p = s.select(F.col("section_id").alias("parent_id"), F.col("title").alias("parent"))
    return s.join(p, "parent_id", "left").join(m, "section_id", "left").select("section_id", "parent", "elements")


@query("context_chunks", f"""WITH {_SEC}, t AS (SELECT doc_id, coalesce(section_id, '') AS section_id, sum(length(trim(text))) AS chars, count(*) AS n FROM es WHERE length(trim(text)) > 0 GROUP BY ALL) SELECT section_id, doc_id, chars::BIGINT AS chars, n AS elements, true AS within FROM t""")
def context_chunks(spark, d):
    """Chunks of at most 512 estimated tokens within a section: together they hold its texts, each once."""
    c = L.context_chunks(L.in_section(elements(spark, d), head()))
    chars = F.length("text") - 2 * (F.size("elements") - 1)
    within = (F.size("elements") == 1) | (F.length("text") / 4 <= 512 + F.size("elements"))
    return c.groupBy("section_id", "doc_id").agg(F.sum(chars).alias("chars"), F.sum(F.size("elements")).alias("elements"), F.bool_and(within).alias("within"))


_FORMAT = r"""CASE WHEN (len(list_filter(h, lambda x: regexp_matches(x, '^\s*\|?\s*:?-{3,}'))) > 0 AND len(list_filter(h, lambda x: len(string_split(x, '|')) >= 3)) >= 2) OR len(list_filter(h, lambda x: regexp_matches(x, '^\s*(#{1,6}\s|[-*]\s|\d+\.\s|```)'))) > 0 THEN 'markdown'
 WHEN len(list_filter(h, lambda x: len(string_split(x, '|')) >= 3)) >= 2 THEN 'tabular' ELSE 'plain' END"""


@query("routed_chunks", f"WITH h AS (SELECT doc_id, text, string_split(text, chr(10))[1:10] AS h FROM documents WHERE length(trim(text, E' \\n\\r\\t')) > 0) SELECT {_FORMAT} AS format, count(DISTINCT doc_id) AS documents FROM h GROUP BY 1")
def routed_chunks(spark, d):
    """Every document cut by the rule of its format: documents of each format that give chunks."""
    c = L.routed(docs(spark, d).where(F.length(F.regexp_replace("text", r"^[ \n\r\t]+|[ \n\r\t]+$", "")) > 0), "doc_id", "text")
    return c.groupBy("format").agg(F.count_distinct("doc_id").alias("documents"))


@query("table_routing", f"WITH {_EL} SELECT CASE WHEN kind = 'table' THEN 'table' ELSE 'text' END AS route, count(*) AS n, sum(length(text))::BIGINT AS chars FROM el GROUP BY 1")
def table_routing(spark, d):
    """Tables go to the table chunker, all else to the text one; elements without a kind are text."""
    route = F.when(F.lower("element_type") == "table", "table").otherwise("text")
    return elements(spark, d).groupBy(route.alias("route")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("split_invariants", r"SELECT doc_id, true AS inside, true AS within, true AS words FROM documents WHERE length(regexp_replace(text, '\s', '', 'g')) > 0")
def split_invariants(spark, d):
    """Plain chunks of each document: parts of the text, at most 1,000 characters, and no word lost."""
    t = docs(spark, d).where(F.length(F.regexp_replace("text", r"\s", "")) > 0)
    c = C.exploded(t, "doc_id", "text", lambda x: C.recursive_split(x, 1000, 400))
    per = c.join(t.select("doc_id", "text"), "doc_id")
    bare = lambda x: F.split(F.trim(F.regexp_replace(x, r"\s+", " ")), " ")
    long = F.filter(bare(F.col("text")), lambda w: F.length(w) <= 300)
    out = per.groupBy("doc_id").agg(F.bool_and(F.contains("text", F.col("chunk"))).alias("inside"), F.bool_and(F.length("chunk") <= 1000).alias("within"), F.array_join(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk")))["chunk"], " ").alias("all"), F.any_value("text").alias("text"))
    return out.select("doc_id", "inside", "within", (F.size(F.array_except(long, bare(F.col("all")))) == 0).alias("words"))


@query("markdown_invariants", r"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')))::BIGINT AS lines FROM documents WHERE regexp_matches(text, '\S')")
def markdown_invariants(spark, d):
    """Spans of markdown elements don't overlap and hold every line with a sign, so their lines add up to the text's."""

    def lines(t: str) -> list[str]:
        all_ = t.split("\n")
        spans = [(e["start"], e["end"]) for e in C.markdown_elements(t)]
        apart = all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
        return [str(sum(bool(x.strip(" \t\n\x0b\x0c\r")) for s, e in spans for x in all_[s : e + 1]) if apart else -1)]

    return C.exploded(docs(spark, d).where(F.col("text").rlike(r"\S")), "doc_id", "text", lines).select("doc_id", F.col("chunk").cast("long").alias("lines"))


@query("table_strategies", "SELECT * FROM (VALUES ('adaptive', 7, 50, true), ('atomic', 1, 50, true), ('per_row', 50, 50, true)) t(strategy, chunks, rows, tiled)")
def table_strategies(spark, d):
    """A table of fifty rows in one chunk, a chunk a row, and as many rows as 400 characters hold."""
    header, rows = ["codice", "descrizione"], [[f"A{i:02}", "x" * 32] for i in range(50)]
    out = []
    for s in ("atomic", "per_row", "adaptive"):
        c = C.table_chunks(header, rows, s, 400)
        tiled = [x["start"] for x in c] == [0, *(x["end_inclusive"] + 1 for x in c[:-1])] and c[-1]["end_inclusive"] == 49
        out.append((s, len(c), sum(x["end_inclusive"] - x["start"] + 1 for x in c), tiled))
    return spark.createDataFrame(out, "strategy string, chunks int, rows int, tiled boolean")


# ---- merges ----


@query("entity_merge_full", """WITH x AS (SELECT lower(trim(any_value(entity_name))) AS name, upper(any_value(entity_type)) AS type, any_value(description) AS description, any_value(source_id) AS source, entity_id FROM extracted_entities GROUP BY entity_id HAVING any_value(entity_name) IS NOT NULL),
k0 AS (SELECT name, type, count(*) AS n FROM x WHERE type IS NOT NULL GROUP BY name, type), k AS (SELECT name, type FROM k0 QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, type) = 1),
ds AS (SELECT name, string_agg(description, chr(10) ORDER BY description) AS descriptions FROM (SELECT DISTINCT name, description FROM x WHERE length(description) > 0) GROUP BY name), ss AS (SELECT name, list_sort(list(DISTINCT source)) AS sources FROM x WHERE source IS NOT NULL GROUP BY name)
SELECT a.name, k.type, ds.descriptions, coalesce(ss.sources, []) AS sources FROM (SELECT DISTINCT name FROM x) a LEFT JOIN k USING (name) LEFT JOIN ds USING (name) LEFT JOIN ss USING (name)""")
def entity_merge_full(spark, d):
    """One row a name: commonest type, distinct descriptions in order, union of sources."""
    e = table(spark, d, "extracted_entities").dropDuplicates(["entity_id"]).where("entity_name is not null")
    x = e.select(F.lower(F.trim("entity_name")).alias("name"), F.upper("entity_type").alias("type"), "description", F.col("source_id").alias("source"))
    kinds = G.most_common(F.col("type"), ["name"], x).withColumnRenamed("value", "type")
    said = x.where("length(description) > 0").select("name", "description").distinct().groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("description")), "\n").alias("descriptions"))
    seen = x.where("source is not null").select("name", "source").distinct().groupBy("name").agg(F.array_sort(F.collect_list("source")).alias("sources"))
    return x.select("name").distinct().join(kinds, "name", "left").join(said, "name", "left").join(seen, "name", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


@query("relationship_merge_full", f"""{WITH}, k0 AS (SELECT src, dst, type, count(*) AS n FROM e GROUP BY src, dst, type), k AS (SELECT src, dst, type FROM k0 QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY n DESC, type) = 1)
SELECT e.src, e.dst, any_value(k.type) AS type, round(sum(e.weight), 2) AS weight, list_sort(list(DISTINCT e.id)) AS sources, list_sort(list(DISTINCT lower(e.type))) AS keywords FROM e JOIN k ON k.src = e.src AND k.dst = e.dst GROUP BY e.src, e.dst""")
def relationship_merge_full(spark, d):
    """One row a pair of nodes: summed weight, commonest type, union of sources and keywords."""
    e = edges(spark, d)
    kinds = G.most_common(F.col("type"), ["src", "dst"], e).withColumnRenamed("value", "type")
    out = e.groupBy("src", "dst").agg(F.round(F.sum("weight"), 2).alias("weight"), F.array_sort(F.collect_set("id")).alias("sources"), F.array_sort(F.collect_set(F.lower("type"))).alias("keywords"))
    return out.join(kinds, ["src", "dst"])


@query("node_merge_full", f"""{WITH}, k AS (SELECT *, lower(trim(name)) AS k FROM n), s AS (SELECT namespace, k, s, min((id, p)) AS pos FROM (SELECT namespace, k, id, unnest(source_ids) AS s, generate_subscripts(source_ids, 1) AS p FROM k) GROUP BY ALL),
o AS (SELECT namespace, k, list(s ORDER BY pos) AS sources FROM s WHERE s IS NOT NULL GROUP BY ALL)
SELECT m.id, m.role, coalesce(o.sources, []) AS sources FROM (SELECT namespace, k, min(id) AS id, first(properties['role'] ORDER BY coalesce(length(properties['role']), 0) DESC, id) AS role FROM k GROUP BY ALL) m LEFT JOIN o ON o.namespace IS NOT DISTINCT FROM m.namespace AND o.k IS NOT DISTINCT FROM m.k""")
def node_merge_full(spark, d):
    """Nodes of one name: the longest description (their role), sources in the order of nodes, each once."""
    n = nodes(spark, d).withColumns({"k": F.lower(F.trim("name")), "role": F.try_element_at("properties", F.lit("role"))})
    group = ["namespace", "k"]
    m = n.groupBy(*group).agg(F.min("id").alias("id"), F.min_by("role", F.struct(-F.coalesce(F.length("role"), F.lit(0)), F.col("id"))).alias("role"))
    s = n.select(*group, "id", F.posexplode("source_ids").alias("p", "s")).where("s is not null").groupBy(*group, "s").agg(F.min(F.struct("id", "p")).alias("at"))
    o = s.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x.s).alias("sources"))
    both = m.alias("m").join(o.alias("o"), F.col("m.namespace").eqNullSafe(F.col("o.namespace")) & F.col("m.k").eqNullSafe(F.col("o.k")), "left")
    return both.select("m.id", "m.role", F.coalesce("o.sources", F.array().cast("array<string>")).alias("sources"))


@query("cross_fetch", f"""WITH {CHUNKS}, en AS (SELECT entity_id, any_value(source_id) AS chunk FROM extracted_entities GROUP BY entity_id HAVING any_value(source_id) IS NOT NULL) SELECT c.id, count(en.entity_id) AS entities, length(any_value(c.text)) AS chars FROM c LEFT JOIN en ON en.chunk = c.id GROUP BY c.id""")
def cross_fetch(spark, d):
    """Chunks with the entities that were drawn from them."""
    e = table(spark, d, "extracted_entities").dropDuplicates(["entity_id"]).where("source_id is not null").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("entities"))
    return chunks(spark, d).select("id", F.length("text").alias("chars")).join(e, "id", "left").withColumn("entities", F.coalesce("entities", F.lit(0)))


# ---- messages, caches, workflows ----


@query("timed_cache", """WITH t AS (SELECT event_type AS kind, user_id AS key, max(ts) AS used FROM events GROUP BY ALL), n AS (SELECT max(ts) AS now FROM events), l AS (SELECT t.*, now FROM t, n WHERE used > now - INTERVAL 2 DAY)
SELECT kind, key, used FROM l QUALIFY row_number() OVER (PARTITION BY kind ORDER BY used DESC, key) <= 100""")
def timed_cache(spark, d):
    """What an inactivity cache holds at the last event: entries used within two days, the hundred last of each kind."""
    e = table(spark, d, "events")
    return S.timed_cache(e, "event_type", "user_id", "ts", e.agg(F.max("ts")).first()[0], "2 days", 100)


@query("queue_worker", "SELECT event_type, count(*) AS handled, count(DISTINCT event_id) AS distinct_events FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def queue_worker(spark, d):
    """Messages from a queue of files, handled in micro-batches, each batch written once under its number."""
    from .streams import _source

    path = scratch(spark, "queue")
    S.into(_source(spark, d), S.to_parquet(path + "/out"), path + "/log")
    done = spark.read.option("basePath", path + "/out").parquet(path + "/out")
    return done.where("event_type is not null").groupBy("event_type").agg(F.count("*").alias("handled"), F.count_distinct("event_id").alias("distinct_events"))


@query("redelivered_once", "SELECT event_id, user_id FROM events")
def redelivered_once(spark, d):
    """A stream in which every event is delivered twice; each comes out once."""
    from .streams import _source

    twice = _source(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return S.collected(spark, S.first_deliveries(twice, "event_id", "1 hour"), "redelivered").select("event_id", "user_id")


@query("single_writer", "SELECT * FROM (VALUES ('first', true), ('second', false), ('after', true)) t(writer, held)")
def single_writer(spark, d):
    """One writer a table: the second is refused until the first lets go."""
    path = scratch(spark, "lock")
    first = plugins.TableLock(spark, path)
    rows = [("first", first.take()), ("second", plugins.TableLock(spark, path).take())]
    first.release()
    last = plugins.TableLock(spark, path)
    rows.append(("after", last.take()))
    last.release()
    return spark.createDataFrame(rows, "writer string, held boolean")


@query("workflow", "SELECT * FROM (VALUES (0, 'route', 'graph'), (1, 'search', 'found 2'), (2, 'answer', 'done')) t(step, node, said)")
def workflow(spark, d):
    """Nodes of an agent's workflow: each says where to go next."""
    steps = {
        "route": lambda s: ("search", s | {"said": "graph" if "relazione" in s["question"] else "text"}),
        "search": lambda s: ("answer", s | {"said": "found 2"}),
        "answer": lambda s: (None, s | {"said": "done"}),
    }
    trace = plugins.run_workflow(steps, "route", {"question": "che relazione c'è?"})
    return spark.createDataFrame([(i, n, s["said"]) for i, (n, s) in enumerate(trace)], "step int, node string, said string")


@query("cluster_strategies", "SELECT 'by_label' AS strategy, count(DISTINCT label) AS clusters, count(*) AS n FROM embeddings UNION ALL SELECT 'sequential', (SELECT sum(ceil(n / 10))::BIGINT FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)), count(*) FROM embeddings")
def cluster_strategies(spark, d):
    """Strategies by name from the registry of clusterings."""
    e = table(spark, d, "embeddings")
    parts = [plugins.clustering(s)(e, "vec_id", "label").agg(F.lit(s).alias("strategy"), F.count_distinct("cluster").alias("clusters"), F.count("*").alias("n")) for s in ("by_label", "sequential")]
    return parts[0].unionByName(parts[1])


@query("domain_profiles", "SELECT * FROM (VALUES ('default', false, 'Riassumi: x'), ('sanita', true, 'Atti di strutture sanitarie. Riassumi: x')) t(profile, known, prompt)")
def domain_profiles(spark, d):
    """Prompts of a profile, with the default's for what a profile lacks."""
    profiles = {"default": {"summary": "Riassumi: {text}"}, "sanita": {"summary": "Atti di strutture sanitarie. Riassumi: {text}"}}
    return spark.createDataFrame([(p, p in ("sanita",), plugins.prompt(profiles, p, "summary", text="x")) for p in ("default", "sanita")], "profile string, known boolean, prompt string")


@query("latency_counters", "SELECT CASE WHEN value < 5 THEN 'l1' WHEN value < 25 THEN 'l2' ELSE 'miss' END AS level, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def latency_counters(spark, d):
    """Counters of a cache by level and kind."""
    level = F.when(F.col("value") < 5, "l1").when(F.col("value") < 25, "l2").otherwise("miss")
    return table(spark, d, "events").groupBy(level.alias("level"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("last_turns_by_text_key", "SELECT * FROM (VALUES ('10', 'dieci'), ('9', 'nove')) t(turn, text)")
def last_turns_by_text_key(spark, d):
    """The last two turns of a history whose keys are numbers in text: 10 comes behind 9."""
    h = spark.createDataFrame([({"1": "uno", "2": "due", "9": "nove", "10": "dieci"},)], "history map<string,string>")
    turns = h.select(F.explode("history").alias("turn", "text"))
    return turns.withColumn("n", F.row_number().over(Window.orderBy(F.desc(F.col("turn").cast("int"))))).where("n <= 2").select("turn", "text")
