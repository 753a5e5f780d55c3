"""Queries of forms and options that the tables alone don't show: second groups, selectors, strategies, forced windows, replays."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from karst.core.session import scratch, table
from karst.functions import text as T
from karst.operators import chunking as C
from karst.operators import digest as D
from karst.operators import graph as G
from karst.operators import retrieval as R
from karst.registry import query
from karst.sources import readers
from karst.streaming import streams as S

from .answers import _letters
from .documents import docs
from .files import _values
from .graphs import WITH
from .search import CHUNKS, chunks, dense


@query("delimited_pairs", _values([(1, "12", "primo testo"), (1, "13", "secondo\ntesto"), (2, None, "senza marche")], "doc, id, content"))
def delimited_pairs(spark, d):
    """Page marks with their number and the text behind them."""
    q = spark.createDataFrame([(1, "<p 12>primo testo</p><p 13> secondo\ntesto </p><p 14> </p>"), (2, "senza marche")], "doc int, text string")
    return q.select("doc", F.inline(C.delimited_pairs(F.col("text"), r"<p (\d+)>(.*?)</p>")))


@query("decomposed_text", _values([(0, "cafe no 5"), (1, "ufficio 12"), (2, None), (3, "")], "id, text"))
def decomposed_text(spark, d):
    q = spark.createDataFrame([(0, "Café, nº 5"), (1, " Uﬃcio—１２ "), (2, None), (3, "...")], "id int, raw string")
    return q.select("id", T.decomposed(F.col("raw")).alias("text"))


@query("reference_forms", _values([(0, "fig. 3"), (0, "§ 2.1"), (0, "art.12"), (0, "tabella 4"), (1, "sez. b")], "id, reference"))
def reference_forms(spark, d):
    """Abbreviated references and section signs."""
    q = spark.createDataFrame([(0, "vedi Fig. 3 e § 2.1, art.12; Tabella  4"), (1, "Sez. B, figli 3"), (2, None)], "id int, text string")
    return q.select("id", F.explode(T.cross_references(F.col("text"))).alias("reference"))


@query("list_cells", _values([(0, ["b", "a"]), (1, ["x", "y z"]), (2, []), (3, ["[rotto"])], "id, items"))
def list_cells(spark, d):
    q = spark.createDataFrame([(0, '["b", "a", "b", " "]'), (1, "x, y z ,,x"), (2, None), (3, "[rotto")], "id int, raw string")
    return q.select("id", T.as_list(F.col("raw")).alias("items"))


@query("source_magic", _values([(0, "pdf"), (1, "xls"), (2, "csv"), (3, "url"), (4, None)], "id, kind"))
def source_magic(spark, d):
    """The first bytes of a payload beat the extension of its name."""
    rows = [(0, "a.txt", "JVBERi0xLjQK", None), (1, "a.pdf", "0M8R4KGxGuEAAA==", None), (2, "a.csv", "YSxi", None), (3, None, None, "https://x.example/y"), (4, None, None, None)]
    q = spark.createDataFrame(rows, "id int, name string, payload string, source string")
    return q.select("id", T.source_type(F.col("source"), F.lit(None).cast("string"), F.col("name"), F.col("payload")).alias("kind"))


@query("html_selectors", _values([("uno\ndue",), ("due",)], "text"))
def html_selectors(spark, d):
    """Parts left out by selector, comments gone; then only the text of one tag."""
    html = '<body><!-- nota --><div id="menu" class="a b">via</div><p class="ad wide">via</p><p>uno</p><section>due</section><div class="a">via</div></body>'
    drop = ("div#menu", "p.ad.wide", ".a")
    return spark.createDataFrame([(readers.html_transform(html, drop_selectors=drop),), (readers.html_transform(html, keep_tags=("section",)),)], "text string")


_DIST = r"""p AS (SELECT doc_id, regexp_split_to_array(text, '\n\s*\n') AS parts FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, n - 1 AS n, list_distinct(regexp_split_to_array(lower(part), '[^\p{L}]+')) AS w FROM (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS n FROM p)),
b AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY n) AS b FROM w), d AS (SELECT doc_id, n, CASE WHEN b IS NOT NULL THEN 1 - len(list_intersect(w, b)) / greatest(len(list_distinct(list_concat(w, b))), 1) END AS distance FROM b)"""


def _segments(spark, d, strategy, amount=None):
    parts = docs(spark, d).where("text is not null").select("doc_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("n", "part"))
    parts = parts.withColumn("w", F.array_distinct(F.split(F.lower("part"), r"[^\p{L}]+"))).withColumn("b", F.lag("w").over(Window.partitionBy("doc_id").orderBy("n")))
    distance = F.when(F.col("b").isNotNull(), 1 - F.size(F.array_intersect("w", "b")) / F.greatest(F.size(F.array_union("w", "b")), F.lit(1)))
    out = C.semantic_breaks(parts.withColumn("distance", distance), "doc_id", "n", "distance", strategy=strategy, amount=amount)
    return out.groupBy("doc_id").agg((F.max("segment") + 1).alias("segments"))


@query("segments_by_deviation", f"WITH {_DIST}, c AS (SELECT doc_id, avg(distance) + 0.5 * stddev_pop(distance) AS lim FROM d GROUP BY doc_id) SELECT doc_id, count(*) FILTER (WHERE distance > lim) + 1 AS segments FROM d JOIN c USING (doc_id) GROUP BY doc_id")
def segments_by_deviation(spark, d):
    return _segments(spark, d, "standard_deviation", 0.5)


@query("segments_by_quartiles", f"WITH {_DIST}, c AS (SELECT doc_id, avg(distance) + 0.5 * (quantile_cont(distance, 0.75) - quantile_cont(distance, 0.25)) AS lim FROM d GROUP BY doc_id) SELECT doc_id, count(*) FILTER (WHERE distance > lim) + 1 AS segments FROM d JOIN c USING (doc_id) GROUP BY doc_id")
def segments_by_quartiles(spark, d):
    return _segments(spark, d, "interquartile", 0.5)


@query("segments_by_gradient", f"""WITH {_DIST}, g AS (SELECT doc_id, n, CASE WHEN distance IS NULL THEN NULL WHEN pv IS NOT NULL AND nx IS NOT NULL THEN (nx - pv) / 2 WHEN nx IS NOT NULL THEN nx - distance ELSE distance - pv END AS slope FROM (SELECT *, lag(distance) OVER (PARTITION BY doc_id ORDER BY n) AS pv, lead(distance) OVER (PARTITION BY doc_id ORDER BY n) AS nx FROM d)),
c AS (SELECT doc_id, quantile_cont(slope, 0.95) AS lim FROM g GROUP BY doc_id) SELECT doc_id, count(*) FILTER (WHERE slope > lim) + 1 AS segments FROM g JOIN c USING (doc_id) GROUP BY doc_id""")
def segments_by_gradient(spark, d):
    return _segments(spark, d, "gradient")


@query("digest_forced", "SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS window_start")
def digest_forced(spark, d):
    """Windows that have a digest are made again when that is asked for."""
    have = table(spark, d, "events").select(F.to_date("ts").alias("window_start"), F.to_date("ts").alias("window_end")).distinct()
    return D.missing(D.windows("2024-01-01", "2024-01-31", "daily", spark), have, forced=True).select("window_start")


@query("digest_monthly_rollup", """WITH w AS (SELECT date_trunc('week', ts)::DATE AS s, count(*) AS rows, sum(value) AS total FROM events GROUP BY ALL)
SELECT date_trunc('month', s)::DATE AS window_start, last_day(s) AS window_end, count(*) AS children, sum(rows)::BIGINT AS rows, round(sum(total), 2) AS total FROM w GROUP BY ALL""")
def digest_monthly_rollup(spark, d):
    """Months from weekly digests, a week counting to the month it begins in."""
    weekly = D.digest(table(spark, d, "events"), F.to_date("ts"), F.col("event_type"), F.col("value"), "weekly")
    return D.rollup(weekly, "monthly").select("window_start", "window_end", "children", "rows", F.round("total", 2).alias("total"))


_DATED = rf"""{CHUNKS}, x AS (SELECT id, metadata_id, text, coalesce(try_strptime(regexp_extract(date_text, '^(\d{{4}}-\d{{2}}-\d{{2}})', 1), '%Y-%m-%d'), try_strptime(regexp_extract(date_text, '^(\d{{2}}/\d{{2}}/\d{{4}})$', 1), '%d/%m/%Y'))::DATE AS day FROM c),
s AS (SELECT id FROM x WHERE day BETWEEN DATE '2025-01-01' AND DATE '2025-01-31'), n AS (SELECT DISTINCT id FROM (SELECT id, try_strptime(unnest(regexp_extract_all(text, '\b(\d{{4}}-\d{{2}}-\d{{2}})\b', 1)), '%Y-%m-%d')::DATE AS day FROM x) WHERE day BETWEEN DATE '2025-01-01' AND DATE '2025-01-31')"""


def _dated(spark, d):
    c = chunks(spark, d)
    iso = lambda p: T.calendar_date(F.regexp_extract("date_text", p, 1))
    day = F.coalesce(iso(r"^(\d{4}-\d{2}-\d{2})"), iso(r"^(\d{2}/\d{2}/\d{4})$"))
    inside = "day between date'2025-01-01' and date'2025-01-31'"
    s = c.select("id", "metadata_id", day.alias("day")).where(inside)
    raw = F.explode(F.regexp_extract_all("text", F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), F.lit(1)))
    n = c.select("id", "metadata_id", raw.alias("raw")).select("id", "metadata_id", F.try_to_timestamp("raw", F.lit("yyyy-MM-dd")).cast("date").alias("day")).where(inside)
    return c, s.select("id", "metadata_id"), n.select("id", "metadata_id").distinct()


@query("digest_augmented", f"WITH {_DATED} SELECT id, bool_or(own) AS own FROM (SELECT id, true AS own FROM s UNION ALL SELECT id, false FROM n) GROUP BY id")
def digest_augmented(spark, d):
    """Sources of a month's digest and the chunks whose text names a day of it, each once."""
    _, s, n = _dated(spark, d)
    both = s.select("id", F.lit(True).alias("own")).unionByName(n.select("id", F.lit(False).alias("own")))
    return both.groupBy("id").agg(F.bool_or("own").alias("own"))


@query("sibling_chunks", f"WITH {_DATED}, k AS (SELECT id FROM n), m AS (SELECT DISTINCT metadata_id FROM x WHERE id IN (SELECT id FROM k) AND metadata_id IS NOT NULL) SELECT x.id FROM x JOIN m USING (metadata_id) WHERE x.id NOT IN (SELECT id FROM k)")
def sibling_chunks(spark, d):
    """Chunks of the same documents as those that name a day of the month, without these."""
    c, _, n = _dated(spark, d)
    docs_ = n.where("metadata_id is not null").select("metadata_id").distinct()
    return c.select("id", "metadata_id").join(docs_, "metadata_id", "left_semi").join(n.select("id"), "id", "left_anti").select("id")


@query("evidence_total", f"WITH {CHUNKS}, k AS (SELECT id, least(length(text), 900) AS n FROM c WHERE length(text) > 0), r AS (SELECT id, sum(n) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS used FROM k) SELECT id, used::BIGINT AS used FROM r WHERE used <= 140000")
def evidence_total(spark, d):
    """Evidence in order of ids, 900 characters a chunk, until 140,000 are used in all."""
    c = chunks(spark, d, "length(text) > 0").select("id", F.least(F.length("text"), F.lit(900)).alias("n"))
    first = c.orderBy("id").limit(140_000)  # a chunk uses one character at least
    return first.withColumn("used", F.sum("n").over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0))).where("used <= 140000").select("id", "used")


@query("fused_metadata", """WITH s AS (SELECT q.vec_id AS query_id, r.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS c, -list_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS l FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0),
a AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, vec_id) AS rank FROM s QUALIFY rank <= 10), b AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(l, 9) DESC, vec_id) AS rank FROM s QUALIFY rank <= 10),
u AS (SELECT *, 'cosine ' || rank AS meta, 0 AS src FROM a UNION ALL SELECT *, 'distance ' || rank, 1 FROM b) SELECT query_id, vec_id, round(sum(1.0 / (60 + rank)), 8) AS rrf, min_by(meta, src) AS meta FROM u GROUP BY query_id, vec_id""")
def fused_metadata(spark, d):
    """A fused row keeps the metadata of the first ranking that holds it."""
    a, b = dense(spark, d, 10), dense(spark, d, 10, "l2")
    fused = R.rrf([a, b], "vec_id", by=["query_id"])
    said = lambda df, name, i: df.select("query_id", "vec_id", F.concat(F.lit(name + " "), F.col("rank").cast("string")).alias("meta"), F.lit(i).alias("src"))
    first = said(a, "cosine", 0).unionByName(said(b, "distance", 1)).groupBy("query_id", "vec_id").agg(F.min_by("meta", "src").alias("meta"))
    return fused.join(first, ["query_id", "vec_id"]).select("query_id", "vec_id", F.round("rrf", 8).alias("rrf"), "meta")


@query("cooccur_twice", "SELECT 'a' AS src, 'b' AS dst, 2::BIGINT AS count, round(ln((2/4) / ((3/4) * (2/4))) / -ln(2/4 + 1e-12), 6) AS npmi")
def cooccur_twice(spark, d):
    """Pairs that meet in two chunks at least."""
    m = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a"), ("2", "b"), ("3", "a"), ("3", "c"), ("4", "d")], "chunk_id string, name string")
    return G.cooccurrence(m).withColumn("npmi", F.round("npmi", 6))


@query("stream_resumed", "SELECT count(*) AS n, count(DISTINCT event_id) AS events FROM events")
def stream_resumed(spark, d):
    """A consumer that dies and starts again goes on behind its checkpoint: nothing is handled twice."""
    from .streams import _source

    path = scratch(spark, "resumed")
    for _ in range(2):
        S.into(_source(spark, d), S.to_parquet(path + "/out"), path + "/log")
    return spark.read.option("basePath", path + "/out").parquet(path + "/out").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("events"))


# ---- communities of chunks ----


def _chunk_communities(spark, d):
    from .answers import members
    from .graphs import nodes

    n = nodes(spark, d).select("id", F.explode("source_ids").alias("chunk_id"))
    return n.join(members(spark, d), "id").select("chunk_id", "community", "level", "id")


_MEM = "m AS (SELECT id, namespace AS community, 0 AS level FROM n WHERE namespace IS NOT NULL UNION ALL SELECT id, namespace || '/' || label, 1 FROM n WHERE namespace IS NOT NULL AND label IS NOT NULL), cc AS (SELECT s.chunk_id, m.community, m.level, m.id FROM (SELECT id, unnest(source_ids) AS chunk_id FROM n) s JOIN m USING (id) WHERE s.chunk_id IS NOT NULL)"


@query("chunk_communities", f"{WITH}, {_MEM} SELECT chunk_id, list_sort(list(DISTINCT community)) AS communities FROM cc GROUP BY chunk_id")
def chunk_communities(spark, d):
    """The communities of the nodes that each chunk mentions."""
    own = _chunk_communities(spark, d).where("chunk_id is not null").select("chunk_id", "community").distinct()
    return own.groupBy("chunk_id").agg(F.array_sort(F.collect_list("community")).alias("communities"))


@query("shared_communities", f"{WITH}, {_MEM}, t AS (SELECT DISTINCT community FROM cc WHERE community LIKE 'gare%'), k AS (SELECT chunk_id, count(DISTINCT community) AS n FROM cc JOIN t USING (community) GROUP BY chunk_id) SELECT chunk_id, n, round(least(0.15 * n, 0.5), 6) AS boost FROM k")
def shared_communities(spark, d):
    """How many of the wanted communities a chunk shares, and the boost that gives."""
    own = _chunk_communities(spark, d).where("chunk_id is not null").select(F.col("chunk_id").alias("id"), "community").distinct()
    ones = own.select("id").distinct().withColumn("score", F.lit(1.0))
    out = G.boosted(ones, own, own.where("community like 'gare%'"))
    n = own.where("community like 'gare%'").groupBy("id").agg(F.count("*").alias("n"))
    return out.join(n, "id").select(F.col("id").alias("chunk_id"), "n", F.round(F.col("score") - 1, 6).alias("boost"))


@query("summary_sources", f"{WITH}, {_MEM}, k AS (SELECT community, level, chunk_id, count(*) AS mentions FROM cc WHERE community NOT LIKE 'gare%' GROUP BY ALL) SELECT community, level, chunk_id, mentions FROM k QUALIFY row_number() OVER (PARTITION BY community, level ORDER BY mentions DESC, chunk_id) <= 30")
def summary_sources(spark, d):
    """Up to thirty chunks for the summary of each community that has none yet; those of tenders have one."""
    done = _chunk_communities(spark, d).where("community like 'gare%'").select("community", "level").distinct()
    k = _chunk_communities(spark, d).where("chunk_id is not null").join(done, ["community", "level"], "left_anti").groupBy("community", "level", "chunk_id").agg(F.count("*").alias("mentions"))
    w = Window.partitionBy("community", "level").orderBy(F.desc("mentions"), "chunk_id")
    return k.withColumn("n", F.row_number().over(w)).where("n <= 30").select("community", "level", "chunk_id", "mentions")


# ---- providers ----


@query("embedding_factory", f"SELECT doc_id, round(sqrt(list_dot_product({_letters('text')}, {_letters('text')})), 4) AS norm FROM documents WHERE regexp_matches(lower(text), '[a-z]')")
def embedding_factory(spark, d):
    """An embedding by its provider's name."""
    from karst.functions import vectors as V
    from karst.plans import plugins

    v = plugins.embedding("letters")(F.col("text"))
    return docs(spark, d).select("doc_id", v.alias("v")).where("v is not null").select("doc_id", F.round(V.norm(F.col("v")), 4).alias("norm"))


@query("injected_scorer", "SELECT doc_id, round(length(text) / 10.0, 3)::DOUBLE AS score FROM documents WHERE text IS NOT NULL")
def injected_scorer(spark, d):
    """A scorer handed in from outside, over whole batches of (question, text)."""
    rows = docs(spark, d).where("text is not null").withColumn("q", F.lit("0123456789"))
    return R.scored_by(rows, _length_ratio, "q", "text").select("doc_id", F.round("score", 3).alias("score"))


def _length_ratio(q: pd.Series, t: pd.Series) -> pd.Series:
    return t.str.len() / q.str.len()


@query("registries", _values([("clustering", "by_label"), ("clustering", "sequential"), ("embedding", "hash"), ("embedding", "letters"), *(("reader", k) for k in ("csv", "docx", "html", "md", "pdf", "txt", "url", "xlsx"))], "kind, name"))
def registries(spark, d):
    from karst.plans import plugins

    rows = [("clustering", n) for n in plugins.CLUSTERINGS] + [("embedding", n) for n in plugins.EMBEDDINGS] + [("reader", n) for n in readers.READERS]
    return spark.createDataFrame(rows, "kind string, name string")


# ---- pages and documents in their common form ----


@query("html_main", _values([(0, 599, True), (1, 213, False), (2, None, None)], "id, chars, same"))
def html_main(spark, d):
    """A long page by its paragraphs, a short one by all its text, a bare one not at all."""
    long = "<body><nav>menu menu</nav><p>" + "a" * 299 + "</p><p>" + "b" * 299 + "</p><footer>fine</footer></body>"
    short = "<body><div>" + "c" * 200 + "</div><p>" + "d" * 12 + "</p></body>"
    pages = [(0, long), (1, short), (2, "<p>poco</p>")]
    rows = [(i, t and len(t), None if t is None else "menu" not in t and i == 0) for i, h in pages for t in [readers.page_text(h)]]
    return spark.createDataFrame(rows, "id int, chars int, same boolean")


@query("common_documents", _values([("csv", "listino", 1), ("html", "Bando", 2), ("md", "note", 1), ("txt", "a", 1)], "type, title, blocks"))
def common_documents(spark, d):
    files = [("csv", "x/listino.csv", b"a,b\n1,2\n"), ("html", "y.html", b"<title>Bando</title><p>uno</p>"), ("md", "note.md", b"# x"), ("txt", "a.txt", b"ciao")]
    docs_ = [readers.extracted(*f) for f in files]
    return spark.createDataFrame([(x["type"], x["title"], len(x["blocks"])) for x in docs_], "type string, title string, blocks int")


@query("tags_and_metadata", f"WITH {CHUNKS} SELECT id FROM c WHERE list_contains(coalesce(tags, []), 'OCR') AND page >= 2 AND namespace IN ('gare-nord', 'gare-sud', 'polizze-nord')")
def tags_and_metadata(spark, d):
    """A tag expression and field conditions at once, as a store takes them."""
    from karst.functions import filters

    where = filters.tag_filter("OCR") & filters.metadata_filter({"page": {"$gte": 2}, "namespace": {"$in": ["gare-nord", "gare-sud", "polizze-nord"]}})
    return chunks(spark, d, where).select("id")


@query("situated_modes", f"WITH {CHUNKS}, k AS (SELECT id, text, CASE WHEN page IS NOT NULL AND metadata_id IS NOT NULL THEN 'p. ' || page || ' di ' || metadata_id END AS context FROM c WHERE text IS NOT NULL) SELECT id, length(CASE WHEN context IS NULL THEN text ELSE context || chr(10) || chr(10) || text END)::INT AS prefixed, length(text)::INT AS beside, context FROM k")
def situated_modes(spark, d):
    """Context before the text, or in the metadata only."""
    context = F.concat(F.lit("p. "), F.col("page").cast("string"), F.lit(" di "), F.col("metadata_id"))
    c = chunks(spark, d, "text is not null").select("id", C.situated(F.col("text"), context).alias("a"), C.situated(F.col("text"), context, "metadata").alias("b"))
    return c.select("id", F.length("a.text").alias("prefixed"), F.length("b.text").alias("beside"), "b.context")
