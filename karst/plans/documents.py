"""Queries of scalar functions, chunkers and readers over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from karst.core.session import table
from karst.functions import filters, vectors
from karst.functions import text as T
from karst.operators import chunking as C
from karst.operators import retrieval as R
from karst.registry import query
from karst.sources import readers

from .search import CHUNKS, LATEST, chunks


def docs(spark, d):
    return table(spark, d, "documents")


def pages(spark, d):
    return table(spark, d, "scraped_pages").dropDuplicates(["page_id"])


@query("source_type", LATEST + r"""
, x AS (SELECT id, trim(metadata_source) AS s, text, lower(trim(metadata_type)) AS k FROM c)
SELECT id, coalesce(CASE regexp_extract(lower(regexp_replace(s, '[?#].*$', '')), '\.([a-z0-9]+)$', 1) WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'doc' THEN 'docx' WHEN 'xlsx' THEN 'xlsx' WHEN 'xls' THEN 'xls'
 WHEN 'csv' THEN 'csv' WHEN 'txt' THEN 'txt' WHEN 'md' THEN 'md' WHEN 'markdown' THEN 'md' WHEN 'html' THEN 'url' WHEN 'htm' THEN 'url' END,
 CASE WHEN regexp_matches(lower(s), '^https?://|^www\.') THEN 'url' END, CASE WHEN length(trim(text)) > 0 THEN 'txt' END) AS detected FROM x""")
def source_type(spark, d):
    c = chunks(spark, d)
    return c.select("id", T.source_type(F.col("metadata_source"), F.col("text"), F.lit(None).cast("string")).alias("detected"))


@query("resolved_type", LATEST + " SELECT id, coalesce(CASE WHEN lower(trim(metadata_type)) NOT IN ('auto', '') THEN lower(trim(metadata_type)) END, 'txt') AS kind FROM c")
def resolved_type(spark, d):
    return chunks(spark, d).select("id", T.resolved_type(F.col("metadata_type"), F.lit("txt")).alias("kind"))


@query("file_name_from_url", r"""
WITH b AS (SELECT page_id, regexp_replace(regexp_replace(trim(any_value(url)), '[?#].*$', ''), '/+$', '') AS u FROM scraped_pages GROUP BY page_id)
SELECT page_id, nullif(string_split(regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*', ''), '/')[-1], '') AS name FROM b""")
def file_name_from_url(spark, d):
    return pages(spark, d).select("page_id", T.file_name(F.col("url")).alias("name"))


@query("html_title", r"SELECT page_id, nullif(trim(regexp_extract(any_value(html), '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM scraped_pages GROUP BY page_id")
def html_title(spark, d):
    return pages(spark, d).select("page_id", T.html_title(F.col("html")).alias("title"))


@query("html_tables")
def html_tables(spark, d):
    """Every table of every page as markdown, with its column names."""

    @F.pandas_udf("array<struct<table_index:int,col_names:array<string>,text:string>>")
    def found(s):
        return s.map(readers.html_tables)

    p = pages(spark, d).where("html is not null").select("page_id", F.explode(found("html")).alias("t"))
    return p.select("page_id", "t.table_index", "t.col_names", "t.text")


@query("html_text")
def html_text(spark, d):
    """Page text without the tags and classes that the site's parameters name."""
    params = table(spark, d, "scrape_params").groupBy("site").agg(F.first("unwanted_tags").alias("tags"), F.first("unwanted_classnames").alias("classes"))

    @F.pandas_udf("string")
    def clean(html, tags, classes):
        import pandas as pd

        listed = lambda x: [] if x is None else [str(v).lower() for v in x if v]
        return pd.Series([readers.html_transform(h, listed(t), listed(c)) for h, t, c in zip(html, tags, classes)])

    return pages(spark, d).join(params, "site", "left").select("page_id", clean("html", "tags", "classes").alias("text"))


@query("calendar_dates", LATEST + r"""
SELECT id, coalesce(try_strptime(regexp_extract(date_text, '^(\d{4}-\d{2}-\d{2})', 1), '%Y-%m-%d'), try_strptime(date_text, '%d/%m/%Y'))::DATE AS day FROM c""")
def calendar_dates(spark, d):
    return chunks(spark, d).select("id", T.calendar_date(F.col("date_text")).alias("day"))


_MONEY = r"(\d{1,3}(?:\.\d{3})*,\d{2}) ?€"


@query("money_amounts", rf"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_MONEY}', 1)) AS raw FROM documents)
SELECT doc_id, count(*) AS n, round(sum(CAST(replace(replace(raw, '.', ''), ',', '.') AS DECIMAL(18,2)))::DOUBLE, 2) AS total FROM m GROUP BY doc_id""")
def money_amounts(spark, d):
    m = docs(spark, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_MONEY), F.lit(1))).alias("raw"))
    return m.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.sum(T.amount(F.col("raw"))).cast("double"), 2).alias("total"))


@query("pattern_entities", r"""
WITH x AS (SELECT doc_id, 'CIG' AS type, unnest(regexp_extract_all(text, '(?i)\bCIG\s*[:\.]?\s*([A-Z0-9]{10})\b', 1)) AS raw FROM documents
UNION ALL SELECT doc_id, 'CUP', unnest(regexp_extract_all(text, '(?i)\bCUP\s*[:\.]?\s*([A-Z0-9]{15})\b', 1)) FROM documents
UNION ALL SELECT doc_id, 'CF', unnest(regexp_extract_all(text, '(?i)\b[A-Z]{6}[0-9]{2}[A-Z][0-9]{2}[A-Z][0-9]{3}[A-Z]\b')) FROM documents
UNION ALL SELECT doc_id, 'DATE_IT', unnest(regexp_extract_all(text, '\b(\d{1,2}[/\-\.]\d{2}[/\-\.]\d{4})\b', 1)) FROM documents
UNION ALL SELECT doc_id, 'MONEY', unnest(regexp_extract_all(text, '(?i)€\s*\d{1,3}(?:\.\d{3})*(?:,\d{2})?|\d{1,3}(?:\.\d{3})*,\d{2}\s*(?:euro|€)')) FROM documents
UNION ALL SELECT doc_id, 'QUANTITY', unnest(regexp_extract_all(text, '(?i)\b(?:n\.?°?|nr\.?|pz\.?)\s*(\d+)\b', 1)) FROM documents)
SELECT type, lower(trim(raw)) AS name, count(DISTINCT doc_id) AS documents FROM x GROUP BY ALL""")
def pattern_entities(spark, d):
    """Documents of each tender code, project code, tax code, date, amount and quantity."""
    e = docs(spark, d).select("doc_id", F.inline(T.entities(F.col("text"))))
    return e.groupBy("type", "name").agg(F.count_distinct("doc_id").alias("documents"))


_TENDER = "CIG: AB12CD34EF cup J31B21000340006 cf RSSMRA80A01H501U il 03-02-2025 e 04.05.2025 per € 10.500,00 e 99,90 euro, n. 50 pz.7 nr 3"


@query("pattern_entities_literal", """SELECT * FROM (VALUES ('CIG', 'ab12cd34ef'), ('CUP', 'j31b21000340006'), ('CF', 'rssmra80a01h501u'), ('DATE_IT', '03-02-2025'), ('DATE_IT', '04.05.2025'),
('MONEY', '€ 10.500,00'), ('MONEY', '99,90 euro'), ('QUANTITY', '50'), ('QUANTITY', '7'), ('QUANTITY', '3')) t(type, name)""")
def pattern_entities_literal(spark, d):
    """Each kind in forms that the tables don't hold: lower case, dashes and points, a leading sign, the word euro."""
    return spark.createDataFrame([(_TENDER,)], "text string").select(F.inline(T.entities(F.col("text"))))


@query("month_expansion", """WITH m AS (SELECT * FROM (VALUES (1, DATE '2024-02-01'), (1, DATE '2025-12-01'), (2, DATE '2026-04-01')) t(id, first))
SELECT id, strftime(unnest(range(first::TIMESTAMP, (first + INTERVAL 1 MONTH)::TIMESTAMP, INTERVAL 1 DAY)), '%d/%m/%Y') AS day FROM m""")
def month_expansion(spark, d):
    """Questions that name months: every day of them."""
    q = spark.createDataFrame([(1, "Cosa è successo tra Febbraio 2024 e dicembre  2025?"), (2, "aprile 2026"), (3, "maggio"), (4, None)], "id int, text string")
    return q.select("id", F.explode(T.dates_of_months(F.col("text"))).alias("day"))


@query("query_keywords", r"""
SELECT doc_id, len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: length(w) >= 4 AND w NOT IN ('della', 'delle', 'with', 'para'))))::INT AS n FROM documents WHERE text IS NOT NULL""")
def query_keywords(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", F.size(T.keywords(F.col("text"), ["della", "delle", "with", "para"])).alias("n"))


@query("cross_references", r"""
WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:\b(?:figure|figura|table|tabella|tabla|section|sezione|sección|equation|equazione|appendix|appendice|articolo|article|artículo)\s+|\b(?:fig|tab|sez|sec|eq|app|art)\.\s*|§\s*)(?:[0-9]+(?:\.[0-9]+)*|[A-Z]\b)', 0)) AS r FROM documents)
SELECT doc_id, lower(regexp_replace(r, '\s+', ' ', 'g')) AS reference, count(*) > 0 AS found FROM x GROUP BY ALL""")
def cross_references(spark, d):
    x = docs(spark, d).select("doc_id", F.explode(T.cross_references(F.col("text"))).alias("reference"))
    return x.select("doc_id", "reference", F.lit(True).alias("found"))


_TIME = [
    r"\boggi\b", r"\bieri\b", r"\bdomani\b", r"\bstamattina\b", r"\bstasera\b", r"\bquesta\s+(?:settimana|giornata|mattina|sera)\b", r"\bquesto\s+(?:mese|anno|trimestre|semestre)\b",
    r"\bl['']?\s*(?:anno|mese|settimana)\s+scorso\b", r"\bnell[ae]?\s+giornata\b", r"\bnel\s+corso\b", r"\bnel\s+periodo\b", r"\bnel\s+mese\b", r"\bultim[ioe]\s+\d+\s+(?:giorni|settimane|mesi)\b",
    r"\bdal\b.{0,40}\b(?:al|fino|a)\b", r"\bdal\s+\d", r"\bdal\s+\w+\s+\d{4}\b", r"\bdal\s+(?:primo|1°?)\b", r"\bfino\s+a\b", r"\bentro\s+il\b",
    r"\b(?:gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|novembre|dicembre)\b", r"\btoday\b", r"\byesterday\b", r"\bthis\s+(?:week|month|year)\b",
    r"\blast\s+(?:week|month|year)\b", r"\bsince\b.{0,20}\d{4}", r"\briassunto\b", r"\briepilogo\b", r"\bsommario\b", r"\bsintesi\b", r"\bcosa\s+hanno\s+(?:fatto|deliberato|deciso|acquistato|assunto)\b",
    r"\bcosa\s+[èe]\s+stato\b", r"\bcosa\s+[èe]\s+successo\b", r"\btipo\s+di\s+attivit[àa]", r"\bche\s+attivit[àa]", r"\bquante?\s+(?:determine|delibere|atti|acquisti|assunzioni)\b",
    r"\bn[°º]?\s*(?:determine|delibere)\b", r"\bquanti\s+(?:medici|infermieri|dipendenti)\b", r"\bsummary\b", r"\bsummarize\b", r"\bwhat\s+(?:happened|did\s+they\s+do)\b", r"\bhow\s+many\b",
]


@query("query_router", "SELECT doc_id, CASE WHEN p >= 0 THEN 'temporal' ELSE 'semantic' END AS route, p AS pattern FROM (SELECT doc_id, CASE "
       + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN {i}" for i, p in enumerate(_TIME)) + " ELSE -1 END AS p FROM documents)")
def query_router(spark, d):
    return docs(spark, d).select("doc_id", T.temporal_route(F.col("text")).alias("r")).select("doc_id", "r.route", "r.pattern")


@query("query_kind", """
SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'tell me about|what is|what are|explain|describe|overview|introduction|summarize|give me|show me|parlami di|cos''è|spiega|descrivi') THEN 'exploratory'
 WHEN regexp_matches(lower(text), 'error|code|bug|issue|fix|problem|how to|tutorial|step by step|configure|install|setup|syntax|command|function|errore|codice|problema|come fare|configurare') THEN 'technical'
 WHEN regexp_matches(lower(text), 'relation|relationship|connect|connection|influence|impact|affect|correlate|between|vs|versus|compare|comparison|difference|similar|relazione|connessione|influenza|impatto|confronto|how does|why does|what causes') THEN 'relational'
 ELSE 'exploratory' END AS kind FROM documents""")
def query_kind(spark, d):
    return docs(spark, d).select("doc_id", T.query_kind(F.col("text")).alias("kind"))


_ANSWERS = "SELECT doc_id, text || ' [' || (doc_id % 7) || '] e poi [12][' || (doc_id % 7) || '].' AS text FROM documents WHERE text IS NOT NULL"


@query("citation_markers", rf"""WITH a AS ({_ANSWERS}) SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '\[(\d+)\]', 1), lambda x: x::INT))) AS ids, trim(regexp_replace(text, '\s*\[\d+\]', '', 'g')) AS bare FROM a""")
def citation_markers(spark, d):
    """Answers that cite: every text with markers set behind it."""
    n = (F.col("doc_id") % 7).cast("string")
    t = F.concat("text", F.lit(" ["), n, F.lit("] e poi [12]["), n, F.lit("]."))
    return docs(spark, d).where("text is not null").withColumn("text", t).select("doc_id", T.citation_ids(F.col("text")).alias("ids"), T.without_citations(F.col("text")).alias("bare"))


@query("text_hashes", "SELECT doc_id, sha256(text) AS sha, md5(text) AS md5 FROM documents WHERE text IS NOT NULL")
def text_hashes(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md5"))


@query("truncated_text", "SELECT doc_id, CASE WHEN length(text) > 400 THEN left(text, 200) || '...' || right(text, 200) ELSE text END AS short FROM documents")
def truncated_text(spark, d):
    return docs(spark, d).select("doc_id", T.truncated(F.col("text"), 100).alias("short"))


@query("key_phrases", r"""
SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(s)), lambda s: length(s) > 20)[1:10] AS phrases FROM documents WHERE text IS NOT NULL""")
def key_phrases(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", T.sentences_as_phrases(F.col("text")).alias("phrases"))


@query("noise_lines", r"""
WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS t FROM documents)
SELECT doc_id, count(*) FILTER (WHERE t = '' OR regexp_matches(t, '^```|^#{1,6}\s|^[-=*_]{3,}$|^[-*•]$')) AS noise, count(*) AS lines FROM l GROUP BY doc_id""")
def noise_lines(spark, d):
    lines = docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(T.is_noise_line(F.col("line"))).alias("noise"), F.count("*").alias("lines"))


@query("heading_levels", r"""
WITH l AS (SELECT body_id, t, n FROM (SELECT body_id, string_split(any_value(body), chr(10)) AS ls FROM page_bodies GROUP BY body_id), LATERAL (SELECT unnest(ls) AS t, generate_subscripts(ls, 1) AS n)),
h AS (SELECT body_id, n, trim(t) AS t FROM l)
SELECT body_id, (n - 1)::INT AS line_no, (CASE WHEN regexp_matches(t, '^#{1,6} ') THEN length(regexp_extract(t, '^(#{1,6}) ', 1)) WHEN regexp_matches(t, '^\d+(\.\d+)+\.? \p{Lu}') THEN len(string_split(regexp_extract(t, '^([\d.]*\d)', 1), '.'))
 WHEN regexp_matches(t, '^\d{1,2}\. \p{Lu}[^.]{0,80}$') THEN 1 WHEN regexp_matches(t, '^[IVX]{1,5}\. \p{Lu}') THEN 1 WHEN regexp_matches(t, '^[A-Z]\. \p{Lu}') THEN 2 ELSE 0 END)::INT AS level FROM h
WHERE regexp_matches(t, '^#{1,6} |^\d+(\.\d+)+\.? \p{Lu}|^\d{1,2}\. \p{Lu}[^.]{0,80}$|^[IVX]{1,5}\. \p{Lu}|^[A-Z]\. \p{Lu}')""")
def heading_levels(spark, d):
    lines = bodies(spark, d).select("body_id", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    return lines.withColumn("level", T.heading_level(F.col("line")).cast("int")).where("level > 0").select("body_id", "line_no", "level")


def bodies(spark, d):
    return table(spark, d, "page_bodies").dropDuplicates(["body_id"])


_LEVELS = r"""l AS (SELECT body_id, t, n FROM (SELECT body_id, string_split(any_value(body), chr(10)) AS ls FROM page_bodies GROUP BY body_id), LATERAL (SELECT unnest(ls) AS t, generate_subscripts(ls, 1) AS n)),
h AS (SELECT body_id, n - 1 AS line_no, trim(t) AS t FROM l), v AS (SELECT body_id, line_no, t, (CASE WHEN regexp_matches(t, '^#{1,6} ') THEN length(regexp_extract(t, '^(#{1,6}) ', 1)) WHEN regexp_matches(t, '^\d+(\.\d+)+\.? \p{Lu}') THEN len(string_split(regexp_extract(t, '^([\d.]*\d)', 1), '.'))
 WHEN regexp_matches(t, '^\d{1,2}\. \p{Lu}[^.]{0,80}$') THEN 1 WHEN regexp_matches(t, '^[IVX]{1,5}\. \p{Lu}') THEN 1 WHEN regexp_matches(t, '^[A-Z]\. \p{Lu}') THEN 2 ELSE 0 END)::INT AS level FROM h), g AS (SELECT * FROM v WHERE level > 0),
up AS (SELECT g.*, p.line_no AS parent FROM g LEFT JOIN LATERAL (SELECT line_no FROM g q WHERE q.body_id = g.body_id AND q.line_no < g.line_no AND q.level < g.level ORDER BY q.line_no DESC LIMIT 1) p ON true)"""


@query("heading_paths", f"WITH RECURSIVE {_LEVELS}, r(body_id, line_no, parent, path) AS (SELECT body_id, line_no, parent, [t] FROM up UNION ALL SELECT r.body_id, r.line_no, up.parent, list_prepend(up.t, r.path) FROM r JOIN up ON up.body_id = r.body_id AND up.line_no = r.parent) SELECT body_id, line_no::INT AS line_no, path FROM r WHERE parent IS NULL")
def heading_paths(spark, d):
    """The headings above each heading of a page, by window functions."""
    lines = bodies(spark, d).select("body_id", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("level", T.heading_level(F.col("line")).cast("int")).withColumn("title", F.trim("line"))
    return C.heading_paths(lines, "body_id", "line_no", "level", "title").where("level > 0").select("body_id", "line_no", "path")


@query("text_formats", r"""WITH h AS (SELECT doc_id, string_split(text, chr(10))[1:10] AS h FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN (len(list_filter(h, lambda x: regexp_matches(x, '^\s*\|?\s*:?-{3,}'))) > 0 AND len(list_filter(h, lambda x: len(string_split(x, '|')) >= 3)) >= 2) OR len(list_filter(h, lambda x: regexp_matches(x, '^\s*(#{1,6}\s|[-*]\s|\d+\.\s|```)'))) > 0 THEN 'markdown'
 WHEN len(list_filter(h, lambda x: len(string_split(x, '|')) >= 3)) >= 2 THEN 'tabular' ELSE 'plain' END AS format FROM h""")
def text_formats(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", T.text_format(F.col("text")).alias("format"))


@query("plain_chunks")
def plain_chunks(spark, d):
    return C.exploded(docs(spark, d), "doc_id", "text", lambda t: C.recursive_split(t, 1000, 400))


@query("sub_windows", """
WITH s AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 50, 1), 250)) AS pos FROM documents WHERE length(text) > 0)
SELECT doc_id, count(*) AS windows, sum(length(substr(text, pos::INT + 1, 300))) AS chars FROM s GROUP BY doc_id""")
def sub_windows(spark, d):
    w = docs(spark, d).where("length(text) > 0").select("doc_id", F.explode(C.char_windows(F.col("text"), 300, 50)).alias("w"))
    return w.groupBy("doc_id").agg(F.count("*").alias("windows"), F.sum(F.length("w")).alias("chars"))


@query("delimited_chunks", r"""
WITH f AS (SELECT doc_id, text, list_filter(list_transform(regexp_extract_all(text, '(?s)(\([^()]*\))', 1), lambda x: trim(x)), lambda x: x <> '') AS found FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(CASE WHEN len(found) > 0 THEN found ELSE [text] END)::INT AS parts, len(found) > 0 AS matched FROM f""")
def delimited_chunks(spark, d):
    """Bracketed parts as chunks, the whole text where there are none."""
    t = docs(spark, d).where("text is not null")
    return t.select("doc_id", F.size(C.delimited(F.col("text"), r"(\([^()]*\))")).alias("parts"), F.col("text").rlike(r"\([^()]*\)").alias("matched"))


@query("markdown_elements")
def markdown_elements(spark, d):
    return C.exploded(docs(spark, d), "doc_id", "text", lambda t: [f"{e['type']}:{e['start']}-{e['end']}" for e in C.markdown_elements(t)], "element")


@query("markdown_chunks")
def markdown_chunks(spark, d):
    return C.exploded(docs(spark, d), "doc_id", "text", lambda t: [c["text"] for c in C.markdown_chunks(t)])


@query("section_chunks")
def section_chunks(spark, d):
    return C.exploded(docs(spark, d), "doc_id", "text", lambda t: [c["text"] for c in C.sections(t)])


@query("table_chunks")
def table_chunks(spark, d):
    """Pipe tables of page bodies, in chunks of at most 1,000 characters with the header repeated."""

    def tables(t: str) -> list[str]:
        return [c["text"] for x in C.pipe_tables(t)[0] for c in C.table_chunks(x["header"], x["rows"], "adaptive", 1000)]

    return C.exploded(bodies(spark, d), "body_id", "body", tables)


@query("semantic_segments", r"""WITH p AS (SELECT doc_id, regexp_split_to_array(text, '\n\s*\n') AS parts FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, n - 1 AS n, list_distinct(regexp_split_to_array(lower(part), '[^\p{L}]+')) AS w FROM (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS n FROM p)),
b AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY n) AS b FROM w), d AS (SELECT *, CASE WHEN b IS NOT NULL THEN 1 - len(list_intersect(w, b)) / greatest(len(list_distinct(list_concat(w, b))), 1) END AS distance FROM b),
c AS (SELECT doc_id, quantile_cont(distance, 0.95) AS cut FROM d GROUP BY doc_id), s AS (SELECT d.doc_id, d.n, sum(CASE WHEN distance > cut THEN 1 ELSE 0 END) OVER (PARTITION BY d.doc_id ORDER BY d.n) AS segment FROM d JOIN c USING (doc_id))
SELECT doc_id, segment::BIGINT AS segment, count(*) AS parts, min(n)::INT AS first FROM s GROUP BY ALL""")
def semantic_segments(spark, d):
    """Paragraphs of a document cut where neighbours share the fewest words (95th percentile of distance)."""
    parts = docs(spark, d).where("text is not null").select("doc_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("n", "part"))
    words = F.array_distinct(F.split(F.lower("part"), r"[^\p{L}]+"))
    before = F.lag("w").over(Window.partitionBy("doc_id").orderBy("n"))
    parts = parts.withColumn("w", words).withColumn("b", before)
    distance = 1 - F.size(F.array_intersect("w", "b")) / F.greatest(F.size(F.array_union("w", "b")), F.lit(1))
    parts = parts.withColumn("distance", F.when(F.col("b").isNotNull(), distance))
    return C.semantic_breaks(parts, "doc_id", "n", "distance").groupBy("doc_id", "segment").agg(F.count("*").alias("parts"), F.min("n").alias("first"))


@query("situated_context", f"""WITH {CHUNKS} SELECT id, coalesce(metadata_source, '') || chr(10) || text AS text FROM c WHERE text IS NOT NULL""")
def situated_context(spark, d):
    """A chunk with its document's name before it: the deterministic form of context enrichment."""
    return chunks(spark, d).where("text is not null").select("id", F.concat(F.coalesce("metadata_source", F.lit("")), F.lit("\n"), "text").alias("text"))


@query("metadata_merge", LATEST + " SELECT id, map_from_entries(list_concat(list_transform(map_entries(metadata), lambda e: {'key': 'sc_' || e.key, 'value': e.value}), [{'key': 'ns', 'value': coalesce(namespace, '')}])) AS merged FROM c WHERE metadata IS NOT NULL")
def metadata_merge(spark, d):
    """Additional metadata under a prefix, beside direct fields."""
    c = chunks(spark, d).where("metadata is not null")
    prefixed = F.transform_keys("metadata", lambda k, v: F.concat(F.lit("sc_"), k))
    return c.select("id", F.map_concat(prefixed, F.create_map(F.lit("ns"), F.coalesce("namespace", F.lit("")))).alias("merged"))


@query("ordered_distinct_tags", LATEST + " SELECT id, list_sort(list_distinct(tags)) AS tags, len(list_distinct(tags))::INT AS n FROM c WHERE tags IS NOT NULL")
def ordered_distinct_tags(spark, d):
    c = chunks(spark, d).where("tags is not null")
    return c.select("id", F.array_sort(F.array_distinct("tags")).alias("tags"), F.size(F.array_distinct("tags")).alias("n"))


@query("page_profile", r"""
WITH p AS (SELECT doc_id, len(list_filter(regexp_split_to_array(any_value(body), '\s+'), lambda x: x <> '')) AS words, length(any_value(body)) AS chars FROM page_bodies GROUP BY body_id, doc_id)
SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE words > 200) AS dense_pages, coalesce(max(words), 0)::INT AS max_words,
 CASE WHEN avg(CASE WHEN coalesce(chars, 0) < 50 THEN 1.0 ELSE 0 END) >= 0.9 THEN 'scanned' WHEN avg(CASE WHEN coalesce(chars, 0) < 50 THEN 1.0 ELSE 0 END) <= 0.1 THEN 'native' ELSE 'mixed' END AS kind FROM p GROUP BY doc_id""")
def page_profile(spark, d):
    words = F.size(F.filter(F.split("body", r"\s+"), lambda x: x != ""))
    p = bodies(spark, d).select("doc_id", F.when(F.col("body").isNotNull(), words).alias("words"), (F.coalesce(F.length("body"), F.lit(0)) < 50).cast("int").alias("bare"))
    share = F.avg("bare")
    kind = F.when(share >= 0.9, "scanned").when(share <= 0.1, "native").otherwise("mixed")
    return p.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(F.col("words") > 200).alias("dense_pages"), F.coalesce(F.max("words"), F.lit(0)).alias("max_words"), kind.alias("kind"))


@query("page_segments", """
WITH n AS (SELECT doc_id, max(page_no) AS last, min(page_no) AS first FROM page_bodies WHERE page_no IS NOT NULL GROUP BY doc_id)
SELECT doc_id, s::INT AS from_page, least(s + 1, last)::INT AS to_page FROM n, LATERAL (SELECT unnest(range(first, last + 1, 2)) AS s)""")
def page_segments(spark, d):
    """Ranges of two pages for conversion in parts."""
    n = table(spark, d, "page_bodies").where("page_no is not null").groupBy("doc_id").agg(F.min("page_no").alias("first"), F.max("page_no").alias("last"))
    s = n.select("doc_id", "last", F.explode(F.sequence("first", "last", F.lit(2))).alias("from_page"))
    return s.select("doc_id", "from_page", F.least(F.col("from_page") + 1, "last").alias("to_page"))


@query("element_sections", """WITH e AS (SELECT element_id, any_value(doc_id) AS doc_id, any_value(page) AS page, any_value(seq) AS seq, any_value(lower(element_type)) AS kind, any_value(text) AS text FROM text_elements GROUP BY element_id)
SELECT element_id, last_value(CASE WHEN kind = 'section_header' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page NULLS FIRST, seq NULLS FIRST, element_id ROWS UNBOUNDED PRECEDING) AS section FROM e""")
def element_sections(spark, d):
    """The heading each element stands under, across the pages of its document, in reading order."""
    e = table(spark, d, "text_elements").dropDuplicates(["element_id"])
    w = Window.partitionBy("doc_id").orderBy("page", "seq", "element_id")
    return e.select("element_id", F.last(F.when(F.lower("element_type") == "section_header", F.col("text")), ignorenulls=True).over(w).alias("section"))


@query("nearest_elements", """
WITH e AS (SELECT element_id, any_value(doc_id) AS doc_id, any_value(page) AS page, any_value(bbox) AS b, any_value(lower(element_type)) AS t FROM text_elements GROUP BY element_id HAVING any_value(bbox) IS NOT NULL),
p AS (SELECT h.element_id, x.element_id AS near, sqrt(pow((h.b[1] + h.b[3]) / 2 - (x.b[1] + x.b[3]) / 2, 2) + pow((h.b[2] + h.b[4]) / 2 - (x.b[2] + x.b[4]) / 2, 2)) AS dist
  FROM e h JOIN e x ON h.doc_id = x.doc_id AND h.page = x.page AND h.t = 'section_header' AND x.t = 'text')
SELECT element_id, near, round(dist, 3) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY element_id ORDER BY round(dist, 6), near) <= 3""")
def nearest_elements(spark, d):
    """The three texts of a page nearest to each heading, by box centres."""
    e = table(spark, d, "text_elements").dropDuplicates(["element_id"]).where("bbox is not null").withColumn("t", F.lower("element_type"))
    h, x = e.where("t = 'section_header'").alias("h"), e.where("t = 'text'").alias("x")
    p = h.join(x, F.expr("h.doc_id = x.doc_id and h.page = x.page"))
    p = p.select("h.element_id", F.col("x.element_id").alias("near"), vectors.bbox_centre_distance(F.col("h.bbox"), F.col("x.bbox")).alias("dist"))
    w = Window.partitionBy("element_id").orderBy(F.round("dist", 6), "near")
    return p.withColumn("n", F.row_number().over(w)).where("n <= 3").select("element_id", "near", F.round("dist", 3).alias("distance"))


@query("accent_folding", f"SELECT doc_id, trim(regexp_replace(lower(translate(source, 'àáâãäåèéêëìíîïòóôõöùúûüñçÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÑÇ', 'aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC')), '[^a-z0-9]+', ' ', 'g')) AS source FROM documents")
def accent_folding(spark, d):
    return docs(spark, d).select("doc_id", T.collapsed(F.col("source")).alias("source"))


@query("cleaned_strings", r"""SELECT element_id, any_value(trim(regexp_replace(trim(replace(replace(replace(text, '&quot;', '"'), '&lt;', '<'), '&amp;', '&')), '^["'']+|["'']+$', '', 'g'))) AS text FROM text_elements GROUP BY element_id HAVING any_value(text) NOT LIKE '%&%'""")
def cleaned_strings(spark, d):
    e = table(spark, d, "text_elements").dropDuplicates(["element_id"])
    return e.where("text not like '%&%'").select("element_id", T.cleaned(F.col("text")).alias("text"))


@query("cleaned_strings_whole", r"""WITH t AS (SELECT element_id, regexp_replace(any_value(text), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]', '', 'g') AS text FROM text_elements GROUP BY element_id)
SELECT element_id, trim(regexp_replace(trim(replace(replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')), '^["'']+|["'']+$', '', 'g')) AS text FROM t WHERE text IS NOT NULL""")
def cleaned_strings_whole(spark, d):
    """Like `cleaned_strings`, which as its SQL states leaves out texts with '&', over all texts."""
    e = table(spark, d, "text_elements").dropDuplicates(["element_id"])
    return e.where("text is not null").select("element_id", T.cleaned(F.col("text")).alias("text"))


@query("split_fields", LATEST + " SELECT id, list_transform(string_split(replace(metadata_source, '//', '/'), '/'), lambda x: trim(x)) AS parts FROM c WHERE metadata_source IS NOT NULL")
def split_fields(spark, d):
    return chunks(spark, d).where("metadata_source is not null").select("id", T.split_on(F.col("metadata_source"), "//", "/").alias("parts"))


@query("sources_by_kind", LATEST + " SELECT lower(trim(metadata_type)) AS kind, count(*) AS chunks, count(DISTINCT metadata_source) AS sources, sum(length(text)) AS chars FROM c GROUP BY 1")
def sources_by_kind(spark, d):
    return chunks(spark, d).groupBy(F.lower(F.trim("metadata_type")).alias("kind")).agg(F.count("*").alias("chunks"), F.count_distinct("metadata_source").alias("sources"), F.sum(F.length("text")).alias("chars"))


@query("embedding_misses", "WITH h AS (SELECT sha256(trim(text)) AS k, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1), seen AS (SELECT sha256(trim(text)) AS k FROM documents WHERE doc_type = 'faq' AND text IS NOT NULL) SELECT doc_id FROM h WHERE k NOT IN (SELECT k FROM seen)")
def embedding_misses(spark, d):
    """Texts without an entry in the cache (here: those of the faq documents), each once."""
    t = docs(spark, d).where("text is not null").withColumn("k", F.sha2(F.trim("text"), 256))
    return t.groupBy("k").agg(F.min("doc_id").alias("doc_id")).join(t.where("doc_type = 'faq'").select("k"), "k", "left_anti").select("doc_id")


@query("undated_or_in_range", LATEST + r""", p AS (SELECT id, coalesce(try_strptime(regexp_extract(date_text, '^(\d{4}-\d{2}-\d{2})', 1), '%Y-%m-%d'), try_strptime(date_text, '%d/%m/%Y'))::DATE AS day FROM c),
k AS (SELECT count(*) FILTER (WHERE day BETWEEN DATE '1990-01-01' AND DATE '1990-12-31') AS hits FROM p)
SELECT id FROM p, k WHERE day IS NOT NULL AND (hits = 0 OR day BETWEEN DATE '1990-01-01' AND DATE '1990-12-31')""")
def undated_or_in_range(spark, d):
    """A range that matches nothing, over dated chunks: all rows come back."""
    c = chunks(spark, d).select("id", F.coalesce(T.calendar_date(F.regexp_extract("date_text", r"^(\d{4}-\d{2}-\d{2})", 1)), T.calendar_date(F.regexp_extract("date_text", r"^(\d{2}/\d{2}/\d{4})$", 1))).alias("day")).where("day is not null")
    days = F.array("day")
    return filters.date_or_undated(c.withColumn("days", days), F.col("days"), "1990-01-01", "1990-12-31").select("id")
