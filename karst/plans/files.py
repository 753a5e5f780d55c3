"""Queries of readers, stores, sheets and parsers of generated text, over literals and tables written and read again."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from karst.core.session import scratch, table
from karst.functions import text as T
from karst.operators import assist as A
from karst.operators import cells as S
from karst.operators.store import AnswerCache, ChunkStore, GraphStore, register_tables
from karst.registry import query
from karst.sources import readers as R

from .graphs import WITH, edges, nodes
from .search import CHUNKS, chunks


def _values(rows, names):
    def one(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (int, float)):
            return str(v) + "::DOUBLE" * isinstance(v, float)
        if isinstance(v, list):
            return "[" + ", ".join(map(one, v)) + "]"
        return "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({names})"


@query("csv_scan", "SELECT o_orderkey, o_orderpriority, round(o_totalprice, 2) AS price FROM orders")
def csv_scan(spark, d):
    """A table written as CSV and read by all executors."""
    path = scratch(spark, "csv")
    table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.round("o_totalprice", 2).alias("price")).write.option("header", True).csv(path)
    return R.csv_table(spark, path, "o_orderkey long, o_orderpriority string, price double")


_SHEET = {"Lotto 1": [["nota iniziale"], [], ["Codice", "Descrizione", None, "Prezzo"], ["A1", "vite, M4", None, 0.5], ["A2", 'dado "x"', None, 2]], "Vuoto": []}


@query("excel_scan", _values([("| Codice | Descrizione | Prezzo |\n| --- | --- | --- |\n| A1 | vite, M4 | 0.5 |\n| A2 | dado \"x\" | 2 |", "table", ["Lotto 1"])], "content, block_type, heading_path"))
def excel_scan(spark, d):
    """A sheet with a note above its header and an empty column."""
    path = scratch(spark, "xlsx")
    R.put_file(spark, f"{path}/a.xlsx", R.xlsx_of(_SHEET))
    return R.read_files(spark, path, "xlsx").select("content", "block_type", "heading_path")


@query("header_rows", _values([(0, 2), (1, 0), (2, 0)], "sheet, header"))
def header_rows(spark, d):
    sheets = [_SHEET["Lotto 1"], [["a", "b"], ["1", "2"]], [["x"], ["y"]]]
    return spark.createDataFrame([(i, R.header_row(s)) for i, s in enumerate(sheets)], "sheet int, header int")


@query("excel_to_csv", _values([("Lotto 1", 'nota iniziale\n\nCodice,Descrizione,,Prezzo\nA1,"vite, M4",,0.5\nA2,"dado ""x""",,2\n'), ("Vuoto", "")], "sheet, csv"))
def excel_to_csv(spark, d):
    return spark.createDataFrame(list(R.xlsx_to_csv(R.xlsx_of(_SHEET)).items()), "sheet string, csv string")


def _docx() -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    tbl = "<w:tbl>" + "".join("<w:tr>" + "".join(map(cell, r)) + "</w:tr>" for r in (["a", "b"], ["1", "2"])) + "</w:tbl>"
    drawing = '<w:p><w:r><w:drawing><wp:docPr xmlns:wp="http://x/wp" id="1" name="i" descr="una mappa"/><a:blip xmlns:a="http://x/a" xmlns:r="http://x/r" r:embed="rId7"/></w:drawing></w:r></w:p>'
    body = p("Titolo", "Heading1") + p("testo uno") + p("Parte", "Heading2") + p("testo due") + tbl + drawing + p("Fine", "Heading1") + p("testo tre")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://x"><Relationship Id="rId7" Target="media/image1.png"/></Relationships>')
        z.writestr("word/media/image1.png", b"12345")
    return out.getvalue()


@query("docx_scan", _values([(0, "Titolo", "heading", []), (1, "testo uno", "text", ["Titolo"]), (2, "Parte", "heading", ["Titolo"]), (3, "testo due", "text", ["Titolo", "Parte"]),
                            (4, "| a | b |\n| --- | --- |\n| 1 | 2 |", "table", ["Titolo", "Parte"]), (5, "Fine", "heading", []), (6, "testo tre", "text", ["Fine"])], '"order", content, block_type, heading_path'))
def docx_scan(spark, d):
    path = scratch(spark, "docx")
    R.put_file(spark, f"{path}/a.docx", _docx())
    return R.read_files(spark, path, "docx").select("order", "content", "block_type", "heading_path")


@query("docx_images", _values([("image1.png", "una mappa", 5)], "name, alt, size"))
def docx_images(spark, d):
    path = scratch(spark, "docx")
    R.put_file(spark, f"{path}/a.docx", _docx())
    return R.read_images(spark, path).select("name", "alt", "size")


def _pdf() -> bytes:
    import zlib

    one = zlib.compress(b"BT /F1 12 Tf 72 700 Td (Contratto \\(bozza\\)) Tj T* (n. 5 del 2024) Tj ET")
    two = b"BT 72 700 Td [(Pagina ) -20 (due)] TJ ET"
    flate = b"4 0 obj <</Length %d /Filter /FlateDecode>> stream\n" % len(one) + one + b"\nendstream endobj\n"
    plain = b"6 0 obj <</Length %d>> stream\n" % len(two) + two + b"\nendstream endobj\n"
    return b"%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [3 0 R 5 0 R] /Count 2>> endobj\n3 0 obj <</Type /Page /Parent 2 0 R /Contents 4 0 R>> endobj\n" + flate + b"5 0 obj <</Type /Page /Parent 2 0 R /Contents [6 0 R]>> endobj\n" + plain + b"%%EOF"


@query("pdf_scan", _values([(1, "Contratto (bozza)\nn. 5 del 2024"), (2, "Pagina due")], "page, content"))
def pdf_scan(spark, d):
    path = scratch(spark, "pdf")
    R.put_file(spark, f"{path}/a.pdf", _pdf())
    return R.read_files(spark, path, "pdf").select("page", "content")


@query("typed_load", _values([("csv", 1), ("docx", 7), ("html", 2), ("md", 1), ("pdf", 2), ("txt", 1), ("xlsx", 1)], "kind, blocks"))
def typed_load(spark, d):
    """One file of each type through the registry of readers."""
    path = scratch(spark, "typed")
    data = {"csv": b"a,b\n1,2\n", "docx": _docx(), "html": b"<html><title>T</title><body><p>uno</p></body></html>", "md": b"# x", "pdf": _pdf(), "txt": b"ciao", "xlsx": R.xlsx_of(_SHEET)}
    for kind, content in data.items():
        R.put_file(spark, f"{path}/{kind}/a.{kind}", content)
    parts = [R.read_files(spark, f"{path}/{kind}", kind).agg(F.lit(kind).alias("kind"), F.count("*").cast("int").alias("blocks")) for kind in data]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("markdown_round_trip", "SELECT doc_id, true AS same, length(text) AS chars FROM documents WHERE text IS NOT NULL AND length(text) > 0")
def markdown_round_trip(spark, d):
    """Every text with front matter as markdown and as JSON, and back."""
    import json

    def run(frames):
        for pdf in frames:
            same, chars = [], []
            for i, t in zip(pdf["doc_id"], pdf["text"]):
                front, blocks = {"id": int(i), "tags": ["a", "b"]}, [{"content": t, "block_type": "text", "page": 1, "heading_path": ["x"]}]
                back = R.from_markdown(R.to_markdown(front, blocks))
                same.append(back == (front, blocks) and json.loads(json.dumps([front, blocks])) == [front, blocks])
                chars.append(len(back[1][0]["content"]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "same": same, "chars": chars})

    rows = table(spark, d, "documents").where("length(text) > 0").select("doc_id", "text")
    return rows.mapInPandas(run, "doc_id long, same boolean, chars int")


@query("snapshots", f"WITH {CHUNKS} SELECT '2024-02' AS latest, 2 AS snapshots, count(*) AS rows FROM c WHERE page > 1")
def snapshots(spark, d):
    """Two snapshots of a table; the latest is read."""
    path = scratch(spark, "snapshots")
    c = chunks(spark, d).select("id", "page")
    R.save_snapshot(c, path, "2024-01")
    R.save_snapshot(c.where("page > 1"), path, "2024-02")
    stamps = R.list_snapshots(spark, path)
    return R.load_snapshot(spark, path).agg(F.lit(stamps[0]).alias("latest"), F.lit(len(stamps)).alias("snapshots"), F.count("*").alias("rows"))


@query("graph_snapshot", f"{WITH} SELECT 'entities' AS what, count(*) AS n FROM n UNION ALL SELECT 'relationships', count(*) FROM e UNION ALL SELECT 'reports', count(DISTINCT namespace) FROM n WHERE namespace IS NOT NULL")
def graph_snapshot(spark, d):
    """Entities, relationships and reports of a graph, each in its folder, saved and loaded."""
    path = scratch(spark, "graph")
    n = nodes(spark, d)
    R.save_graph(n, edges(spark, d), n.where("namespace is not null").groupBy("namespace").agg(F.count("*").alias("size")), path, "all", "idx", "t1")
    parts = [df.agg(F.lit(k).alias("what"), F.count("*").alias("n")) for k, df in R.load_graph(spark, path, "all", "idx").items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("artefacts", _values([("b", "i", "report", "2024-03", "r.txt", 6)], "namespace, index, kind, ts, name, size"))
def artefacts(spark, d):
    """Files put, a namespace deleted, the latest of a kind listed."""
    a = R.Artefacts(spark, scratch(spark, "artefacts"))
    for ns, ts, data in (("a", "2024-01", b"1"), ("b", "2024-02", b"old"), ("b", "2024-03", b"latest")):
        a.put(ns, "i", "report", ts, "r.txt", data)
    a.delete("a")
    latest = a.latest("b", "i", "report")
    kept = a.get("b", "i", "report").select(F.length("content").alias("n"))
    return a.list("b").where(F.col("ts") == latest).join(kept, F.col("size") == F.col("n")).select("namespace", "index", "kind", "ts", "name", "size")


@query("table_catalogue", "SELECT 'nation' AS name, count(*) AS rows FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def table_catalogue(spark, d):
    """Extracted tables in a catalogue, registered as views and counted by SQL."""
    path = scratch(spark, "catalogue")
    rows = [(n, f"{d}/{n}.parquet") for n in ("nation", "region")]
    spark.createDataFrame(rows, "name string, path string").write.parquet(path)
    register_tables(spark, spark.read.parquet(path).selectExpr("'cat_' || name as name", "path"))
    return spark.sql("select 'nation' as name, count(*) as rows from cat_nation union all select 'region', count(*) from cat_region")


@query("chunk_store", f"WITH {CHUNKS}, s AS (SELECT id, coalesce(namespace, 'default') AS namespace, metadata_id FROM c) SELECT namespace, count(*) AS chunks FROM s WHERE namespace <> 'gare-sud' AND metadata_id IS DISTINCT FROM 'md-54' GROUP BY namespace")
def chunk_store(spark, d):
    """All chunks upserted, again, then a namespace and a document deleted: what is left by namespace."""
    store = ChunkStore(spark, scratch(spark, "store"))
    c = chunks(spark, d)
    store.upsert(c)
    store.upsert(c)
    store.delete("gare-sud")
    for r in c.where("metadata_id = 'md-54'").select(F.coalesce("namespace", F.lit("default")).alias("n")).distinct().collect():  # one document's namespaces
        store.delete(r.n, "md-54")
    return store.namespaces()


@query("graph_store", f"{WITH} SELECT label AS kind, count(*) AS n FROM n WHERE namespace IS NOT NULL AND label IS NOT NULL AND namespace <> 'gare-nord' GROUP BY label")
def graph_store(spark, d):
    """Nodes and relationships put twice, one namespace deleted: nodes by label."""
    store = GraphStore(spark, scratch(spark, "graph"))
    n = nodes(spark, d).where("namespace is not null and label is not null")
    store.put_nodes(n)
    store.put_nodes(n)
    e = edges(spark, d).join(n.select(F.col("id").alias("src"), "namespace"), "src").withColumn("properties", F.create_map().cast("map<string,string>"))
    store.put_edges(e)
    store.delete("gare-nord")
    return store.nodes.read().groupBy(F.col("label").alias("kind")).agg(F.count("*").alias("n"))


@query("answer_cache", _values([("n1", "Quanto costa?", "10", "exact"), ("n1", "quanto  costera", "10", "near"), ("n1", "dove siete", None, "none"), ("n2", "Quanto costa?", None, "none")], "namespace, question, answer, how"))
def answer_cache(spark, d):
    """First the question's key, then the nearest stored question of its namespace, then nothing."""
    from karst.functions import vectors as V

    cache = AnswerCache(spark, scratch(spark, "answers"))
    stored = spark.createDataFrame([("n1", " quanto COSTA? ", "10"), ("n3", "x", "y")], "namespace string, question string, answer string")
    cache.store(stored.withColumn("embedding", V.letter_vector(F.col("question")).cast("array<float>")))
    cache.invalidate("n3")
    asked = spark.createDataFrame([("n1", "Quanto costa?"), ("n1", "quanto  costera"), ("n1", "dove siete"), ("n2", "Quanto costa?")], "namespace string, question string")
    return cache.lookup(asked.withColumn("embedding", V.letter_vector(F.col("question"))), 0.92).select("namespace", "question", "answer", "how")


# ---- generated text ----


@query("generated_json", _values([(1, "{\"a\": 1}"), (2, None), (3, None), (4, "{\"b\": [1, 2]}")], "id, found"))
def generated_json(spark, d):
    import json

    texts = ['Ecco: {"a": 1} fine', "niente", "{rotto", 'x {"b": [1, 2]}']
    found = [A.json_of(t) for t in texts]
    return spark.createDataFrame([(i, None if f is None else json.dumps(f)) for i, f in enumerate(found, 1)], "id int, found string")


@query("generated_questions", _values([(0, "Chi garantisce il mutuo?"), (1, "Quanto costa la polizza?"), (2, "Dove si firma?"), (3, "Quando scade il contratto?")], "position, question"))
def generated_questions(spark, d):
    text = 'Q1: "Chi garantisce il mutuo?"\n2. Quanto costa la polizza.\n- Dove si firma?\n\nTesto senza domanda\nQuando scade il contratto?\n* Dove si firma?'
    return spark.createDataFrame(list(enumerate(A.questions_of(text))), "position int, question string")


_RECORDS = 'entity|Banca ABC|Company|una banca\nentity|X|a b c d|troppo lungo\nentity|corto|P\nrelationship|Mario|Banca ABC|has loan|mutuo|0\nrelationship|Mario|Luca|knows|amici|molto|2024-01-01\nrumore'


@query("extraction_records", _values([("entity", "BANCA ABC", "COMPANY", None, None), ("relationship", "MARIO", "HAS_LOAN", 0.0, None), ("relationship", "MARIO", "KNOWS", 1.0, "2024-01-01")], "kind, name, type, weight, date"))
def extraction_records(spark, d):
    e, r = A.extraction_records(_RECORDS)
    rows = [("entity", x["name"], x["type"], None, None) for x in e] + [("relationship", x["src"], x["type"], x["weight"], x["date"]) for x in r]
    return spark.createDataFrame(rows, "kind string, name string, type string, weight double, date string")


@query("requirement_list", _values([("REQ-001", "il sistema registra"), ("REQ-002", "il sistema avvisa")], "req_id, requirement"))
def requirement_list(spark, d):
    rows = spark.createDataFrame([("Requisito",), (" il sistema registra ",), ("",), ("il sistema avvisa",)], "r string").coalesce(1)
    return A.requirements_of(rows, "r")


@query("requirement_sheet", _values([("Lotto 1", "R1", "registra", True), ("Lotto 1", "R2", "avvisa", False), ("Lotto 2", "R1", "stampa", True)], "lot, id, text, mandatory"))
def requirement_sheet(spark, d):
    """A workbook with a sheet a lot, rendered, read by its headers, flags in words."""
    book = R.xlsx_of({"Lotto 1": [["ID requisito", "Descrizione", "Obbligatorio"], ["R1", "registra", "SI"], ["R2", "avvisa", "no"], [None, None, None]], "Lotto 2": [["Descrizione", "ID"], ["stampa", "R1"]]})
    rows = []
    for lot, (header, *body) in R.xlsx_sheets(book):
        at = [S.column_of([h or "" for h in header], w) for w in (["id"], ["descrizione", "testo"], ["obbligator"])]
        rows += [(lot, *(r[i] if i is not None and i < len(r) else None for i in at)) for r in body if any(r)]
    df = spark.createDataFrame(rows, "lot string, id string, text string, raw string")
    return df.select("lot", "id", "text", S.flag(F.col("raw"), True).alias("mandatory"))


@query("sheet_cells", _values([(0, True, 1.5, "conformita", "on_off"), (1, False, None, "tabellare", "proporzionale"), (2, True, 3.0, None, "variabile"), (3, True, None, "discrezionale", "proporzionale")], "id, flag, number, type, mode"))
def sheet_cells(spark, d):
    rows = [(0, " Sì", "1,5", "Conformità", "On/Off", None), (1, "FALSE", "x", "tabellari", None, "punteggio proporzionale"), (2, "boh", "3", "altro", "", "testo"), (3, None, None, "DISCREZIONALE", "proporzionale", "on off")]
    df = spark.createDataFrame(rows, "id int, f string, n string, t string, m string, text string")
    return df.select("id", S.flag(F.col("f"), True).alias("flag"), S.number(F.col("n")).alias("number"), S.business_type(F.col("t")).alias("type"), S.mode(F.col("m"), F.col("text")).alias("mode"))


@query("product_headers", _values([(0, "A1", "vite"), (1, "A1", "vite M4"), (2, None, "dado")], "sheet, code, name"))
def product_headers(spark, d):
    sheets = [(["Nome commerciale", "CODICE articolo"], [["vite", "A1"], [None, None]]), (["x", "y", "z"], [["A1", "vite", "M4"]]), (["Denominazione prodotto"], [["dado"]])]
    return spark.createDataFrame([(i, *p) for i, (h, r) in enumerate(sheets) for p in S.products(h, r)], "sheet int, code string, name string")


@query("judgement_summary", """WITH t AS (SELECT l_returnflag AS lot, count(*) AS total, count(*) FILTER (WHERE l_linestatus = 'O') AS compliant, 0::BIGINT AS non_compliant, 0::BIGINT AS partial, count(*) FILTER (WHERE l_linestatus <> 'O') AS not_verifiable,
round(CASE WHEN count(*) FILTER (WHERE l_linestatus = 'O') > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 4) AS rate, count(*) AS criteria, count(*) FILTER (WHERE l_tax >= 0.02 AND l_discount > 0) AS scored, round(sum(CASE WHEN l_tax >= 0.02 AND l_discount > 0 THEN l_discount ELSE 0 END), 2) AS points,
round(sum(CASE WHEN l_tax >= 0.02 AND l_discount > 0 THEN l_quantity ELSE 0 END), 2) AS most, count(*) FILTER (WHERE l_tax < 0.02) AS to_review, round(sum(CASE WHEN l_tax < 0.02 THEN l_quantity ELSE 0 END), 2) AS review_points, count(*) FILTER (WHERE l_linenumber = 1) AS unattributed FROM lineitem GROUP BY 1) SELECT * FROM t""")
def judgement_summary(spark, d):
    """Lines as criteria: judged by status, scored unless a person must look, attributed or not."""
    l = table(spark, d, "lineitem").withColumn("lot", F.col("l_returnflag"))  # noqa: E741
    tab = l.select("lot", F.when(F.col("l_linestatus") == "O", "compliant").otherwise("?").alias("judgment"))
    disc = l.select("lot", F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("score"), F.col("l_quantity").alias("max_points"), (F.col("l_tax") < 0.02).alias("human"), (F.col("l_linenumber") != 1).alias("attributed"))
    return S.summary(tab, disc, "lot")


@query("table_references", """WITH t AS (SELECT body_id, doc_id, unnest(list_distinct(list_transform(regexp_extract_all(any_value(body) || ' vedi Tabella ' || (any_value(page_no) % 5 + 1), '(?i)\\b(?:tabella|table|tabla|tab\\.)\\s*(\\d+)', 1), lambda x: x::INT))) AS number FROM page_bodies GROUP BY body_id, doc_id),
u AS (SELECT 't' || i AS table_id, doc_id, i::INT AS number FROM (SELECT DISTINCT doc_id FROM page_bodies) x, range(1, 100) r(i)) SELECT t.body_id AS element_id, u.table_id FROM t JOIN u USING (doc_id, number)""".replace("\\\\", "\\"))
def table_references(spark, d):
    """Bodies, with a reference set behind each, that name a table of their document by number."""
    b = table(spark, d, "page_bodies").dropDuplicates(["body_id"]).select(F.col("body_id").alias("element_id"), "doc_id", F.col("body").alias("text"))
    named = table(spark, d, "page_bodies").dropDuplicates(["body_id"]).select(F.col("body_id").alias("element_id"), "doc_id", F.concat("body", F.lit(" vedi Tabella "), (F.col("page_no") % 5 + 1).cast("string")).alias("text"))
    tables = b.select("doc_id").distinct().withColumn("number", F.explode(F.sequence(F.lit(1), F.lit(99)))).withColumn("table_id", F.concat(F.lit("t"), F.col("number").cast("string")))
    return A.references_to_tables(named, tables)


@query("citation_names", f"""WITH {CHUNKS}, m AS (SELECT metadata_source AS source, max(nullif(regexp_extract(regexp_replace(metadata_source, '[?#].*$', ''), '([^/]+)/*$', 1), '')) AS file_name FROM c WHERE metadata_source IS NOT NULL AND id < '8' GROUP BY 1)
SELECT c.id, m.file_name FROM c LEFT JOIN m ON m.source = c.metadata_source""")
def citation_names(spark, d):
    """Citations with the file name that retrieved chunks give for their source; null where none does."""
    c = chunks(spark, d)
    base = F.nullif(F.regexp_extract(F.regexp_replace("metadata_source", r"[?#].*$", ""), r"([^/]+)/*$", 1), F.lit(""))
    names = c.where("metadata_source is not null and id < '8'").groupBy("metadata_source").agg(F.max(base).alias("file_name"))
    return c.select("id", "metadata_source").join(names, "metadata_source", "left").select("id", "file_name")


@query("skipped_lines", _values([(0, True), (1, True), (2, True), (3, False), (4, True), (5, True), (6, False), (7, True)], "id, skip"))
def skipped_lines(spark, d):
    """Lines of generated records that hold no data: markup, rules, numbers, disclaimers, prose without quotes."""
    lines = ["### Titolo", "----------", "1. punto", '"entity","NOME","TIPO","testo"', "Note: this is it", "una frase di testo semplice", "NOME", "```json"]
    return spark.createDataFrame(list(enumerate(lines)), "id int, line string").select("id", T.skipped_line(F.col("line")).alias("skip"))
