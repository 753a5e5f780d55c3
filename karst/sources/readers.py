"""Readers and writers of documents: CSV, spreadsheets, DOCX, HTML, markdown with front matter, snapshots."""

from __future__ import annotations

import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from karst.operators.chunking import markdown_table

READERS: dict[str, Callable[[bytes], list[dict]]] = {}


def reader(*kinds: str):
    """Registers a reader of one file's bytes: blocks {content, block_type, page, heading_path}."""

    def put(f):
        for k in kinds:
            READERS[k] = f
        return f

    return put


def _block(content: str, kind: str = "text", page: int = 1, path: list[str] | None = None) -> dict:
    return {"content": content, "block_type": kind, "page": page, "heading_path": path or []}


def row_blocks(header: list[str], rows: list[list[str]], whole: int = 100, each: int = 50) -> list[dict]:
    """One markdown block, or blocks of `each` rows when there are over `whole`."""
    step = each if len(rows) > whole else max(1, len(rows))
    return [_block(markdown_table(header, rows[i : i + step]), "table") for i in range(0, max(1, len(rows)), step)]


@reader("csv")
def read_csv(data: bytes) -> list[dict]:
    df = pd.read_csv(io.BytesIO(data), dtype=str, keep_default_na=False)
    return row_blocks(list(df.columns), df.values.tolist())


def header_row(rows: list[list], within: int = 10) -> int:
    """The first of the first rows with the most filled cells; 0 when none has two."""
    filled = [sum(c not in (None, "") for c in r) for r in rows[:within]]
    return 0 if not filled or max(filled) <= 1 else filled.index(max(filled))


def sheet_blocks(name: str, rows: list[list]) -> list[dict]:
    """Blocks of a sheet: preamble above the header left out, empty columns dropped, large sheets split by rows and width."""
    if not rows:
        return []
    at = header_row(rows)
    body = rows[at + 1 :]
    width = max(map(len, rows))
    keep = [i for i in range(width) if any(i < len(r) and r[i] not in (None, "") for r in body)]
    cell = lambda r, i: "" if i >= len(r) or r[i] is None else str(r[i])
    header = [cell(rows[at], i) for i in keep]
    lines = [[cell(r, i) for i in keep] for r in body]
    text = markdown_table(header, lines)
    per = len(lines) if len(lines) <= 100 and len(text) <= 4000 else min(50, max(1, int(len(lines) * 4000 / len(text))))
    return [_block(markdown_table(header, lines[i : i + per]), "table", path=[name]) for i in range(0, len(lines), max(1, per))]


_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def xlsx_sheets(data: bytes) -> list[tuple[str, list[list]]]:
    """(name, rows) of a workbook's sheets from its XML, so no spreadsheet library is needed."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(_S + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
    names = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(_S + "sheet")]
    out = []
    files = sorted((n for n in z.namelist() if re.match(r"xl/worksheets/sheet\d+\.xml$", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    for name, file in zip(names, files):
        rows = []
        for row in ET.fromstring(z.read(file)).iter(_S + "row"):
            line: list = []
            for c in row.iter(_S + "c"):
                letters = re.match(r"[A-Z]+", c.get("r") or "A")[0]
                col = 0
                for ch in letters:
                    col = col * 26 + ord(ch) - 64
                line += [None] * (col - len(line))
                v, kind = c.find(_S + "v"), c.get("t")
                line[col - 1] = "".join(t.text or "" for t in c.iter(_S + "t")) if kind == "inlineStr" else None if v is None else shared[int(v.text)] if kind == "s" else v.text
            rows.append(line)
        out.append((name, rows))
    return out


@reader("xlsx")
def read_xlsx(data: bytes) -> list[dict]:
    return [b for name, rows in xlsx_sheets(data) for b in sheet_blocks(name, rows)]


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


@reader("docx")
def read_docx(data: bytes) -> list[dict]:
    """Paragraphs with their heading path and tables as markdown, from the document's XML."""
    z = zipfile.ZipFile(io.BytesIO(data))
    body = ET.fromstring(z.read("word/document.xml")).find(_W + "body")
    text = lambda e: "".join(t.text or "" for t in e.iter(_W + "t"))
    out, stack = [], []
    for e in body:
        if e.tag == _W + "tbl":
            rows = [[text(c).strip() for c in r.iter(_W + "tc")] for r in e.iter(_W + "tr")]
            if rows:
                out.append(_block(markdown_table(rows[0], rows[1:]), "table", path=[t for _, t in stack]))
        elif e.tag == _W + "p" and text(e).strip():
            style = e.find(f"{_W}pPr/{_W}pStyle")
            m = re.match(r"(?:Heading|Titolo|heading )\s*(\d)", style.get(_W + "val") or "") if style is not None else None
            if m:
                stack = [s for s in stack if s[0] < int(m[1])]
                out.append(_block(text(e).strip(), "heading", path=[t for _, t in stack]))
                stack.append((int(m[1]), text(e).strip()))
            else:
                out.append(_block(text(e).strip(), path=[t for _, t in stack]))
    return out


def docx_images(data: bytes) -> list[dict]:
    """{name, data, size, alt} of the embedded images, each once; alt is what the document says of the image."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    target = {}
    if "word/_rels/document.xml.rels" in names:
        target = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("word/_rels/document.xml.rels"))}
    alt: dict[str, str] = {}
    for drawing in ET.fromstring(z.read("word/document.xml")).iter(_W + "drawing"):
        said = next((e.get("descr") or e.get("title") or "" for e in drawing.iter() if e.tag.endswith("}docPr")), "")
        for e in drawing.iter():
            for k, v in e.attrib.items():
                if k.endswith("}embed") and v in target:
                    alt.setdefault("word/" + target[v].lstrip("/").removeprefix("word/"), said)
    return [{"name": n.rsplit("/", 1)[-1], "data": z.read(n), "size": z.getinfo(n).file_size, "alt": alt.get(n, "")} for n in sorted(names) if n.startswith("word/media/")]


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, name, alt, size, data of the images of all DOCX files under `path`; files are read on the executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [{"path": p, "name": i["name"], "alt": i["alt"], "size": i["size"], "data": i["data"]} for p, data in zip(pdf["path"], pdf["content"]) for i in docx_images(bytes(data))]
            if rows:
                yield pd.DataFrame(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, name string, alt string, size long, data binary")


class _Page(HTMLParser):
    def __init__(self, drop_tags: set[str], drop_classes: set[str], keep_tags: set[str], drop_selectors: tuple[str, ...] = ()):
        super().__init__(convert_charrefs=True)
        self.drop_tags, self.drop_classes, self.keep_tags = drop_tags, drop_classes, keep_tags
        self.rules = [_selector(s) for s in drop_selectors]
        self.open: list[tuple[str, bool, bool]] = []
        self.blocks: list[str] = []
        self.tables: list[list[list[str]]] = []
        self.title, self.text = "", ""

    def flush(self) -> None:
        t = " ".join(self.text.split())
        if t and (not self.blocks or self.blocks[-1] != t):
            self.blocks.append(t)
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "hr", "p", "div", "li", "tr", "h1", "h2", "h3", "h4", "table", "section", "article"):
            self.flush()
        if tag in ("br", "hr", "img", "input", "meta", "link"):
            return
        own = dict(attrs)
        classes = set((own.get("class") or "").split())
        named = any((not t or t == tag) and (not i or i == own.get("id")) and c <= classes for t, i, c in self.rules)
        dropped = (self.open and self.open[-1][1]) or tag in self.drop_tags or bool(classes & self.drop_classes) or named
        kept = (bool(self.open) and self.open[-1][2]) or not self.keep_tags or tag in self.keep_tags
        self.open.append((tag, bool(dropped), kept))
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.tables[-1][-1].append("")

    def handle_endtag(self, tag):
        if tag in ("p", "div", "li", "tr", "h1", "h2", "h3", "h4", "table", "section", "article", "td", "th"):
            self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        tags = [t for t, _, _ in self.open]
        if "title" in tags:
            self.title = self.title or " ".join(data.split())
        elif not (self.open and (self.open[-1][1] or not self.open[-1][2])) and not {"script", "style"} & set(tags):
            self.text += data
            if {"td", "th"} & set(tags) and self.tables and self.tables[-1] and self.tables[-1][-1]:
                self.tables[-1][-1][-1] = " ".join((self.tables[-1][-1][-1] + " " + data).split())


def _selector(text: str) -> tuple[str, str, set[str]]:
    """(tag, id, classes) of a simple selector such as div#menu.wide; each may be missing."""
    m = re.fullmatch(r"\s*([a-zA-Z][\w-]*|\*)?((?:[#.][\w-]+)*)\s*", text)
    if not m or not (m[1] or m[2]):
        raise ValueError(f"selector {text!r}")
    marks = re.findall(r"([#.])([\w-]+)", m[2])
    return ("" if m[1] in (None, "*") else m[1].lower()), next((v for k, v in marks if k == "#"), ""), {v for k, v in marks if k == "."}


def page(html: str, drop_tags=(), drop_classes=(), keep_tags=(), drop_selectors=()) -> _Page:
    p = _Page(set(drop_tags), set(drop_classes), set(keep_tags), tuple(drop_selectors))
    p.feed(html)
    p.flush()
    return p


def html_transform(html: str | None, drop_tags=(), drop_classes=(), keep_tags=(), drop_selectors=()) -> str:
    """Text of a page, a line a block, without comments and the named tags, classes and selectors, repeated
    neighbours once; with `keep_tags`, of these only."""
    return "\n".join(page(html, drop_tags, drop_classes, keep_tags, drop_selectors).blocks) if html else ""


def html_tables(html: str | None) -> list[dict]:
    """{table_index, col_names, text} of each table with text of ten characters or more."""
    out = []
    for i, rows in enumerate(page(html).tables if html else []):
        rows = [r for r in rows if any(r)]
        if rows:
            width = max(map(len, rows))
            rows = [r + [""] * (width - len(r)) for r in rows]
            text = markdown_table(rows[0], rows[1:])
            if len(text) >= 10:
                out.append({"table_index": i, "col_names": rows[0], "text": text})
    return out


_FRAME = ("nav", "footer", "header", "aside", "form", "menu", "button", "select")
_BODY = ("p", "h1", "h2", "h3", "h4", "li", "td", "th", "blockquote", "pre")


def page_text(html: str | None, enough: int = 500, least: int = 100) -> str | None:
    """A page's text: paragraphs, headings, items and cells outside its frame; where that is under `enough`
    characters, the longer of it and of all text outside scripts; nothing under `least`."""
    if not html:
        return None
    precise = html_transform(html, drop_tags=_FRAME, keep_tags=_BODY)
    if len(precise) < enough:
        precise = max(precise, html_transform(html), key=len)
    return precise if len(precise) >= least else None


def extracted(kind: str, name: str, data: bytes) -> dict:
    """One document in its common form: type, title (the first heading, else the file's name), resource, tags, extra and blocks."""
    blocks = READERS[kind](data)
    title = next((b["content"] for b in blocks if b["block_type"] == "heading"), name.rsplit("/", 1)[-1].rsplit(".", 1)[0])
    return {"type": kind, "title": title, "description": "", "resource": name, "tags": [], "extra": {"blocks": str(len(blocks))}, "blocks": blocks}


@reader("html", "url")
def read_html(data: bytes) -> list[dict]:
    p = page(data.decode("utf-8", "replace"))
    return ([_block(p.title, "heading")] if p.title else []) + [_block(b) for b in p.blocks]


@reader("txt", "md")
def read_text(data: bytes) -> list[dict]:
    return [_block(data.decode("utf-8", "replace"))]


def read_files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """path, order, content, block_type, page, heading_path of all files under `path`; files are read on the executors."""
    parse = READERS[kind]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [{"path": p, "order": i, **b} for p, data in zip(pdf["path"], pdf["content"]) for i, b in enumerate(parse(bytes(data)))]
            if rows:
                yield pd.DataFrame(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, order int, content string, block_type string, page int, heading_path array<string>")


# ---- documents with front matter ----

_MARK = re.compile(r"<!-- block (\{.*?\}) -->\n")


def to_markdown(front: dict, blocks: list[dict]) -> str:
    """Front matter and blocks; `from_markdown` gives both back."""
    head = "---\n" + "".join(f"{k}: {json.dumps(v, ensure_ascii=False)}\n" for k, v in front.items()) + "---\n"
    body = ""
    for b in blocks:
        meta = {k: v for k, v in b.items() if k != "content"}
        body += f"<!-- block {json.dumps(meta, ensure_ascii=False)} -->\n{b['content']}\n"
    return head + body


def from_markdown(text: str) -> tuple[dict, list[dict]]:
    m = re.match(r"---\n(.*?)---\n", text, re.S)
    front = {k: json.loads(v) for k, _, v in (line.partition(": ") for line in m[1].splitlines())} if m else {}
    parts = _MARK.split(text[m.end() :] if m else text)
    if len(parts) == 1:
        return front, [_block(parts[0])] if parts[0].strip() else []
    return front, [{"content": c[:-1] if c.endswith("\n") else c, **json.loads(meta)} for meta, c in zip(parts[1::2], parts[2::2])]


# ---- snapshots ----


def save_snapshot(df: DataFrame, path: str, stamp: str, *partition_by: str) -> None:
    """One snapshot of a table: path/snapshot_ts=stamp, replaced if it is there. All snapshots of a path are partitioned alike."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{path}/snapshot_ts={stamp}")


def load_snapshot(spark: SparkSession, path: str, stamp: str | None = None) -> DataFrame:
    """A snapshot, the latest by default; only its directory is read."""
    stamp = stamp or next(iter(list_snapshots(spark, path)))
    return spark.read.parquet(f"{path}/snapshot_ts={stamp}")


def row_buckets(rows: DataFrame, order: str, each: int, by: list[str]) -> DataFrame:
    """`rows` with bucket: runs of `each` rows in order within `by`."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("bucket", F.floor((F.row_number().over(w) - 1) / each))


# ---- tables, conversions, artefacts ----


def csv_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file or folder as rows: split and read by all executors, with a header line."""
    r = spark.read.option("header", True).option("mode", "PERMISSIVE")
    return (r.schema(schema) if schema else r).csv(path)


def cell_text(v: object) -> str:
    s = "" if v is None else str(v)
    return '"' + s.replace('"', '""') + '"' if re.search(r'[",\n\r]', s) else s


def xlsx_to_csv(data: bytes) -> dict[str, str]:
    """Each sheet of a workbook as CSV text, all its rows, by name."""
    return {name: "".join(",".join(cell_text(c) for c in row) + "\n" for row in rows) for name, rows in xlsx_sheets(data)}


def xlsx_of(sheets: dict[str, list[list[object]]]) -> bytes:
    """A workbook with inline strings and numbers: results rendered at the edge."""
    from xml.sax.saxutils import escape

    def column(i: int) -> str:
        out = ""
        i += 1
        while i:
            i, r = divmod(i - 1, 26)
            out = chr(65 + r) + out
        return out

    def cell(r: int, i: int, v: object) -> str:
        if v is None:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{column(i)}{r}"><v>{v}</v></c>'
        return f'<c r="{column(i)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    main, out = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", io.BytesIO()
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + kinds + "</Types>")
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            lines = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{lines}</sheetData></worksheet>')
    return out.getvalue()


_PDF_TEXT = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|T[*dD]|'|\"|ET|T[jJ]")
_PDF_ESCAPE = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_pages(data: bytes) -> list[str]:
    """Text of the pages of a PDF with plain or deflated content streams and Latin encodings.

    Pages whose fonts have encodings of their own, and scanned ones, come out empty or short: they
    are for recognition, which is a hook.
    """
    import zlib

    objects = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.S)}

    def stream(body: bytes) -> bytes:
        m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
        if not m:
            return b""
        try:
            return zlib.decompress(m[1]) if b"FlateDecode" in body else m[1]
        except zlib.error:
            return b""

    def literal(token: bytes) -> str:
        if token[:1] == b"<":
            raw = bytes.fromhex(re.sub(rb"\s", b"", token[1:-1]).decode() + "0" * (len(re.sub(rb"\s", b"", token[1:-1])) % 2))
        else:
            raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _PDF_ESCAPE.get(m[1], m[1]), token[1:-1], flags=re.S)
        return raw.decode("utf-16-be", "replace")[1:] if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")

    out = []
    for number in sorted(objects):
        body = objects[number]
        if not re.search(rb"/Type\s*/Page\b(?!s)", body):
            continue
        content = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        text = ""
        for ref in re.findall(rb"(\d+)\s+\d+\s+R", content[1]) if content else []:
            for token in _PDF_TEXT.findall(stream(objects.get(int(ref), b""))):
                if token[:1] in b"(<":
                    text += literal(token)
                elif token in (b"T*", b"Td", b"TD", b"'", b'"', b"ET") and text and not text.endswith("\n"):
                    text += "\n"
        out.append("\n".join(" ".join(line.split()) for line in text.split("\n")).strip())
    return out


@reader("pdf")
def read_pdf(data: bytes) -> list[dict]:
    """A block for each page that has text."""
    return [_block(t, page=i) for i, t in enumerate(pdf_pages(data), 1) if t]


def put_file(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file in the shared folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


class Artefacts:
    """Files by namespace, index, kind and time under one path: base/namespace=/index=/kind=/ts=/name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, namespace: str, index: str, kind: str, ts: str, name: str, data: bytes) -> None:
        put_file(self.spark, f"{self.path}/namespace={namespace}/index={index}/kind={kind}/ts={ts}/{name}", data)

    def list(self, namespace: str | None = None, index: str | None = None, kind: str | None = None) -> DataFrame:
        """namespace, index, kind, ts, name, size, path; directories that the filters exclude aren't listed."""
        part = lambda k, v: f"{k}={v or '*'}"
        glob = "/".join([self.path, part("namespace", namespace), part("index", index), part("kind", kind), "*"])
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(glob).select("path", "length")
        field = lambda k: F.regexp_extract("path", rf"/{k}=([^/]*)/", 1).alias(k)
        return files.select(*map(field, ("namespace", "index", "kind", "ts")), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "path")

    def latest(self, namespace: str, index: str, kind: str) -> str | None:
        return self.list(namespace, index, kind).agg(F.max("ts")).first()[0]

    def get(self, namespace: str, index: str, kind: str, ts: str | None = None) -> DataFrame:
        """name, content of the files of one time, the latest by default."""
        ts = ts or self.latest(namespace, index, kind)
        files = self.spark.read.format("binaryFile").load(f"{self.path}/namespace={namespace}/index={index}/kind={kind}/ts={ts}")
        return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def delete(self, namespace: str, index: str | None = None, kind: str | None = None) -> None:
        parts = [self.path, f"namespace={namespace}", *([f"index={index}"] if index else []), *([f"kind={kind}"] if index and kind else [])]
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join(parts))
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def list_snapshots(spark: SparkSession, path: str) -> list[str]:
    """Times of the snapshots of a path, the latest first; directories are listed, no file is read."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted((n.partition("=")[2] for n in names if n.startswith("snapshot_ts=")), reverse=True)


def save_graph(entities: DataFrame, relationships: DataFrame, reports: DataFrame, path: str, namespace: str, index: str, stamp: str) -> None:
    """One snapshot of a graph: a folder each for entities, relationships and reports, by namespace and index."""
    for name, df in (("entities", entities), ("relationships", relationships), ("reports", reports)):
        save_snapshot(df, f"{path}/{namespace}/{index}/{name}", stamp)


def load_graph(spark: SparkSession, path: str, namespace: str, index: str, stamp: str | None = None) -> dict[str, DataFrame]:
    return {name: load_snapshot(spark, f"{path}/{namespace}/{index}/{name}", stamp) for name in ("entities", "relationships", "reports")}
