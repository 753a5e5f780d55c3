"""Cutting documents into chunks: plain, semantic, tables, markdown, sections.

One document is parsed in one call; all of these are per-row table functions over Arrow
batches, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def recursive_split(text: str, size: int = 1000, overlap: int = 400, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most `size` characters, cut at the first separator that gives small enough parts;
    each starts with whole parts of the end of the one before, at most `overlap` characters."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the size")
    if len(text) <= size:
        return [text] if text.strip() else []

    def atoms(t: str, level: int) -> list[str]:
        if len(t) <= size - overlap or level >= len(separators):
            return [t]
        mark = separators[level]
        if mark == "":
            step = size - overlap
            return [t[i : i + step] for i in range(0, len(t), step)]
        parts = t.split(mark)
        kept = [p + mark for p in parts[:-1]] + [parts[-1]]
        return [a for p in kept if p for a in atoms(p, level + 1)]

    out: list[str] = []
    window: list[str] = []
    length = 0
    for a in atoms(text, 0):
        if length + len(a) > size and window:
            out.append("".join(window).strip())
            while window and (length > overlap or length + len(a) > size):
                length -= len(window.pop(0))
        window.append(a)
        length += len(a)
    if window:
        out.append("".join(window).strip())
    return [c for c in out if c]


def exploded(rows: DataFrame, key: str, text: str, f: Callable[[str], list[str]], name: str = "chunk") -> DataFrame:
    """`key`, chunk_index, total_chunks, `name` for each piece that `f` makes of a text; null texts give none."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, index, total, parts = [], [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pieces = f(t) if t else []
                keys += [k] * len(pieces)
                index += range(len(pieces))
                total += [len(pieces)] * len(pieces)
                parts += pieces
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(index, pa.int32()), pa.array(total, pa.int32()), pa.array(parts, pa.string())], [key, "chunk_index", "total_chunks", name])

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, chunk_index int, total_chunks int, {name} string")


def char_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of `size` characters that start `size - overlap` apart, inside the JVM."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(F.length(text) > 0, F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def delimited(text: Column, pattern: str, group: int = 1) -> Column:
    """Trimmed matches of a group of a DOTALL pattern; the whole text where none matches."""
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit("(?s)" + pattern), F.lit(group)), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(text))


def situated(text: Column, context: Column, mode: str = "prefix") -> Column:
    """Struct (text, context) of a chunk with what situates it: before the text, or beside it only. `context` is any
    expression, a language model's answer too; null and blank ones change nothing."""
    if mode not in ("prefix", "metadata"):
        raise ValueError(f"mode {mode!r}")
    said = F.when(F.length(F.trim(context)) > 0, context)
    whole = F.concat_ws("\n\n", said, text) if mode == "prefix" else text
    return F.struct(whole.alias("text"), said.alias("context"))


def delimited_pairs(text: Column, pattern: str) -> Column:
    """Structs (id, content) of a DOTALL pattern with two groups; the whole text without id where none matches."""
    of = lambda g: F.regexp_extract_all(text, F.lit("(?s)" + pattern), F.lit(g))
    found = F.filter(F.transform(F.arrays_zip(of(1).alias("a"), of(2).alias("b")), lambda x: F.struct(F.trim(x.a).alias("id"), F.trim(x.b).alias("content"))), lambda x: x.content != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("id"), text.alias("content"))))


def semantic_breaks(parts: DataFrame, key: str, order: str, distance: str, percentile: float = 0.95, strategy: str = "percentile", amount: float | None = None) -> DataFrame:
    """`parts` with segment (from 0): a new one where the distance to the part before passes the document's limit.

    The limit is the percentile; the mean and `amount` (3) standard deviations; the mean and
    `amount` (1.5) interquartile ranges; or, for gradient, the percentile of the distances' slopes, which are
    then compared in their place.
    """
    doc = Window.partitionBy(key)
    at = lambda q, c: F.percentile(c, F.lit(q)).over(doc)
    value = F.col(distance)
    if strategy == "gradient":
        w = doc.orderBy(order)
        before, after = F.lag(distance).over(w), F.lead(distance).over(w)
        slope = F.when(before.isNotNull() & after.isNotNull(), (after - before) / 2).when(after.isNotNull(), after - value).otherwise(value - before)
        parts = parts.withColumn("__slope", F.when(value.isNotNull(), slope))
        value = F.col("__slope")
    limits = {
        "percentile": lambda: at(percentile, value), "gradient": lambda: at(percentile, value),
        "standard_deviation": lambda: F.avg(value).over(doc) + (3.0 if amount is None else amount) * F.stddev_pop(value).over(doc),
        "interquartile": lambda: F.avg(value).over(doc) + (1.5 if amount is None else amount) * (at(0.75, value) - at(0.25, value)),
    }
    if strategy not in limits:
        raise ValueError(f"strategy {strategy!r} is none of {sorted(limits)}")
    new = F.coalesce((value > F.col("__cut")).cast("int"), F.lit(0))
    return parts.withColumn("__cut", limits[strategy]()).withColumn("segment", F.sum(new).over(doc.orderBy(order))).drop("__cut", "__slope")


# ---- pipe tables ----

_RULE = re.compile(r"^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|?\s*$")


def cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def pipe_tables(text: str) -> tuple[list[dict], list[str]]:
    """(tables, other lines). A table is a header, a rule and the rows of the header's width below;
    lines that don't fit are kept as text."""
    lines, tables, rest, i = text.split("\n"), [], [], 0
    while i < len(lines):
        if "|" in lines[i] and i + 1 < len(lines) and _RULE.match(lines[i + 1]) and "|" in lines[i + 1]:
            header, rows, k = cells(lines[i]), [], i + 2
            while k < len(lines) and "|" in lines[k] and len(cells(lines[k])) == len(header):
                rows.append(cells(lines[k]))
                k += 1
            tables.append({"header": header, "rows": rows, "line": i})
            i = k
        else:
            rest.append(lines[i])
            i += 1
    return tables, rest


def markdown_table(header: list[str], rows: list[list[str]]) -> str:
    return "\n".join("| " + " | ".join(r) + " |" for r in [header, ["---"] * len(header), *rows])


def table_chunks(header: list[str], rows: list[list[str]], strategy: str = "adaptive", limit: int = 8000) -> list[dict]:
    """Chunks {text, start, end_inclusive} of a table.

    atomic: one chunk; per_row: a chunk a row; adaptive: as many rows as fit `limit`
    characters, the header repeated. Every row is in exactly one chunk; a table without
    rows is one chunk of its header.
    """
    if strategy not in ("atomic", "per_row", "adaptive"):
        raise ValueError(f"strategy {strategy!r}")
    if not rows:
        return [{"text": markdown_table(header, []), "start": 0, "end_inclusive": -1}]
    head = len(markdown_table(header, []))
    groups: list[list[int]] = []
    size = head
    for i, r in enumerate(rows):
        width = len("| " + " | ".join(r) + " |") + 1
        if groups and (strategy == "atomic" or (strategy == "adaptive" and size + width <= limit)):
            groups[-1].append(i)
            size += width
        else:
            groups.append([i])
            size = head + width
    return [{"text": markdown_table(header, [rows[i] for i in g]), "start": g[0], "end_inclusive": g[-1]} for g in groups]


# ---- markdown ----


def markdown_elements(text: str) -> list[dict]:
    """Elements {type, text, start, end, level, path}: heading, code, table, list, quote, image, rule, paragraph.

    Line spans are inclusive; `path` holds the headings above, outermost first.
    """
    lines, out, i = text.split("\n"), [], 0
    stack: list[tuple[int, str]] = []

    def put(kind: str, start: int, end: int, level: int = 0) -> None:
        out.append({"type": kind, "text": "\n".join(lines[start : end + 1]), "start": start, "end": end, "level": level, "path": [t for _, t in stack]})

    while i < len(lines):
        line, start = lines[i], i
        if not line.strip():
            i += 1
            continue
        if m := re.match(r"^(#{1,6})\s+(.+?)\s*#*\s*$", line):
            level = len(m[1])
            stack = [s for s in stack if s[0] < level]
            put("heading", i, i, level)
            stack.append((level, m[2]))
        elif line.lstrip().startswith("```"):
            i += 1
            while i < len(lines) and not lines[i].lstrip().startswith("```"):
                i += 1
            put("code", start, min(i, len(lines) - 1))
        elif "|" in line and i + 1 < len(lines) and _RULE.match(lines[i + 1]) and "|" in lines[i + 1]:
            while i + 1 < len(lines) and "|" in lines[i + 1]:
                i += 1
            put("table", start, i)
        elif re.match(r"^\s*!\[[^\]]*\]\([^)]*\)\s*$", line):
            put("image", i, i)
        elif re.match(r"^\s*([-*_])(\s*\1){2,}\s*$", line):
            put("rule", i, i)
        else:
            kind = "list" if re.match(r"^\s*([-*+•]|\d+[.)])\s+", line) else "quote" if line.lstrip().startswith(">") else "paragraph"
            while i + 1 < len(lines) and lines[i + 1].strip() and not re.match(r"^(#{1,6}\s|\s*```|\s*!\[)", lines[i + 1]):
                nxt = "list" if re.match(r"^\s*([-*+•]|\d+[.)])\s+", lines[i + 1]) else "quote" if lines[i + 1].lstrip().startswith(">") else "paragraph"
                if (nxt != kind and kind == "paragraph") or ("|" in lines[i + 1] and i + 2 < len(lines) and _RULE.match(lines[i + 2])):
                    break
                i += 1
            put(kind, start, i)
        i += 1
    return out


def markdown_chunks(text: str, size: int = 1000, least: int = 100, table_limit: int = 30_000) -> list[dict]:
    """Elements grouped up to `size` characters within a heading path; tables alone, split over
    `table_limit`; a chunk under `least` joins the one before of the same section."""
    out: list[dict] = []
    for e in markdown_elements(text):
        if e["type"] == "table" and len(e["text"]) > table_limit:
            found, _ = pipe_tables(e["text"])
            out += [{"text": c["text"], "path": e["path"], "type": "table"} for t in found for c in table_chunks(t["header"], t["rows"], "adaptive", table_limit)]
            continue
        path = e["path"] + ([re.sub(r"^#+\s*|\s*#+$", "", e["text"])] if e["type"] == "heading" else [])
        last = out[-1] if out else None
        if last and last["type"] != "table" and e["type"] != "table" and last["path"] == path and (len(last["text"]) + len(e["text"]) + 2 <= size or len(e["text"]) < least):
            last["text"] += "\n\n" + e["text"]
        else:
            out.append({"text": e["text"], "path": path, "type": e["type"]})
    return out


def sections(text: str, depth: int = 2, size: int = 1000) -> list[dict]:
    """A chunk a heading of at most `depth` levels, with all below it; one over twice `size` is split."""
    out: list[dict] = []
    title: list[str] = []
    body: list[str] = []

    def close() -> None:
        t = "\n\n".join(body)
        if t.strip():
            parts = [t] if len(t) <= 2 * size else recursive_split(t, size, 0)
            out.extend({"path": list(title), "text": p} for p in parts)

    for e in markdown_elements(text):
        if e["type"] == "heading" and e["level"] <= depth:
            close()
            title, body = e["path"] + [e["text"].lstrip("#").strip()], [e["text"]]
        else:
            body.append(e["text"])
    close()
    return out


def heading_paths(lines: DataFrame, key: str, order: str, level: str, title: str) -> DataFrame:
    """`lines` with path: the last heading of each level above a line, deeper ones forgotten when a higher one comes.

    Window functions only; a document's lines are one bounded group.
    """
    w = Window.partitionBy(key).orderBy(order)
    marks = [F.last(F.when(F.col(level) == i, F.struct(F.col(order).alias("at"), F.col(title).alias("t"))), ignorenulls=True).over(w) for i in range(1, 7)]
    out = lines.withColumns({f"__h{i}": m for i, m in enumerate(marks, 1)})
    above = lambda i: F.greatest(F.lit(-1).cast("long"), F.lit(-1).cast("long"), *(F.coalesce(F.col(f"__h{j}.at").cast("long"), F.lit(-1).cast("long")) for j in range(1, i)))
    kept = [F.when(F.col(f"__h{i}.at").cast("long") > above(i), F.col(f"__h{i}.t")) for i in range(1, 7)]
    return out.withColumn("path", F.filter(F.array(*kept), lambda x: x.isNotNull())).drop(*(f"__h{i}" for i in range(1, 7)))
