"""Documents as laid-out elements: reading order, section trees, chunks that know their section, routing by kind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karst.functions import text as T
from karst.operators import chunking as C

ORDER = ["page", "seq", "element_id"]


def reading_order(elements: DataFrame) -> DataFrame:
    """`elements` with place: the position in their document by page, sequence and id."""
    return elements.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(*ORDER)))


def section_tree(elements: DataFrame, header: Column, level: Column) -> DataFrame:
    """Sections of each document: section_id, doc_id, title, level, place, parent_id, depth.

    elements: doc_id, element_id, text, place. A header's parent is the last header before it of
    a lower level. Levels go from 1 to 6; a parent is one of at most five last headers, so
    windows say it, and the depth is the number of levels open above.
    """
    heads = elements.where(header).select("doc_id", F.col("element_id").alias("section_id"), F.col("text").alias("title"), F.least(F.greatest(level, F.lit(1)), F.lit(6)).cast("int").alias("level"), "place")
    before = Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda i: F.last(F.when(F.col("level") <= i, F.struct("place", "section_id", F.col("level").alias("l"))), ignorenulls=True).over(before)
    out = heads.withColumns({f"__b{i}": last(i) for i in range(1, 6)})
    parent = F.lit(None).cast("struct<place:int,section_id:string,l:int>")
    for i in range(1, 6):  # the last header of a lower level
        parent = F.when(F.col("level") == i + 1, F.col(f"__b{i}")).otherwise(parent)
    out = out.withColumn("__p", parent)
    # open levels above: each level whose last header stands behind the last one of any lower level
    opened = F.lit(0)
    for i in range(1, 6):
        own = F.last(F.when(F.col("level") == i, F.col("place")), ignorenulls=True).over(before)
        lower = F.last(F.when(F.col("level") < i, F.col("place")), ignorenulls=True).over(before)
        opened = opened + F.when((F.col("level") > i) & own.isNotNull() & (own > F.coalesce(lower, F.lit(-1))), 1).otherwise(0)
    return out.select("doc_id", "section_id", "title", "level", "place", F.col("__p.section_id").alias("parent_id"), opened.alias("depth"))


def in_section(elements: DataFrame, header: Column) -> DataFrame:
    """`elements` with section_id: the last header at or before them, null before the first."""
    w = Window.partitionBy("doc_id").orderBy("place")
    return elements.withColumn("section_id", F.last(F.when(header, F.col("element_id")), ignorenulls=True).over(w))


def section_graph(elements: DataFrame, sections: DataFrame) -> DataFrame:
    """Edges src, dst, type of a document's structure: section to parent (PART_OF), element to section (IN_SECTION),
    element to the section whose title begins with the number it names (REFERS_TO)."""
    a = sections.where("parent_id is not null").select(F.col("section_id").alias("src"), F.col("parent_id").alias("dst"), F.lit("PART_OF").alias("type"))
    b = elements.where("section_id is not null and section_id <> element_id").select(F.col("element_id").alias("src"), F.col("section_id").alias("dst"), F.lit("IN_SECTION").alias("type"))
    numbers = F.transform(F.regexp_extract_all("text", F.lit(r"(?i)\b(?:section|sezione|sección)\s+(\d+(?:\.\d+)*)"), F.lit(1)), lambda x: x)
    named = elements.select("doc_id", F.col("element_id").alias("src"), F.explode(F.array_distinct(numbers)).alias("number"))
    titled = sections.select("doc_id", F.col("section_id").alias("dst"), F.regexp_extract("title", r"^\s*(\d+(?:\.\d+)*)", 1).alias("number")).where("number <> ''")
    c = named.join(titled, ["doc_id", "number"]).select("src", "dst", F.lit("REFERS_TO").alias("type"))
    return a.unionByName(b).unionByName(c).distinct()


def context_chunks(elements: DataFrame, most: int = 512) -> DataFrame:
    """doc_id, section_id, chunk_index, text, elements, page: the texts of a section in order, as many as `most`
    estimated tokens (a quarter of the characters) hold; a text over it is a chunk of its own.

    elements: doc_id, section_id, element_id, text, page, place. Sections are packed one by one in Arrow
    batches; a section is one group, so its texts should fit a task.
    """
    import pandas as pd

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, parts, size = [], [], 0
        for e in pdf.sort_values("place").itertuples():
            n = len(e.text) // 4
            if parts and size + n > most:
                rows.append(parts)
                parts, size = [], 0
            parts.append(e)
            size += n
        rows.append(parts)
        return pd.DataFrame({
            "doc_id": pdf["doc_id"].iloc[0], "section_id": pdf["section_id"].iloc[0], "chunk_index": range(len(rows)), "text": ["\n\n".join(e.text for e in r) for r in rows],
            "elements": [[e.element_id for e in r] for r in rows], "page": [r[0].page for r in rows],
        })

    some = elements.withColumn("text", F.trim("text")).where(F.length("text") > 0).withColumn("section_id", F.coalesce("section_id", F.lit("")))
    rows = some.select("doc_id", "section_id", "element_id", "text", F.coalesce("page", F.lit(0)).alias("page"), "place")
    return rows.groupBy("doc_id", "section_id").applyInPandas(pack, "doc_id string, section_id string, chunk_index int, text string, elements array<string>, page int")


def routed(rows: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 400, table_limit: int = 8000) -> DataFrame:
    """`key`, format, chunk_index, total_chunks, chunk: each text by its format, markdown by elements, pipe tables by
    rows, other text by separators."""

    def tabular(t: str) -> list[str]:
        tables, rest = C.pipe_tables(t)
        out = [c["text"] for x in tables for c in C.table_chunks(x["header"], x["rows"], "adaptive", table_limit)]
        return out + C.recursive_split("\n".join(rest), size, overlap)

    split: dict[str, Callable[[str], list[str]]] = {
        "markdown": lambda t: [c["text"] for c in C.markdown_chunks(t, size)], "tabular": tabular, "plain": lambda t: C.recursive_split(t, size, overlap),
    }
    kinds = rows.select(key, text, T.text_format(F.col(text)).alias("format")).where(F.col(text).isNotNull())
    parts = [C.exploded(kinds.where(F.col("format") == k), key, text, f).withColumn("format", F.lit(k)) for k, f in split.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
