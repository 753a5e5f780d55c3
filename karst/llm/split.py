"""Problem 5: items over a size limit, cut at natural boundaries.

A text is a tree: headings by depth, blocks between blank lines, lines and list items,
sentences, clauses, words, characters. Sibling subtrees are merged bottom-up while they
fit; only a node that is too large itself is descended into. The nodes tile the text,
so the new parts of the pieces, joined, are the text again.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEADING = re.compile(r"^(?:(#{1,6})[ \t]+\S|<h([1-6])\b|(\d{1,3}(?:\.\d{1,3}){0,4})[.)]?[ \t]+[^\W\d_][^\n]{0,78}[^\s.;:,!?]?[ \t]*$)", re.M | re.I)
_BLOCK = re.compile(r"\n[ \t\r]*\n\s*|(?<=>)\s*(?=<(?:p|div|section|article|table|ul|ol|h[1-6])\b)", re.I)
_LINE = re.compile(r"\r\n|\n|\r| | |(?<=>)(?=<(?:li|tr|td|br)\b)")
_SENTENCE = re.compile(r"(?<=[.!?…。！？])[\"'”’»)\]]*\s+|(?<=[。！？])")
_CLAUSE = re.compile(r"(?<=[;:,—])\s+")
_WORD = re.compile(r"\s+")


def _headings(text: str) -> list[list[int]]:
    """Start of each heading line, by depth 1 to 6."""
    found: list[list[int]] = [[] for _ in range(6)]
    for m in _HEADING.finditer(text):
        if m[3]:  # a numbered line counts as heading only if it stands alone
            before = text[max(0, m.start() - 2) : m.start()].replace("\r", "")
            after = text[m.end() : m.end() + 3].replace("\r", "")
            if (m.start() and before != "\n\n" and not before.endswith("\n\n")) or (after and not after.startswith("\n\n")):
                continue
        depth = len(m[1]) if m[1] else int(m[2]) if m[2] else min(6, 1 + m[3].count("."))
        found[depth - 1].append(m.start())
    return found


def boundaries(text: str) -> list[list[int]]:
    """Sorted positions at which each level of the tree may be cut, coarsest first."""
    levels = _headings(text)
    levels += [[m.end() for m in rule.finditer(text)] for rule in (_BLOCK, _LINE, _SENTENCE, _CLAUSE, _WORD)]
    return [x for x in levels if x]


def _tree(levels: list[list[int]], text: str, lo: int, hi: int, level: int, room: int) -> list[tuple[int, int]]:
    """Segments of [lo, hi), each within `room`.

    Whole siblings are merged while they fit; the parts of a node that was too large stay apart
    from its siblings, so no piece straddles the node's bounds.
    """
    if hi - lo <= room:
        return [(lo, hi)]
    while level < len(levels):
        cuts = levels[level]
        a, b = bisect_right(cuts, lo), bisect_left(cuts, hi)
        if a < b:
            break
        level += 1
    else:
        out = []
        while hi - lo > room:
            cut = lo + room
            while cut > lo + 1 and unicodedata.combining(text[cut]):  # not between a letter and its marks
                cut -= 1
            if cut == lo + 1 and room > 1:
                cut = lo + room
            out.append((lo, cut))
            lo = cut
        return [*out, (lo, hi)]
    out: list[tuple[int, int]] = []
    start = at = lo  # of the siblings merged so far, and where they end
    for end in [*cuts[a:b], hi]:
        if end - start > room:
            if at > start:
                out.append((start, at))
                start = at
            if end - start > room:
                out += _tree(levels, text, start, end, level + 1, room)
                start = end
        at = end
    return [*out, (start, hi)] if start < hi else out


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, new_from, end) of each piece, in code points.

    text[start:end] is the piece, of at most `limit`; text[new_from:end] is what the
    piece before doesn't have, and start = new_from - overlap but for the first piece.
    An overlap that leaves no room is reduced to limit - 1; a negative one is 0. A text
    within the limit is one piece.
    """
    overlap = max(0, min(overlap, limit - 1))
    if len(text) <= limit:
        return [(0, 0, len(text))]
    spans = _tree(boundaries(text), text, 0, len(text), 0, limit - overlap)
    return [(max(0, a - overlap), a, b) for a, b in spans]


def limits(settings: DataFrame) -> DataFrame:
    """namespace, item_kind, max_chars, overlap_chars; `*` is the default of a kind.

    Of repeated rows the smallest value counts; a value under 1 (0 for the overlap) is
    taken as missing.
    """
    return settings.groupBy("namespace", "item_kind").agg(
        F.min(F.when(F.col("max_chars") >= 1, F.col("max_chars").cast("int"))).alias("max_chars"),
        F.min(F.when(F.col("overlap_chars") >= 0, F.col("overlap_chars").cast("int"))).alias("overlap_chars"),
    )


def oversized(items: DataFrame, settings: DataFrame) -> DataFrame:
    """Rows of `items` (item_kind, item_id, namespace, text) over their limit, with
    max_chars and overlap_chars. Null texts and kinds without any limit give no row."""
    # one row a namespace and kind: configuration, of a size that doesn't follow the corpus
    by_kind = limits(settings)
    default = by_kind.where("namespace = '*'").select("item_kind", F.col("max_chars").alias("__m"), F.col("overlap_chars").alias("__o"))
    own = by_kind.where("namespace <> '*'")
    out = items.select("item_kind", "item_id", "namespace", "text").join(own, ["namespace", "item_kind"], "left").join(default, "item_kind", "left")
    out = out.withColumns({"max_chars": F.coalesce("max_chars", "__m"), "overlap_chars": F.coalesce("overlap_chars", "__o", F.lit(0))})
    return out.where(F.length("text") > F.col("max_chars")).select("item_kind", "item_id", "text", "max_chars", "overlap_chars")


def split_oversized(items: DataFrame, settings: DataFrame) -> DataFrame:
    """item_kind, item_id, piece_no (from 0), start, new_from, end, piece of every oversized item.

    A repeated key is split once. Texts reach Python only if they are over the limit.
    """
    big = oversized(items, settings).dropDuplicates(["item_kind", "item_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for kind, item, text, limit, overlap in zip(*(c.to_pylist() for c in batch.columns)):
                for n, (start, new, end) in enumerate(pieces(text, limit, overlap)):
                    rows.append((kind, item, n, start, new, end, text[start:end]))
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.string(), pa.string(), *[pa.int32()] * 4, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    names = ["item_kind", "item_id", "piece_no", "start", "new_from", "end", "piece"]
    return big.mapInArrow(run, "item_kind string, item_id string, piece_no int, start int, new_from int, `end` int, piece string")


def stored_items(chunks: DataFrame, page_bodies: DataFrame) -> DataFrame:
    """Chunks and page bodies as items of `split_oversized`."""
    a = chunks.select(F.lit("chunk").alias("item_kind"), F.col("id").alias("item_id"), "namespace", "text")
    b = page_bodies.select(F.lit("page_body").alias("item_kind"), F.col("body_id").alias("item_id"), "namespace", F.col("body").alias("text"))
    return a.unionByName(b)
