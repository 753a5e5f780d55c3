"""Problem 6: the whole corpus as ids of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, vocabulary_path


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """`key` and the ids of `text`, one row per row of `docs`; no shuffle.

    Null and empty texts give an empty list, special-token strings are ordinary text,
    repeated rows stay repeated, other columns are neither read nor clash (`key` and
    `text` are the only ones selected). The vocabulary file at `path` must exist on
    every executor; each Python worker loads it once.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            texts, n = batch.column(1), batch.num_rows
            for i in range(0, n, 512):  # small output batches: ids take several times the memory of the text
                part = [encode(t) for t in texts.slice(i, 512).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 512), pa.array(part, pa.list_(pa.int32()))], [key, out])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).alias("__text")).mapInArrow(run, f"`{key}` {kind}, `{out}` array<int>")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """`key` and `tokens` (int) of each row; 0 for null and empty texts."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path).count
        for batch in batches:
            sizes = pa.array([count(t.as_py()) for t in batch.column(1)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes], [key, "tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).alias("__text")).mapInArrow(run, f"`{key}` {kind}, tokens int")
