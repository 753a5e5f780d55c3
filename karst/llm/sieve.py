"""A filter of fixed size for the keys of a join.

Where few rows of a large table have a partner, moving all of them to meet it is waste. The
keys of the other side set bits in a table of 2^20 words of 64 bits, which is broadcast: a
million rows at most, however many keys there are. Rows whose bit isn't set have no partner.
With very many keys the filter lets more rows through, and the exact join that follows
decides, so the result is the same at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BITS = 20


def _word(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - WORD_BITS)


def _bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))


def sieve(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose `key` may be in the column of that name of `keys`: none that is in it is lost.

    Null keys have no partner and are dropped.
    """
    h = F.xxhash64(F.col(key))
    bits = keys.where(F.col(key).isNotNull()).select(_word(h).alias("__word"), _bit(h).alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    marked = rows.where(F.col(key).isNotNull()).withColumns({"__word": _word(h), "__bit": _bit(h)})
    found = marked.join(F.broadcast(bits), "__word").where(F.col("__bits").bitwiseAND(F.col("__bit")) != 0)  # 2^20 rows at most
    return found.drop("__word", "__bit", "__bits")
