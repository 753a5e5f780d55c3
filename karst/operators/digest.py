"""Calendar windows and hierarchical digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_of(day: Column, granularity: str) -> tuple[Column, Column]:
    """First and last day of the window a day is in: daily, weekly (Monday to Sunday) or monthly."""
    if granularity == "daily":
        return day, day
    if granularity == "weekly":
        first = F.date_trunc("week", day).cast("date")
        return first, F.date_add(first, 6)
    if granularity == "monthly":
        return F.trunc(day, "month"), F.last_day(day)
    raise ValueError(f"granularity {granularity!r}")


def windows(first: str, last: str, granularity: str, spark) -> DataFrame:
    """window_start, window_end of a range; the first and the last window are clipped to it."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    start, end = window_of(F.col("day"), granularity)
    both = days.select(F.greatest(start, F.lit(first).cast("date")).alias("window_start"), F.least(end, F.lit(last).cast("date")).alias("window_end"))
    return both.distinct()


def digest(rows: DataFrame, day: Column, kind: Column, amount: Column, granularity: str, by: list[str] | None = None) -> DataFrame:
    """`by`, window_start, window_end, kinds (map of counts), rows, total (null without any amount).

    Counts are aggregated by kind first, so the map of a window is built from a row a kind.
    """
    start, end = window_of(day, granularity)
    keys = [*(by or []), "window_start", "window_end"]
    per = rows.where(day.isNotNull()).groupBy(*(by or []), start.alias("window_start"), end.alias("window_end"), kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(amount).alias("amount"))
    entry = F.struct(F.coalesce("kind", F.lit("unknown")).alias("k"), F.col("n").alias("v"))
    return per.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("kinds"), F.sum("n").alias("rows"), F.sum("amount").alias("total"))


def rollup(children: DataFrame, granularity: str, by: list[str] | None = None) -> DataFrame:
    """Digests of a coarser granularity from finer ones: `by`, window, children, rows, total.

    A parent counts if its children cover at least half of its days, in whole days
    (three of seven do): `complete`.
    """
    start, end = window_of(F.col("window_start"), granularity)
    keys = [*(by or []), "p_start", "p_end"]
    out = children.withColumns({"p_start": start, "p_end": end}).groupBy(*keys).agg(F.count("*").alias("children"), F.sum("rows").alias("rows"), F.sum("total").alias("total"))
    days = F.date_diff("p_end", "p_start") + 1
    out = out.withColumn("complete", F.col("children") >= F.greatest(F.lit(1), F.floor(days / 2)))
    return out.withColumnsRenamed({"p_start": "window_start", "p_end": "window_end"})


def missing(wanted: DataFrame, present: DataFrame, forced: bool = False) -> DataFrame:
    """Windows without a digest yet; all of them if `forced`."""
    if forced:
        return wanted
    return wanted.join(present.select("window_start", "window_end"), ["window_start", "window_end"], "left_anti")
