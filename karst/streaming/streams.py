"""Structured Streaming: event windows, late data, deduplication, sessions, job states.

The reference service has no event-time operators; windows, sessions and late data are
extensions over the event table. Job states and idempotent claims are its behaviour.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from karst.core.session import scratch

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """The files under `path` as a stream of events, `ts` as timestamp."""
    raw = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str | None = None, by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """window_start, `by`, n, total of tumbling or sliding windows; rows later than `late` are dropped."""
    rows = events.withWatermark("ts", late) if late else events
    win = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = rows.groupBy(win.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """user_id, session_start, session_end, n: runs of a user's events with pauses under `gap`."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def first_deliveries(events: DataFrame, key: str, late: str) -> DataFrame:
    """Each key once within the lateness bound: a second delivery of a task is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


#: Ranks of the states of a job; a later state of lower rank is a stale message.
STATES = {"queued": 0, "processing": 1, "completed": 2, "failed": 2}


def job_states(messages: DataFrame, ttl_ms: int | None = 7_200_000) -> DataFrame:
    """job_id, state, changes: the furthest state of each job, forgotten `ttl_ms` after its last
    message; null keeps them, as a run over what is there now must: processing-time timers would hold it open.

    `messages`: job_id, state, ts. Unknown states and steps back are ignored.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        current, changes = state.get if state.exists else ("", 0)
        for pdf in frames:
            for s in pdf.sort_values("ts")["state"]:
                if s in STATES and (not current or STATES[s] > STATES[current]):
                    current, changes = s, changes + 1
        if current:
            state.update((current, changes))
            if ttl_ms:
                state.setTimeoutDuration(ttl_ms)
            yield pd.DataFrame({"job_id": [key[0]], "state": [current], "changes": [changes]})

    return messages.groupBy("job_id").applyInPandasWithState(step, "job_id string, state string, changes int", "state string, changes int", "update", "ProcessingTimeTimeout" if ttl_ms else "NoTimeout")


def run_once(df: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> StreamingQuery:
    """Runs a stream over all that is there now, into the in-memory table `name` (for small results)."""
    w = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return q


def into(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Feeds every micro-batch to `sink`, which must write idempotently by batch number."""
    q = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def to_parquet(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes a batch to its own directory: a replay replaces it."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def timed_cache(uses: DataFrame, kind: str, key: str, at: str, now, idle: str, most: int) -> DataFrame:
    """kind, key, used: entries of an inactivity cache at `now`: used within `idle`, of each kind the `most` last used.

    Works on a table of uses and, as a batch of a stream's state, on what `latest` uses it keeps.
    """
    from pyspark.sql import Window

    last = uses.groupBy(F.col(kind).alias("kind"), F.col(key).alias("key")).agg(F.max(at).alias("used"))
    live = last.where(F.col("used") > F.lit(now) - F.expr(f"interval {idle}"))
    w = Window.partitionBy("kind").orderBy(F.desc("used"), "key")
    return live.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def collected(spark: SparkSession, df: DataFrame, tag: str, mode: str = "append") -> DataFrame:
    """Result of a stream over all that is there now, written in parquet to the shared folder and read back."""
    where = scratch(spark, f"stream-{tag}")
    if mode == "append":
        q = df.writeStream.outputMode("append").option("checkpointLocation", where + "/log").trigger(availableNow=True).format("parquet").option("path", where + "/out").start()
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(where + "/out")
    into_ = df.writeStream.outputMode(mode).option("checkpointLocation", where + "/log").trigger(availableNow=True)
    # complete mode: the last batch holds the whole result
    q = into_.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(where + "/out")).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(where + "/out")
