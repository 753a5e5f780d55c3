"""Queries that run as Structured Streaming over the whole event table."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from karst.registry import query
from karst.streaming import streams as S


def _source(spark, d):
    """The event file as a stream: its directory, restricted to its name."""
    raw = spark.readStream.schema(S.EVENT_SCHEMA).option("pathGlobFilter", "events*.parquet").parquet(d)
    if os.path.isdir(f"{d}/events.parquet"):
        raw = spark.readStream.schema(S.EVENT_SCHEMA).parquet(f"{d}/events.parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    out = S.collected(spark, S.windowed(_source(spark, d), "1 hour"), "tumbling", "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz"), "event_type", "n", F.round("total", 2).alias("total"))


@query("stream_sliding", """SELECT time_bucket(INTERVAL 1 HOUR, ts) - o.h * INTERVAL 1 HOUR AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events, (SELECT unnest([0, 1]) AS h) o GROUP BY ALL""")
def stream_sliding(spark, d):
    out = S.collected(spark, S.windowed(_source(spark, d), "2 hours", "1 hour"), "sliding", "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz"), "event_type", "n", F.round("total", 2).alias("total"))


@query("stream_sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    out = S.collected(spark, S.sessions(_source(spark, d), "30 minutes"), "sessions", "complete")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz"), F.col("session_end").cast("timestamp_ntz"), "n")


@query("stream_first_deliveries", "SELECT event_id, user_id FROM events")
def stream_first_deliveries(spark, d):
    """Every event delivered once within an hour's lateness: the table repeats none."""
    out = S.collected(spark, S.first_deliveries(_source(spark, d), "event_id", "1 hour"), "first")
    return out.select("event_id", "user_id")


@query("stream_job_states", """SELECT CAST(user_id AS VARCHAR) AS job_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'completed' WHEN bool_or(event_type IN ('view', 'click')) THEN 'processing' ELSE 'queued' END AS state FROM events WHERE event_type IN ('signup', 'view', 'click', 'purchase') GROUP BY user_id""")
def stream_job_states(spark, d):
    """Signup queues a user's job, a view or click processes it, a purchase completes it."""
    state = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type").isin("view", "click"), "processing").when(F.col("event_type") == "purchase", "completed")
    messages = _source(spark, d).select(F.col("user_id").cast("string").alias("job_id"), state.alias("state"), "ts").where("state is not null")
    out = S.collected(spark, S.job_states(messages, None), "jobs", "update")
    return out.select("job_id", "state")
