"""Sessions: an append-only log of events, folded into one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrollsift.functions import text as T


def folded(events: DataFrame) -> DataFrame:
    """(session_id, name, ts, event) with event start, pause, resume or stop -> one row a session."""
    status = F.when(F.col("last") == "stop", "stopped").when(F.col("last") == "pause", "paused").otherwise("active")
    return (
        events.groupBy("session_id")
        .agg(F.min_by("name", "ts").alias("name"), F.min("ts").alias("started_at"), F.max(F.when(F.col("event") == "stop", F.col("ts"))).alias("stopped_at"), F.max_by("event", "ts").alias("last"))
        .withColumn("status", status)
        .withColumn("status_label", T.status_label(F.col("status")))
        .withColumn("name", F.coalesce("name", T.session_name(F.col("started_at"))))
        .drop("last")
    )


def rollup(captures: DataFrame) -> DataFrame:
    """Captures and distinct contents of each session, and when it was active."""
    hashed = captures.select("session_id", "ts", F.xxhash64("output").alias("h"))
    return hashed.groupBy("session_id").agg(F.count("*").alias("capture_count"), F.countDistinct("h").alias("blob_count"), F.min("ts").alias("started_at"), F.max("ts").alias("last_at"))


def newest(sessions: DataFrame, n: int = 5) -> DataFrame:
    return sessions.orderBy(F.desc("started_at"), "session_id").limit(n)


def by_name(sessions: DataFrame, name: str) -> DataFrame:
    return newest(sessions.filter(F.col("name") == name), 1)


def durations(sessions: DataFrame, now) -> DataFrame:
    return sessions.withColumn("duration", F.coalesce("stopped_at", F.lit(now)) - F.col("started_at"))
