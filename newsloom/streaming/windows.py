"""Streams by event time with Spark's own watermark: for aggregates and repeats, where a row behind it may be dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(df: DataFrame, time_ms: str, delay: str) -> DataFrame:
    return df.withColumn("event_time", F.timestamp_millis(time_ms)).withWatermark("event_time", delay)


def first_seen(df: DataFrame, key: str, time_ms: str, delay: str = "7 days") -> DataFrame:
    """Each key once while it is remembered: the first row that arrives. Works on batches and streams."""
    if not df.isStreaming:
        return df.withColumn("event_time", F.timestamp_millis(time_ms)).dropDuplicates([key])
    return _timed(df, time_ms, delay).dropDuplicatesWithinWatermark([key])


def counts(df: DataFrame, time_ms: str, length: str = "10 minutes", slide: str | None = None, delay: str = "24 hours") -> DataFrame:
    """Rows per window; a stream emits a window once it can't change any more."""
    g = _timed(df, time_ms, delay).groupBy(F.window("event_time", length, slide or length).alias("w")).agg(F.count("*").alias("n"))
    return g.select(F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "n")


def sessions(df: DataFrame, key: str, time_ms: str, gap: str = "48 hours", delay: str = "24 hours") -> DataFrame:
    """Runs of a key's rows with no pause longer than ``gap``."""
    g = _timed(df, time_ms, delay).groupBy(key, F.session_window("event_time", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select(key, F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "n")
