"""Structured Streaming on event tables; windows are an extension beyond the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed_totals(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type in event-time windows; works on a stream or a table."""
    at = F.window("ts", length, slide) if slide else F.window("ts", length)
    grouped = _timed(events, late).groupBy(at.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events of a user no further apart than ``gap``."""
    grouped = _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def first_seen(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One row an event id, however often it is delivered within the watermark."""
    return _timed(events, late).dropDuplicatesWithinWatermark(["event_id"])
