"""Streaming twins: hourly bars under a watermark and sessions by gap. The same functions take batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame) -> DataFrame:
    """events with ts as a timestamp (the tables' ts has no zone)."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_bars(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(series, dt, open, high, low, close, volume); on a stream, an hour is final once the watermark has passed it."""
    at = F.struct("ts", "event_id")
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("series")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("volume")
    )
    return rows.select("series", F.col("w.start").alias("dt"), "open", "high", "low", "close", "volume")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """(user_id, start, n_events, total): events of a user less than a gap apart."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))
    return rows.select("user_id", F.col("w.start").alias("start"), "n_events", "total")
