"""Bars of an event stream by event time, with watermarks: tumbling or sliding windows, and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_bars(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(series, start, end, n, level) of events (ts, event_type, value); rows later than `late` are left out."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = events.withWatermark("ts", late).groupBy(window.alias("w"), F.col("event_type").alias("series")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("level"))
    return rows.select("series", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "level")


def session_bars(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n, total): a user's events with no gap as long as `gap` between them."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")
