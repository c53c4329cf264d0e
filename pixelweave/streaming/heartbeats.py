"""Event streams of agents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def throughput(events: DataFrame, length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events and total value by window and kind; ``events``: ts (timestamp), event_type, value. Streaming or batch."""
    agg = events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return agg.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """An agent's activity without gaps of ``gap``."""
    agg = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return agg.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")
