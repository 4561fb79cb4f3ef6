"""Event-time windows over an event stream or table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``start, event_type, n, total`` per tumbling window; a stream's late rows past ``late`` are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    grouped = timed.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", "total")
