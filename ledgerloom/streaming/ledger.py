"""Streaming form of the period aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_totals(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count and sum of value by window and type of a stream (ts, event_type, value); rows later than `late` go."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
