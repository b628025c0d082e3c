"""Bars from an event stream: tumbling windows under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_bars(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(symbol, ts, open, high, low, close, volume) of windows that the watermark has closed; equal to the batch bars of the same events."""
    key = F.struct("ts", "event_id")
    b = events.where("value is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), F.col("event_type").alias("symbol"))
    b = b.agg(F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return b.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")

