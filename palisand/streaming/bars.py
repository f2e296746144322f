"""An extension: price bars from a stream of trades, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, asset, price (mean) and n of each window of events (ts, asset, value); works on streams and on tables."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", size).alias("w"), "asset").agg(F.avg("value").alias("price"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "asset", "price", "n")
