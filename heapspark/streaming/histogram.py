"""A histogram that follows a stream, in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed(stream: DataFrame, time: str, key: str, value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, key, n, total) of each window; a batch DataFrame gives the same rows.  State is bounded by the watermark."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    out = rows.groupBy(F.window(time, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), key, "n", "total")
