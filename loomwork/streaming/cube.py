"""The count cube over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_cube(events: DataFrame, time: str, keys: list[str], window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts for each window and combination of keys; rows later than ``late`` are dropped, so state stays bounded."""
    at = F.window(time, window)
    counted = events.withWatermark(time, late).groupBy(at.alias("w"), *keys).agg(F.count(F.lit(1)).alias("x"))
    return counted.select(F.col("w.start").alias("window_start"), *keys, "x")
