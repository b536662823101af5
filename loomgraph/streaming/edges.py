"""Edges as a stream: windowed degrees with a watermark (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_degrees(edges: DataFrame, time: str, src: str, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Edges out of each node in each window of event time; works on streams and on tables.

    Edges that come later than ``late`` behind the newest are left out of a stream's windows.
    """
    w = F.window(F.col(time), window, slide) if slide else F.window(F.col(time), window)
    counts = edges.withWatermark(time, late).groupBy(w.alias("w"), F.col(src).alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return counts.select("node", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "degree")
