"""Geometry operators on streams: they are stateless, so a streaming GeoFrame is an ordinary one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_bounds(points: DataFrame, time: str, x: str, y: str, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Bounding box and count of points by event-time window; rows later than `late` are left out."""
    w = points.withWatermark(time, late).groupBy(F.window(time, size).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax")).select(F.col("w.start").alias("start"), "n", "xmin", "ymin", "xmax", "ymax")
