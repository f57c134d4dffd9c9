"""Voxel representatives and event steps over streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.voxel import representatives


def stream_representatives(points: DataFrame, size: float, origin: Sequence[float]) -> DataFrame:
    """The batch operator as it is: least (score, idx) and counts are associative, so update or complete mode gives after
    each micro-batch what a batch over all points so far would. State is one row for each occupied cell."""
    return representatives(points, size, origin)


def windowed_counts(events: DataFrame, time: str, by: Sequence[str], length: str, late: str) -> DataFrame:
    """Counts and mean values in time windows, with a watermark that lets state go."""
    w = F.window(time, length)
    out = events.withWatermark(time, late).groupBy(w, *by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("window.start").alias("start"), *by, "n", "mean")
