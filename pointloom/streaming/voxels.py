"""Voxel sums of a stream, an extension: counts and sums are algebraic, so the batch aggregation runs in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators.grid import grid_keys


def windowed_voxels(stream: DataFrame, bins: list[float], time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and centroid of each voxel in each window of the stream (ts, p)."""
    d = len(bins)
    keyed = stream.withWatermark(time, late).select(F.window(time, window).alias("w"), "p", *grid_keys(bins))
    return keyed.groupBy("w", *(f"g{i}" for i in range(d))).agg(F.count("*").alias("count"), *(F.avg(F.col("p")[i]).alias(f"p{i}") for i in range(d)))
