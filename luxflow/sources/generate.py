"""Synthetic recordings, the same for the same seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spatial import grid
from ..schema import dense_index


def events(spark: SparkSession, n: int, height: int, width: int, t_min: float = 0.0, t_max: float = 1.0, dist: str = "uniform", seed: int = 0) -> DataFrame:
    """n events at uniform places and sorted uniform times."""
    if dist != "uniform":
        raise NotImplementedError(dist)
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(seed * 8 + k)), F.lit(1 << 52)) / float(1 << 52)
    rows = spark.range(n).select("id", F.floor(u(0) * width).cast("int").alias("x"), F.floor(u(1) * height).cast("int").alias("y"), (F.lit(t_min) + u(2) * (t_max - t_min)).alias("t"), (u(3) < 0.5).alias("p"))
    return dense_index(rows, ["t", "id"]).select("idx", "t", "x", "y", "p")


def random_flow(spark: SparkSession, height: int, width: int, top: float, seed: int = 0) -> DataFrame:
    """(y, x, fx, fy) within -top and top."""
    u = lambda k: (F.pmod(F.xxhash64("y", "x", F.lit(seed * 2 + k)), F.lit(1 << 52)) / float(1 << 52) * 2 - 1) * top
    return grid(spark, height, width).select("y", "x", u(0).cast("float").alias("fx"), u(1).cast("float").alias("fy"))


def uniform_flow(spark: SparkSession, height: int, width: int, fx: float, fy: float) -> DataFrame:
    return grid(spark, height, width).select("y", "x", F.lit(fx).cast("float").alias("fx"), F.lit(fy).cast("float").alias("fy"))
