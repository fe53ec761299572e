"""Pixel-grid aggregations of events, in sparse long form.

Pixels without events have no row; densify adds them. Sums of a pixel are combined
before the shuffle, so a busy pixel or a huge recording costs one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import grid


def _edge(value: Column, size: int) -> Column:
    """Coordinate truncated toward zero; one that equals the size falls in the last pixel."""
    whole = value.cast("int")
    return F.when(value == size, size - 1).otherwise(whole)


def histogram(events: DataFrame, height: int, width: int, use_polarity: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """(y, x, value): events per pixel, on less off ones if use_polarity; the last pixel's far edge belongs to it, all else off the grid goes."""
    inside = events.where((F.col("x") >= 0) & (F.col("x") <= width) & (F.col("y") >= 0) & (F.col("y") <= height))
    sign = F.when(F.col("p").cast("int") == 1, 1).when(F.col("p").cast("int") == 0, -1).otherwise(0)
    value = F.sum(sign) if use_polarity else F.count("*")
    return inside.groupBy(*by, _edge(F.col("y"), height).alias("y"), _edge(F.col("x"), width).alias("x")).agg(value.cast("long").alias("value"))


def densify(cells: DataFrame, height: int, width: int, column: str = "value", fill: float = 0) -> DataFrame:
    """A row for every pixel."""
    return grid(cells.sparkSession, height, width).join(cells, ["y", "x"], "left").withColumn(column, F.coalesce(column, F.lit(fill)))


def time_map(events: DataFrame, height: int, width: int, decay: float, t: str = "t_us") -> DataFrame:
    """(y, x, value) of every pixel: exp(-decay * (last time - time of the pixel's last event by idx)); untouched pixels count as time 0."""
    inside = events.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))
    last = inside.groupBy("y", "x").agg(F.max_by(t, "idx").alias("_t"))
    top = events.agg(F.max(t).alias("_top"))
    every = densify(last, height, width, "_t").crossJoin(F.broadcast(top))
    return every.select("y", "x", F.exp(-decay * (F.col("_top") - F.col("_t"))).alias("value"))


def voxel_grid(events: DataFrame, height: int, width: int, bins: int, t: str = "t_us", weight: Column | None = None) -> DataFrame:
    """(bin, y, x, value): polarity, or weight with 0 as -1, shared between the two bins next to an event's time; off-grid events go."""
    if min(height, width, bins) < 1:
        raise ValueError("height, width and bins must be positive")
    sign = F.when(F.col("p"), 1.0).otherwise(-1.0) if weight is None else F.when(weight == 0, -1.0).otherwise(weight)
    ends = events.agg(F.min(t).alias("_low"), F.max(t).alias("_high"))
    inside = events.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height)).crossJoin(F.broadcast(ends))
    length = F.when(F.col("_high") == F.col("_low"), 1).otherwise(F.col("_high") - F.col("_low"))
    placed = inside.withColumn("_tn", (bins - 1) * (F.col(t) - F.col("_low")) / length)
    placed = placed.withColumn("_b", F.col("_tn").cast("int")).withColumn("_d", F.col("_tn") - F.col("_tn").cast("int")).withColumn("_p", sign)
    shares = F.array(F.struct(F.col("_b").alias("bin"), (F.col("_p") * (1 - F.col("_d"))).alias("v")), F.struct((F.col("_b") + 1).alias("bin"), (F.col("_p") * F.col("_d")).alias("v")))
    spread = placed.select("y", "x", F.explode(shares).alias("_s")).where(F.col("_s.bin") < bins)
    return spread.groupBy(F.col("_s.bin").alias("bin"), "y", "x").agg(F.sum("_s.v").alias("value"))


def normalize_voxels(voxels: DataFrame, value: str = "value") -> DataFrame:
    """Values other than 0 less their mean, by their standard deviation; zeros stay."""
    some = F.col(value) != 0
    stats = voxels.agg(F.sum(some.cast("int")).alias("_n"), F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_q"))
    mean = F.col("_s") / F.col("_n")
    std = F.sqrt(F.col("_q") / F.col("_n") - mean * mean)
    scaled = voxels.crossJoin(F.broadcast(stats)).withColumn(value, F.when(some, (F.col(value) - mean) / std).otherwise(F.col(value)))
    return scaled.drop("_n", "_s", "_q")


def slice_counts(sliced: DataFrame) -> DataFrame:
    """(slice, y, x, on, off): events of each polarity."""
    return sliced.groupBy("slice", "y", "x").agg(F.sum(F.col("p").cast("long")).alias("on"), F.sum((~F.col("p")).cast("long")).alias("off"))


def slice_totals(sliced: DataFrame) -> DataFrame:
    """(slice, n) for every slice from 0 to the last, empty ones too."""
    n = sliced.groupBy("slice").agg(F.count("*").alias("n"))
    every = n.agg(F.max("slice").alias("_top")).select(F.explode(F.sequence(F.lit(0), F.col("_top"))).alias("slice"))
    return every.join(n, "slice", "left").select("slice", F.coalesce("n", F.lit(0)).alias("n"))


def decayed_counts(counts: DataFrame, decay: float, horizon: int | None = None, bucket: int = 32) -> DataFrame:
    """(slice, y, x, on, off) as running sums in which each slice counts decay times the one before's.

    A pixel has a row for every slice from its first to the last of all. Each count is
    sent on to the slices of its bucket of `bucket` slices only; what a bucket starts
    from is the decayed sum of the buckets before, found the same way, so no pixel's
    history meets in one row. With a horizon, each count instead ends after that many
    slices, and slices without a pixel's events in reach have no row for it.
    """
    if decay <= 0:
        return counts.select("slice", "y", "x", F.col("on").cast("double").alias("on"), F.col("off").cast("double").alias("off"))
    if decay > 1 and horizon is None:
        raise ValueError("decay must be 1 at most, or a horizon given")
    if bucket < 2:
        raise ValueError(f"bucket must be 2 at least, got {bucket}")
    top = counts.agg(F.max("slice")).first()[0]
    own = counts.select(F.col("slice").cast("long").alias("slice"), "y", "x", F.col("on").cast("double").alias("on"), F.col("off").cast("double").alias("off"))
    return _decayed(own, decay, 0 if top is None else int(top), horizon, bucket)


def _decayed(counts: DataFrame, decay: float, top: int, horizon: int | None, bucket: int) -> DataFrame:
    last = F.lit(top)
    if horizon is not None:
        last = F.least(F.col("slice") + horizon, last)
    elif top >= bucket:
        at = F.floor(F.col("slice") / bucket)
        left = F.pow(F.lit(decay), (at + 1) * bucket - F.col("slice"))  # at the next bucket's first slice
        ends = counts.where(at < top // bucket).groupBy((at + 1).alias("slice"), "y", "x").agg(F.sum(F.col("on") * left).alias("on"), F.sum(F.col("off") * left).alias("off"))
        starts = _decayed(ends, decay**bucket, top // bucket, None, bucket)
        counts = counts.unionByName(starts.withColumn("slice", F.col("slice") * bucket))
        last = F.least((at + 1) * bucket - 1, last)
    sent = counts.select("y", "x", "on", "off", F.col("slice").alias("_from"), F.explode(F.sequence(F.col("slice"), last)).alias("slice"))
    share = F.pow(F.lit(decay), F.col("slice") - F.col("_from"))
    return sent.groupBy("slice", "y", "x").agg(F.sum(F.col("on") * share).alias("on"), F.sum(F.col("off") * share).alias("off"))


def intensity_bounds(frames: DataFrame, size: int, value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """(*by, frame_idx, low, high): each frame's least and largest value, held to [0, 0.45] and [0.55, 1], as medians over it and the size frames before."""
    from .temporal import sliding_median

    ends = frames.groupBy(*by, "frame_idx").agg(F.least(F.greatest(F.min(value), F.lit(0.0)), F.lit(0.45)).alias("low"), F.least(F.greatest(F.max(value), F.lit(0.55)), F.lit(1.0)).alias("high"))
    m = sliding_median(ends, "frame_idx", ["low", "high"], size, by)
    return m.select(*by, "frame_idx", F.col("low_median").alias("low"), F.col("high_median").alias("high"))


def to_byte(value: Column, low: Column, high: Column) -> Column:
    """255 * (value - low) / (high - low), held to 0..255 and truncated."""
    return F.least(F.greatest(255.0 * (value - low) / (high - low), F.lit(0.0)), F.lit(255.0)).cast("int")


def collate(samples: DataFrame, size: int, order: str = "frame_idx") -> DataFrame:
    """(batch, samples): the rows of each `size` neighbours as an array of structs in order; without samples an error."""
    if size < 1:
        raise ValueError("batch size must be positive")
    if samples.isEmpty():
        raise ValueError("there are no samples to batch")
    held = F.array_sort(F.collect_list(F.struct(order, *[c for c in samples.columns if c != order])))
    return samples.groupBy(F.floor(F.col(order) / size).alias("batch")).agg(held.alias("samples"))
