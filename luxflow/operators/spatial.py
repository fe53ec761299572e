"""Coordinate lookups: rectification, undistortion, dense flow."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a lookup map that is sent to every task: the largest sensor's pixels.
MAP_ROWS = 1 << 21


def grid(spark: SparkSession, height: int, width: int) -> DataFrame:
    """(y, x) of every pixel."""
    return spark.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))


def _lookup(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """A per-pixel table as the small side of a join; it has a row per pixel, which is what is checked."""
    return F.broadcast(pixels) if height * width <= MAP_ROWS else pixels


def clip(value: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def undistort(events: DataFrame, mapping: DataFrame, height: int, width: int) -> DataFrame:
    """events with x, y from mapping (y, x, rx, ry) at their clipped pixel, rounded half to even; none is dropped, and results may leave the sensor."""
    at = events.withColumn("_x", clip(F.col("x"), 0, width - 1)).withColumn("_y", clip(F.col("y"), 0, height - 1))
    m = mapping.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.rint("rx").cast("int").alias("_rx"), F.rint("ry").cast("int").alias("_ry"))
    return at.join(_lookup(m, height, width), ["_x", "_y"]).withColumn("x", F.col("_rx")).withColumn("y", F.col("_ry")).drop("_x", "_y", "_rx", "_ry")


def rectify(events: DataFrame, mapping: DataFrame, height: int, width: int) -> DataFrame:
    """As undistort, but events off the sensor before or after go."""
    m = mapping.select("x", "y", F.rint("rx").cast("int").alias("_rx"), F.rint("ry").cast("int").alias("_ry"))
    m = m.where((F.col("_rx") >= 0) & (F.col("_rx") < width) & (F.col("_ry") >= 0) & (F.col("_ry") < height))
    return events.join(_lookup(m, height, width), ["x", "y"]).withColumn("x", F.col("_rx")).withColumn("y", F.col("_ry")).drop("_rx", "_ry")


def prerectify(events: DataFrame, mapping: DataFrame, height: int, width: int) -> DataFrame:
    """rectify, with idx dense again in the old order."""
    from ..schema import dense_again

    kept = rectify(events, mapping, height, width).withColumnRenamed("idx", "_old")
    return dense_again(kept, "_old").drop("_old")


def pinhole_map(spark: SparkSession, height: int, width: int, calibration: tuple[float, ...], rounds: int = 20) -> DataFrame:
    """(y, x, rx, ry): where each pixel lies without lens distortion.

    calibration: fx fy cx cy k1 k2 p1 p2 [k3]. The Brown-Conrady model is undone by
    fixed-point iteration on normalised coordinates, as one expression per round.
    """
    fx, fy, cx, cy, k1, k2, p1, p2 = calibration[:8]
    k3 = calibration[8] if len(calibration) > 8 else 0.0
    df = grid(spark, height, width).withColumn("_u", (F.col("x") - cx) / fx).withColumn("_v", (F.col("y") - cy) / fy)

    def again(at: Column, _: Column) -> Column:
        u, v = at["u"], at["v"]
        r2 = u * u + v * v
        radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
        du, dv = 2 * p1 * u * v + p2 * (r2 + 2 * u * u), p1 * (r2 + 2 * v * v) + 2 * p2 * u * v
        return F.struct(((at["u0"] - du) / radial).alias("u"), ((at["v0"] - dv) / radial).alias("v"), at["u0"].alias("u0"), at["v0"].alias("v0"))

    start = F.struct(F.col("_u").alias("u"), F.col("_v").alias("v"), F.col("_u").alias("u0"), F.col("_v").alias("v0"))
    solved = df.withColumn("_s", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, again))
    return solved.select("y", "x", (F.col("_s.u") * fx + cx).alias("rx"), (F.col("_s.v") * fy + cy).alias("ry"))


def undistort_image(image: DataFrame, mapping: DataFrame) -> DataFrame:
    """(y, x, value) sampled bilinearly at mapping's (rx, ry): each pixel joins its four neighbours; off the image counts as 0."""
    corners = [F.struct((F.floor("ry") + dy).cast("int").alias("_y"), (F.floor("rx") + dx).cast("int").alias("_x"), (F.abs(1 - dy - (F.col("ry") - F.floor("ry"))) * F.abs(1 - dx - (F.col("rx") - F.floor("rx")))).alias("_w")) for dy in (0, 1) for dx in (0, 1)]
    spread = mapping.select("y", "x", F.explode(F.array(*corners)).alias("_c")).select("y", "x", "_c.*")
    pixels = image.select(F.col("y").alias("_y"), F.col("x").alias("_x"), "value")
    return spread.join(pixels, ["_y", "_x"], "left").groupBy("y", "x").agg(F.sum(F.col("_w") * F.coalesce("value", F.lit(0))).alias("value"))


def sample_flow(points: DataFrame, flow: DataFrame, height: int, width: int) -> DataFrame:
    """points (yc, xc, ...) with (fx, fy, valid) of the nearest pixel; 0 and false off the field."""
    f = flow.select(F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("fx").alias("_fx"), F.col("fy").alias("_fy"))
    at = points.withColumn("_y", F.rint("yc").cast("int")).withColumn("_x", F.rint("xc").cast("int"))
    joined = at.join(_lookup(f, height, width), ["_y", "_x"], "left")
    inside = (F.col("_x") >= 0) & (F.col("_x") < width) & (F.col("_y") >= 0) & (F.col("_y") < height)
    zero = F.lit(0.0).cast("float")
    return joined.withColumn("fx", F.coalesce("_fx", zero)).withColumn("fy", F.coalesce("_fy", zero)).withColumn("valid", inside).drop("_y", "_x", "_fx", "_fy")


def propagate(points: DataFrame, flow: DataFrame, scale: float, height: int, width: int) -> DataFrame:
    """One step of points (y0, x0, yc, xc, xm, ym) through a flow field; an axis whose sample is off the field or exactly zero is masked."""
    s = sample_flow(points, flow, height, width)
    k = F.lit(scale).cast("float")
    return s.select(
        "y0", "x0", (F.col("yc") + F.col("fy") * k).cast("float").alias("yc"), (F.col("xc") + F.col("fx") * k).cast("float").alias("xc"),
        (F.col("xm") & F.col("valid") & (F.col("fx") != 0)).alias("xm"), (F.col("ym") & F.col("valid") & (F.col("fy") != 0)).alias("ym"),
    )


def flow_steps(times: list[float], start: float, end: float) -> list[tuple[int, float]]:
    """(frame, share) of the flow frames that an interval passes: a rest of the first, whole ones, a share of the last."""
    if end <= start:
        raise ValueError(f"the interval [{start}, {end}) is empty")
    if len(times) < 2:
        raise ValueError("two flow timestamps are needed at least")
    if start < times[0] or end > times[-1]:
        raise ValueError(f"[{start}, {end}) is outside [{times[0]}, {times[-1]}]")
    t, last = np.asarray(times, float), len(times) - 2
    at = int(np.searchsorted(t, start, side="right")) - 1
    if not 0 <= at <= last:
        raise ValueError(f"no flow frame starts at or before {start}")
    length, rest = t[at + 1] - t[at], t[at + 1] - start
    if min(length, rest) >= end - start:
        return [(at, (end - start) / length)]
    out = [(at, rest / length)]
    at += 1
    while at < last and t[at + 1] < end:
        out.append((at, 1.0))
        at += 1
    return [*out, (at, (end - t[at]) / (t[at + 1] - t[at]))]


def interval_flow(flows: DataFrame, times: list[float], start: float, end: float, height: int, width: int) -> DataFrame:
    """(y, x, dx, dy), float: how far each pixel moves in [start, end).

    flows: (frame, y, x, fx, fy). Within one frame's interval its field is scaled;
    otherwise pixels are carried through the fields one after another, a join per frame
    that the interval spans.
    """
    steps = flow_steps(times, start, end)
    field = lambda i: flows.where(F.col("frame") == i)
    if len(steps) == 1:
        k = F.lit(steps[0][1]).cast("float")
        return field(steps[0][0]).select("y", "x", (F.col("fx").cast("float") * k).alias("dx"), (F.col("fy").cast("float") * k).alias("dy"))
    g = grid(flows.sparkSession, height, width)
    points = g.select(F.col("y").alias("y0"), F.col("x").alias("x0"), F.col("y").cast("float").alias("yc"), F.col("x").cast("float").alias("xc"), F.lit(True).alias("xm"), F.lit(True).alias("ym"))
    for i, share in steps:
        points = propagate(points, field(i), share, height, width)
    zero = F.lit(0.0).cast("float")
    return points.select(F.col("y0").alias("y"), F.col("x0").alias("x"), F.when(F.col("xm"), F.col("xc") - F.col("x0")).otherwise(zero).cast("float").alias("dx"), F.when(F.col("ym"), F.col("yc") - F.col("y0")).otherwise(zero).cast("float").alias("dy"))
