"""Pixel tables for display: event painting, slice frames, depth and flow colours, image filters."""

from __future__ import annotations

from math import sqrt
from statistics import NormalDist
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import clip, grid


def paint(events: DataFrame, height: int, width: int) -> DataFrame:
    """(y, x, r, g, b) of touched pixels: the last event's colour at the clipped pixel; all others are white."""
    at = events.select("idx", "p", clip(F.col("y"), 0, height - 1).alias("y"), clip(F.col("x"), 0, width - 1).alias("x"))
    last = at.groupBy("y", "x").agg(F.max_by("p", "idx").alias("p"))
    return last.select("y", "x", F.when(F.col("p"), 255).otherwise(0).alias("r"), F.lit(0).alias("g"), F.when(F.col("p"), 0).otherwise(255).alias("b"))


def frames(counts: DataFrame, height: int, width: int, scale: float = 80.0, threshold: int = 20, radius: int = 0) -> DataFrame:
    """(slice, y, x, color) of painted pixels: on or off where the dilated strength clip(count * scale, 0, 255) is above threshold; off wins."""
    strength = lambda c: F.floor(F.least(F.greatest(F.col(c) * scale, F.lit(0.0)), F.lit(255.0))).cast("int")
    s = counts.select("slice", "y", "x", strength("on").alias("on"), strength("off").alias("off"))
    if radius:
        steps = F.sequence(F.lit(-radius), F.lit(radius))
        s = s.withColumn("_dy", F.explode(steps)).withColumn("_dx", F.explode(steps)).select("slice", (F.col("y") + F.col("_dy")).alias("y"), (F.col("x") + F.col("_dx")).alias("x"), "on", "off")
        s = s.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width)).groupBy("slice", "y", "x").agg(F.max("on").alias("on"), F.max("off").alias("off"))
    color = F.when(F.col("off") > threshold, "off").when(F.col("on") > threshold, "on")
    return s.select("slice", "y", "x", color.alias("color")).where("color IS NOT NULL")


def depth_level(depth: Column, low: float, high: float, fill: float | None = None) -> Column:
    """Place of a depth between low and high, 0 to 1; nan as fill."""
    d = depth if fill is None else F.when(F.isnan(depth), fill).otherwise(depth)
    return (F.least(F.greatest(d, F.lit(low)), F.lit(high)) - low) / (high - low)


# A public-domain polynomial in a level from 0 to 1, lowest power first, for red, green and blue of the viridis map.
VIRIDIS = (
    (0.2777273272234177, 0.1050930431085774, -0.3308618287255563, -4.634230498983486, 6.228269936347081, 4.776384997670288, -5.435455855934631),
    (0.005407344544966578, 1.404613529898575, 0.214847559468213, -5.799100973351585, 14.17993336680509, -13.74514537774601, 4.645852612178535),
    (0.3340998053353061, 1.384590162594685, 0.09509516302823659, -19.33244095627987, 56.69055260068105, -65.35303263337234, 26.3124352495832),
)


def viridis(n: int = 256) -> list[tuple[float, float, float]]:
    """n colours from dark blue to yellow; within a few of 255 of the map's own table."""
    at = [i / (n - 1) for i in range(n)]
    return [tuple(min(1.0, max(0.0, sum(c * t**k for k, c in enumerate(row)))) for row in VIRIDIS) for t in at]


def color_depth(depths: DataFrame, colors: list[tuple[float, float, float]] | None = None, low: float = 0.1, high: float = 100.0, fill: float = 100.0) -> DataFrame:
    """depths (y, x, depth) with (r, g, b), 0 to 255: the map's colour at the depth's level; colors: the map from low to high, evenly spaced; viridis if not given."""
    colors = colors or viridis()
    at = F.least(F.floor(depth_level(F.col("depth"), low, high, fill) * len(colors)), F.lit(len(colors) - 1)).cast("int")
    channel = lambda i: F.floor(F.get(F.array(*[F.lit(float(c[i])) for c in colors]), at) * 255).cast("int")
    return depths.select("*", channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"))


def flow_hsv(flows: DataFrame, order: float = 1.0, top: float | None = None) -> DataFrame:
    """flows (y, x, v, h) with (hue, sat, val): direction as 0..179, magnitude^order by its largest as 0..255; inf and nan count as 0 in the magnitude."""
    safe = lambda c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), 0.0).otherwise(F.col(c))
    mag = F.pow(F.sqrt(safe("v") * safe("v") + safe("h") * safe("h")), order)
    angle = F.floor((F.atan2("h", "v") + F.lit(3.141592653589793)) * 180.0 / 3.141592653589793 / 2.0).cast("int")
    m = flows.select("*", mag.alias("_m"), angle.alias("hue"), F.lit(255).alias("sat"))
    most = m.agg(F.max("_m").alias("_top")) if top is None else flows.sparkSession.range(1).select(F.lit(top).alias("_top"))
    return m.crossJoin(F.broadcast(most)).withColumn("val", F.floor(255 * F.col("_m") / F.col("_top")).cast("int")).drop("_m", "_top")


def hsv_to_rgb(hue: Column, sat: Column, val: Column) -> list[Column]:
    """(r, g, b), 0 to 255, of hue in half degrees and sat and val in 0..255."""
    sector = F.floor(hue / 30.0)
    f = hue / 30.0 - sector
    s, v = sat / 255.0, val / 255.0
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    table = [(v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q)]
    out = []
    for i, name in enumerate("rgb"):
        c = F.lit(None).cast("double")
        for k, row in enumerate(table):
            c = F.when(sector % 6 == k, row[i]).otherwise(c)
        out.append(F.rint(c * 255).cast("int").alias(name))
    return out


def color_wheel(spark, size: int) -> DataFrame:
    """(y, x, v, h) on a square from -1 to 1, as input of flow_hsv."""
    step = 2.0 / (size - 1)
    return grid(spark, size, size).select("y", "x", (F.col("y") * step - 1).alias("v"), (F.col("x") * step - 1).alias("h"))


def gaussian_kernel(size: int = 5, sigma: float = 1.0) -> list[list[float]]:
    """g_i g_j, summing to 1, where g_i squared is the standard normal's mass in the i-th of `size` equal bins round 0.

    Fixed: the bins reach half of (2 sigma + 1) / size beyond sigma on either side.
    """
    normal, width = NormalDist(), (2 * sigma + (2 * sigma + 1) / size) / size
    g = [sqrt(normal.cdf((i + 1 - size / 2) * width) - normal.cdf((i - size / 2) * width)) for i in range(size)]
    return [[a * b / sum(g) ** 2 for b in g] for a in g]


def convolve(image: DataFrame, kernel: list[list[float]], height: int, width: int, value: str = "value") -> DataFrame:
    """(y, x, value) with zero padding: each pixel sends its weighted value to its neighbours, which are summed before the shuffle."""
    half = len(kernel) // 2
    weights = F.array(*[F.struct(F.lit(half - i).alias("dy"), F.lit(half - j).alias("dx"), F.lit(w).alias("w")) for i, row in enumerate(kernel) for j, w in enumerate(row)])
    sent = image.select((F.col("y")).alias("_y"), F.col("x").alias("_x"), F.col(value).alias("_v"), F.explode(weights).alias("_k"))
    sent = sent.select((F.col("_y") + F.col("_k.dy")).alias("y"), (F.col("_x") + F.col("_k.dx")).alias("x"), (F.col("_v") * F.col("_k.w")).alias("_v"))
    inside = sent.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width))
    return inside.groupBy("y", "x").agg(F.sum("_v").alias(value))


def unsharp(image: DataFrame, height: int, width: int, amount: float, sigma: float = 1.0, value: str = "value") -> DataFrame:
    """(1 + amount) * image - amount * blurred."""
    if amount <= 0:
        return image
    blurred = convolve(image, gaussian_kernel(5, sigma), height, width, value).withColumnRenamed(value, "_blurred")
    return image.join(blurred, ["y", "x"], "left").withColumn(value, (1 + amount) * F.col(value) - amount * F.coalesce("_blurred", F.lit(0.0))).drop("_blurred")


def bilateral(image: DataFrame, height: int, width: int, sigma_color: float, sigma_space: float, size: int = 5, value: str = "value") -> DataFrame:
    """Mean of the pixels within size // 2, weighted by nearness in place and value."""
    half = size // 2
    steps = [(dy, dx) for dy in range(-half, half + 1) for dx in range(-half, half + 1) if dy * dy + dx * dx <= half * half]
    shifts = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps])
    sent = image.select(F.explode(shifts).alias("_k"), "y", "x", F.col(value).alias("_v")).select((F.col("y") + F.col("_k.dy")).alias("y"), (F.col("x") + F.col("_k.dx")).alias("x"), "_v", (F.col("_k.dy") * F.col("_k.dy") + F.col("_k.dx") * F.col("_k.dx")).alias("_d"))
    both = image.join(sent, ["y", "x"])
    diff = F.col("_v") - F.col(value)
    w = F.exp(-F.col("_d") / (2 * sigma_space**2) - diff * diff / (2 * sigma_color**2))
    return both.groupBy("y", "x").agg((F.sum(w * F.col("_v")) / F.sum(w)).alias(value))


def flip(cells: DataFrame, height: int, width: int) -> DataFrame:
    return cells.withColumn("y", height - 1 - F.col("y")).withColumn("x", width - 1 - F.col("x"))


class Padding(NamedTuple):
    """A padded size, and what is added before and after each side."""

    height: int
    width: int
    top: int
    bottom: int
    left: int
    right: int

    def cropped(self, image):
        """What was padded, out of the padded image (an array of rows)."""
        return image[self.top : self.height - self.bottom, self.left : self.width - self.right]


def padding(height: int, width: int, encoders: int) -> Padding:
    """To the next multiple of 2 ** encoders; of an odd number of added rows or columns one more comes before."""
    more = [-n % 2**encoders for n in (height, width)]
    (top, bottom), (left, right) = ((n - n // 2, n // 2) for n in more)
    return Padding(height + more[0], width + more[1], top, bottom, left, right)


def reflect_pad(cells: DataFrame, height: int, width: int, encoders: int) -> DataFrame:
    """Cells on the padded grid, its borders mirrored without the edge pixel."""
    g = padding(height, width, encoders)
    padded = grid(cells.sparkSession, g.height, g.width)
    mirror = lambda c, n: F.when(c < 0, -c).when(c >= n, 2 * (n - 1) - c).otherwise(c)
    source = padded.withColumn("_y", mirror(F.col("y") - g.top, height)).withColumn("_x", mirror(F.col("x") - g.left, width))
    return source.join(cells.withColumnRenamed("y", "_y").withColumnRenamed("x", "_x"), ["_y", "_x"], "left").drop("_y", "_x")
