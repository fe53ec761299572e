"""Projections, filters, slices and set operations on event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matrix(events: DataFrame) -> DataFrame:
    """(y, x, t, p) as doubles, in idx order of the idx column."""
    return events.select("idx", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), F.col("t_us").cast("double").alias("t"), F.col("p").cast("int").cast("double").alias("p"))


def color(p: Column) -> Column:
    """Red for on, blue for off."""
    return F.when(p, "FF0000").otherwise("0000FF")


def count(events: DataFrame) -> int:
    return events.count()


def normalize_index(i: Column, n: Column) -> Column:
    """A possibly negative index as one from 0; an error past either end."""
    at = F.when(i < 0, i + n).otherwise(i)
    return F.when((at >= 0) & (at < n), at).otherwise(F.raise_error(F.concat(F.lit("index out of range: "), i.cast("string"))).cast("long"))


def row(events: DataFrame, i: int) -> DataFrame:
    """The event at index i; negative from the end."""
    at = i if i >= 0 else events.count() + i
    return events.where(F.col("idx") == at)


def python_slice(events: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """What Python's [start:stop:step] takes, step above zero; the count is only taken for negative bounds."""
    if step < 1:
        raise ValueError("step must be positive")
    n = events.count() if min(start or 0, stop if stop is not None else 0) < 0 else None
    low = 0 if start is None else max(0, start + n) if start < 0 else start
    out = events.where(F.col("idx") >= low)
    if stop is not None:
        out = out.where(F.col("idx") < (max(0, stop + n) if stop < 0 else stop))
    return out if step == 1 else out.where((F.col("idx") - low) % step == 0)


def by_index(events: DataFrame, start: int, stop: int, n: int | None = None) -> DataFrame:
    """Events start up to but not stop; with n, bounds outside 0..n or reversed are errors."""
    if n is not None and not 0 <= start <= stop <= n:
        raise IndexError(f"invalid event range [{start}, {stop}) of {n} events")
    return events.where((F.col("idx") >= start) & (F.col("idx") < stop))


def by_time(df: DataFrame, start: int | float, stop: int | float, column: str = "t_us", strict: bool = False, closed: str = "left") -> DataFrame:
    """Rows of [start, stop), or of (start, stop] if closed is right; strict: an error if stop < start."""
    if strict and stop < start:
        raise ValueError(f"invalid time range [{start}, {stop})")
    t = F.col(column)
    return df.where((t > start) & (t <= stop) if closed == "right" else (t >= start) & (t < stop))


def in_bounds(events: DataFrame, height: int, width: int) -> DataFrame:
    return events.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))


def pixel_counts(events: DataFrame, height: int) -> DataFrame:
    """Events per pixel number y + x * height; a y past height aliases another pixel."""
    return events.groupBy((F.col("y") + F.col("x") * height).cast("long").alias("pixel")).agg(F.count("*").alias("n"))


def hot_pixel_filter(events: DataFrame, height: int, threshold: int = 10) -> DataFrame:
    """Without all events of the pixels that have more than threshold of them; the counts, one row per pixel, are what is joined."""
    hot = pixel_counts(events, height).where(F.col("n") > threshold).select("pixel")
    return events.withColumn("pixel", (F.col("y") + F.col("x") * height).cast("long")).join(hot, "pixel", "left_anti").drop("pixel")


def finite(value: Column, fill: float = 0.0, nan_only: bool = False) -> Column:
    """value with nan, and unless nan_only infinities, replaced."""
    bad = F.isnan(value) if nan_only else F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, fill).otherwise(value)


def append(events: DataFrame, more: DataFrame) -> DataFrame:
    """more after events, its idx numbered on from theirs; one aggregate, no sort."""
    n = events.agg((F.coalesce(F.max("idx"), F.lit(-1)) + 1).alias("_n"))
    return events.unionByName(more.crossJoin(F.broadcast(n)).withColumn("idx", F.col("idx") + F.col("_n")).drop("_n"))


def members(df: DataFrame, keys: DataFrame, on: str, invert: bool = False) -> DataFrame:
    return df.join(keys.select(on), on, "left_anti" if invert else "left_semi")


def first(events: DataFrame, n: int) -> DataFrame:
    return events.where(F.col("idx") < n)


def trailing(events: DataFrame, n: int) -> DataFrame:
    """The last n events; the last index is one aggregate."""
    last = events.agg(F.max("idx").alias("_last"))
    return events.crossJoin(F.broadcast(last)).where(F.col("idx") > F.col("_last") - n).drop("_last")


def order_violations(df: DataFrame, column: str = "t_us", order: str = "idx", strict: bool = False) -> DataFrame:
    """(violations): rows whose value is below (strict: not above) that of the row before."""
    from .running import with_previous

    before = with_previous(df.select(order, column), order, {"_before": column})
    bad = F.col(column) <= F.col("_before") if strict else F.col(column) < F.col("_before")
    return before.agg(F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("violations"))


def metadata(events: DataFrame) -> DataFrame:
    """(num_events, t_start, t_end, duration, width, height); times are null without events."""
    return events.agg(
        F.count("*").alias("num_events"), F.min_by("t_us", "idx").alias("t_start"), F.max_by("t_us", "idx").alias("t_end"),
        (F.max_by("t_us", "idx") - F.min_by("t_us", "idx")).alias("duration"), (F.max("x") + 1).cast("long").alias("width"), (F.max("y") + 1).cast("long").alias("height"),
    )


def numbered(df: DataFrame, *order: str, name: str = "frame_idx") -> DataFrame:
    """A side stream with a dense index in the given order."""
    from ..schema import dense_index

    return dense_index(df, list(order), name)
