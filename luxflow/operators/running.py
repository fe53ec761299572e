"""Running state over one long order, in buckets.

A window over a whole recording would be one task. Here rows are put into buckets of
the order; a window runs inside each bucket, and what a bucket starts from comes from
a table of one row per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 1 << 18


def _carried(df: DataFrame, by: Sequence[str], bucket: str, made: dict[str, Column], over: dict) -> DataFrame:
    """One row per bucket with what the buckets before leave: made aggregates a bucket, over folds buckets."""
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(*by, bucket).agg(*[c.alias(n) for n, c in made.items()])
    return sizes.select(*by, bucket, *[over[n](F.col(n)).over(before).alias(n) for n in made])


def running(df: DataFrame, order: str, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None, by: Sequence[str] = (), bucket: int = BUCKET) -> DataFrame:
    """df with, per name, the sum, last non-null value or maximum of an expression over the rows up to and with each one.

    order: an integer column, unique within `by`.
    """
    sums, lasts, maxes = sums or {}, lasts or {}, maxes or {}
    columns = df.columns
    work = df.select("*", F.floor(F.col(order) / bucket).alias("_b"), *[c.alias(f"_in_{n}") for n, c in {**sums, **lasts, **maxes}.items()])
    own = Window.partitionBy(*by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    made: dict[str, Column] = {}
    over = {}
    for n in sums:
        made[f"_c_{n}"], over[f"_c_{n}"] = F.sum(f"_in_{n}"), F.sum
    for n in lasts:
        made[f"_c_{n}"], over[f"_c_{n}"] = F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), F.col(order))), lambda c: F.last(c, ignorenulls=True)
    for n in maxes:
        made[f"_c_{n}"], over[f"_c_{n}"] = F.max(f"_in_{n}"), F.max
    carried = _carried(work, by, "_b", made, over)
    local = work.select("*", *[F.sum(f"_in_{n}").over(own).alias(f"_l_{n}") for n in sums], *[F.last(f"_in_{n}", ignorenulls=True).over(own).alias(f"_l_{n}") for n in lasts], *[F.max(f"_in_{n}").over(own).alias(f"_l_{n}") for n in maxes])
    joined = local.join(carried, [*by, "_b"])
    out = [(F.coalesce(f"_c_{n}", F.lit(0)) + F.coalesce(f"_l_{n}", F.lit(0))).alias(n) for n in sums]
    out += [F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in lasts]
    out += [F.greatest(f"_l_{n}", f"_c_{n}").alias(n) for n in maxes]
    return joined.select(*columns, *out)


def with_previous(df: DataFrame, order: str, names: dict[str, str], by: Sequence[str] = (), bucket: int = BUCKET) -> DataFrame:
    """df with, per new name, the value of a column in the row before; order is dense, so rows find their neighbour by it across buckets."""
    columns = df.columns
    work = df.withColumn("_b", F.floor(F.col(order) / bucket))
    own = Window.partitionBy(*by, "_b").orderBy(order)
    ends = work.groupBy(*by, "_b").agg(*[F.max_by(F.struct(c), F.col(order)).alias(f"_e_{n}") for n, c in names.items()])
    before = ends.select(*by, "_b", *[F.lag(f"_e_{n}").over(Window.partitionBy(*by).orderBy("_b")).alias(f"_p_{n}") for n in names])
    local = work.select("*", *[F.lag(F.struct(c)).over(own).alias(f"_l_{n}") for n, c in names.items()])
    return local.join(before, [*by, "_b"]).select(*columns, *[F.coalesce(f"_l_{n}", f"_p_{n}")[c].alias(n) for n, c in names.items()])
