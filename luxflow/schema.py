"""The event table and its side streams as DataFrames.

An event is (idx, t_us, x, y, p): dense 0-based file order, integer microseconds, pixel
and polarity. A DataFrame has no order, so every operator that needs one orders by idx.
A `recording` column may lead; operators take partition columns as `by`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("recording", T.StringType()),
        T.StructField("idx", T.LongType()),
        T.StructField("t_us", T.LongType()),
        T.StructField("t", T.DoubleType()),
        T.StructField("x", T.IntegerType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("p", T.BooleanType()),
    ]
)

#: Sensor shapes (height, width).
SENSORS = {"mvsec": (260, 346), "dsec": (480, 640), "dsec_frame": (1080, 1440), "davis240": (180, 240), "evk4": (720, 1280)}


def polarity(value: Column, rule: str = "positive") -> Column:
    """Polarity as boolean. positive: above zero; nonzero or truthy: anything but zero, so -1 counts as on; strict: -1, 0 or 1 only, else an error."""
    if rule == "positive":
        return value > 0
    if rule in ("nonzero", "truthy"):
        return value != 0
    if rule == "strict":
        return F.when(value.isin(-1, 0, 1), value > 0).otherwise(F.raise_error(F.concat(F.lit("polarity must be -1, 0 or 1, got "), value.cast("string"))).cast("boolean"))
    raise ValueError(f"unknown polarity rule {rule!r}")


def seconds(value: Column, unit: str, offset: Column | int = 0) -> Column:
    """A stored time as seconds: us, ns or s; offset in the stored unit."""
    scale = {"us": 1e-6, "ns": 1e-9, "s": 1.0}[unit]
    return (value + offset) * scale


def camera_view(events: DataFrame) -> DataFrame:
    """The driver's `events` table as a 40 x 30 sensor's events."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id").alias("idx"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"),
        (F.col("user_id") % 40).cast("int").alias("x"),
        (k % 30).cast("int").alias("y"),
        F.col("event_type").isin("click", "view", "purchase").alias("p"),
    )


BUCKET_ROWS = 500_000


def dense_index(df: DataFrame, order: list[str], name: str = "idx", rows: int = BUCKET_ROWS) -> DataFrame:
    """df with a dense 0-based index in the given order, without sending all rows to one task.

    Up to `rows` rows are numbered in one task. More are range-partitioned by all order
    columns, about `rows` to a partition, and written once to the shared folder with
    their place in their partition; an index is that place plus the sizes of the
    partitions before, a table of one row for each. As they are written, a partition that
    is made again can't be cut elsewhere. Rows equal in all order columns are numbered
    arbitrarily, and share a partition.
    """
    from .shared import written

    n = df.count()
    if n <= rows:
        return _numbered(df.withColumn("_part", F.lit(0)), order, name)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    cut = df.repartitionByRange(n // rows + 1, *order).sortWithinPartitions(*order)
    cut = written(cut.withColumn("_part", F.spark_partition_id()).withColumn("_place", place), "numbered")
    sizes = cut.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return cut.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_place")).cast("long")).drop("_part", "_place", "_before")  # a row for each `rows` rows


def dense_again(df: DataFrame, order: str, name: str = "idx", bucket: int = 1 << 18) -> DataFrame:
    """As dense_index for one whole-number column, such as an index that has lost rows: buckets of equal width, no look at the data."""
    return _numbered(df.withColumn("_part", F.floor(F.col(order) / bucket)), [order], name)


def _numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    sizes = df.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return df.withColumn("_place", place).join(before, "_part").withColumn(name, (F.col("_before") + F.col("_place")).cast("long")).drop("_part", "_place", "_before")
