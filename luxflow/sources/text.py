"""Text recordings: events, poses, IMU rows, timestamps, calibrations."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import dense_again, polarity
from . import files


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(idx, value): the lines of a text file, or of a folder's or pattern's files by name, with their dense place in it.

    A scan deals files and blocks of files over partitions by size, not in order. Lines of
    one block stay together, so a line's place is its place in its block, which needs no
    shuffle, plus the lines of the blocks before. Blocks are counted by a scan of their
    own; if that one cut or dealt them otherwise, it is an error.
    """
    meta = {"_file": "_metadata.file_path", "_start": "_metadata.file_block_start", "_length": "_metadata.file_block_length"}
    raw = spark.read.text(path).select("value", *[F.col(c).alias(n) for n, c in meta.items()], F.monotonically_increasing_id().alias("_id"))
    block = ["_part", *meta]
    raw = raw.withColumn("_part", F.shiftright("_id", 33))
    sizes = raw.groupBy(*block).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = sizes.select(*block, (F.sum("_n").over(Window.orderBy("_file", "_start")) - F.col("_n") - F.col("_first")).alias("_before"))
    moved = F.raise_error(F.concat(F.lit("blocks of a text file were dealt otherwise when they were counted: "), F.col("_file"))).cast("long")
    return raw.join(F.broadcast(before), block, "left").select(F.coalesce(F.col("_before") + F.col("_id"), moved).alias("idx"), "value")  # a row for each block


def fields(value: Column, pattern: str = r"\s+") -> Column:
    return F.split(F.trim(value), pattern)


def data_lines(df: DataFrame, comment: str = "#") -> DataFrame:
    """Without blank lines and comments, idx dense again."""
    kept = df.where((F.trim("value") != "") & ~F.ltrim("value").startswith(comment)).withColumnRenamed("idx", "_old")
    return dense_again(kept, "_old").drop("_old")


def parse_events(rows: DataFrame, rule: str = "positive") -> DataFrame:
    """(idx, value) lines of `t x y p` as (idx, t, x, y, p)."""
    f = fields(F.col("value"))
    return rows.select("idx", f[0].cast("double").alias("t"), f[1].cast("int").alias("x"), f[2].cast("int").alias("y"), polarity(f[3].cast("int"), rule).alias("p"))


def read_events(spark: SparkSession, path: str, rule: str = "positive") -> DataFrame:
    return parse_events(lines(spark, path), rule)


def read_rows(spark: SparkSession, path: str, columns: int | None = None) -> DataFrame:
    """(idx, row): every line's numbers; with columns, another count is an error."""
    values = F.transform(fields(F.col("value")), lambda x: x.cast("double"))
    rows = data_lines(lines(spark, path)).select("idx", values.alias("row"))
    if columns is None:
        return rows
    return rows.withColumn("row", F.when(F.size("row") == columns, F.col("row")).otherwise(F.raise_error(F.concat(F.lit(f"expected {columns} columns in row "), F.col("idx").cast("string"))).cast("array<double>")))


def _named(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select("idx", *[F.col("row")[i].alias(n) for i, n in enumerate(names)])


def read_imu(spark: SparkSession, path: str) -> DataFrame:
    return _named(read_rows(spark, path, 7), "t", "ax", "ay", "az", "gx", "gy", "gz")


def read_pose(spark: SparkSession, path: str) -> DataFrame:
    return _named(read_rows(spark, path, 8), "t", "px", "py", "pz", "qx", "qy", "qz", "qw")


def read_timestamps(spark: SparkSession, path: str) -> DataFrame:
    """(idx, t): one column, `#` lines skipped."""
    return _named(read_rows(spark, path), "t")


def read_integer_rows(spark: SparkSession, path: str, columns: int = 1) -> DataFrame:
    """(idx, v0, v1, ...): integers between commas or white space; comments and a header of letters are skipped, more columns cut."""
    kept = data_lines(lines(spark, path).where(~F.ltrim("value").rlike("^[A-Za-z]")))
    f = F.split(F.trim("value"), r"[\s,]+")
    return kept.select("idx", *[f[i].cast("long").alias(f"v{i}") for i in range(columns)])


def read_index(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """(idx, t, path): an image or depth list; names are taken from the list's folder. If check, they must exist, and times must rise."""
    from ..operators.select import order_violations

    folder = os.path.dirname(path)
    f = fields(F.col("value"))
    listed = data_lines(lines(spark, path)).select("idx", f[0].cast("double").alias("t"), F.concat(F.lit(folder.removeprefix("file:") + "/"), f[1]).alias("path"))
    if not check:
        return listed
    if order_violations(listed, "t", strict=True).first()["violations"]:
        raise ValueError(f"timestamps do not rise in {path}")
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.regexp_replace("path", "^file:", "").alias("path"), F.lit(True).alias("_there"))
    missing = F.raise_error(F.concat(F.lit("missing file "), F.col("path"))).cast("string")
    return listed.join(there, "path", "left").select("idx", "t", F.when(F.col("_there"), F.col("path")).otherwise(missing).alias("path"))


def read_calibration(path: str) -> tuple[float, ...]:
    """fx fy cx cy k1 k2 p1 p2 k3; a missing k3 is 0."""
    values = tuple(float(v) for v in files.read(path).decode().split())
    if len(values) not in (8, 9):
        raise ValueError(f"expected 8 or 9 numbers in {path}, got {len(values)}")
    return values if len(values) == 9 else (*values, 0.0)


def checked_events(rows: DataFrame) -> DataFrame:
    """Events of a DAVIS text recording, (idx, t, x, y, p): four columns, whole coordinates from 0 to 32767, polarity -1, 0 or 1; anything else is an error that names the row."""
    f = fields(F.col("value"))
    whole = f[1].cast("double").isNotNull() & (f[1].cast("double") == F.floor(f[1].cast("double"))) & (f[2].cast("double") == F.floor(f[2].cast("double")))
    inside = f[1].cast("double").between(0, 32767) & f[2].cast("double").between(0, 32767)
    good = (F.size(f) == 4) & whole & inside & f[3].cast("double").isin(-1.0, 0.0, 1.0)
    bad = F.raise_error(F.concat(F.lit("bad event in row "), F.col("idx").cast("string"), F.lit(": "), F.col("value"))).cast("double")
    return rows.select("idx", F.when(good, f[0].cast("double")).otherwise(bad).alias("t"), f[1].cast("double").cast("int").alias("x"), f[2].cast("double").cast("int").alias("y"), (f[3].cast("double") > 0).alias("p"))


def read_davis_events(spark: SparkSession, path: str) -> DataFrame:
    """checked_events of a file, times not falling."""
    from ..operators.select import order_violations

    events = checked_events(data_lines(lines(spark, path)))
    if order_violations(events, "t").first()["violations"]:
        raise ValueError(f"timestamps fall in {path}")
    return events


def format_events(events: DataFrame, t: Column | None = None) -> DataFrame:
    """(idx, value): `%.9f %d %d %d` lines of t, x, y, p; digits beyond a double's precision are zeros."""
    at = F.col("t_us") / 1e6 if t is None else t
    return events.select("idx", F.format_string("%.9f %d %d %d", at, F.col("x"), F.col("y"), F.col("p").cast("int")).alias("value"))


def write_events(events: DataFrame, path: str, t: Column | None = None) -> None:
    """A folder of text files that hold the lines in order, range-partitioned by idx."""
    format_events(events, t).repartitionByRange("idx").sortWithinPartitions("idx").select("value").write.mode("overwrite").text(path)
