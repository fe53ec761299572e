"""Sequential codecs as window algebra: EVT3 words and 5-byte records, in SQL only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import BUCKET, running

#: Fixed values of the format: the word types.
ADDR_Y, ADDR_X, BASE_X, VECT_12, VECT_8, TIME_LOW, TIME_HIGH = 0, 2, 3, 4, 5, 6, 8


def evt3(words: DataFrame, by: Sequence[str] = (), strict_time: bool = False, bucket: int | None = None) -> DataFrame:
    """EVT3 words (i, v) -> events (idx, t_us, x, y, p), idx dense in word and bit order.

    Low and high time counters unwrap on their own, so a low one that wraps as the high
    one ticks counts twice; strict_time takes the high one's ticks alone. x of vectors
    runs on from the last base by the widths passed, empty masks too.

    One shuffle puts words into buckets of i. Windows inside a bucket find its own
    state, a summary of one row per bucket says what it starts from, and each word's
    state is the sum of both.
    """
    v, ty, pl = F.col("v"), F.col("ty"), F.col("pl")
    w = words.select(*by, "i", "v", F.shiftright(v, 12).alias("ty"), v.bitwiseAND(0xFFF).alias("pl"), F.floor(F.col("i") / (bucket or BUCKET)).alias("_b"))
    mask = F.when(ty == VECT_12, pl).when(ty == VECT_8, pl.bitwiseAND(0xFF)).otherwise(0)
    w = w.withColumn("_wd", F.when(ty == VECT_12, 12).when(ty == VECT_8, 8).otherwise(0)).withColumn("_n", F.when(ty == ADDR_X, 1).otherwise(F.bit_count(mask)))
    own = Window.partitionBy(*by, "_b").orderBy("i")
    before, upto = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c, rows: F.last(c, ignorenulls=True).over(rows)
    counters = {"lo": TIME_LOW, "hi": TIME_HIGH}
    local = w.select(
        "*", *[last(F.when(ty == k, pl), before).alias(f"prev_{n}") for n, k in counters.items()], *[last(F.when(ty == k, pl), upto).alias(f"now_{n}") for n, k in counters.items()],
        last(F.when(ty == ADDR_Y, v.bitwiseAND(0x7FF)), upto).alias("y"), F.coalesce(F.sum("_wd").over(before), F.lit(0)).alias("cw"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("at"),
    )
    base = F.when(ty == BASE_X, F.struct(v.bitwiseAND(0x7FF).alias("x"), F.col("cw"), (v.bitwiseAND(0x800) != 0).alias("p")))
    local = local.select("*", *[F.sum(F.when((ty == k) & (pl < F.col(f"prev_{n}")), 1).otherwise(0)).over(upto).alias(f"fell_{n}") for n, k in counters.items()], last(base, upto).alias("base"))

    summary = local.groupBy(*by, "_b").agg(
        *[F.min_by("pl", F.when(ty == k, F.col("i"))).alias(f"first_{n}") for n, k in counters.items()], *[F.max_by(f"now_{n}", "i").alias(f"last_{n}") for n in counters], *[F.max(f"fell_{n}").alias(f"falls_{n}") for n in counters],
        F.max_by("y", "i").alias("last_y"), F.max_by("base", "i").alias("last_base"), F.sum("_wd").alias("widths"), F.sum("_n").alias("events"),
    )
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    summed = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    start = summary.select("*", *[last(f"last_{n}", earlier).alias(f"from_{n}") for n in counters], summed("widths").alias("from_cw"), summed("events").alias("from_at"), last("last_y", earlier).alias("from_y"))
    # a bucket's first word of a counter may be below the last one before it
    start = start.select("*", *[F.coalesce((F.col(f"first_{n}") < F.col(f"from_{n}")).cast("int"), F.lit(0)).alias(f"step_{n}") for n in counters], F.when(F.col("last_base").isNotNull(), F.struct(F.col("last_base.x").alias("x"), (F.col("last_base.cw") + F.col("from_cw")).alias("cw"), F.col("last_base.p").alias("p"))).alias("_base"))
    start = start.select(*by, "_b", "from_cw", "from_at", "from_y", *[f"from_{n}" for n in counters], *[f"step_{n}" for n in counters], *[summed(F.col(f"falls_{n}") + F.col(f"step_{n}")).alias(f"wraps_{n}") for n in counters], last("_base", earlier).alias("from_base"))

    emitting = local.where(ty.isin(ADDR_X, VECT_12, VECT_8) & (F.col("_n") > 0)).join(start, [*by, "_b"])

    def counter(name: str, shift: int, wrap: int) -> Column:
        seen = F.col(f"now_{name}").isNotNull()
        wraps = F.col(f"wraps_{name}") + F.col(f"fell_{name}") + F.when(seen, F.col(f"step_{name}")).otherwise(0)
        return F.coalesce(f"now_{name}", f"from_{name}", F.lit(0)) * (1 << shift) + wraps * wrap

    t = counter("lo", 0, 0 if strict_time else 1 << 12) + counter("hi", 12, 1 << 24)
    here = F.when(F.col("base").isNotNull(), F.struct(F.col("base.x").alias("x"), (F.col("base.cw") + F.col("from_cw")).alias("cw"), F.col("base.p").alias("p"))).otherwise(F.col("from_base"))
    bits = lambda n: F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.getbit(F.col("pl").cast("int"), k) == 1)
    bit = F.when(ty == ADDR_X, F.array(F.lit(0))).when(ty == VECT_12, bits(12)).otherwise(bits(8))
    rows = emitting.select(*by, "ty", "v", (F.col("from_at") + F.col("at")).alias("at"), t.cast("long").alias("t_us"), F.coalesce("y", "from_y", F.lit(0)).cast("int").alias("y"), here.alias("base"), (F.col("from_cw") + F.col("cw")).alias("cw"), F.posexplode(bit).alias("k", "bit"))
    single = ty == ADDR_X
    x = F.when(single, v.bitwiseAND(0x7FF)).otherwise(F.coalesce("base.x", F.lit(0)) + F.col("cw") - F.coalesce("base.cw", F.lit(0)) + F.col("bit"))
    p = F.when(single, v.bitwiseAND(0x800) != 0).otherwise(F.coalesce("base.p", F.lit(False)))
    return rows.select(*by, (F.col("at") + F.col("k")).cast("long").alias("idx"), "t_us", x.cast("int").alias("x"), "y", p.alias("p"))


def records(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """5-byte records (i, b0..b4) -> (i, t_us, x, y, p): y = 240 marks an overflow, adds 2^13 to itself and all after, and is no event."""
    stamped = rows.select(*by, "i", F.col("b0").alias("x"), F.col("b1").alias("y"), (F.shiftright("b2", 7) == 1).alias("p"), (F.col("b2").bitwiseAND(0x7F) * 65536 + F.col("b3") * 256 + F.col("b4")).cast("long").alias("_ts"))
    counted = running(stamped, "i", sums={"_over": (F.col("y") == 240).cast("long")}, by=by)
    return counted.where("y <> 240").select(*by, "i", (F.col("_ts") + F.col("_over") * 8192).alias("t_us"), "x", "y", "p")
