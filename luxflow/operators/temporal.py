"""As-of, nearest and interval joins on time, without cartesian products."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Distinct times in a bucket, about, and frames that are sent to every task at most.
BUCKET, FRAMES = 1 << 18, 200_000


def _span(events: DataFrame, t: str, probes: DataFrame | None = None) -> int | float:
    """Width of a bucket of time in which about BUCKET events and probes are, so dense recordings and many probes of few events have short buckets. Probes may have any times, so the events' range is what is cut."""
    n, low, high = events.agg(F.count("*"), F.min(t), F.max(t)).first()
    if not n or high == low:
        return 1
    if probes is not None:
        n += probes.agg(F.count(t)).first()[0]
    width = (high - low) / (n // BUCKET + 1)
    return max(1, int(width) + 1) if isinstance(low, int) else width * (1 + 1e-9)


def as_of(probes: DataFrame, events: DataFrame, probe_id: str = "probe_id", t: str = "t_us", by: Sequence[str] = (), strict: bool = True, span: int | float | None = None, around: bool = False) -> DataFrame:
    """probes with `at`: the last event's idx with time before (strict) or not after each probe's; -1 if none, also of a null time.

    events: (idx, t), idx dense and in time order. Of events at one time only the last
    idx matters, so they are aggregated first. Times and probes meet in buckets of
    `span` time units, by default such that a bucket has about BUCKET events and
    probes; what a bucket starts from is a table of one row per bucket. Probes carry their columns
    along and are shuffled once. around: also `t_left` and `t_right`, the times of that
    event and of the next one.
    """
    if span is None:
        span = _span(events, t, probes)
    first = 0 if strict else 2  # before or after events of the same time
    row = F.struct(*[probes[c] for c in probes.columns])
    none = F.lit(None).cast(probes.select(row.alias("r")).schema["r"].dataType)
    times = events.select(*by, F.col(t).alias("_t"), F.col("idx").alias("_idx")).groupBy(*by, "_t").agg(F.max("_idx").alias("_idx"))
    both = times.select(*by, "_t", "_idx", F.lit(1).alias("_k"), none.alias("_row"))
    both = both.unionByName(probes.select(*by, F.col(t).alias("_t"), F.lit(None).cast("long").alias("_idx"), F.lit(first).alias("_k"), row.alias("_row")))
    both = both.withColumn("_b", F.floor(F.col("_t") / span)).withColumn("_et", F.when(F.col("_k") == 1, F.col("_t")))
    ends = times.groupBy(*by, F.floor(F.col("_t") / span).alias("_b")).agg(F.max("_idx").alias("_end"), F.max("_t").alias("_high"), F.min("_t").alias("_low"))
    # the buckets of probes, which may have no events
    marks = both.select(*by, "_b").distinct().join(ends, [*by, "_b"], "left")
    back = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select(*by, "_b", F.max("_end").over(back).alias("_before"), *([F.max("_high").over(back).alias("_left"), F.min("_low").over(ahead).alias("_right")] if around else []))
    run = Window.partitionBy(*by, "_b").orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_at", F.max("_idx").over(run))
    if around:
        turned = Window.partitionBy(*by, "_b").orderBy(F.desc("_t"), F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
        found = found.withColumn("_tl", F.max("_et").over(run)).withColumn("_tr", F.min("_et").over(turned))
    found = found.where(F.col("_k") == first).join(carried, [*by, "_b"], "left")
    out = [F.coalesce("_at", "_before", F.lit(-1)).cast("long").alias("at")]
    if around:
        out += [F.coalesce("_tl", "_left").alias("t_left"), F.coalesce("_tr", "_right").alias("t_right")]
    return found.select("_row.*", *out)


def time_to_index(probes: DataFrame, events: DataFrame, **options) -> DataFrame:
    """The last event strictly before each probe."""
    return as_of(probes, events, strict=True, **options)


def index_to_time(indices: DataFrame, events: DataFrame, n: int | None = None) -> DataFrame:
    """indices (i) with the time of that event; negative ones from the end if n is given."""
    at = F.when(F.col("i") < 0, F.col("i") + n).otherwise(F.col("i")) if n is not None else F.col("i")
    return indices.withColumn("_at", at).join(events.select(F.col("idx").alias("_at"), "t_us"), "_at").drop("_at")


def nearest(probes: DataFrame, stream: DataFrame, probe_id: str = "probe_id", t: str = "t_us", **options) -> DataFrame:
    """probes with `nearest`: idx of the stream's row nearest in time.

    The earlier of two equally near; of rows at one time, the first if it is at or after
    the probe, the last if before; null for an empty stream.
    """
    placed = as_of(probes, stream, probe_id, t, strict=True, around=True, **options)
    near = (
        F.when(F.col("t_left").isNull() & F.col("t_right").isNull(), F.lit(None).cast("long"))
        .when(F.col("t_right").isNull(), F.col("at")).when(F.col("t_left").isNull(), F.col("at") + 1)
        .when(F.col(t) - F.col("t_left") <= F.col("t_right") - F.col(t), F.col("at")).otherwise(F.col("at") + 1)
    )
    return placed.withColumn("nearest", near).drop("at", "t_left", "t_right")


def bracket(probes: DataFrame, stream: DataFrame, probe_id: str = "probe_id", t: str = "t_us") -> DataFrame:
    """probes with (t_before, t_after): the last time at or before, the first after."""
    placed = as_of(probes, stream, probe_id, t, strict=False, around=True)
    return placed.withColumnsRenamed({"t_left": "t_before", "t_right": "t_after"}).drop("at")


def frame_bounds(frames: DataFrame, events: DataFrame) -> DataFrame:
    """frames (frame_idx, t_us) with [lo, hi): the events since the frame before; the first frame's start with event 0."""
    from .running import with_previous

    placed = as_of(frames, events, "frame_idx").withColumn("hi", F.col("at") + 1).drop("at")
    return with_previous(placed, "frame_idx", {"lo": "hi"}).withColumn("lo", F.coalesce("lo", F.lit(0)))


def _owned(events: DataFrame, frames: DataFrame, at: str, limit: int) -> DataFrame:
    """events with the frame_idx of the first frame whose `at` is above theirs; frames: (frame_idx, at), frame_idx dense from 0, at not falling.

    Up to `limit` frames are sent to every task: each interval is listed under the
    equal bins that it touches, about two rows a frame, and events look up their bin, so
    they are not shuffled at all. More frames are joined as of.
    """
    n, low, high = frames.agg(F.count("*"), F.min(at), F.max(at)).first()
    if not n:
        return events.withColumn("frame_idx", F.lit(None).cast("long")).where(F.lit(False))
    if n > limit:
        ends = frames.select(F.col("frame_idx").alias("idx"), F.col(at))
        placed = as_of(events, ends, "idx", at, strict=False)
        return placed.withColumn("frame_idx", F.col("at") + 1).where(F.col("frame_idx") < n).drop("at")
    from .running import with_previous

    width = max(1, (high - low) // n)
    spans = with_previous(frames.select("frame_idx", F.col(at).alias("_t1")), "frame_idx", {"_t0": "_t1"}).where("_t0 < _t1")
    bins = spans.select(F.col("frame_idx").alias("_f"), "_t0", "_t1", F.explode(F.sequence(F.floor(F.col("_t0") / width), F.floor((F.col("_t1") - 1) / width))).alias("_bin"))
    own = events.withColumn("_bin", F.floor(F.col(at) / width)).alias("e").join(F.broadcast(bins), (F.col("e._bin") == bins["_bin"]) & (F.col(at) >= F.col("_t0")) & (F.col(at) < F.col("_t1")), "left")
    frame = F.when(F.col(at) < low, F.lit(0).cast("long")).otherwise(F.col("_f").cast("long"))
    return own.select(*[F.col(f"e.{c}") for c in events.columns], frame.alias("frame_idx")).where("frame_idx IS NOT NULL")


def in_frames(events: DataFrame, frames: DataFrame, limit: int = FRAMES) -> DataFrame:
    """events with the frame_idx whose interval [previous frame, frame) they fall in; those after the last frame go.

    Frame k owns [t of k-1, t of k), so an event's frame is the one after the last frame at or before it.
    """
    return _owned(events, frames.select("frame_idx", "t_us"), "t_us", limit)


def frames_by_event_index(events: DataFrame, frames: DataFrame, limit: int = FRAMES) -> DataFrame:
    """As in_frames, by each frame's stored event_idx: frame k owns [event_idx of k-1, event_idx of k)."""
    return _owned(events.withColumn("_pos", F.col("idx")), frames.select("frame_idx", F.col("event_idx").alias("_pos")), "_pos", limit).drop("_pos")


def within(left: DataFrame, right: DataFrame, tolerance: int = 1) -> DataFrame:
    """left (id, t_us) with match: the last right idx whose t_us is at most tolerance after the probe, if it is not further before it either."""
    shifted = left.withColumn("_t0", F.col("t_us")).withColumn("t_us", F.col("t_us") + tolerance)
    placed = as_of(shifted, right, "id", strict=False, around=True)
    hit = F.when(F.abs(F.col("t_left") - F.col("_t0")) <= tolerance, F.col("at"))
    return placed.select("id", F.col("_t0").alias("t_us"), hit.alias("match"))


def count_windows(events: DataFrame, n: int) -> DataFrame:
    """events with `window`: tumbling windows of n events, the last one short."""
    if n <= 0:
        raise ValueError(f"num_events must be positive, got {n}")
    return events.withColumn("window", F.floor(F.col("idx") / n))


def window_bounds(first: int | float, last: int | float, width: int | float) -> list[tuple]:
    """Starts and ends by repeated addition from the first time, until one reaches the last."""
    if width <= 0:
        raise ValueError(f"time_window must be positive, got {width}")
    out, at = [], first
    while at < last:
        out.append((len(out), at, at + width))
        at = at + width
    return out


def time_windows(events: DataFrame, width: int | float, t: str = "t_us", include_last: bool = False) -> DataFrame:
    """events with `window`: tumbling windows [start, start + width) from the first event on.

    As windows end when one reaches the last time, events exactly on a final boundary
    belong to none, and a recording of one time has none; include_last keeps them.
    Integer times take one division; others the same additions as the boundaries
    themselves, as a table of starts joined as-of.
    """
    if width <= 0:
        raise ValueError(f"time_window must be positive, got {width}")
    ends = events.agg(F.min(t).alias("_first"), F.max(t).alias("_last"))
    if isinstance(width, int) and dict(events.dtypes)[t] in ("bigint", "int"):
        number = F.floor((F.col(t) - F.col("_first")) / width)
        out = events.crossJoin(F.broadcast(ends)).withColumn("window", number)
        if not include_last:
            out = out.where(F.col("_first") + F.col("window") * width < F.col("_last"))
        return out.drop("_first", "_last")
    low, high = ends.first()
    bounds = window_bounds(low, high, width) if low is not None else []
    if include_last and low is not None:
        bounds.append((len(bounds), bounds[-1][2] if bounds else low, high + width))
    starts = events.sparkSession.createDataFrame([(i, float(a)) for i, a, _ in bounds], "idx long, _s double")
    placed = as_of(events.withColumn("_s", F.col(t).cast("double")), starts, "idx", "_s", strict=False, span=max(1.0, float(width) * 1000))
    end = bounds[-1][2] if bounds else float("-inf")
    return placed.withColumnRenamed("at", "window").where((F.col("window") >= 0) & (F.col(t) < end)).drop("_s")


def ms_to_index(events: DataFrame, unit: int = 1000) -> DataFrame:
    """(ms, idx): first event at or after each whole unit, up to the last event's; counts per unit, summed up."""
    per = events.groupBy((F.floor(F.col("t_us") / unit) + 1).alias("ms")).agg(F.count("*").alias("n"))  # the first boundary after the event
    top = events.agg(F.floor(F.max("t_us") / unit).alias("top"))
    grid = top.select(F.explode(F.sequence(F.lit(0), F.col("top"))).alias("ms"))
    filled = grid.join(per, "ms", "left").withColumn("_b", F.floor(F.col("ms") / (1 << 18)))
    before = filled.groupBy("_b").agg(F.sum("n").alias("s")).select("_b", F.sum("s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    run = Window.partitionBy("_b").orderBy("ms").rowsBetween(Window.unboundedPreceding, 0)
    counted = filled.withColumn("_l", F.sum("n").over(run)).join(before, "_b")
    return counted.select("ms", (F.coalesce("carry", F.lit(0)) + F.coalesce("_l", F.lit(0))).alias("idx"))


def slices(events: DataFrame, slice_us: int, late: bool = True) -> DataFrame:
    """events with `slice`: floor((t - first t) / slice_us); an event of an earlier slice than one before it counts into that one if late."""
    start = events.agg(F.min_by("t_us", "idx").alias("_t0"))
    out = events.crossJoin(F.broadcast(start)).withColumn("slice", F.floor((F.col("t_us") - F.col("_t0")) / slice_us)).drop("_t0")
    if not late:
        return out
    from .running import running

    return running(out.withColumnRenamed("slice", "_own"), "idx", maxes={"slice": F.col("_own")}).drop("_own").withColumn("slice", F.greatest("slice", F.lit(0)))


def previous(df: DataFrame, order: str, column: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """A side stream with the value of its row before; order is dense."""
    from .running import with_previous

    return with_previous(df, order, {name: column}, by)


def sliding_median(df: DataFrame, order: str, columns: Sequence[str], size: int, by: Sequence[str] = (), bucket: int = 1 << 16) -> DataFrame:
    """Each column's median over a row and the `size` rows before; order is dense.

    Rows are dealt over buckets of the order; the last `size` rows of a bucket also go
    to the next ones that reach back to them.
    """
    bucket = max(bucket, size + 1)
    own = F.floor(F.col(order) / bucket)
    late = F.col(order) % bucket >= bucket - size
    spread = df.withColumn("_b", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy(*by, "_b").orderBy(order).rowsBetween(-size, 0)
    made = spread.withColumns({f"{c}_median": F.percentile(F.col(c), 0.5).over(w) for c in columns})
    return made.where(F.col("_b") == own).drop("_b")
