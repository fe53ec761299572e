"""Multi-stream samples: every modality joined to the frame or interval that it belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import temporal
from ..operators.running import with_previous
from ..schema import dense_index


def intervals(frames: DataFrame) -> DataFrame:
    """(frame_idx, t0, t1) between neighbouring frames."""
    pairs = with_previous(frames.select("frame_idx", F.col("t_us").alias("t1")), "frame_idx", {"t0": "t1"}).where("t0 IS NOT NULL")
    return pairs.select((F.col("frame_idx") - 1).alias("frame_idx"), "t0", "t1")


def _count_in(spans: DataFrame, stream: DataFrame, name: str) -> DataFrame:
    """(frame_idx, name): rows of a stream in each half-open interval, from the stream's places at both ends."""
    dense = stream.select("idx", "t_us")
    ends = spans.select(F.concat(F.col("frame_idx"), F.lit(":0")).alias("probe_id"), F.col("t0").alias("t_us")).unionAll(spans.select(F.concat(F.col("frame_idx"), F.lit(":1")).alias("probe_id"), F.col("t1").alias("t_us")))
    at = temporal.time_to_index(ends, dense).select(F.split("probe_id", ":").alias("k"), "at")
    side = at.groupBy(F.col("k")[0].cast("long").alias("frame_idx")).agg(F.max(F.when(F.col("k")[1] == "1", F.col("at"))).alias("b"), F.max(F.when(F.col("k")[1] == "0", F.col("at"))).alias("a"))
    return side.select("frame_idx", (F.col("b") - F.col("a")).alias(name))


def interval_samples(frames: DataFrame, events: DataFrame, imu: DataFrame | None = None, disparity: DataFrame | None = None) -> DataFrame:
    """(frame_idx, t0, t1, num_events, num_imu, disparity): a row per interval; disparity is the idx nearest to its end. A missing stream gives nulls."""
    spans = intervals(frames)
    out = spans.join(_count_in(spans, events, "num_events"), "frame_idx", "left")
    if imu is not None:
        dense = dense_index(imu.select("t_us"), ["t_us"])
        out = out.join(_count_in(spans, dense, "num_imu"), "frame_idx", "left")
    else:
        out = out.withColumn("num_imu", F.lit(None).cast("long"))
    if disparity is not None:
        near = temporal.nearest(spans.select(F.col("frame_idx").alias("probe_id"), F.col("t1").alias("t_us")), disparity)
        out = out.join(near.select(F.col("probe_id").alias("frame_idx"), F.col("nearest").alias("disparity")), "frame_idx", "left")
    else:
        out = out.withColumn("disparity", F.lit(None).cast("long"))
    return out.select("frame_idx", "t0", "t1", "num_events", "num_imu", "disparity")


def modal_samples(
    spans: DataFrame, events: DataFrame, images: DataFrame | None = None, has_flow: bool = False, backward: DataFrame | None = None, disparity: DataFrame | None = None, imu: DataFrame | None = None, lidar: DataFrame | None = None,
) -> DataFrame:
    """(frame_idx, t0, t1, num_events, num_imu, num_lidar, image_start, image_end, flow, flow_backward, disparity), a row per interval.

    The images nearest to both ends, the disparity nearest to the end, the interval's own
    flow, and the backward flow that starts within a microsecond of the interval. A
    missing stream gives nulls.
    """
    none = F.lit(None).cast("long")
    out = spans.select("frame_idx", "t0", "t1")
    for name, stream in (("num_events", events), ("num_imu", imu), ("num_lidar", lidar)):
        if stream is None:
            out = out.withColumn(name, none)
        else:
            dense = stream if stream is events else dense_index(stream.select("t_us"), ["t_us"])
            out = out.join(_count_in(spans, dense, name), "frame_idx", "left")
    for name, stream, end in (("image_start", images, "t0"), ("image_end", images, "t1"), ("disparity", disparity, "t1")):
        if stream is None:
            out = out.withColumn(name, none)
        else:
            near = temporal.nearest(spans.select(F.col("frame_idx").alias("probe_id"), F.col(end).alias("t_us")), stream.select("idx", "t_us"))
            out = out.join(near.select(F.col("probe_id").alias("frame_idx"), F.col("nearest").alias(name)), "frame_idx", "left")
    out = out.withColumn("flow", F.col("frame_idx").cast("long") if has_flow else none)
    if backward is None:
        out = out.withColumn("flow_backward", none)
    else:
        same = temporal.within(spans.select(F.col("frame_idx").alias("id"), F.col("t0").alias("t_us")), backward.select("idx", "t_us"), 1)
        out = out.join(same.select(F.col("id").alias("frame_idx"), F.col("match").alias("flow_backward")), "frame_idx", "left")
    return out.select("frame_idx", "t0", "t1", "num_events", "num_imu", "num_lidar", "image_start", "image_end", "flow", "flow_backward", "disparity")


def frame_samples(frames: DataFrame, events: DataFrame, pose: DataFrame | None = None, depth: DataFrame | None = None) -> DataFrame:
    """A row per frame: its events as an array of structs in order, and the nearest pose and depth rows' idx."""
    owned = temporal.in_frames(events, frames).groupBy("frame_idx").agg(F.array_sort(F.collect_list(F.struct("idx", "t_us", "x", "y", "p"))).alias("events"))
    out = frames.join(owned, "frame_idx", "left").withColumn("events", F.coalesce("events", F.array().cast("array<struct<idx:bigint,t_us:bigint,x:int,y:int,p:boolean>>")))
    for name, stream in (("pose", pose), ("depth", depth)):
        if stream is None:
            out = out.withColumn(name, F.lit(None).cast("long"))
        else:
            near = temporal.nearest(frames.select(F.col("frame_idx").alias("probe_id"), "t_us"), stream)
            out = out.join(near.select(F.col("probe_id").alias("frame_idx"), F.col("nearest").alias(name)), "frame_idx", "left")
    return out


def num_samples(flow_rows: int | None, images: int | None) -> int:
    """Flow rows if there are any, else intervals between images."""
    return flow_rows if flow_rows is not None else max(0, (images or 0) - 1)
