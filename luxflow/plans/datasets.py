"""Recordings of the MVSEC and DSEC layouts: HDF5 events (where h5py is there) and side streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spatial
from ..operators.select import numbered
from ..schema import SENSORS, polarity
from ..sources import cache, files, layout, rasters, rosbag, text
from . import samples
from .protocols import Samples
from .recording import Recording

#: Ground-truth frames of each MVSEC sequence that hold.
MVSEC_VALID = {"indoor_flying1": (60, 1340), "indoor_flying2": (140, 1500), "indoor_flying3": (100, 1711), "indoor_flying4": (104, 380), "outdoor_day1": (0, 5020), "outdoor_day2": (30, None)}


def _timed(df: DataFrame, scale: float = 1e6) -> DataFrame:
    return df.withColumn("t_us", F.rint(F.col("t") * scale).cast("long"))


#: Ground truth of MVSEC by stream: dataset, type of its values. Names are fixed by the files.
MVSEC_TRUTH = {"depth": ("depth_image_raw", "float"), "depth_rect": ("depth_image_rect", "float"), "flow_hdf5": ("flow_dist", "double"), "blended": ("blended_image_rect", "int")}


def mvsec(spark: SparkSession, root: str, sequence: str, camera: str = "left", copies: str | None = None) -> Recording:
    """`{sequence}_data.hdf5` (x, y, t, p rows in seconds), frames with their event places and pixels, IMU, LiDAR scans, poses and odometry as 4 x 4 matrices, depth, flow and blended images, and flow archives, as far as they are there.

    Images, fields and scans are (idx, t_us, shape, values), matrices (idx, t_us,
    matrix) of 16 numbers. copies: a folder in which the flow archive is kept as Parquet.
    """
    data, truth = f"{root}/{sequence}_data.hdf5", f"{root}/{sequence}_gt.hdf5"
    base = f"davis/{camera}"
    raw = rasters.read_hdf5(spark, data, {"row": (f"{base}/events", "array<double>")})
    at = lambda i: F.col("row")[i]
    events = raw.select("idx", F.rint(at(2) * 1e6).cast("long").alias("t_us"), at(0).cast("int").alias("x"), at(1).cast("int").alias("y"), polarity(at(3)).alias("p"))
    some = lambda path, read: _optional(read) if files.exists(path) else None
    fields = lambda path, key, times, kind: some(path, lambda: _timed(rasters.read_hdf5_frames(spark, path, key, times, kind)))
    streams: dict[str, DataFrame | None] = {}
    streams["frames"] = _optional(lambda: _timed(rasters.read_hdf5(spark, data, {"t": (f"{base}/image_raw_ts", "double"), "event_idx": (f"{base}/image_raw_event_inds", "long")})))
    streams["images"] = fields(data, f"{base}/image_raw", f"{base}/image_raw_ts", "int")
    streams["imu"] = _optional(lambda: _timed(rasters.read_hdf5(spark, data, {"t": (f"{base}/imu_ts", "double"), "imu": (f"{base}/imu", "array<double>")})))
    streams["velodyne"] = fields(data, "velodyne/scans", "velodyne/scans_ts", "float")
    for name in ("pose", "odometry"):
        held = fields(truth, f"{base}/{name}", f"{base}/{name}_ts", "double")
        streams["pose" if name == "pose" else "odometry_matrix"] = held if held is None else held.select("idx", "t", "t_us", F.col("values").alias("matrix"))
    for name, (key, kind) in MVSEC_TRUTH.items():
        streams[name] = fields(truth, f"{base}/{key}", f"{base}/{key}_ts", kind)
    flow = f"{root}/{sequence}_gt_flow_dist.npz"
    read = lambda: _timed(rasters.read_npz_flow(spark, flow)).withColumnRenamed("frame", "idx")
    streams["flow"] = (read() if copies is None else cache.cached(spark, copies, flow, "flow", read)) if files.exists(flow) else None
    archive = f"{root}/{sequence}_odom.npz"
    columns = {"t": "timestamps", "linear_velocity": "lin_vel", "position": "pos", "quaternion": "quat", "angular_velocity": "ang_vel"}
    streams["odometry"] = _timed(rasters.read_npz_rows(spark, archive, columns)) if files.exists(archive) else None
    return Recording(events, streams, SENSORS["mvsec"])


def mvsec_samples(recording: Recording) -> Samples:
    """A sample per frame: its events, time, and the idx of the nearest row of each other stream, null where there is none."""
    from ..operators.temporal import nearest

    out = recording.frame_samples().drop("pose", "depth")
    for name in ("images", "flow", "imu", "depth", "depth_rect", "blended", "velodyne", "pose"):
        stream = recording.streams.get(name)
        if stream is None:
            out = out.withColumn(name, F.lit(None).cast("long"))
            continue
        near = nearest(out.select(F.col("frame_idx").alias("probe_id"), "t_us"), stream.select("idx", "t_us"))
        out = out.join(near.select(F.col("probe_id").alias("frame_idx"), F.col("nearest").alias(name)), "frame_idx", "left")
    return Samples(out, on_close=recording.close)


def _optional(read) -> DataFrame | None:
    """A stream that a recording may lack."""
    try:
        return read()
    except KeyError:
        return None


def mvsec_map(spark: SparkSession, root: str, sequence: str, camera: str = "left") -> DataFrame:
    """(y, x, rx, ry) of the text maps of the sequence's category, in root or its calibration folder."""
    kind = layout.category(sequence)

    def values(axis: str) -> DataFrame:
        name = f"{kind}_{camera}_{axis}_map.txt"
        path = next(p for p in (f"{root}/{name}", f"{root}/{kind}_calib/{name}") if files.exists(p))
        return text.read_rows(spark, path).select(F.col("idx").cast("int").alias("y"), F.posexplode("row").alias("x", f"r{axis}"))

    return values("x").join(values("y"), ["y", "x"]).select("y", "x", "rx", "ry")


def valid_frames(frames: DataFrame, sequence: str) -> DataFrame:
    """The ground-truth frames that hold."""
    low, high = MVSEC_VALID.get(sequence, (0, None))
    kept = frames.where(F.col("idx") >= low)
    return kept if high is None else kept.where(F.col("idx") < high)


def dsec(spark: SparkSession, root: str, sequence: str, split: str = "train", camera: str = "left", prerectify: bool = False, check: bool = False) -> Recording:
    """Events in microseconds with the file's offset added, image times, flow intervals, disparity times, and bag streams as far as they are there.

    prerectify: coordinates through the camera's map, events that leave the sensor gone
    and the rest numbered again. check: coordinates off the sensor are an error.
    """
    found = layout.dsec_sequence(root, sequence, split)
    path = f"{found['events']}/{camera}/events.h5"
    offset = _scalar(path, "t_offset")
    raw = rasters.read_hdf5(spark, path, {"x": ("events/x", "int"), "y": ("events/y", "int"), "t": ("events/t", "long"), "p": ("events/p", "int")})
    events = raw.select("idx", (F.col("t") + offset).alias("t_us"), "x", "y", polarity(F.col("p"), "nonzero").alias("p"))
    height, width = SENSORS["dsec"]
    if check:
        inside = (F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height)
        events = events.withColumn("x", F.when(inside, F.col("x")).otherwise(F.raise_error(F.concat(F.lit("off the sensor: event "), F.col("idx").cast("string"))).cast("int")))
    if prerectify:
        events = spatial.prerectify(events, dsec_map(spark, f"{found['events']}/{camera}"), height, width)
    streams: dict[str, DataFrame | None] = {}
    if "images" in found:
        streams["frames"] = text.read_integer_rows(spark, f"{found['images']}/timestamps.txt").select("idx", F.col("v0").alias("t_us"))
        exposures = f"{found['images']}/{camera}/exposure_timestamps.txt"
        if files.exists(exposures):
            streams["exposures"] = text.read_integer_rows(spark, exposures, 2).select("idx", F.col("v0").alias("t_us"), F.col("v1").alias("end_us"))
    if "flow" in found:
        for way in ("forward", "backward"):
            if files.exists(f"{found['flow']}/{way}_timestamps.txt"):
                rows = text.read_integer_rows(spark, f"{found['flow']}/{way}_timestamps.txt", 2)
                streams[f"flow_{way}"] = rows.select("idx", F.col("v0").alias("t_us"), F.col("v1").alias("end_us"))
    if "disparity" in found:
        streams["disparity"] = text.read_integer_rows(spark, f"{found['disparity']}/timestamps.txt").select("idx", F.col("v0").alias("t_us"))
    bag = f"{layout.auxiliary_root(root, sequence)}/data/{layout.drive(sequence)}/lidar_imu.bag"
    if files.exists(bag):
        streams["imu"] = rosbag.read_imu(spark, bag).withColumn("t_us", F.floor(F.col("t_ns") / 1000))
        streams["lidar"] = rosbag.read_lidar(spark, bag).withColumn("t_us", F.floor(F.col("t_ns") / 1000))
    return Recording(events, streams, SENSORS["dsec"])


def dsec_samples(recording: Recording) -> Samples:
    """A sample per forward flow interval, or per interval between images if there is no flow."""
    flow, images = recording.streams.get("flow_forward"), recording.streams.get("frames")
    if flow is not None:
        spans = flow.select(F.col("idx").alias("frame_idx"), F.col("t_us").alias("t0"), F.col("end_us").alias("t1"))
    elif images is not None:
        spans = samples.intervals(images.select(F.col("idx").alias("frame_idx"), "t_us"))
    else:
        raise ValueError("samples need forward flow or images")
    streams = {name: recording.streams.get(name) for name in ("imu", "lidar", "disparity", "flow_backward")}
    made = samples.modal_samples(spans, recording.events, images=images, has_flow=flow is not None, backward=streams.pop("flow_backward"), **streams)
    return Samples(made, on_close=recording.close)


def dsec_ms_to_idx(spark: SparkSession, path: str, num_events: int) -> DataFrame:
    """(ms, idx) as stored beside the events; places outside the recording, or falling, are an error."""
    from ..operators.select import order_violations

    held = rasters.read_hdf5(spark, path, {"place": ("ms_to_idx", "long")})
    low, high = held.agg(F.min("place"), F.max("place")).first()
    if low is not None and (low < 0 or high > num_events):
        raise ValueError(f"ms_to_idx of {path} leaves 0 to {num_events}")
    if order_violations(held, "place").first()["violations"]:
        raise ValueError(f"ms_to_idx of {path} falls")
    return held.select(F.col("idx").alias("ms"), F.col("place").alias("idx"))


def _scalar(path: str, key: str) -> int:
    import h5py

    with h5py.File(path) as f:
        return int(np.asarray(f[key]))


def dsec_map(spark: SparkSession, events_folder: str, key: str = "rectify_map") -> DataFrame:
    """(y, x, rx, ry) of a camera's rectification map, read by rows of pixels."""
    path = next(p for p in (f"{events_folder}/rectify_maps.h5", f"{events_folder}/rectify_map.h5") if files.exists(p))
    height, width = SENSORS["dsec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import h5py

        for batch in batches:
            for y in batch.column(0).to_pylist():
                with h5py.File(path) as f:
                    row = np.asarray(f[key][y], np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(width, y, np.int32)), pa.array(np.arange(width, dtype=np.int32)), pa.array(np.ascontiguousarray(row[:, 0])), pa.array(np.ascontiguousarray(row[:, 1]))], ["y", "x", "rx", "ry"])

    return spark.range(height).mapInArrow(run, "y int, x int, rx float, ry float")


def dsec_images(spark: SparkSession, folder: str, times: str, exposures: str | None = None) -> DataFrame:
    """(idx, t_us, path, height, width, channels, pixels), PNG files by name joined to the times of a list by place; with a list of them, exposure_start and exposure_end too. An error if their numbers differ."""
    stamps = text.read_integer_rows(spark, times).select("idx", F.col("v0").alias("t_us"))
    out = rasters.ordinals(rasters.read_png(spark, f"{folder}/*.png"), stamps)
    if exposures is None:
        return out
    spans = text.read_integer_rows(spark, exposures, 2).select("idx", F.col("v0").alias("exposure_start"), F.col("v1").alias("exposure_end"))
    if spans.count() != stamps.count():
        raise ValueError("exposures and timestamps differ in number")
    return out.join(spans, "idx")


def backward_anchor(samples: DataFrame, backward: DataFrame) -> DataFrame:
    """samples (id, t_us) with the backward flow row that starts within a microsecond of them."""
    from ..operators.temporal import within

    return within(samples, numbered(backward.select("t_us"), "t_us", name="idx"), 1)
