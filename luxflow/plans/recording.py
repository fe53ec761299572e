"""A recording: its events and side streams as DataFrames, with positional and timed access."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import select, spatial, temporal
from ..sources import cache, layout, rasters, text
from . import samples
from .protocols import EventSource, Samples


class Loading(Enum):
    """OFF: no scan; LAZY: a DataFrame; CACHED: one that is persisted."""

    OFF = "off"
    LAZY = "lazy"
    CACHED = "cached"

    @classmethod
    def of(cls, value: Loading | str | bool | None) -> Loading:
        if isinstance(value, cls):
            return value
        if isinstance(value, str):
            return cls(value.lower())
        return cls.LAZY if value else cls.OFF


@dataclass
class Recording(EventSource):
    """events: (idx, t_us, x, y, p). Side streams: (idx, t_us, ...), or None where a recording has none."""

    events: DataFrame
    streams: dict[str, DataFrame | None] = field(default_factory=dict)
    resolution: tuple[int, int] | None = None
    _held: list[DataFrame] = field(default_factory=list)

    def load(self, **modes: Loading | str | bool) -> Recording:
        """Streams (and `events`) as OFF, LAZY or CACHED."""
        for name, mode in modes.items():
            mode = Loading.of(mode)
            held = self.events if name == "events" else self.streams.get(name)
            if mode is Loading.CACHED and held is not None:
                held = held.persist()
                self._held.append(held)
            if name == "events":
                self.events = held
            else:
                self.streams[name] = None if mode is Loading.OFF else held
        return self

    def close(self) -> None:
        for df in self._held:
            df.unpersist()
        self._held.clear()

    def __del__(self) -> None:
        if self._held:
            warnings.warn("a recording with persisted streams was not closed", ResourceWarning, stacklevel=2)

    @property
    def num_events(self) -> int:
        return self.events.count()

    def metadata(self) -> DataFrame:
        return select.metadata(self.events)

    def load_events(self, start: int, stop: int, check: bool = True) -> DataFrame:
        """Events from start up to stop; check counts them first, to refuse places outside the recording."""
        return select.by_index(self.events, start, stop, self.num_events if check else None)

    def get_events_by_time(self, start: int, stop: int) -> DataFrame:
        return select.by_time(self.events, start, stop, strict=True)

    def time_to_index(self, t: int) -> int:
        """The last event strictly before t; -1 if none."""
        return self.events.where(F.col("t_us") < t).agg(F.coalesce(F.max("idx"), F.lit(-1))).first()[0]

    def index_to_time(self, index: int) -> int:
        """The time of an event, negative ones from the end."""
        found = select.row(self.events, index).first()
        if found is None:
            raise IndexError(index)
        return found["t_us"]

    def times_to_indices(self, probes: DataFrame) -> DataFrame:
        return temporal.time_to_index(probes, self.events)

    def indices_to_times(self, indices: DataFrame) -> DataFrame:
        return temporal.index_to_time(indices, self.events, self.num_events)

    def windows(self, num_events: int | None = None, time_window: int | None = None) -> DataFrame:
        """events with `window`, by count or by time."""
        if (num_events is None) == (time_window is None):
            raise ValueError("exactly one of num_events and time_window is needed")
        return temporal.count_windows(self.events, num_events) if num_events is not None else temporal.time_windows(self.events, time_window)

    def iter_events(self, num_events: int | None = None, time_window: int | None = None) -> Iterator[DataFrame]:
        """Each window that holds events, as a DataFrame of its own; windows() has all at once."""
        tagged = self.windows(num_events, time_window)
        for r in tagged.select("window").distinct().orderBy("window").toLocalIterator():
            yield tagged.where(F.col("window") == r["window"]).drop("window")

    def stream(self, name: str) -> DataFrame:
        held = self.streams.get(name)
        if held is None:
            raise KeyError(f"{name} is not loaded")
        return held

    def by_time(self, name: str, start: int, stop: int) -> DataFrame:
        return select.by_time(self.stream(name), start, stop)

    def nearest(self, name: str, probes: DataFrame) -> DataFrame:
        return temporal.nearest(probes, self.stream(name))

    def frame_bounds(self) -> DataFrame:
        return temporal.frame_bounds(self.stream("frames").withColumnRenamed("idx", "frame_idx"), self.events)

    def frame_samples(self) -> DataFrame:
        """A row per frame with its events and the nearest rows of pose and depth."""
        frames = self.stream("frames").withColumnRenamed("idx", "frame_idx").select("frame_idx", "t_us")
        return samples.frame_samples(frames, self.events, self.streams.get("pose"), self.streams.get("depth"))

    def interval_samples(self) -> DataFrame:
        """A row per interval between frames, with its events, IMU rows and nearest disparity."""
        frames = self.stream("frames").withColumnRenamed("idx", "frame_idx").select("frame_idx", "t_us")
        return samples.interval_samples(frames, self.events, self.streams.get("imu"), self.streams.get("disparity"))

    def samples(self) -> Samples:
        """Frames by number, each with its events."""
        return Samples(self.frame_samples(), on_close=self.close)

    def undistort(self, mapping: DataFrame, height: int, width: int) -> DataFrame:
        return spatial.undistort(self.events, mapping, height, width)

    def rectify(self, mapping: DataFrame, height: int, width: int) -> DataFrame:
        return spatial.rectify(self.events, mapping, height, width)


def _micros(df: DataFrame) -> DataFrame:
    """t in seconds as whole microseconds t_us."""
    return df.withColumn("t_us", F.rint(F.col("t") * 1e6).cast("long"))


def davis(spark, root: str, name: str | None = None, resolution: tuple[int, int] | None = None, copies: str | None = None) -> Recording:
    """A DAVIS or ECD text recording; files that are missing or hold no rows give empty streams, or None if absent.

    Without a resolution it is that of the first frame, if there is one. copies: a
    folder in which events are kept as Parquet, sorted by place, so that ranges of them
    are found by row-group statistics; made again when the text changes.
    """
    from ..sources import files

    folder = layout.davis_recording(root, name)
    if resolution is not None and min(resolution) < 1:
        raise ValueError(f"resolution must be positive, got {resolution}")
    there = lambda n: files.exists(f"{folder}/{n}")
    streams = {
        "frames": _micros(text.read_index(spark, f"{folder}/images.txt")) if there("images.txt") else None,
        "depth": _micros(text.read_index(spark, f"{folder}/depthmaps.txt")) if there("depthmaps.txt") else None,
        "imu": _micros(text.read_imu(spark, f"{folder}/imu.txt")) if there("imu.txt") else None,
        "pose": _micros(text.read_pose(spark, f"{folder}/groundtruth.txt")) if there("groundtruth.txt") else None,
    }
    if resolution is None and streams["frames"] is not None:
        first = streams["frames"].orderBy("idx").select("path").first()
        if first is not None and first["path"].endswith(".png") and files.read(first["path"], 0, 8) == rasters.SIGNATURE:
            resolution = rasters.png_shape(first["path"])
    read = lambda: _micros(text.read_davis_events(spark, f"{folder}/events.txt")).select("idx", "t_us", "x", "y", "p")
    events = read() if copies is None else cache.cached(spark, copies, f"{folder}/events.txt", "events", read)
    return Recording(events, streams, resolution)


def ecd(spark, root: str, sequence: str) -> Recording:
    """A named recording of the event-camera data set, of a 180 x 240 sensor."""
    from ..schema import SENSORS

    return davis(spark, root, layout.validated(sequence), SENSORS["davis240"])


def batches(frame_samples: DataFrame, size: int) -> DataFrame:
    from ..operators.representations import collate

    return collate(frame_samples, size)


def iterate(frame_samples: DataFrame, order: str = "frame_idx") -> Iterator:
    """Samples in order; each call starts again."""
    return frame_samples.orderBy(order).toLocalIterator()
