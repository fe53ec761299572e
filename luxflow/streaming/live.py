"""Live recordings: growing files as streams, windows with watermarks, state carried across batches."""

from __future__ import annotations

import itertools
import os
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.reconstruction import Frames, Model, image_rows, voxels
from ..shared import place
from ..sources import files

#: Rows of a batch that a task holds at a time, and of an unfinished window that go into the state itself.
ROWS, HELD = 1 << 18, 1 << 12
EVENTS = "recording string, idx long, t_us long, x int, y int, p boolean"


def tail(spark: SparkSession, folder: str, schema: str = EVENTS, max_files: int = 100) -> DataFrame:
    """Event Parquet files as they arrive in a folder; nothing new is not the end."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def stamped(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.timestamp_micros("t_us"))


def window_counts(events: DataFrame, width_us: int, late_us: int = 0) -> DataFrame:
    """(recording, start_us, on, off) of tumbling windows, aligned to the epoch; rows later than the watermark are dropped, unlike slices below."""
    w = F.window("ts", f"{width_us} microseconds")
    counted = stamped(events).withWatermark("ts", f"{late_us} microseconds").groupBy("recording", w.alias("w")).agg(F.sum(F.col("p").cast("long")).alias("on"), F.sum((~F.col("p")).cast("long")).alias("off"))
    return counted.select("recording", F.unix_micros("w.start").alias("start_us"), "on", "off")


def ordered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A group's rows in idx order, a range of ROWS idx at a time. More rows than that lie in a file for each range meanwhile, so that memory does not grow with the batch."""
    columns, held, n = ["idx", "t_us", "x", "y", "p"], [], 0
    for part in parts:
        held.append(part[columns].copy())
        n += len(part)
        if n > ROWS:
            break
    if n <= ROWS:
        yield pd.concat(held).sort_values("idx", kind="stable")
        return
    with tempfile.TemporaryDirectory() as folder:
        there = set()
        for part in itertools.chain(held, (p[columns] for p in parts)):
            for number, rows in part.groupby(part["idx"] // ROWS):
                there.add(number)
                with open(os.path.join(folder, str(number)), "ab") as f:
                    pickle.dump(rows, f)
        held.clear()
        for number in sorted(there):
            with open(os.path.join(folder, str(number)), "rb") as f:
                end, found = os.fstat(f.fileno()).st_size, []
                while f.tell() < end:
                    found.append(pickle.load(f))
            yield pd.concat(found).sort_values("idx", kind="stable")


SLICES = "recording string, slice long, y int, x int, on long, off long"
_STATE = "t0 long, slice long"


def slice_counts(events: DataFrame, slice_us: int) -> DataFrame:
    """(recording, slice, y, x, on, off) per batch and slice; sums of these are the recording's.

    Slices count from a recording's first event. A late event counts into the slice
    that is current when it comes, never an older one; what is kept between batches is
    the first time and the current slice.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t0, now = state.get if state.exists else (None, 0)
        open_: pd.DataFrame | None = None  # counts of the current slice so far

        def counts(made: pd.DataFrame) -> pd.DataFrame:
            return made.groupby(["slice", "y", "x"], as_index=False)[["on", "off"]].sum()

        for rows in ordered(parts):
            t0 = int(rows["t_us"].iloc[0]) if t0 is None else t0
            own = ((rows["t_us"] - t0) // slice_us).clip(lower=now).cummax()
            now = int(own.iloc[-1])
            made = counts(rows.assign(slice=own, on=rows["p"].astype("int64"), off=(~rows["p"].astype(bool)).astype("int64")))
            made = made if open_ is None else counts(pd.concat([open_, made]))
            done, open_ = made[made["slice"] < now], made[made["slice"] == now]
            yield done.assign(recording=key[0])[["recording", "slice", "y", "x", "on", "off"]]
        state.update((t0, now))
        yield open_.assign(recording=key[0])[["recording", "slice", "y", "x", "on", "off"]]

    return events.groupBy("recording").applyInPandasWithState(step, SLICES, _STATE, "append", GroupStateTimeout.NoTimeout)


class Waiting:
    """The events of a slice that has not ended: up to HELD of them here, the others in files of a folder."""

    def __init__(self, folder: str, number: int = 0):
        self.folder, self.slice, self.ends = folder, number, None
        self.paths: list[str] = []
        self.held = np.empty(0, np.dtype([("t", np.int64), ("x", np.int32), ("y", np.int32), ("p", bool)]))

    def add(self, rows: pd.DataFrame) -> None:
        made = np.empty(len(rows), self.held.dtype)
        made["t"], made["p"] = rows["t_us"].to_numpy(), rows["p"].to_numpy()
        made["x"], made["y"] = rows["x"].fillna(-1).to_numpy(), rows["y"].fillna(-1).to_numpy()  # nowhere on the sensor
        low, high = self.ends or (made["t"][0], made["t"][0])
        self.ends = int(min(low, made["t"].min())), int(max(high, made["t"].max()))
        self.held = np.concatenate([self.held, made])
        if len(self.held) > HELD:
            self.paths.append(f"{self.folder}/{uuid.uuid4().hex}")
            files.write(self.paths[-1], self.held.tobytes())
            self.held = self.held[:0].copy()

    def pieces(self) -> Iterator[np.ndarray]:
        for path in self.paths:
            yield np.frombuffer(files.read(path), self.held.dtype)
        yield self.held


IMAGES = "recording string, frame_idx long, y int, x int, value double"


def reconstructions(events: DataFrame, slice_us: int, height: int, width: int, bins: int, run: Callable[[], Model], encoders: int = 2) -> DataFrame:
    """IMAGES rows: a model's image of each slice of every recording, as soon as an event of a later slice has come.

    Slices and late events are as in slice_counts; slices without events have no image.
    Between batches are kept, for each recording, the first time, the current slice
    with its events so far, and the model's state, so images are those of the whole
    recording in one run. More than HELD events of the current slice lie in files of the
    shared folder, which the state names: the state goes to the task with every few
    rows of a batch.
    """
    folder = place(events.sparkSession, "waiting")

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t0, waiting, kept = pickle.loads(state.get[0]) if state.exists else (None, Waiting(folder), None)
        frames = Frames(height, width, bins, run(), encoders, kept)
        for rows in ordered(parts):
            t = rows["t_us"].to_numpy()
            t0 = int(t[0]) if t0 is None else t0
            own = np.maximum.accumulate(np.maximum((t - t0) // slice_us, waiting.slice))
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for low, high in itertools.pairwise(cuts):
                if own[low] > waiting.slice:
                    if waiting.ends is not None:
                        image = frames.step(*voxels(waiting.pieces, bins, height, width, waiting.ends))
                        yield image_rows(waiting.slice, image).assign(recording=key[0])[["recording", "frame_idx", "y", "x", "value"]]
                    waiting = Waiting(folder, int(own[low]))
                waiting.add(rows.iloc[low:high])
        state.update((pickle.dumps((t0, waiting, frames.state)),))

    return events.groupBy("recording").applyInPandasWithState(step, IMAGES, "held binary", "append", GroupStateTimeout.NoTimeout)


def newest(stream: DataFrame, show: Callable[[DataFrame], None], column: str = "slice"):
    """A query that hands over only each batch's newest slice of every recording."""

    def latest(batch: DataFrame, _: int) -> None:
        top = batch.groupBy("recording").agg(F.max(column).alias(column))
        show(batch.join(top, ["recording", column], "left_semi"))

    return stream.writeStream.foreachBatch(latest)
