"""Codec words and records as a data source whose partitions are byte ranges, so one huge recording is read by many tasks and many small ones by few.

format("luxflow_words") gives (recording, i, v): 16-bit little-endian words after an
EVT3 header. format("luxflow_records") gives (recording, i, b0..b4): 5-byte records.
Decoding them is window algebra (operators.decode), in buckets of i.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import decode
from . import files

#: Bytes of a range, and tasks over which smaller ranges are dealt.
RANGE, TASKS = 32 << 20, 64


class Ranges(InputPartition):
    """Byte ranges of one task: (path, start, end, number of the first word)."""

    def __init__(self, parts: list[tuple[str, int, int, int]]):
        self.parts = parts


def dealt(ranges: list[tuple[str, int, int, int]], tasks: int = TASKS) -> list[Ranges]:
    """Ranges in order, dealt by bytes over no more than `tasks` tasks, or as many as have RANGE bytes each; those of a task that follow one another in a file are one."""
    total = sum(end - start for _, start, end, _ in ranges)
    share = total / min(len(ranges), max(tasks, -(-total // RANGE))) if ranges else 1
    out: list[Ranges] = []
    before, last = 0, None
    for path, start, end, first in ranges:
        at = int(before / share)
        before += end - start
        if at != last:
            out.append(Ranges([]))
            last = at
        held = out[-1].parts
        if held and held[-1][0] == path and held[-1][2] == start:
            held[-1] = (path, held[-1][1], end, held[-1][3])
        else:
            held.append((path, start, end, first))
    return out


def evt3_header(data: bytes) -> tuple[int, dict[str, str]]:
    """Length of the leading `% ` lines, and their fields; an error if they declare another format than EVT3."""
    at, found = 0, {}
    while data[at : at + 2] == b"% ":
        end = data.find(b"\n", at)
        if end < 0:
            break
        line = data[at + 2 : end].decode("ascii", "replace").strip()
        at = end + 1
        key, _, value = line.partition(" ")
        if key == "end":
            break
        found[key.lower()] = value.strip()
    kind, version = found.get("format", ""), found.get("evt", "")
    if (kind and "EVT3" not in kind.upper()) or (not kind and version and version not in ("3", "3.0")):
        raise ValueError(f"not an EVT3 recording: {found}")
    return at, found


class _Reader(DataSourceReader):
    width = 2

    def __init__(self, path: str, span: int):
        self.path, self.span = path, max(self.width, span // self.width * self.width)

    def header(self, path: str) -> int:
        return evt3_header(files.read(path, 0, 1 << 16))[0]

    def partitions(self) -> list[Ranges]:
        out = []
        for path in self.path.split(","):
            low = self.header(path)
            high = low + (files.size(path) - low) // self.width * self.width  # an odd rest at the end is dropped
            out += [(path, at, min(at + self.span, high), (at - low) // self.width) for at in range(low, high, self.span)]
        return dealt(out) or [Ranges([])]

    def arrays(self, raw: bytes) -> list[pa.Array]:
        return [pa.array(np.frombuffer(raw, "<u2").astype(np.int32))]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        step = (1 << 20) // self.width * self.width
        for path, start, end, number in partition.parts:
            for at in range(start, end, step):
                raw = files.read(path, at, min(step, end - at))
                first = number + (at - start) // self.width
                n = len(raw) // self.width
                yield pa.RecordBatch.from_arrays([pa.repeat(path, n), pa.array(np.arange(first, first + n)), *self.arrays(raw)], ["recording", "i", *self.fields])

    fields = ("v",)


class _RecordReader(_Reader):
    width = 5
    fields = ("b0", "b1", "b2", "b3", "b4")

    def header(self, path: str) -> int:
        return 0

    def arrays(self, raw: bytes) -> list[pa.Array]:
        table = np.frombuffer(raw, np.uint8).reshape(-1, 5).astype(np.int32)
        return [pa.array(np.ascontiguousarray(table[:, k])) for k in range(5)]


class Words(DataSource):
    @classmethod
    def name(cls) -> str:
        return "luxflow_words"

    def schema(self) -> str:
        return "recording string, i long, v int"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("range", RANGE)))


class Records(DataSource):
    @classmethod
    def name(cls) -> str:
        return "luxflow_records"

    def schema(self) -> str:
        return "recording string, i long, b0 int, b1 int, b2 int, b3 int, b4 int"

    def reader(self, schema) -> DataSourceReader:
        return _RecordReader(self.options["path"], int(self.options.get("range", RANGE)))


def _read(spark: SparkSession, source: type[DataSource], paths: str | list[str], span: int) -> DataFrame:
    spark.dataSource.register(source)
    path = paths if isinstance(paths, str) else ",".join(paths)
    return spark.read.format(source.name()).option("range", span).load(path)


def read_evt3(spark: SparkSession, paths: str | list[str], span: int = RANGE, strict_time: bool = False) -> DataFrame:
    """Events (recording, idx, t_us, x, y, p) of EVT3 recordings."""
    return decode.evt3(_read(spark, Words, paths, span), by=["recording"], strict_time=strict_time)


def read_bin(spark: SparkSession, paths: str | list[str], span: int = RANGE) -> DataFrame:
    """Events (recording, i, t_us, x, y, p) of 5-byte records; i skips the overflow markers."""
    return decode.records(_read(spark, Records, paths, span), by=["recording"])
