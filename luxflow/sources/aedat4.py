"""AEDAT4 containers: packets are listed by one task a file and decoded by many."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import files

MAGIC = b"#!AER-DAT4.0\r\n"
#: Well-known stream names and the packet identifier of each.
STREAMS = {"events": b"EVTS", "frames": b"FRME", "imu": b"IMUS", "triggers": b"TRIG"}
#: Element types of frame formats; eight ids for each number of channels.
PIXELS = ("u1", "i1", "<u2", "<i2", "<i4", "<f4", "<f8")
EVENT = np.dtype([("t", "<i8"), ("x", "<i2"), ("y", "<i2"), ("p", "u1"), ("pad", "V3")])


class Aedat4Error(ValueError):
    """A container that can't be read."""


class Table:
    """A FlatBuffers table; slots are numbered from 0."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at
        self.vtable = at - self._get("<i", at)
        self.slots = (self._get("<H", self.vtable) - 4) // 2

    def _get(self, kind: str, at: int):
        if not 0 <= at <= len(self.data) - struct.calcsize(kind):
            raise Aedat4Error("an offset points outside its buffer")
        return struct.unpack_from(kind, self.data, at)[0]

    @classmethod
    def root(cls, data: bytes, identifier: bytes, prefixed: bool) -> Table:
        at = 4 if prefixed else 0
        if len(data) < at + 8 or (prefixed and struct.unpack_from("<I", data)[0] != len(data) - 4):
            raise Aedat4Error("a size prefix does not fit its buffer")
        if data[at + 4 : at + 8] != identifier:
            raise Aedat4Error(f"expected {identifier!r}, found {data[at + 4:at + 8]!r}")
        return cls(data, at + struct.unpack_from("<I", data, at)[0])

    def place(self, slot: int) -> int | None:
        offset = self._get("<H", self.vtable + 4 + 2 * slot) if slot < self.slots else 0
        return self.at + offset if offset else None

    def number(self, slot: int, kind: str, default=0):
        at = self.place(slot)
        return default if at is None else self._get(kind, at)

    def vector(self, slot: int, width: int) -> tuple[int, int]:
        """(place of the first element, count)."""
        at = self.place(slot)
        if at is None:
            return 0, 0
        at += self._get("<I", at)
        n = self._get("<I", at)
        if at + 4 + n * width > len(self.data):
            raise Aedat4Error("a vector runs past its buffer")
        return at + 4, n

    def raw(self, slot: int) -> bytes:
        at, n = self.vector(slot, 1)
        return self.data[at : at + n]

    def tables(self, slot: int) -> Iterator[Table]:
        at, n = self.vector(slot, 4)
        for k in range(at, at + 4 * n, 4):
            yield Table(self.data, k + self._get("<I", k))


def header(path: str) -> tuple[int, int, int, dict[str, int]]:
    """(place of the first packet, compression, place of the packet table or -1, stream ids by kind)."""
    start = files.read(path, 0, len(MAGIC) + 4)
    if start[: len(MAGIC)] != MAGIC:
        raise Aedat4Error(f"no version line in {path}")
    if len(start) < len(MAGIC) + 4:
        raise Aedat4Error("the header's size is missing")
    n = struct.unpack_from("<I", start, len(MAGIC))[0]
    data = files.read(path, len(start), n)
    if len(data) < n:
        raise Aedat4Error("the header is cut short")
    table = Table.root(data, b"IOHE", prefixed=False)
    return len(start) + n, table.number(0, "<i"), table.number(1, "<q", -1), stream_ids(table.raw(2).decode())


def stream_ids(xml: str) -> dict[str, int]:
    """Stream id of each kind: by its well-known name, else by packet identifier."""
    if not xml:
        return {}
    by_name, by_kind = {}, {}
    for node in ElementTree.fromstring(xml).iter("node"):
        if node.get("name") != "outInfo":
            continue
        for stream in node.findall("node"):
            attrs = {a.get("key"): a.text or "" for a in stream.findall("attr")}
            name, kind = attrs.get("originalOutputName"), attrs.get("typeIdentifier")
            if name is not None and kind is not None and (stream.get("name") or "").isdigit():
                by_name[name] = by_kind[kind] = int(stream.get("name"))
        break
    found = {k: by_name.get(k, by_kind.get(ident.decode())) for k, ident in STREAMS.items()}
    return {k: v for k, v in found.items() if v is not None}


def packets(path: str, kind: str) -> list[tuple[int, int, int]]:
    """(place, size, compression) of each packet of a kind: from the packet table if there are several streams and it is there, else by walking the packets' headers."""
    first, compression, table, ids = header(path)
    if kind not in ids:
        return []
    if table >= 0 and len(ids) > 1:
        raw = files.read(path, table)
        held = Table.root(_inflated(raw, compression) if compression else raw, b"FTAB", prefixed=True)
        out = []
        for row in held.tables(0):
            at = row.place(1)
            stream, n = struct.unpack_from("<ii", row.data, at)
            if stream == ids[kind]:
                out.append((row.number(0, "<q"), n, compression))
        return out
    end = table if table >= 0 else files.size(path)
    system, at = files.opened(path)
    out, place = [], first
    with system.open_input_file(at) as f:
        while place < end:
            f.seek(place)
            head = f.read(8)
            if len(head) < 8:
                raise Aedat4Error("a packet's header is cut short")
            stream, n = struct.unpack("<ii", head)
            if n < 0 or place + 8 + n > end:
                raise Aedat4Error("a packet is cut short")
            if stream == ids[kind]:
                out.append((place + 8, n, compression))
            place += 8 + n
    return out


def _inflated(raw: bytes, compression: int) -> bytes:
    if compression == 0:
        return raw
    if compression not in (1, 2, 3, 4):
        raise Aedat4Error(f"unknown compression {compression}")
    with pa.CompressedInputStream(io.BytesIO(raw), "lz4" if compression < 3 else "zstd") as f:
        return f.read()


def events_of(data: bytes) -> dict[str, list]:
    table = Table.root(data, b"EVTS", prefixed=True)
    at, n = table.vector(0, EVENT.itemsize)
    rows = np.frombuffer(data, EVENT, n, at) if n else np.empty(0, EVENT)
    return {"t_us": rows["t"].astype(np.int64), "x": rows["x"].astype(np.int32), "y": rows["y"].astype(np.int32), "p": rows["p"] != 0}


def frames_of(data: bytes) -> dict[str, list]:
    table = Table.root(data, b"FRME", prefixed=True)
    kind, w, h, pixels = table.number(5, "<b"), table.number(6, "<h"), table.number(7, "<h"), table.raw(10)
    channels, element = kind // 8 + 1, kind % 8
    if not 0 <= kind < 32 or element >= len(PIXELS):
        raise Aedat4Error(f"unknown frame format {kind}")
    if len(pixels) != w * h * channels * np.dtype(PIXELS[element]).itemsize:
        raise Aedat4Error(f"{len(pixels)} bytes of pixels do not fill {w}x{h}x{channels}")
    return {"t_us": [table.number(0, "<q")], "height": [h], "width": [w], "channels": [channels], "format": [kind], "pixels": [pixels]}


def imu_of(data: bytes) -> dict[str, list]:
    rows = [[t.number(0, "<q"), *(t.number(s, "<f", 0.0) for s in range(2, 8))] for t in Table.root(data, b"IMUS", prefixed=True).tables(0)]
    return {n: [r[i] for r in rows] for i, n in enumerate(("t_us", "ax", "ay", "az", "gx", "gy", "gz"))}


def triggers_of(data: bytes) -> dict[str, list]:
    rows = [(t.number(0, "<q"), t.number(1, "<b")) for t in Table.root(data, b"TRIG", prefixed=True).tables(0)]
    return {n: [r[i] for r in rows] for i, n in enumerate(("t_us", "type"))}


_KINDS = {
    "events": (events_of, "t_us long, x int, y int, p boolean"),
    "frames": (frames_of, "t_us long, height int, width int, channels int, format int, pixels binary"),
    "imu": (imu_of, "t_us long, ax double, ay double, az double, gx double, gy double, gz double"),
    "triggers": (triggers_of, "t_us long, type int"),
}


def read(spark: SparkSession, paths: str | list[str], kind: str = "events") -> DataFrame:
    """One stream of AEDAT4 files: recording, packet, row (its place in the packet) and the stream's columns."""
    decoded, columns = _KINDS[kind]
    listed = spark.createDataFrame([(p,) for p in ([paths] if isinstance(paths, str) else paths)], "recording string")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = packets(path, kind)
                yield pa.RecordBatch.from_pydict({"recording": pa.array([path] * len(rows), pa.string()), "packet": pa.array(np.arange(len(rows))), "at": pa.array([r[0] for r in rows], pa.int64()), "size": pa.array([r[1] for r in rows], pa.int64()), "compression": pa.array([r[2] for r in rows], pa.int32())})

    schema = spark.createDataFrame([], f"recording string, packet long, row long, {columns}").schema

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in batches:
            for path, packet, at, n, compression in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                made = decoded(_inflated(files.read(path, at, n), compression))
                count = len(made["t_us"])
                values = {"recording": [path] * count, "packet": [packet] * count, "row": np.arange(count), **made}
                yield pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) for f in kinds], schema=kinds)

    found = listed.repartition("recording").mapInArrow(find, "recording string, packet long, at long, size long, compression int")
    return found.repartition("recording", "packet").mapInArrow(decode, schema)


def read_events(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Events (recording, idx, t_us, x, y, p), idx dense in packet order."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = read(spark, paths, "events")
    sizes = rows.groupBy("recording", "packet").agg(F.count("*").alias("_n"))
    before = sizes.select("recording", "packet", (F.sum("_n").over(Window.partitionBy("recording").orderBy("packet")) - F.col("_n")).alias("_before"))
    return rows.join(before, ["recording", "packet"]).select("recording", (F.col("_before") + F.col("row")).alias("idx"), "t_us", "x", "y", "p")
