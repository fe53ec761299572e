"""ROS 1 bags (format 2.0): IMU and point-cloud topics."""

from __future__ import annotations

import bz2
import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files

MAGIC = b"#ROSBAG V2.0\n"
#: Record types of the format, and element types of point fields.
MESSAGE, CHUNK, CONNECTION = 2, 5, 7
ELEMENTS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 8: "f8"}


def _records(data: bytes, at: int = 0) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    while at < len(data):
        n = struct.unpack_from("<I", data, at)[0]
        head, at = _fields(data[at + 4 : at + 4 + n]), at + 4 + n
        size = struct.unpack_from("<I", data, at)[0]
        yield head, data[at + 4 : at + 4 + size]
        at += 4 + size


def parts(path: str) -> tuple[list[tuple[int, int, bytes]], dict[int, str]]:
    """(place, size, packing) of each chunk of a bag, and the topic of each connection listed outside of chunks; chunks themselves are skipped over, not read."""
    system, at = files.opened(path)
    chunks, names = [], {}
    with system.open_input_file(at) as f:
        size = f.size()
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a ROS 1 bag")
        while f.tell() < size:
            head = _fields(f.read(struct.unpack("<I", f.read(4))[0]))
            n, place = struct.unpack("<I", f.read(4))[0], f.tell()
            if place + n > size:
                raise ValueError(f"{path} is cut short")
            kind = head[b"op"][0]
            if kind == CHUNK:
                chunks.append((place, n, head[b"compression"]))
            elif kind == CONNECTION:
                names[struct.unpack("<I", head[b"conn"])[0]] = head[b"topic"].decode()
            f.seek(place + n)
    return chunks, names


def _fields(raw: bytes) -> dict[bytes, bytes]:
    found, at = {}, 0
    while at < len(raw):
        size = struct.unpack_from("<I", raw, at)[0]
        key, _, value = raw[at + 4 : at + 4 + size].partition(b"=")
        found[key] = value
        at += 4 + size
    return found


def _unpacked(body: bytes, how: bytes) -> bytes:
    if how not in (b"none", b"bz2"):
        raise ValueError(f"unsupported chunk compression {how!r}")
    return bz2.decompress(body) if how == b"bz2" else body


def connections(body: bytes) -> dict[int, str]:
    """The topic of each connection that an unpacked chunk lists."""
    return {struct.unpack("<I", head[b"conn"])[0]: head[b"topic"].decode() for head, _ in _records(body) if head[b"op"][0] == CONNECTION}


def messages(body: bytes, topic: str, names: dict[int, str]) -> Iterator[tuple[int, bytes]]:
    """(time in ns, body) of a topic's messages in an unpacked chunk, in order."""
    for head, data in _records(body):
        if head[b"op"][0] == MESSAGE and names.get(struct.unpack("<I", head[b"conn"])[0]) == topic:
            s, ns = struct.unpack("<II", head[b"time"])
            yield s * 1_000_000_000 + ns, data


def _header(body: bytes) -> tuple[str, int]:
    """(frame id, place after the header)."""
    n = struct.unpack_from("<I", body, 12)[0]
    return body[16 : 16 + n].decode(), 16 + n


def imu(body: bytes) -> list[float]:
    """Angular velocity, acceleration, quaternion (x, y, z, w)."""
    _, at = _header(body)
    q = struct.unpack_from("<4d", body, at)
    w = struct.unpack_from("<3d", body, at + 32 + 72)
    a = struct.unpack_from("<3d", body, at + 32 + 72 + 24 + 72)
    return [*w, *a, *q]


def points(body: bytes) -> tuple[str, np.ndarray]:
    """(frame id, points) of a PointCloud2; padding between rows is left out."""
    frame, at = _header(body)
    height, width, n = struct.unpack_from("<III", body, at)
    at += 12
    names, kinds, offsets = [], [], []
    for _ in range(n):
        size = struct.unpack_from("<I", body, at)[0]
        names.append(body[at + 4 : at + 4 + size].decode())
        offset, kind, count = struct.unpack_from("<IBI", body, at + 4 + size)
        if kind not in ELEMENTS:
            raise ValueError(f"unknown point field type {kind}")
        offsets.append(offset)
        kinds.append((ELEMENTS[kind], count))
        at += 4 + size + 9
    big, step, row, size = struct.unpack_from("<BIII", body, at)
    order = ">" if big else "<"
    dtype = np.dtype({"names": names, "formats": [order + k if c == 1 else (order + k, (c,)) for k, c in kinds], "offsets": offsets, "itemsize": step or 1})
    if not height or not width:
        return frame, np.empty(0, dtype)
    if step <= 0 or row < step * width or size < row * height:
        raise ValueError("the point cloud's layout does not fit its data")
    data = body[at + 13 : at + 13 + row * height]
    return frame, np.concatenate([np.frombuffer(data, dtype, width, y * row) for y in range(height)])


def _read(spark: SparkSession, paths: str | list[str], topic: str, columns: str, row_of: Callable[[int, bytes], dict], batch: int = 256) -> DataFrame:
    """(recording, idx, columns) of a topic's messages; a task lists a bag's chunks, others read a chunk each.

    Bags whose chunks rely on connections listed in earlier chunks only, which their
    index would repeat, have those collected by the listing task.
    """
    listed = spark.createDataFrame([(p,) for p in ([paths] if isinstance(paths, str) else paths)], "recording string").repartition("recording")
    schema = spark.createDataFrame([], f"recording string, chunk long, row long, {columns}").schema

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for path in rows.column(0).to_pylist():
                chunks, names = parts(path)
                if not names:
                    for place, n, how in chunks:
                        names |= connections(_unpacked(files.read(path, place, n), how))
                made = [{"recording": path, "chunk": i, "place": place, "size": n, "how": how.decode(), "names": json.dumps(names)} for i, (place, n, how) in enumerate(chunks)]
                yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("recording", pa.string()), ("chunk", pa.int64()), ("place", pa.int64()), ("size", pa.int64()), ("how", pa.string()), ("names", pa.string())]))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for rows in batches:
            for r in rows.to_pylist():
                body = _unpacked(files.read(r["recording"], r["place"], r["size"]), r["how"].encode())
                names = {int(k): v for k, v in json.loads(r["names"]).items()} | connections(body)
                held: list[dict] = []
                for i, (t, data) in enumerate(messages(body, topic, names)):
                    held.append({"recording": r["recording"], "chunk": r["chunk"], "row": i, **row_of(t, data)})
                    if len(held) == batch:
                        yield pa.RecordBatch.from_pylist(held, schema=kinds)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=kinds)

    found = listed.mapInArrow(find, "recording string, chunk long, place long, size long, how string, names string")
    rows = found.repartition("recording", "chunk").mapInArrow(decode, schema)
    sizes = rows.groupBy("recording", "chunk").agg(F.count("*").alias("_n"))
    before = sizes.select("recording", "chunk", (F.sum("_n").over(Window.partitionBy("recording").orderBy("chunk")) - F.col("_n")).alias("_before"))
    names = [f.name for f in schema if f.name not in ("recording", "chunk", "row")]
    return rows.join(before, ["recording", "chunk"]).select("recording", (F.col("_before") + F.col("row")).alias("idx"), *names)


def read_imu(spark: SparkSession, paths: str | list[str], topic: str = "/imu/data") -> DataFrame:
    names = ("wx", "wy", "wz", "ax", "ay", "az", "qx", "qy", "qz", "qw")
    columns = "t_ns long, " + ", ".join(f"{n} double" for n in names)
    return _read(spark, paths, topic, columns, lambda t, body: {"t_ns": t, **dict(zip(names, imu(body), strict=True))})


def read_lidar(spark: SparkSession, paths: str | list[str], topic: str = "/velodyne_points") -> DataFrame:
    """(recording, idx, t_ns, frame_id, points): a scan's points as structs of x, y, z, intensity, ring and time; fields that a bag lacks are null."""
    fields = (("x", float), ("y", float), ("z", float), ("intensity", float), ("ring", int), ("time", float))

    def row(t: int, body: bytes) -> dict:
        frame, cloud = points(body)
        held = {n: cloud[n].tolist() if n in (cloud.dtype.names or ()) else [None] * len(cloud) for n, _ in fields}
        return {"t_ns": t, "frame_id": frame, "points": [{n: None if v is None else kind(v) for (n, kind), v in zip(fields, values, strict=True)} for values in zip(*held.values(), strict=True)]}

    return _read(spark, paths, topic, "t_ns long, frame_id string, points array<struct<x:float,y:float,z:float,intensity:float,ring:int,time:float>>", row, 4)
