"""Bytes of recordings in the formats that are read here: EVT3, 5-byte records, AEDAT4, ROS 1 bags; and files written by the tasks that hold their rows."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import aedat4, files, rosbag


def put(rows: DataFrame, name: Callable[[int], str], content: Callable[[pd.DataFrame], bytes], by: str = "file") -> list[str]:
    """Writes a file for each value of the integer column `by`, from its rows, in the task that holds them; their paths, in order.

    A file's rows are in one task, so files must be of bounded size.
    """

    def one(part: pd.DataFrame) -> pd.DataFrame:
        number = int(part[by].iloc[0])
        files.write(name(number), content(part))
        return pd.DataFrame({"file": [number]})

    return [name(r["file"]) for r in rows.groupBy(by).applyInPandas(one, "file long").orderBy("file").collect()]  # a row for each file


def evt3(rows: pd.DataFrame, header: bytes = b"") -> bytes:
    """EVT3 words of events (t_us, x, y, p): each with its time, row and column."""
    t, x, y, p = (rows[c].to_numpy(np.int64) for c in ("t_us", "x", "y", "p"))
    words = np.stack([0x8000 | t >> 12 & 0xFFF, 0x6000 | t & 0xFFF, y & 0x7FF, 0x2000 | p << 11 | x & 0x7FF], axis=1)
    return header + words.astype("<u2").tobytes()


def records(rows: pd.DataFrame) -> bytes:
    """5-byte records of events (t_us, x, y, p); times below 2^23."""
    t, x, y, p = (rows[c].to_numpy(np.int64) for c in ("t_us", "x", "y", "p"))
    return np.stack([x, y, p << 7 | t >> 16 & 127, t >> 8 & 255, t & 255], axis=1).astype(np.uint8).tobytes()


class Flat:
    """A small FlatBuffers writer: tables of scalars and references, appended one after another."""

    def __init__(self):
        self.parts = bytearray()

    def table(self, slots):
        """slots: {number: (format, value) or ('ref', position)} -> position."""
        while len(self.parts) % 8:
            self.parts += b"\0"
        n = max(slots, default=-1) + 1
        vtable = len(self.parts)
        at, offsets = 8, {}
        for k, (kind, value) in slots.items():
            size = 4 if kind == "ref" else struct.calcsize(kind)
            at = -(-at // size) * size
            offsets[k] = at
            at += size
        vsize = 4 + 2 * n
        pad = -(vtable + vsize) % 8
        start = vtable + vsize + pad
        self.parts += struct.pack("<HH", vsize, at) + b"".join(struct.pack("<H", offsets.get(k, 0)) for k in range(n)) + bytes(pad)
        body = bytearray(at)
        struct.pack_into("<i", body, 0, start - vtable)
        self.parts += body
        for k, (kind, value) in slots.items():
            place = start + offsets[k]
            if kind == "ref":
                self.fix(place, value)
            else:
                struct.pack_into(kind, self.parts, place, *(value if isinstance(value, tuple) else (value,)))
        return start

    def fix(self, place, target):
        self.refs = getattr(self, "refs", [])
        self.refs.append((place, target))

    def vector(self, raw, n):
        while (len(self.parts) + 4) % 8:
            self.parts += b"\0"
        at = len(self.parts)
        self.parts += struct.pack("<I", n) + raw
        return at

    def finish(self, build, ident, prefixed=True):
        """build returns the root; references are laid out by a second vector of positions behind their users."""
        root = build(self)
        out = bytearray(struct.pack("<I", root + 8) + ident) + self.parts
        for place, target in getattr(self, "refs", []):
            struct.pack_into("<I", out, place + 8, target - place)
        return (struct.pack("<I", len(out)) if prefixed else b"") + bytes(out)


def packet(ident, raw_vector, n, more=None, slot=0):
    """A root table whose slot refers to a vector behind it."""
    f = Flat()

    def build(f):
        slots = {slot: ("ref", 0), **(more or {})}
        root = f.table(slots)
        v = f.vector(raw_vector, n)
        f.refs = [(p, v) for p, _ in f.refs]
        return root

    return f.finish(build, ident)


def tables_packet(ident, tables):
    f = Flat()

    def build(f):
        root = f.table({0: ("ref", 0)})
        user = f.refs.pop()[0]
        v = f.vector(bytes(4 * len(tables)), len(tables))
        refs = [(user, v)]
        for i, t in enumerate(tables):
            refs.append((v + 4 + 4 * i, f.table(t)))
        f.refs = refs
        return root

    return f.finish(build, ident)


def aedat4_file(streams, packets, compression=0, table=True):
    """Bytes of a container: streams (name, type) by number, packets (stream, bytes)."""
    xml = '<dv><node name="outInfo">' + "".join(f'<node name="{i}"><attr key="originalOutputName">{n}</attr><attr key="typeIdentifier">{t}</attr></node>' for i, (n, t) in enumerate(streams)) + "</node></dv>"
    squeeze = (lambda b: pa.Codec("lz4").compress(b, asbytes=True)) if compression in (1, 2) else (lambda b: pa.Codec("zstd").compress(b, asbytes=True)) if compression else (lambda b: b)

    def head(position):
        f = Flat()

        def build(f):
            root = f.table({0: ("<i", compression), 1: ("<q", position), 2: ("ref", 0)})
            v = f.vector(xml.encode(), len(xml))
            f.refs = [(p, v) for p, _ in f.refs]
            return root

        return f.finish(build, b"IOHE", prefixed=False)

    body, index = b"", []
    first = len(aedat4.MAGIC) + 4 + len(head(0))
    for stream, data in packets:
        data = squeeze(data)
        index.append((first + len(body) + 8, stream, len(data)))
        body += struct.pack("<ii", stream, len(data)) + data
    end = squeeze(tables_packet(b"FTAB", [{0: ("<q", at), 1: ("<ii", (s, n))} for at, s, n in index])) if table else b""
    h = head(first + len(body) if table else -1)
    return aedat4.MAGIC + struct.pack("<I", len(h)) + h + body + end


def events_packet(rows: pd.DataFrame) -> bytes:
    body = np.zeros(len(rows), aedat4.EVENT)
    for name, column in (("t", "t_us"), ("x", "x"), ("y", "y"), ("p", "p")):
        body[name] = rows[column].to_numpy()
    return packet(b"EVTS", body.tobytes(), len(rows))


def frame_packet(t_us: int, image: np.ndarray) -> bytes:
    """A frame of (height, width) bytes."""
    return packet(b"FRME", image.astype(np.uint8).tobytes(), image.size, {0: ("<q", t_us), 5: ("<b", 0), 6: ("<h", image.shape[1]), 7: ("<h", image.shape[0])}, slot=10)


def imu_packet(rows: list[tuple]) -> bytes:
    """rows: time, then acceleration and angular velocity."""
    return tables_packet(b"IMUS", [{0: ("<q", int(r[0])), **{2 + k: ("<f", float(v)) for k, v in enumerate(r[1:])}} for r in rows])


def triggers_packet(rows: list[tuple[int, int]]) -> bytes:
    return tables_packet(b"TRIG", [{0: ("<q", int(t)), 1: ("<b", int(kind))} for t, kind in rows])


def bag(topic_bodies):
    def record(head, body):
        h = b"".join(struct.pack("<I", len(k) + 1 + len(v)) + k + b"=" + v for k, v in head.items())
        return struct.pack("<I", len(h)) + h + struct.pack("<I", len(body)) + body

    topics = sorted({t for t, _, _ in topic_bodies})
    inner = b"".join(record({b"op": bytes([7]), b"conn": struct.pack("<I", i), b"topic": t.encode()}, b"") for i, t in enumerate(topics))
    inner += b"".join(record({b"op": bytes([2]), b"conn": struct.pack("<I", topics.index(t)), b"time": struct.pack("<II", ns // 10**9, ns % 10**9)}, body) for t, ns, body in topic_bodies)
    return rosbag.MAGIC + record({b"op": bytes([3])}, bytes(10)) + record({b"op": bytes([5]), b"compression": b"none"}, inner)


def bag_imu(w: list[float], a: list[float], q: list[float]) -> bytes:
    """The body of an IMU message."""
    head = struct.pack("<III", 0, 1, 2) + struct.pack("<I", 3) + b"imu"
    return head + struct.pack("<4d", *q) + bytes(72) + struct.pack("<3d", *w) + bytes(72) + struct.pack("<3d", *a) + bytes(72)


def bag_points(rows: list[tuple], padding: int = 6) -> bytes:
    """The body of a point cloud message of one row: x, y, z, intensity, ring, time; padding bytes after it."""
    fields = b"".join(struct.pack("<I", len(n)) + n + struct.pack("<IBI", o, k, 1) for n, o, k in ((b"x", 0, 7), (b"y", 4, 7), (b"z", 8, 7), (b"intensity", 12, 7), (b"ring", 16, 4), (b"time", 18, 7)))
    head = struct.pack("<III", 0, 1, 2) + struct.pack("<I", 3) + b"vel"
    body = b"".join(struct.pack("<4fHf", *r) for r in rows) + bytes(padding)
    return head + struct.pack("<III", 1, len(rows), 6) + fields + struct.pack("<BIII", 0, 22, 22 * len(rows) + padding, len(body)) + body + b"\1"
