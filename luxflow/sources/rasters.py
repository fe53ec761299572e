"""Images and dense fields: PNG, NPZ, and HDF5 where its library is there."""

from __future__ import annotations

import io
import struct
import warnings
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, channels), 8 or 16 bits, of a PNG without interlacing or palette."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, parts, head = 8, [], None
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", data, at + 8)
        elif kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    width, height, depth, color, _, _, interlaced = head
    if depth not in (8, 16) or color not in (0, 2, 4, 6) or interlaced:
        raise ValueError(f"unsupported PNG: depth {depth}, color {color}, interlaced {interlaced}")
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[color]
    step = channels * depth // 8
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height + 1, width * step), np.uint8)
    for y in range(height):
        kind, line, up = rows[y, 0], rows[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            out[y + 1] = np.add.accumulate(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            out[y + 1] = line + up
        else:
            now = bytearray(line.tobytes())
            above = up.tobytes()
            for i in range(len(now)):
                a, b = now[i - step] if i >= step else 0, above[i]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = above[i - step] if i >= step else 0
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                now[i] = (now[i] + guess) & 255
            out[y + 1] = np.frombuffer(bytes(now), np.uint8)
    pixels = out[1:].reshape(height, width * channels, depth // 8)
    values = pixels[:, :, 0].astype(np.uint16) if depth == 8 else pixels[:, :, 0].astype(np.uint16) << 8 | pixels[:, :, 1]
    return values.astype(np.uint8 if depth == 8 else np.uint16).reshape(height, width, channels)


def png_shape(path: str) -> tuple[int, int]:
    """(height, width) of a PNG file, from its first bytes."""
    width, height = struct.unpack(">II", files.read(path, 16, 8))
    return height, width


def encode_png(image: np.ndarray) -> bytes:
    """A PNG of (height, width) or (height, width, 1 to 4) pixels of 8 or 16 bits."""
    image = image[:, :, None] if image.ndim == 2 else image
    height, width, channels = image.shape
    rows = image.astype(">u2").view(np.uint8) if image.dtype.itemsize == 2 else image.astype(np.uint8)
    raw = np.concatenate([np.zeros((height, 1), np.uint8), rows.reshape(height, -1)], axis=1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8 * image.dtype.itemsize, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


IMAGE = "path string, height int, width int, channels int, pixels array<int>"


def read_png(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, channels, pixels) of PNG files, decoded by the tasks that read them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                image = decode_png(data)
                h, w, c = image.shape
                yield pa.RecordBatch.from_arrays([pa.array([name]), *[pa.array([v], pa.int32()) for v in (h, w, c)], pa.array([image.ravel().astype(np.int32)], pa.list_(pa.int32()))], ["path", "height", "width", "channels", "pixels"])

    raw = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:", "").alias("path"), "content")
    return raw.mapInArrow(run, IMAGE)


def read_frames(spark: SparkSession, index: str) -> DataFrame:
    """(idx, t, path, height, width, channels, pixels): the images of a list of times and names."""
    from .text import read_index

    listed = read_index(spark, index)
    return listed.join(read_png(spark, f"{index.rpartition('/')[0]}/*.png"), "path").select("idx", "t", "path", "height", "width", "channels", "pixels")


def depth_of(images: DataFrame) -> DataFrame:
    """(path, y, x, depth) of one-channel depth images, their values as they are."""
    return pixels(images).where("channel = 0").select("path", "y", "x", F.col("value").cast("float").alias("depth"))


def same_shape(images: DataFrame) -> DataFrame:
    """images, or an error if their shapes differ."""
    shapes = images.select("height", "width", "channels").distinct().limit(2).count()
    if shapes > 1:
        raise ValueError("images differ in shape")
    return images


def pixels(images: DataFrame) -> DataFrame:
    """(path, y, x, channel, value), one row per value."""
    at = images.select("path", "width", "channels", F.posexplode("pixels").alias("k", "value"))
    cell = F.floor(F.col("k") / F.col("channels"))
    return at.select("path", F.floor(cell / F.col("width")).cast("int").alias("y"), (cell % F.col("width")).cast("int").alias("x"), (F.col("k") % F.col("channels")).cast("int").alias("channel"), "value")


def flow_of(images: DataFrame) -> DataFrame:
    """(path, y, x, fx, fy, valid) of 16-bit flow images: red and green hold (value - 2^15) / 128, blue whether it holds."""
    value = lambda c: F.max(F.when(F.col("channel") == c, F.col("value")))
    flow = lambda c: ((value(c) - 32768) / 128.0).cast("float")
    return pixels(images).groupBy("path", "y", "x").agg(flow(0).alias("fx"), flow(1).alias("fy"), (value(2) != 0).alias("valid"))


def disparity_of(images: DataFrame) -> DataFrame:
    """(path, y, x, disparity, valid) of 16-bit disparity images in units of 1/256; 0 is no measurement."""
    return pixels(images).select("path", "y", "x", (F.col("value") / 256.0).cast("float").alias("disparity"), (F.col("value") > 0).alias("valid"))


def ordinals(images: DataFrame, times: DataFrame) -> DataFrame:
    """images by name joined to times (idx, ...) by place; an error if the numbers differ."""
    from ..operators.select import numbered

    if images.count() != times.count():
        raise ValueError("images and timestamps differ in number")
    return numbered(images, "path", name="idx").join(times, "idx")


def npz_members(path: str) -> dict[str, tuple[int, int, int]]:
    """Each member of an archive: where its header begins in the file, its bytes there, and how they are packed; only the archive's directory is read."""
    system, at = files.opened(path)
    with system.open_input_file(at) as f, zipfile.ZipFile(pa.PythonFile(f) if not hasattr(f, "seekable") else f) as z:
        return {i.filename.removesuffix(".npy"): (i.header_offset, i.compress_size, i.compress_type) for i in z.infolist()}


class _Member:
    """One array of an archive, read as far as it is asked for."""

    def __init__(self, path: str, member: tuple[int, int, int]):
        offset, size, packed = member
        name, extra = struct.unpack("<HH", files.read(path, offset + 26, 4))
        self.path, self.at, self.size, self.packed = path, offset + 30 + name + extra, size, packed
        if packed not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise ValueError(f"unknown packing {packed} in {path}")
        head = self._bytes(0, min(1 << 12, size) if not packed else 1 << 12)
        stream = io.BytesIO(head)
        version = np.lib.format.read_magic(stream)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        self.shape, fortran, self.dtype = read(stream)
        if fortran:
            raise ValueError(f"arrays in column order are not read: {path}")
        self.first = stream.tell()

    def _bytes(self, low: int, n: int) -> bytes:
        """n unpacked bytes from low on; of stored members just those are read, of deflated ones all before are unpacked and let go."""
        if not self.packed:
            return files.read(self.path, self.at + low, n)
        system, at = files.opened(self.path)
        out, seen, machine = [], 0, zlib.decompressobj(-15)
        with system.open_input_file(at) as f:
            f.seek(self.at)
            left = self.size
            while left and seen < low + n:
                raw = f.read(min(left, 1 << 20))
                left -= len(raw)
                part = machine.decompress(raw)
                out.append(part[max(0, low - seen) : max(0, low + n - seen)])
                seen += len(part)
        return b"".join(out)

    def rows(self, low: int, high: int) -> np.ndarray:
        step = int(np.prod(self.shape[1:], dtype=np.int64)) * self.dtype.itemsize
        raw = self._bytes(self.first + low * step, (high - low) * step)
        return np.frombuffer(raw, self.dtype).reshape(high - low, *self.shape[1:])


def _npz_blocks(spark: SparkSession, paths: list[str], key: str, block: int) -> DataFrame:
    """(recording, low, high) of blocks of an array's rows; tasks open the archives, so the plan and the driver's work are as small for many as for one."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                n = _Member(path, npz_members(path)[key]).shape[0]
                low = np.arange(0, n, block)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(low), pa.string()), pa.array(low), pa.array(np.minimum(low + block, n))], ["recording", "low", "high"])

    listed = spark.createDataFrame([(p,) for p in paths], "recording string").mapInArrow(find, "recording string, low long, high long")
    return listed.repartition(4 * spark.sparkContext.defaultParallelism, "recording", "low")  # a number, as so few bytes would be coalesced to one task


def _blocks_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[str, int, int, list[_Member]]]:
    """Blocks with their archive's members, which are opened once for blocks that follow one another."""
    last, held = None, []
    for batch in batches:
        for path, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if path != last:
                members = npz_members(path)
                last, held = path, [_Member(path, members[k]) for k in keys]
            yield path, low, high, held


def read_npz_flow(spark: SparkSession, paths: str | list[str], x: str = "x_flow_dist", y: str = "y_flow_dist", t: str = "timestamps", block: int = 16) -> DataFrame:
    """(frame, t, height, width, fx, fy) of an archive of flow frames, one row per frame, or of a list of archives with `recording` before; a task reads blocks of frames out of the archives' members."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, low, high, members in _blocks_of(batches, [x, y, t]):
            fx, fy, times = (m.rows(low, high) for m in members)
            h, w = fx.shape[1:]
            flat = [pa.FixedSizeListArray.from_arrays(pa.array(a.astype(np.float32).ravel()), h * w).cast(pa.list_(pa.float32())) for a in (fx, fy)]
            yield pa.RecordBatch.from_arrays([pa.array([path] * (high - low)), pa.array(np.arange(low, high)), pa.array(times.astype(float)), pa.array(np.full(high - low, h, np.int32)), pa.array(np.full(high - low, w, np.int32)), *flat], ["recording", "frame", "t", "height", "width", "fx", "fy"])

    found = _npz_blocks(spark, [paths] if isinstance(paths, str) else paths, t, block).mapInArrow(run, "recording string, frame long, t double, height int, width int, fx array<float>, fy array<float>")
    return found.drop("recording") if isinstance(paths, str) else found


def read_npz_rows(spark: SparkSession, paths: str | list[str], columns: dict[str, str], block: int = 1 << 16) -> DataFrame:
    """(idx, name...) of an archive of equally long arrays, such as odometry, or of a list of archives with `recording` before: scalars as double, rows as array<double>; read by tasks in blocks.

    What is a scalar is told by the first archive; another that differs, or whose arrays differ in length, is an error.
    """
    listed, keys = [paths] if isinstance(paths, str) else paths, list(columns.values())
    flat = {}
    if listed:
        members = npz_members(listed[0])
        shapes = {name: _Member(listed[0], members[key]).shape for name, key in columns.items()}
        if len({s[0] for s in shapes.values()}) > 1:
            raise ValueError(f"arrays differ in length in {listed[0]}")
        flat = {name: len(s) == 1 for name, s in shapes.items()}
    schema = "recording string, idx long, " + ", ".join(f"{name} {'double' if flat.get(name, True) else 'array<double>'}" for name in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, low, high, members in _blocks_of(batches, keys):
            if any(m.shape[0] != members[0].shape[0] for m in members):
                raise ValueError(f"arrays differ in length in {path}")
            if any((len(m.shape) == 1) != f for m, f in zip(members, flat.values(), strict=True)):
                raise ValueError(f"arrays differ in shape in {path}")
            held = [m.rows(low, high).astype(float) for m in members]
            yield pa.RecordBatch.from_arrays([pa.array([path] * (high - low)), pa.array(np.arange(low, high)), *map(_rows_of, held)], ["recording", "idx", *columns])

    found = _npz_blocks(spark, listed, keys[0], block).mapInArrow(run, schema)
    return found.drop("recording") if isinstance(paths, str) else found


def _rows_of(a: np.ndarray) -> pa.Array:
    """An array's rows: numbers, or lists over its one flat buffer."""
    if a.ndim == 1:
        return pa.array(a)
    width = int(np.prod(a.shape[1:], dtype=np.int64))
    offsets = pa.array(np.arange(len(a) + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(a).ravel()))


def flow_pixels(flows: DataFrame, *keep: str) -> DataFrame:
    """(*keep, frame, y, x, fx, fy) of flow frames."""
    at = flows.select(*keep, "frame", "width", F.posexplode(F.arrays_zip("fx", "fy")).alias("k", "v"))
    return at.select(*keep, "frame", F.floor(F.col("k") / F.col("width")).cast("int").alias("y"), (F.col("k") % F.col("width")).cast("int").alias("x"), F.col("v.fx").alias("fx"), F.col("v.fy").alias("fy"))


def read_hdf5(spark: SparkSession, path: str, columns: dict[str, tuple[str, str]], rows: int = 1_000_000) -> DataFrame:
    """(idx, name...) of HDF5 datasets, name -> (dataset, Spark type), in blocks of rows; needs h5py where tasks run."""
    import h5py

    with h5py.File(path) as f:
        n = len(f[next(iter(columns.values()))[0]])
        if any(len(f[k]) != n for k, _ in columns.values()):
            raise ValueError("datasets differ in length")

    schema = spark.createDataFrame([], "idx long, " + ", ".join(f"{name} {kind}" for name, (_, kind) in columns.items())).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import h5py
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in batches:
            for block in batch.column(0).to_pylist():
                low, high = block * rows, min(n, (block + 1) * rows)
                with h5py.File(path) as f:
                    held = [np.asarray(f[k][low:high]) for k, _ in columns.values()]
                arrays = [np.arange(low, high), *held]
                yield pa.RecordBatch.from_arrays([_rows_of(a).cast(f.type) for a, f in zip(arrays, kinds, strict=True)], schema=kinds)

    return spark.range(-(-n // rows)).mapInArrow(run, schema)


def read_times(spark: SparkSession, path: str, key: str, kind: str = "int") -> DataFrame:
    """(idx, t) of an HDF5 dataset of times alone; a warning if the largest is the largest of its type, which then was too small."""
    held = read_hdf5(spark, path, {"t": (key, kind)})
    top = held.agg(F.max("t")).first()[0]
    if top == {"int": (1 << 31) - 1, "bigint": (1 << 63) - 1, "long": (1 << 63) - 1}.get(kind):
        warnings.warn(f"times of {path} reach the end of {kind}", stacklevel=2)
    return held


def read_hdf5_frames(spark: SparkSession, path: str, key: str, times: str, kind: str = "float", block: int = 8) -> DataFrame:
    """(idx, t, shape, values) of an HDF5 dataset of one image, field or scan for each time, in blocks of a few; values row by row."""
    import h5py

    with h5py.File(path) as f:
        n, shape = len(f[key]), [int(v) for v in f[key].shape[1:]]
        if len(f[times]) != n:
            raise ValueError(f"{key} and {times} differ in length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import h5py

        for batch in batches:
            for low in batch.column(0).to_pylist():
                high = min(n, low + block)
                with h5py.File(path) as f:
                    values, t = np.asarray(f[key][low:high]), np.asarray(f[times][low:high], float)
                flat = _rows_of(values.reshape(high - low, -1).astype({"float": np.float32, "double": np.float64, "int": np.int32}[kind]))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, high)), pa.array(t), pa.array([shape] * (high - low), pa.list_(pa.int32())), flat], ["idx", "t", "shape", "values"])

    return spark.range(0, n, block).mapInArrow(run, f"idx long, t double, shape array<int>, values array<{kind}>")


def field_pixels(frames: DataFrame) -> DataFrame:
    """(idx, t, channel, y, x, value) of frames with shape (height, width), or (channels, height, width)."""
    h, w = F.element_at("shape", -2), F.element_at("shape", -1)
    at = frames.select("idx", "t", h.alias("_h"), w.alias("_w"), F.posexplode("values").alias("_k", "value"))
    cell = F.floor(F.col("_k") / F.col("_w"))
    return at.select("idx", "t", F.floor(cell / F.col("_h")).cast("int").alias("channel"), (cell % F.col("_h")).cast("int").alias("y"), (F.col("_k") % F.col("_w")).cast("int").alias("x"), "value")
