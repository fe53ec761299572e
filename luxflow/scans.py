"""Registered queries of the readers: files made of the test tables are written by tasks to the shared folder and read back.

The camera's events are dealt over recordings of FILE events with the time 100 * place.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import select, temporal
from .queries import CAM, FRAMES, H, W, cam, frames
from .schema import seconds
from .shared import place
from .sources import aedat4, cache, encode, files, generate, layout, rasters, rosbag, text, words

FILE = 2000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DEALT = f"{CAM}, ev AS (SELECT idx // {FILE} AS file, idx % {FILE} AS i, idx % {FILE} * 100 AS t_us, x, y, p FROM cam)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def dealt(spark: SparkSession, d: str) -> DataFrame:
    """(file, i, t_us, x, y, p)."""
    return cam(spark, d).select(F.floor(F.col("idx") / FILE).alias("file"), (F.col("idx") % FILE).alias("i"), (F.col("idx") % FILE * 100).alias("t_us"), "x", "y", "p")


def file_of(path: str = "recording"):
    """The number before a path's last dot."""
    return F.regexp_extract(path, r"(\d+)\.[a-z0-9]+$", 1).cast("long").alias("file")


# --- codec words and records ------------------------------------------------------------

HEADERS = (b"", b"% evt 3.0\n% end\n", b"% format EVT3;height=30;width=40\n% date 2020-01-01\n% end\n")


def _evt3(spark: SparkSession, d: str) -> list[str]:
    """Recordings with and without a header, each with a spare byte at its end."""
    folder = place(spark, "evt3")
    return encode.put(dealt(spark, d), lambda n: f"{folder}/{n}.raw", lambda rows: encode.evt3(rows.sort_values("i"), HEADERS[int(rows["file"].iloc[0]) % 3]) + b"\1")


@query(f"WITH {DEALT} SELECT file, i AS idx, t_us, x, y, p FROM ev")
def src11_evt3_files(spark, d):
    return words.read_evt3(spark, _evt3(spark, d), span=4096, strict_time=True).select(file_of(), "idx", "t_us", "x", "y", "p")


@query(f"WITH {DEALT}, w AS (SELECT file, i, [32768 + t_us // 4096, 24576 + t_us % 4096, y, 8192 + 2048 * CAST(p AS INTEGER) + x] AS ws FROM ev), k AS (SELECT unnest([0, 1, 2, 3]) AS k) SELECT file, 4 * i + k AS i, CAST(ws[k + 1] AS INTEGER) AS v FROM w, k")
def src00_word_source(spark, d):
    spark.dataSource.register(words.Words)
    raw = spark.read.format("luxflow_words").option("range", 1000).load(",".join(_evt3(spark, d)))
    return raw.select(file_of(), "i", "v")


@query(f"WITH {CAM}, n AS (SELECT idx // {FILE} AS file, unnest([0, 1, 2]) AS kind FROM cam GROUP BY 1) SELECT DISTINCT file, CASE file % 3 WHEN 0 THEN '' WHEN 1 THEN 'evt' ELSE 'format' END AS first, CASE file % 3 WHEN 0 THEN 0 WHEN 1 THEN 16 ELSE 57 END AS size FROM n")
def src11a_headers(spark, d):
    rows = []
    for path in _evt3(spark, d):
        size, found = words.evt3_header(files.read(path, 0, 1 << 16))
        rows.append((int(path.rpartition("/")[2].removesuffix(".raw")), next(iter(found), ""), size))
    return spark.createDataFrame(rows, "file long, first string, size int")


RECORDS = "CASE WHEN i % 50 = 49 THEN 240 ELSE y END AS y, i * 7 AS ts"


@query(f"WITH {DEALT}, r AS (SELECT file, i, x, {RECORDS}, p FROM ev), o AS (SELECT *, ts + 8192 * sum(CAST(y = 240 AS INTEGER)) OVER (PARTITION BY file ORDER BY i) AS t_us FROM r) SELECT file, i, CAST(t_us AS BIGINT) AS t_us, x, y, p FROM o WHERE y <> 240")
def src12_bin_files(spark, d):
    folder = place(spark, "bin")
    rows = dealt(spark, d).withColumn("y", F.when(F.col("i") % 50 == 49, 240).otherwise(F.col("y"))).withColumn("t_us", F.col("i") * 7)
    paths = encode.put(rows, lambda n: f"{folder}/{n}.bin", lambda part: encode.records(part.sort_values("i")))
    return words.read_bin(spark, paths, span=1000).select(file_of(), "i", "t_us", "x", "y", "p")


# --- AEDAT4 -----------------------------------------------------------------------------

STREAMS = [("events", "EVTS"), ("frames", "FRME"), ("mine", "IMUS"), ("triggers", "TRIG")]


def _aedat4(spark: SparkSession, d: str) -> list[str]:
    """Containers of packets of 500 events, a frame of the places touched, a row of inertial data for each 100th event and a trigger for each 250th; compressions in turn."""
    folder = place(spark, "aedat4")

    def content(rows: pd.DataFrame) -> bytes:
        rows, number = rows.sort_values("i"), int(rows["file"].iloc[0])
        image = np.zeros((H, W), np.uint8)
        image[rows["y"], rows["x"]] = 1
        packets = [(0, encode.events_packet(rows[k : k + 500])) for k in range(0, len(rows), 500)]
        packets.insert(1, (1, encode.frame_packet(number, image)))
        packets.append((2, encode.imu_packet([(i, x, y, x + 1, y + 1, x / 2, y / 2) for i, x, y in zip(rows["i"], rows["x"], rows["y"], strict=True) if i % 100 == 0])))
        packets.append((3, encode.triggers_packet([(t, x % 7) for i, t, x in zip(rows["i"], rows["t_us"], rows["x"], strict=True) if i % 250 == 0])))
        return encode.aedat4_file(STREAMS, packets, compression=(0, 1, 3)[number % 3], table=number % 2 == 0)

    return encode.put(dealt(spark, d), lambda n: f"{folder}/{n}.aedat4", content)


@query(f"WITH {DEALT} SELECT file, i AS idx, t_us, x, y, p FROM ev")
def src07_aedat4_events(spark, d):
    return aedat4.read_events(spark, _aedat4(spark, d)).select(file_of(), "idx", "t_us", "x", "y", "p")


@query(f"WITH {DEALT}, g AS (SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM generate_series(0, {H - 1}) a(y), generate_series(0, {W - 1}) b(x)), f AS (SELECT DISTINCT file FROM ev), hit AS (SELECT DISTINCT file, y, x, 1 AS n FROM ev) SELECT file, file AS t_us, {H} AS height, {W} AS width, 1 AS channels, y, x, CAST(coalesce(n, 0) AS INTEGER) AS value FROM f CROSS JOIN g LEFT JOIN hit USING (file, y, x)")
def src08_aedat4_frames(spark, d):
    raw = aedat4.read(spark, _aedat4(spark, d), "frames")
    cell = F.posexplode(F.split(F.hex("pixels"), "(?<=\\G..)")).alias("k", "byte")
    at = raw.select(file_of(), "t_us", "height", "width", "channels", cell).where("byte <> ''")
    return at.select("file", "t_us", "height", "width", "channels", F.floor(F.col("k") / W).cast("int").alias("y"), (F.col("k") % W).alias("x"), F.conv("byte", 16, 10).cast("int").alias("value"))


@query(f"WITH {DEALT} SELECT file, i AS t_us, x::DOUBLE AS ax, y::DOUBLE AS ay, x + 1.0::DOUBLE AS az, y + 1.0::DOUBLE AS gx, x / 2.0::DOUBLE AS gy, y / 2.0::DOUBLE AS gz FROM ev WHERE i % 100 = 0")
def src09_aedat4_imu(spark, d):
    return aedat4.read(spark, _aedat4(spark, d), "imu").select(file_of(), "t_us", "ax", "ay", "az", "gx", "gy", "gz")


@query(f"WITH {DEALT} SELECT file, t_us, x % 7 AS type FROM ev WHERE i % 250 = 0")
def src10_aedat4_triggers(spark, d):
    return aedat4.read(spark, _aedat4(spark, d), "triggers").select(file_of(), "t_us", "type")


@query(f"WITH {DEALT}, n AS (SELECT file, count(*) AS n, count(*) FILTER (i % 100 = 0) AS m FROM ev GROUP BY 1) SELECT file, kind, CASE kind WHEN 'events' THEN CAST(ceil(n / 500.0) AS BIGINT) ELSE 1 END AS packets, [0, 1, 3][CAST(file % 3 AS INTEGER) + 1] AS compression FROM n, (SELECT unnest(['events', 'frames', 'imu', 'triggers']) AS kind)")
def src06_aedat4_packets(spark, d):
    rows = []
    for path in _aedat4(spark, d):
        number = int(path.rpartition("/")[2].removesuffix(".aedat4"))
        for kind in aedat4.STREAMS:
            held = aedat4.packets(path, kind)
            rows.append((number, kind, len(held), held[0][2]))
    return spark.createDataFrame(rows, "file long, kind string, packets long, compression int")


# --- text -------------------------------------------------------------------------------


def _text(spark: SparkSession, rows: DataFrame, name: str, order: str = "idx") -> str:
    """A folder of text files that hold rows' value in order."""
    path = f"{place(spark, 'text')}/{name}"
    rows.repartitionByRange(order).sortWithinPartitions(order).select("value").write.text(path)
    return path


@query(f"WITH {CAM} SELECT idx, idx / 1000.0::DOUBLE AS t, x, y, p FROM cam")
def src01_text_files(spark, d):
    path = f"{place(spark, 'text')}/events.txt"
    text.write_events(cam(spark, d), path, F.col("idx") / 1000.0)
    return text.read_events(spark, path)


@query(f"WITH {CAM} SELECT idx, idx / 1000.0::DOUBLE AS t, x, y, p FROM cam")
def src27_davis_events(spark, d):
    rows = cam(spark, d)
    line = F.format_string("%.6f %d %d %d", F.col("idx") / 1000.0, "x", "y", F.when(F.col("p"), 1).otherwise(-F.col("x") % 2))
    value = F.when(F.col("idx") % 100 == 7, F.concat(F.lit("# a comment\n\n"), line)).otherwise(line)
    return text.read_davis_events(spark, _text(spark, rows.select("idx", value.alias("value")), "events.txt"))


def _columns(rows: DataFrame, n: int) -> DataFrame:
    """Lines of n numbers, with a comment before every tenth."""
    line = F.concat_ws(" ", F.format_string("%.3f", F.col("idx") / 8.0), *[(F.col("x") * k + F.col("y")).cast("string") for k in range(1, n)])
    return rows.select("idx", F.when(F.col("idx") % 10 == 0, F.concat(F.lit("# here\n"), line)).otherwise(line).alias("value"))


def _numbers(names: str) -> str:
    return ", ".join(f"(x * {k} + y)::DOUBLE AS {n}" for k, n in enumerate(names.split(), 1))


@query(f"WITH {CAM} SELECT idx, idx / 8.0::DOUBLE AS t, {_numbers('px py pz qx qy qz qw')} FROM cam")
def src30_pose_rows(spark, d):
    return text.read_pose(spark, _text(spark, _columns(cam(spark, d), 8), "groundtruth.txt"))


@query(f"WITH {CAM} SELECT idx, idx / 8.0::DOUBLE AS t, {_numbers('ax ay az gx gy gz')} FROM cam")
def src29_imu_rows(spark, d):
    return text.read_imu(spark, _text(spark, _columns(cam(spark, d), 7), "imu.txt"))


@query(f"WITH {CAM} SELECT idx, 5 AS n, idx / 8.0 + 10 * x + 4 * y AS total FROM cam")
def src02_rows_of_any_width(spark, d):
    rows = text.read_rows(spark, _text(spark, _columns(cam(spark, d), 5), "pose.txt"))
    return rows.select("idx", F.size("row").alias("n"), F.aggregate("row", F.lit(0.0), lambda a, v: a + v).alias("total"))


@query(f"WITH {CAM} SELECT idx, idx / 8.0::DOUBLE AS t FROM cam")
def src05_timestamps(spark, d):
    return text.read_timestamps(spark, _text(spark, _columns(cam(spark, d), 1), "timestamps.txt"))


@query(f"WITH {CAM} SELECT idx, t_us AS v0, t_us + x AS v1 FROM cam")
def src38_integer_rows(spark, d):
    line = F.concat(F.col("t_us"), F.when(F.col("idx") % 2 == 0, ", ").otherwise(" "), F.col("t_us") + F.col("x"), F.lit(" 9"))
    rows = cam(spark, d).select("idx", F.when(F.col("idx") == 0, F.concat(F.lit("# start\nfrom to\n"), line)).otherwise(line).alias("value"))
    return text.read_integer_rows(spark, _text(spark, rows, "timestamps.txt"), 2)


@query(f"SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, x + y / 4.0::DOUBLE AS rx, y - x / 8.0::DOUBLE AS ry FROM generate_series(0, {H - 1}) a(y), generate_series(0, {W - 1}) b(x)")
def src26_text_maps(spark, d):
    from .plans.datasets import mvsec_map

    root = place(spark, "maps")
    y, x = np.mgrid[0:H, 0:W]
    for axis, table in (("x", x + y / 4), ("y", y - x / 8)):
        files.write(f"{root}/indoor_flying_calib/indoor_flying_left_{axis}_map.txt", "\n".join(" ".join(map(str, row)) for row in table.tolist()).encode())
    return mvsec_map(spark, root, "indoor_flying3")


@query("SELECT unnest([100, 101, 2, 1.5, -0.1, 0.2, 0.01, 0.02, 0])::DOUBLE AS value, unnest(generate_series(0, 8)) AS place")
def src31_calibration(spark, d):
    path = f"{place(spark, 'calib')}/calib.txt"
    files.write(path, b"100 101 2 1.5 -.1 .2 .01 .02\n")
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(text.read_calibration(path))], "place long, value double")


@query("SELECT 'cam0' AS camera, 1.5::DOUBLE AS fx, 2.5::DOUBLE AS fy UNION ALL SELECT 'cam1', 3.0, 4.0")
def src42_yaml_calibration(spark, d):
    path = f"{place(spark, 'yaml')}/cam_to_cam.yaml"
    files.write(path, b"%YAML:1.0\nintrinsics:\n  cam0: {camera_matrix: [1.5, 2.5]}\n  cam1: {camera_matrix: [3, 4]}\n")
    held = layout.yaml_calibration(path)["intrinsics"]
    return spark.createDataFrame([(k, float(v["camera_matrix"][0]), float(v["camera_matrix"][1])) for k, v in held.items()], "camera string, fx double, fy double")


# --- images and dense fields --------------------------------------------------------------

TOUCHED = f"{DEALT}, g AS (SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM generate_series(0, {H - 1}) a(y), generate_series(0, {W - 1}) b(x)), f AS (SELECT DISTINCT file FROM ev), c AS (SELECT file, y, x, count(*) AS n FROM ev GROUP BY 1, 2, 3), px AS (SELECT file, y, x, coalesce(n, 0) AS n FROM f CROSS JOIN g LEFT JOIN c USING (file, y, x))"


def _counts(rows: pd.DataFrame) -> np.ndarray:
    return np.bincount(rows["y"] * W + rows["x"], minlength=H * W).reshape(H, W)


def _images(spark: SparkSession, d: str, image: Callable[[pd.DataFrame], np.ndarray]) -> tuple[str, int]:
    """A folder of PNG files, one for each recording, and their number."""
    folder = place(spark, "png")
    return folder, len(encode.put(dealt(spark, d), lambda n: f"{folder}/{n:06d}.png", lambda rows: rasters.encode_png(image(rows))))


@query(f"WITH {TOUCHED} SELECT file AS idx, file / 4.0::DOUBLE AS t, y, x, CAST(least(n, 255) AS INTEGER) AS value FROM px")
def src04_frame_index(spark, d):
    folder, n = _images(spark, d, lambda rows: np.minimum(_counts(rows), 255).astype(np.uint8))
    files.write(f"{folder}/images.txt", b"# time name\n" + "".join(f"{i / 4} {i:06d}.png\n" for i in range(n)).encode())
    held = rasters.read_frames(spark, f"{folder}/images.txt")
    times = held.select("path", "idx", "t")
    return rasters.pixels(held).join(times, "path").select("idx", "t", "y", "x", "value")


@query(f"WITH {TOUCHED} SELECT file, {H} AS height, {W} AS width, 1 AS channels, CAST(sum(least(n, 255)) AS BIGINT) AS total FROM px GROUP BY 1")
def src33_gray_images(spark, d):
    folder, _ = _images(spark, d, lambda rows: np.minimum(_counts(rows), 255).astype(np.uint8))
    held = rasters.same_shape(rasters.read_png(spark, f"{folder}/*.png"))
    return held.select(file_of("path"), "height", "width", "channels", F.aggregate("pixels", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query(f"WITH {TOUCHED} SELECT file, y, x, CAST(n * 300 AS FLOAT) AS depth FROM px")
def src32_depth_images(spark, d):
    folder, _ = _images(spark, d, lambda rows: (_counts(rows) * 300).astype(np.uint16))
    return rasters.depth_of(rasters.read_png(spark, f"{folder}/*.png")).select(file_of("path"), "y", "x", "depth")


@query(f"WITH {TOUCHED} SELECT file, y, x, CAST((n * 64 - 100) / 128.0 AS FLOAT) AS fx, CAST((x - y) / 128.0 AS FLOAT) AS fy, n > 0 AS valid FROM px")
def src40_flow_images(spark, d):
    def flow(rows: pd.DataFrame) -> np.ndarray:
        n, (y, x) = _counts(rows), np.mgrid[0:H, 0:W]
        return np.stack([32768 + n * 64 - 100, 32768 + x - y, n > 0], axis=2).astype(np.uint16)

    folder, _ = _images(spark, d, flow)
    return rasters.flow_of(rasters.read_png(spark, f"{folder}/*.png")).select(file_of("path"), "y", "x", "fx", "fy", "valid")


@query(f"WITH {TOUCHED} SELECT file, y, x, CAST(n * 40 / 256.0 AS FLOAT) AS disparity, n > 0 AS valid FROM px")
def src41_disparity_images(spark, d):
    folder, _ = _images(spark, d, lambda rows: (_counts(rows) * 40).astype(np.uint16))
    return rasters.disparity_of(rasters.read_png(spark, f"{folder}/*.png")).select(file_of("path"), "y", "x", "disparity", "valid")


@query(f"WITH {DEALT} SELECT file AS idx, 1000 * file AS t_us, 1000 * file + 10 AS exposure_start, 1000 * file + 30 AS exposure_end, {H} AS height, {W} AS width FROM ev GROUP BY 1, 2, 3, 4")
def src39_images_and_exposures(spark, d):
    from .plans.datasets import dsec_images

    folder, n = _images(spark, d, lambda rows: np.minimum(_counts(rows), 255).astype(np.uint8))
    files.write(f"{folder}/timestamps.txt", "".join(f"{1000 * i}\n" for i in range(n)).encode())
    files.write(f"{folder}/exposure_timestamps_left.txt", b"# start, end\n" + "".join(f"{1000 * i + 10}, {1000 * i + 30}\n" for i in range(n)).encode())
    held = dsec_images(spark, folder, f"{folder}/timestamps.txt", f"{folder}/exposure_timestamps_left.txt")
    return held.select("idx", "t_us", "exposure_start", "exposure_end", "height", "width")


def _archives(spark: SparkSession, d: str, arrays: Callable[[pd.DataFrame], dict[str, np.ndarray]], packed: bool) -> list[str]:
    folder = place(spark, "npz")

    def content(rows: pd.DataFrame) -> bytes:
        import io

        out = io.BytesIO()
        (np.savez_compressed if packed else np.savez)(out, **arrays(rows.sort_values("i")))
        return out.getvalue()

    return encode.put(dealt(spark, d), lambda n: f"{folder}/{n}.npz", content)


@query(f"WITH {DEALT}, a AS (SELECT file, CAST(frame AS BIGINT) AS frame, frame / 2.0::DOUBLE AS t, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(frame * 100 + y * 10 + x + file AS FLOAT) AS fx, CAST(y - x AS FLOAT) AS fy FROM (SELECT DISTINCT file FROM ev), generate_series(0, 39) f(frame), generate_series(0, 3) a(y), generate_series(0, 4) b(x)) SELECT * FROM a")
def src24_flow_archives(spark, d):
    def arrays(rows: pd.DataFrame) -> dict[str, np.ndarray]:
        k, y, x = np.mgrid[0:40, 0:4, 0:5].astype(float)
        return {"x_flow_dist": k * 100 + y * 10 + x + int(rows["file"].iloc[0]), "y_flow_dist": y - x, "timestamps": np.arange(40) / 2}

    held = rasters.read_npz_flow(spark, _archives(spark, d, arrays, packed=True))
    return rasters.flow_pixels(held, "recording", "t").select(file_of(), "frame", "t", "y", "x", "fx", "fy")


@query(f"WITH {DEALT} SELECT file, i AS idx, t_us::DOUBLE AS t, x::DOUBLE AS px, y::DOUBLE AS py FROM ev")
def src25_odometry_archives(spark, d):
    arrays = lambda rows: {"timestamps": rows["t_us"].to_numpy(float), "pos": np.stack([rows["x"], rows["y"]], axis=1).astype(float)}
    rows = rasters.read_npz_rows(spark, _archives(spark, d, arrays, packed=False), {"t": "timestamps", "position": "pos"})
    return rows.select(file_of(), "idx", "t", F.col("position")[0].alias("px"), F.col("position")[1].alias("py"))


# --- a whole recording ----------------------------------------------------------------------


def _davis(spark: SparkSession, d: str) -> str:
    """A recording's folder: event k at k / 1000 s, a frame after every FILE events, a pose and IMU row for every 500th."""
    folder, n = _images(spark, d, lambda rows: np.minimum(_counts(rows), 255).astype(np.uint8))
    c = cam(spark, d)
    text.write_events(c, f"{folder}/events.txt", F.col("idx") / 1000.0)
    files.write(f"{folder}/images.txt", "".join(f"{(i + 1) * FILE / 1000} {i:06d}.png\n" for i in range(n)).encode())
    for name, width in (("groundtruth.txt", 8), ("imu.txt", 7)):
        rows = c.where("idx % 500 = 0").select("idx", F.concat_ws(" ", (F.col("idx") / 1000.0).cast("string"), *[F.col("x").cast("string")] * (width - 1)).alias("value"))
        rows.repartitionByRange("idx").sortWithinPartitions("idx").select("value").write.text(f"{folder}/{name}")
    return folder


@query(f"WITH {DEALT}, f AS (SELECT file AS frame_idx, count(*) AS n FROM ev GROUP BY 1), m AS (SELECT max(i) AS top FROM (SELECT row_number() OVER (ORDER BY idx) - 1 AS i FROM cam WHERE idx % 500 = 0)) SELECT frame_idx, (frame_idx + 1) * {FILE} * 1000 AS t_us, n, least((frame_idx + 1) * {FILE // 500}, top) AS pose FROM f, m")
def api05_davis_frames(spark, d):
    from .plans import recording

    held = recording.davis(spark, _davis(spark, d)).frame_samples()
    return held.select("frame_idx", "t_us", F.size("events").cast("long").alias("n"), "pose")


@query(f"WITH {CAM}, n AS (SELECT count(*) AS n FROM cam) SELECT {H} AS height, {W} AS width, n AS events, n - 1 AS last, (n - 1) * 1000 AS t_last, CAST(ceil(n / 500.0) AS BIGINT) AS imu FROM n")
def prj07_recording_facts(spark, d):
    """The sensor's size is that of the first frame where it isn't given; events are read from a copy the second time."""
    from .plans import recording

    folder, copies = _davis(spark, d), place(spark, "copies")
    files.write(f"{folder}/made", b"")
    with recording.davis(spark, folder, copies=copies) as r:
        again = recording.davis(spark, folder, copies=copies)
        n = again.num_events
        row = (*r.resolution, n, r.time_to_index(n * 1000), again.index_to_time(-1), r.stream("imu").count())
    return spark.createDataFrame([row], "height int, width int, events long, last long, t_last long, imu long")


# --- bags ---------------------------------------------------------------------------------


def _bags(spark: SparkSession, d: str) -> list[str]:
    folder = place(spark, "bags")

    def content(rows: pd.DataFrame) -> bytes:
        bodies = []
        for i, t, x, y in zip(rows["i"], rows["t_us"], rows["x"], rows["y"], strict=True):
            if i % 20 == 0:
                bodies.append(("/imu/data", int(t) * 1000 + 5, encode.bag_imu([x, y, 1], [x + y, 2, 3], [0, 0, 0, 1])))
            if i % 100 == 50:
                bodies.append(("/velodyne_points", int(t) * 1000, encode.bag_points([(x, y, k, k + 1, k, 0.5) for k in range(int(x) % 3 + 1)])))
        return encode.bag(sorted(bodies, key=lambda b: b[1]))

    return encode.put(dealt(spark, d), lambda n: f"{folder}/{n}.bag", content)


@query(f"WITH {DEALT} SELECT file, i // 20 AS idx, t_us * 1000 + 5 AS t_ns, x::DOUBLE AS wx, y::DOUBLE AS wy, (x + y)::DOUBLE AS ax, 1.0::DOUBLE AS qw FROM ev WHERE i % 20 = 0")
def src43_bag_imu(spark, d):
    return rosbag.read_imu(spark, _bags(spark, d)).select(file_of(), "idx", "t_ns", "wx", "wy", "ax", "qw")


LIDAR = f"{DEALT}, scan AS (SELECT file, i // 100 AS idx, t_us * 1000 AS t_ns, unnest(generate_series(0, x % 3)) AS k, x, y FROM ev WHERE i % 100 = 50)"


@query(f"WITH {LIDAR} SELECT file, idx, t_ns, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(k AS FLOAT) AS z, CAST(k + 1 AS FLOAT) AS intensity, CAST(k AS INTEGER) AS ring FROM scan")
def src44_bag_lidar(spark, d):
    scans = rosbag.read_lidar(spark, _bags(spark, d)).select(file_of(), "idx", "t_ns", F.explode("points").alias("q"))
    return scans.select("file", "idx", "t_ns", *[F.col(f"q.{c}").alias(c) for c in ("x", "y", "z", "intensity", "ring")])


@query(f"WITH {LIDAR} SELECT DISTINCT file, idx, t_ns // 1000 AS t_us FROM scan WHERE t_ns // 1000 >= 20000 AND t_ns // 1000 < 120000")
def flt04_lidar_time_range(spark, d):
    scans = rosbag.read_lidar(spark, _bags(spark, d)).withColumn("t_us", F.floor(F.col("t_ns") / 1000))
    return select.by_time(scans, 20_000, 120_000).select(file_of(), "idx", "t_us")


# --- layouts, generators, caches -----------------------------------------------------------


@query("SELECT unnest(['boxes_6dof', 'poster_6dof', 'shapes_6dof']) AS name, unnest([1, 1, 1]) AS there")
def src46_recordings_below(spark, d):
    root = place(spark, "ecd")
    for name in ("shapes_6dof", "boxes_6dof", "poster_6dof", "other"):
        files.write(f"{root}/{name}/events.txt", b"0 1 1 1\n")
    return spark.createDataFrame([(n, int(layout.davis_recording(root, n).endswith(f"/{n}"))) for n in layout.available(root)], "name string, there int")


@query("SELECT unnest(['grouped', 'official', 'root', 'split']) AS layout, unnest(['train_events/zurich_city_04_a/events', 'events/zurich_city_04_a', 'zurich_city_04_a/events', 'train/zurich_city_04_a/events']) AS events, unnest(['zurich_city_04', 'zurich_city_04', 'zurich_city_04', 'zurich_city_04']) AS drive")
def src45_sequence_layouts(spark, d):
    rows = []
    for name, way in (("grouped", "train_events/zurich_city_04_a/events"), ("official", "events/zurich_city_04_a"), ("split", "train/zurich_city_04_a/events"), ("root", "zurich_city_04_a/events")):
        root = place(spark, "dsec")
        files.write(f"{root}/{way}/left/events.h5", b"")
        found = layout.dsec_sequence(root, "zurich_city_04_a")["events"]
        rows.append((name, found[len(root) + 1 :], layout.drive("zurich_city_04_a")))
    return spark.createDataFrame(rows, "layout string, events string, drive string")


@query("SELECT 5000::BIGINT AS n, 0::BIGINT AS falling, TRUE AS inside, 5000::BIGINT AS places, TRUE AS balanced")
def src49_generated_events(spark, d):
    e = generate.events(spark, 5000, H, W, 0.5, 2.0, seed=3)
    falling = select.order_violations(e, "t")
    inside = (F.col("x") >= 0) & (F.col("x") < W) & (F.col("y") >= 0) & (F.col("y") < H) & (F.col("t") >= 0.5) & (F.col("t") <= 2.0)
    stats = e.agg(F.count("*").alias("n"), F.min(inside).alias("inside"), F.count_distinct("idx").alias("places"), F.avg(F.col("p").cast("int")).between(0.45, 0.55).alias("balanced"))
    return stats.crossJoin(F.broadcast(falling.withColumnRenamed("violations", "falling"))).select("n", "falling", "inside", "places", "balanced")  # one row each


@query(f"SELECT {H * W}::BIGINT AS n, TRUE AS inside, TRUE AS differs")
def src50_random_flow(spark, d):
    f = generate.random_flow(spark, H, W, 3.0, seed=2)
    return f.agg(F.count("*").alias("n"), F.min((F.abs("fx") <= 3) & (F.abs("fy") <= 3)).alias("inside"), (F.count_distinct("fx") > H * W // 2).alias("differs"))


@query(f"SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(1.5 AS FLOAT) AS fx, CAST(-2 AS FLOAT) AS fy FROM generate_series(0, {H - 1}) a(y), generate_series(0, {W - 1}) b(x)")
def src51_uniform_flow(spark, d):
    return generate.uniform_flow(spark, H, W, 1.5, -2.0)


@query(f"WITH {CAM} SELECT idx, t_us, x, y, p FROM cam")
def snk04_cached_copy(spark, d):
    source, root = place(spark, "source"), place(spark, "copies")
    files.write(f"{source}/made.txt", b"1")
    for _ in range(2):  # the second time it is only read
        held = cache.cached(spark, root, f"{source}/made.txt", "events", lambda: cam(spark, d))
    return held


@query(f"WITH {CAM} SELECT idx, t_us, x, y, p FROM cam")
def snk02_appended(spark, d):
    path, c = place(spark, "appended"), cam(spark, d)
    for part in (c.where("idx % 2 = 0"), c.where("idx % 2 = 1")):
        cache.convert(part, path, mode="append")
    return spark.read.parquet(path)


@query(f"WITH {CAM} SELECT idx, round(t_us * 1e-6, 3) AS us, round((t_us + 7) * 1e-9, 6) AS ns, t_us::DOUBLE AS s FROM cam")
def fn04_units(spark, d):
    return cam(spark, d).select("idx", F.round(seconds(F.col("t_us"), "us"), 3).alias("us"), F.round(seconds(F.col("t_us"), "ns", 7), 6).alias("ns"), seconds(F.col("t_us"), "s").alias("s"))


@query("WITH g(i, w) AS (VALUES (0, 0.174178483500::DOUBLE), (1, 0.212377497209), (2, 0.226888038582), (3, 0.212377497209), (4, 0.174178483500)) SELECT a.i, b.i AS j, round(a.w * b.w, 9) AS w FROM g a, g b")
def fn15_kernel(spark, d):
    from .operators.render import gaussian_kernel

    return spark.createDataFrame([(i, j, w) for i, row in enumerate(gaussian_kernel()) for j, w in enumerate(row)], "i int, j int, w double").select("i", "j", F.round("w", 9).alias("w"))


@query(f"WITH {CAM}, z AS (SELECT min(t_us) AS z FROM cam), b AS (SELECT ms * 60000000 + z AS t_us, ms FROM z, (SELECT unnest(generate_series(0, (SELECT max(t_us) - min(t_us) FROM cam) // 60000000)) AS ms)) SELECT ms, (SELECT count(*) FROM cam WHERE cam.t_us < b.t_us) AS idx FROM b")
def srt03_sparse_index(spark, d):
    """Places of whole minutes by lookup in the stream itself."""
    c = cam(spark, d)
    low, high = c.agg(F.min("t_us"), F.max("t_us")).first()
    probes = spark.range((high - low) // 60_000_000 + 1).select(F.col("id").alias("ms"), (F.col("id") * 60_000_000 + low).alias("t_us"))
    return temporal.time_to_index(probes, c, probe_id="ms").select("ms", (F.col("at") + 1).alias("idx"))


@query(f"WITH {CAM}, {FRAMES}, n AS (SELECT count(*) AS n FROM frames) SELECT frame_idx, frame_idx < n - 1 AS owns FROM frames, n")
def str08_frames_in_order(spark, d):
    from .plans.recording import iterate

    f = frames(spark, d)
    seen = [r["frame_idx"] for r in iterate(f)]
    if seen != sorted(seen):
        raise ValueError("frames come out of order")
    return f.select("frame_idx", (F.col("frame_idx") < len(seen) - 1).alias("owns"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
