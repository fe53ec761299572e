import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from luxflow.operators import decode, temporal
from luxflow.plans import recording
from luxflow.sources import aedat4, cache, generate, layout, rasters, rosbag, text, words
from luxflow.sources.encode import aedat4_file, bag, packet, tables_packet


def evt3(path, values, header=b"% evt 3.0\n% format EVT3;height=10;width=32\n% end\n", rest=b""):
    path.write_bytes(header + struct.pack(f"<{len(values)}H", *values) + rest)
    return str(path)


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("idx").collect()]


@pytest.mark.parametrize("span", [2, 6, 1 << 20])
def test_evt3_words(spark, tmp_path, span):
    read = lambda values, **k: words.read_evt3(spark, evt3(tmp_path / f"{len(values)}{k.get('n', '')}.raw", values, **{a: b for a, b in k.items() if a != 'n'}), span)
    got = rows(read([0x8001, 0x6002, 0x0003, 0x2804, 0x300A, 0x4005, 0x5003]), "x", "y", "t_us", "p")
    assert got == [(4, 3, 4098, True), (10, 3, 4098, False), (12, 3, 4098, False), (22, 3, 4098, False), (23, 3, 4098, False)]
    assert rows(read([0x8000, 0x6000, 1, 0x2001, 0x300A, 0x400F, 0x201E], n="b"), "x") == [(1,), (10,), (11,), (12,), (13,), (30,)]
    assert rows(read([0x8FFF, 0x6FFF, 1, 0x2001, 0x8000, 0x6000, 1, 0x2002]), "t_us")[0] == (16777215,)
    assert rows(read([0x8000, 0x6001, 2, 0x2803], header=b"", rest=b"\x01"), "x", "y", "t_us", "p") == [(3, 2, 1, True)]


def test_evt3_wraps_and_headers(spark, tmp_path):
    path = evt3(tmp_path / "w.raw", [0x8FFF, 0x6FFF, 1, 0x2001, 0x8000, 0x6000, 1, 0x2002])
    assert rows(words.read_evt3(spark, path), "t_us") == [(16777215,), (16781312,)]
    assert rows(words.read_evt3(spark, path, strict_time=True), "t_us") == [(16777215,), (16777216,)]
    with pytest.raises(ValueError):
        words.evt3_header(b"% evt 2.0\n% format EVT2\n% end\n")
    assert words.evt3_header(b"")[0] == 0


def slow_evt3(values):
    """A word-by-word machine."""
    y = base = low = high = lo_wraps = hi_wraps = prev_lo = prev_hi = 0
    bp, out = False, []
    for v in values:
        kind, pl = v >> 12, v & 0xFFF
        if kind == 0:
            y = v & 0x7FF
        elif kind == 2:
            out.append((v & 0x7FF, y, low + high, bool(v & 0x800)))
        elif kind == 3:
            base, bp = v & 0x7FF, bool(v & 0x800)
        elif kind in (4, 5):
            n = 12 if kind == 4 else 8
            out += [(base + k, y, low + high, bp) for k in range(n) if pl >> k & 1]
            base += n
        elif kind == 6:
            lo_wraps += pl < prev_lo
            prev_lo, low = pl, pl + 4096 * lo_wraps
        elif kind == 8:
            hi_wraps += pl < prev_hi
            prev_hi, high = pl, (pl << 12) + (hi_wraps << 24)
    return out


def test_evt3_against_machine_in_small_buckets(spark, tmp_path, monkeypatch):
    from luxflow.operators import running

    rng = np.random.default_rng(1)
    values = (rng.choice([0, 1, 2, 2, 3, 4, 5, 6, 7, 8, 14], 3000) * 4096 + rng.integers(0, 4096, 3000)).tolist()
    path = evt3(tmp_path / "r.raw", values)
    monkeypatch.setattr(decode, "BUCKET", 64)
    for f in (running.running, running.with_previous):
        monkeypatch.setattr(f, "__defaults__", tuple(64 if d == running.BUCKET else d for d in f.__defaults__))
    assert rows(words.read_evt3(spark, path, span=100), "x", "y", "t_us", "p") == slow_evt3(values)


def test_bin(spark, tmp_path):
    recs = [(1, 2, True, 5), (9, 240, False, 0), (3, 4, False, 70000), (0, 240, True, 1), (7, 8, True, 2)]
    data = b"".join(bytes([x, y, p << 7 | ts >> 16, ts >> 8 & 255, ts & 255]) for x, y, p, ts in recs)
    (tmp_path / "a.bin").write_bytes(data)
    got = words.read_bin(spark, str(tmp_path / "a.bin"), span=5).orderBy("i").collect()
    assert [(r.i, r.x, r.y, r.p, r.t_us) for r in got] == [(0, 1, 2, True, 5), (2, 3, 4, False, 70000 + 8192), (4, 7, 8, True, 2 + 2 * 8192)]


@pytest.mark.parametrize(("compression", "table"), [(0, True), (0, False), (1, True), (3, True), (4, False)])
def test_aedat4(spark, tmp_path, compression, table):
    events = lambda rows: packet(b"EVTS", b"".join(struct.pack("<qhhBBh", t, x, y, p, 0, 0) for t, x, y, p in rows), len(rows))
    frame = packet(b"FRME", bytes(range(6)), 6, {0: ("<q", 10), 5: ("<b", 0), 6: ("<h", 3), 7: ("<h", 2)}, slot=10)
    imu = tables_packet(b"IMUS", [{0: ("<q", 7), 2: ("<f", 0.1), 3: ("<f", 0.2), 4: ("<f", 0.3), 5: ("<f", 1.1), 6: ("<f", 1.2), 7: ("<f", 1.3)}])
    trigger = tables_packet(b"TRIG", [{0: ("<q", 8), 1: ("<b", 2)}])
    (tmp_path / "a.aedat4").write_bytes(aedat4_file([("events", "EVTS"), ("frames", "FRME"), ("mine", "IMUS"), ("triggers", "TRIG")], [(0, events([(1, 2, 3, 1)])), (1, frame), (2, imu), (0, events([(4, 5, 6, 0), (5, 6, 7, 1)])), (3, trigger)], compression, table))
    path = str(tmp_path / "a.aedat4")
    assert rows(aedat4.read_events(spark, path), "idx", "t_us", "x", "y", "p") == [(0, 1, 2, 3, True), (1, 4, 5, 6, False), (2, 5, 6, 7, True)]
    f = aedat4.read(spark, path, "frames").first()
    assert (f.t_us, f.height, f.width, f.channels, bytes(f.pixels)) == (10, 2, 3, 1, bytes(range(6)))
    i = aedat4.read(spark, path, "imu").first()
    assert (i.t_us, round(i.ax, 5), round(i.gz, 5)) == (7, 0.1, 1.3)
    assert [(t.t_us, t.type) for t in aedat4.read(spark, path, "triggers").collect()] == [(8, 2)]


def test_aedat4_damage(tmp_path):
    (tmp_path / "b").write_bytes(b"#!AER-DAT3.1\r\n0000")
    with pytest.raises(aedat4.Aedat4Error):
        aedat4.header(str(tmp_path / "b"))
    with pytest.raises(aedat4.Aedat4Error):
        aedat4.events_of(b"\x09\0\0\0aaaaEVTSxx")
    with pytest.raises(aedat4.Aedat4Error):
        aedat4._inflated(b"", 9)


def test_png_round_trips(spark, tmp_path):
    rng = np.random.default_rng(2)
    for shape, kind in (((5, 7), np.uint8), ((4, 6, 3), np.uint16), ((3, 3, 2), np.uint8), ((4, 5, 4), np.uint8)):
        image = rng.integers(0, np.iinfo(kind).max, shape).astype(kind)
        assert (rasters.decode_png(rasters.encode_png(image)).reshape(shape) == image).all()
    flow = np.zeros((2, 3, 3), np.uint16)
    flow[..., 0], flow[..., 1], flow[..., 2] = 32768 + 128, 32768 - 256, [[1, 0, 1], [1, 1, 1]]
    (tmp_path / "0.png").write_bytes(rasters.encode_png(flow))
    got = rasters.flow_of(rasters.read_png(spark, str(tmp_path))).orderBy("y", "x").collect()
    assert [(r.fx, r.fy, r.valid) for r in got][:2] == [(1.0, -2.0, True), (1.0, -2.0, False)]


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
def test_png_filters(kind):
    rng = np.random.default_rng(kind)
    image = rng.integers(0, 255, (6, 5, 3)).astype(np.uint8)
    raw = bytearray()
    flat = image.reshape(6, 15).astype(int)
    for y in range(6):
        raw.append(kind)
        for i in range(15):
            a, b, c = flat[y, i - 3] if i >= 3 else 0, flat[y - 1, i] if y else 0, flat[y - 1, i - 3] if y and i >= 3 else 0
            p = a + b - c
            guess = {1: a, 2: b, 3: (a + b) // 2, 4: min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]}[kind]
            raw.append((flat[y, i] - guess) % 256)
    whole = rasters.encode_png(image)
    at = whole.index(b"IDAT") - 4
    n = struct.unpack_from(">I", whole, at)[0]
    body = zlib.compress(bytes(raw))
    made = whole[:at] + struct.pack(">I", len(body)) + b"IDAT" + body + b"\0\0\0\0" + whole[at + 12 + n :]
    assert (rasters.decode_png(made) == image).all()


def test_npz(spark, tmp_path):
    np.savez(tmp_path / "f.npz", x_flow_dist=np.arange(24.0).reshape(4, 2, 3), y_flow_dist=-np.arange(24.0).reshape(4, 2, 3), timestamps=np.arange(4.0))
    f = rasters.flow_pixels(rasters.read_npz_flow(spark, str(tmp_path / "f.npz")))
    assert {(r.frame, r.y, r.x): (r.fx, r.fy) for r in f.collect()}[(2, 1, 2)] == (17.0, -17.0)
    np.savez(tmp_path / "o.npz", timestamps=np.arange(3.0), pos=np.ones((3, 3)))
    o = rasters.read_npz_rows(spark, str(tmp_path / "o.npz"), {"t": "timestamps", "position": "pos"}).orderBy("idx").collect()
    assert o[2].t == 2.0 and o[0].position == [1.0, 1.0, 1.0]


def davis(folder):
    (folder / "events.txt").write_text("# t x y p\n0.00 1 0 1\n0.05 2 1 0\n\n0.10 3 2 1\n0.15 0 1 -1\n0.20 1 2 1\n")
    for k in range(3):
        (folder / f"i{k}.png").write_bytes(rasters.encode_png((np.arange(12) + 10 * k).reshape(3, 4).astype(np.uint8)))
    (folder / "images.txt").write_text("0 i0.png\n0.1 i1.png\n0.2 i2.png\n")
    (folder / "imu.txt").write_text("".join(f"{t} 1 2 3 4 5 6\n" for t in (0.025, 0.075, 0.125, 0.175)))
    (folder / "groundtruth.txt").write_text("".join(f"{t} 1 2 3 0 0 0 1\n" for t in (0, 0.1, 0.2)))
    (folder / "calib.txt").write_text("100 101 2 1.5 -.1 .2 .01 .02")


def test_davis_recording(spark, tmp_path):
    davis(tmp_path)
    r = recording.davis(spark, str(tmp_path))
    assert r.num_events == 5 and r.time_to_index(0) == -1 and r.time_to_index(100_000) == 1
    assert [b.at + 1 for b in temporal.time_to_index(r.stream("frames").select(F.col("idx").alias("probe_id"), "t_us"), r.events).orderBy("probe_id").collect()] == [0, 2, 4]
    s = r.frame_samples().orderBy("frame_idx").collect()
    assert [[e.t_us for e in x.events] for x in s] == [[], [0, 50_000], [100_000, 150_000]]
    assert [x.pose for x in s] == [0, 1, 2]
    assert [round(x.t, 3) for x in r.by_time("imu", 50_000, 150_000).orderBy("idx").collect()] == [0.075, 0.125]
    assert text.read_calibration(str(tmp_path / "calib.txt")) == (100, 101, 2, 1.5, -0.1, 0.2, 0.01, 0.02, 0)
    assert rasters.same_shape(rasters.read_png(spark, str(tmp_path / "*.png"))).count() == 3
    assert [b.count() for b in r.iter_events(num_events=2)] == [2, 2, 1]
    assert [b.count() for b in r.iter_events(time_window=100_000)] == [2, 2]
    for bad in ((-1, 2), (3, 2), (0, 6)):
        with pytest.raises(IndexError):
            r.load_events(*bad)
    with pytest.raises(ValueError):
        r.windows()
    with r.load(imu="cached", pose=False) as held:
        assert held.streams["pose"] is None and held.stream("imu").count() == 4
    assert layout.davis_recording(str(tmp_path.parent), tmp_path.name) == str(tmp_path)


@pytest.mark.parametrize("line", ["0.3 -1 1 1", "0.3 40000 1 1", "0.3 1.5 1 1", "0.3 1 1 2", "0.1 1 1 1", "0.3 1 1"])
def test_bad_davis_rows(spark, tmp_path, line):
    (tmp_path / "events.txt").write_text(f"0.1 1 1 1\n0.2 1 1 0\n{line}\n")
    with pytest.raises(Exception, match="bad event in row 2|timestamps fall"):
        text.read_davis_events(spark, str(tmp_path / "events.txt")).collect()


def test_empty_recording(spark, tmp_path):
    (tmp_path / "events.txt").write_text("# nothing\n")
    (tmp_path / "groundtruth.txt").write_text("")
    (tmp_path / "images.txt").write_text("0.5 a.png\n")
    (tmp_path / "a.png").write_bytes(b"x")
    r = recording.davis(spark, str(tmp_path))
    assert r.time_to_index(0) == -1 and r.load_events(0, 0).count() == 0
    m = r.metadata().first()
    assert (m.num_events, m.t_start, m.duration) == (0, None, None)
    s = r.frame_samples().collect()
    assert len(s) == 1 and s[0].pose is None and s[0].events == []
    assert list(r.iter_events(time_window=10)) == []


def test_integer_rows_and_text_round_trip(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# start, end\nfrom to\n1, 2, 9\n3 4\n")
    assert [(r.v0, r.v1) for r in text.read_integer_rows(spark, str(tmp_path / "t.txt"), 2).orderBy("idx").collect()] == [(1, 2), (3, 4)]
    e = generate.events(spark, 200, 20, 40, 0.1, 0.3)
    text.write_events(e, str(tmp_path / "out"), F.col("t"))
    back = text.read_events(spark, str(tmp_path / "out")).orderBy("idx").collect()
    want = e.orderBy("idx").collect()
    assert [(round(r.t, 9), r.x, r.y, r.p) for r in want] == [(r.t, r.x, r.y, r.p) for r in back]
    assert all(a.t <= b.t for a, b in zip(want, want[1:], strict=False))


def test_cache_follows_its_source(spark, tmp_path):
    source = tmp_path / "s.txt"
    source.write_text("0.1 1 2 1\n")
    made = []

    def build():
        made.append(1)
        return text.read_events(spark, str(source))

    for _ in range(2):
        assert cache.cached(spark, str(tmp_path / "c"), str(source), "events", build).count() == 1
    source.write_text("0.1 1 2 1\n0.2 1 2 1\n")
    assert cache.cached(spark, str(tmp_path / "c"), str(source), "events", build).count() == 2
    assert len(made) == 2
    assert cache.convert(build(), str(tmp_path / "p"), {"t": "time"}) == 2
    assert spark.read.parquet(str(tmp_path / "p")).columns == ["idx", "time", "x", "y", "p"]


def test_rosbag(spark, tmp_path):
    head = struct.pack("<III", 0, 1, 2) + struct.pack("<I", 3) + b"imu"
    body = head + struct.pack("<4d", 0, 0, 0, 1) + bytes(72) + struct.pack("<3d", 1, 2, 3) + bytes(72) + struct.pack("<3d", 4, 5, 6) + bytes(72)
    fields = b"".join(struct.pack("<I", len(n)) + n + struct.pack("<IBI", o, k, 1) for n, o, k in ((b"x", 0, 7), (b"y", 4, 7), (b"z", 8, 7), (b"intensity", 12, 7), (b"ring", 16, 4), (b"time", 18, 7)))
    point = lambda i: struct.pack("<4fHf", i, i + 1, i + 2, i + 3, i, i / 10)
    cloud = head + struct.pack("<III", 2, 2, 6) + fields + struct.pack("<BIII", 0, 22, 50, 100) + b"".join(point(2 * r) + point(2 * r + 1) + bytes(6) for r in range(2)) + b"\1"
    (tmp_path / "a.bag").write_bytes(bag([("/imu/data", 10**9 + 5, body), ("/velodyne_points", 2 * 10**9, cloud), ("/imu/data", 3 * 10**9, body)]))
    i = rosbag.read_imu(spark, str(tmp_path / "a.bag")).orderBy("idx").collect()
    assert [(r.t_ns, r.wx, r.az, r.qw) for r in i] == [(10**9 + 5, 1.0, 6.0, 1.0), (3 * 10**9, 1.0, 6.0, 1.0)]
    s = rosbag.read_lidar(spark, str(tmp_path / "a.bag")).first()
    assert s.frame_id == "imu" and [(p.x, p.ring) for p in s.points] == [(0.0, 0), (1.0, 1), (2.0, 2), (3.0, 3)]


def test_layouts(tmp_path):
    for name in ("shapes_6dof", "other"):
        (tmp_path / name).mkdir()
    assert layout.available(str(tmp_path)) == ["shapes_6dof"]
    assert layout.category("indoor_flying12") == "indoor_flying" and layout.drive("zurich_city_04_a") == "zurich_city_04"
    with pytest.raises(ValueError):
        layout.validated("nope")
    (tmp_path / "train_events" / "s1" / "events").mkdir(parents=True)
    assert layout.dsec_sequence(str(tmp_path), "s1")["events"].endswith("train_events/s1/events")
    (tmp_path / "c.yaml").write_text("%YAML:1.0\na: {b: [1, 2]}\n")
    assert layout.yaml_calibration(str(tmp_path / "c.yaml")) == {"a": {"b": [1, 2]}}


@pytest.mark.parametrize("cut", ["128m", "100"])
def test_lines_keep_the_order_of_names_whatever_their_files_sizes(spark, tmp_path, cut):
    """A scan takes the largest files and blocks first."""
    want, at = [], 0
    for k, n in enumerate([3, 40, 0, 7, 90, 1]):
        (tmp_path / f"part-{k:05d}.txt").write_text("".join(f"{(at + i) / 8} {at + i}\n" for i in range(n)))
        want += range(at, at + n)
        at += n
    spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert rows(text.lines(spark, str(tmp_path)), "idx", "value") == [(i, f"{i / 8} {i}") for i in want]
        assert rows(text.read_timestamps(spark, str(tmp_path)), "idx", "t") == [(i, i / 8) for i in want]
        assert rows(text.read_rows(spark, str(tmp_path), 2), "idx", "row") == [(i, [i / 8, float(i)]) for i in want]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_davis_events_of_several_files_do_not_fall(spark, tmp_path):
    (tmp_path / "events.txt").mkdir()
    for k, n in enumerate([2, 50, 5]):
        (tmp_path / "events.txt" / f"part-{k:05d}.txt").write_text("# new file\n" + "".join(f"{k}.{i:03d} {i} 1 1\n" for i in range(n)))
    held = recording.davis(spark, str(tmp_path))
    assert rows(held.events, "idx", "x") == list(enumerate([*range(2), *range(50), *range(5)]))
    assert held.index_to_time(-1) == 2_004_000


def test_npz_of_many_archives_in_one_plan(spark, tmp_path):
    """The plan doesn't grow with the archives."""
    paths = [str(tmp_path / f"{k}.npz") for k in range(40)]
    for k, path in enumerate(paths):
        np.savez_compressed(path, x_flow_dist=np.full((3, 1, 2), k), y_flow_dist=np.zeros((3, 1, 2)), timestamps=np.arange(3.0), pos=np.full((3, 2), k))
    flows = rasters.read_npz_flow(spark, paths, block=2)
    got = {(r.recording, r.frame, r.t, r.x, r.fx) for r in rasters.flow_pixels(flows, "recording", "t").collect()}
    assert got == {(path, f, float(f), x, float(k)) for k, path in enumerate(paths) for f in range(3) for x in range(2)}
    held = rasters.read_npz_rows(spark, paths, {"t": "timestamps", "pos": "pos"}, block=2)
    assert {(r.recording, r.idx, r.t, tuple(r.pos)) for r in held.collect()} == {(path, i, float(i), (float(k),) * 2) for k, path in enumerate(paths) for i in range(3)}
    assert len(held._jdf.queryExecution().optimizedPlan().toString()) < 5000
    np.savez(paths[7], timestamps=np.arange(3.0), pos=np.ones((2, 2)))
    with pytest.raises(Exception, match="differ in length"):
        held.collect()


def test_tasks_of_byte_ranges_grow_with_bytes_only():
    small = [(f"{k}.raw", at, at + 1000, at // 2) for k in range(3000) for at in range(0, 16_000, 1000)]
    parts = words.dealt(small)
    assert len(parts) == words.TASKS
    assert [(p, at, at + 1000, at // 2) for t in parts for p, low, high, first in t.parts for at in range(low, high, 1000)] == small
    assert all(first == low // 2 for t in parts for _, low, _, first in t.parts)
    assert max(sum(high - low for _, low, high, _ in t.parts) for t in parts) < 2 * 48_000_000 / words.TASKS
    large = [("a.raw", at, at + words.RANGE, at // 2) for at in range(0, 500 * words.RANGE, words.RANGE)]
    assert [t.parts for t in words.dealt(large)] == [[r] for r in large]
    assert [t.parts for t in words.dealt(small[:3])] == [[r] for r in small[:3]]
    assert words.dealt([]) == []


def test_many_recordings_are_read_by_few_tasks(spark, tmp_path):
    paths = [evt3(tmp_path / f"{k}.raw", [0x8000, 0x6000 + k, 1, 0x2000 + k]) for k in range(100)]
    spark.dataSource.register(words.Words)
    raw = spark.read.format("luxflow_words").option("range", 2).load(",".join(paths))
    assert raw.rdd.getNumPartitions() <= words.TASKS
    assert {(r.recording, r.i, r.v) for r in raw.collect()} == {(p, i, v) for k, p in enumerate(paths) for i, v in enumerate([0x8000, 0x6000 + k, 1, 0x2000 + k])}
