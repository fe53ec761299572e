
import numpy as np
import pytest
from pyspark.sql import functions as F

from luxflow.plans import datasets
from luxflow.sources import layout, rasters

FAKE = '''
import numpy as np


class File(dict):
    """Arrays of an npz archive under h5py's names."""

    def __init__(self, path):
        with np.load(path) as held:
            super().__init__({k.replace("|", "/"): held[k] for k in held.files})

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass
'''


def store(path, **arrays):
    with open(path, "wb") as f:
        np.savez(f, **{k.replace("/", "|"): v for k, v in arrays.items()})


def fake(spark, tmp_path):
    import sys

    (tmp_path / "h5py.py").write_text(FAKE)
    if "h5py" not in sys.modules:
        spark.sparkContext.addPyFile(str(tmp_path / "h5py.py"))


def test_mvsec(spark, tmp_path):
    fake(spark, tmp_path)
    rng = np.random.default_rng(1)
    t = 1504645177 + np.sort(rng.random(500)) * 70
    rows = np.stack([rng.integers(0, 346, 500), rng.integers(0, 260, 500), t, rng.choice([-1, 1], 500)], axis=1).astype(float)
    frames = 1504645177 + np.arange(20) * 3.5
    store(tmp_path / "indoor_flying1_data.hdf5", **{"davis/left/events": rows, "davis/left/image_raw_ts": frames, "davis/left/image_raw_event_inds": np.searchsorted(t, frames), "davis/left/imu": rng.random((100, 6)), "davis/left/imu_ts": np.linspace(t[0], t[-1], 100)})
    r = datasets.mvsec(spark, str(tmp_path), "indoor_flying1")
    got = r.events.orderBy("idx").collect()
    assert [(e.x, e.y, e.p) for e in got] == [(int(a), int(b), d > 0) for a, b, _, d in rows]
    assert r.stream("imu").count() == 100 and r.streams["pose"] is None and r.streams["flow"] is None
    from luxflow.operators.temporal import frames_by_event_index

    owned = frames_by_event_index(r.events, r.stream("frames").withColumnRenamed("idx", "frame_idx")).groupBy("frame_idx").count().collect()
    ends = np.searchsorted(t, frames)
    assert {o.frame_idx: o["count"] for o in owned} == {k: n for k, n in enumerate(np.diff(np.concatenate([[0], ends]))) if n}
    (tmp_path / "indoor_flying_left_x_map.txt").write_text("0 1.5\n0 2\n")
    (tmp_path / "indoor_flying_left_y_map.txt").write_text("0 0\n1 1.5\n")
    assert {(m.y, m.x): (m.rx, m.ry) for m in datasets.mvsec_map(spark, str(tmp_path), "indoor_flying1").collect()}[(1, 1)] == (2.0, 1.5)


def test_dsec(spark, tmp_path):
    fake(spark, tmp_path)
    rng = np.random.default_rng(2)
    base = tmp_path / "train" / "zurich_city_04_a"
    for d in ("events/left", "images", "flow", "disparity"):
        (base / d).mkdir(parents=True)
    t = np.sort(rng.integers(0, 5_000_000, 2000))
    store(base / "events/left/events.h5", **{"events/x": rng.integers(0, 640, 2000), "events/y": rng.integers(0, 480, 2000), "events/t": t, "events/p": rng.integers(0, 2, 2000), "t_offset": np.array(1_600_000_000_000)})
    times = 1_600_000_000_000 + np.arange(10) * 500_000
    (base / "images/timestamps.txt").write_text("\n".join(map(str, times)))
    for way in ("forward", "backward"):
        (base / f"flow/{way}_timestamps.txt").write_text("# start, end\n" + "\n".join(f"{a}, {b}" for a, b in zip(times[:-1], times[1:], strict=True)))
    (base / "disparity/timestamps.txt").write_text("\n".join(map(str, times[::2])))
    shift = rng.standard_normal((480, 640, 2)).astype(np.float32)
    store(base / "events/left/rectify_map.h5", rectify_map=shift)
    m = datasets.dsec_map(spark, str(base / "events/left"))
    assert m.count() == 480 * 640
    r = m.where("y = 479 AND x = 3").first()
    assert (r.rx, r.ry) == tuple(shift[479, 3].tolist())
    r = datasets.dsec(spark, str(tmp_path), "zurich_city_04_a")
    s = {x.frame_idx: x for x in r.interval_samples().collect()}
    want = np.searchsorted(t + 1_600_000_000_000, times)
    assert [s[k].num_events for k in range(9)] == np.diff(want).tolist()
    assert s[0].num_imu is None and s[1].disparity == 1 and s[0].disparity == 0
    probes = r.stream("flow_forward").select(F.col("idx").alias("id"), (F.col("t_us") + 1).alias("t_us"))
    assert [m.match for m in datasets.backward_anchor(probes, r.stream("flow_backward")).orderBy("id").collect()] == list(range(9))


def test_mvsec_ground_truth(spark, tmp_path):
    fake(spark, tmp_path)
    rng = np.random.default_rng(3)
    t = np.arange(60) * 0.01
    rows = np.stack([rng.integers(0, 346, 60), rng.integers(0, 260, 60), t, rng.choice([-1, 1], 60)], axis=1).astype(float)
    truth = np.arange(5) * 0.1
    images, scans = rng.integers(0, 255, (6, 4, 5)).astype(np.uint8), rng.random((3, 7, 4)).astype(np.float32)
    depth, flow, pose = rng.random((5, 4, 5)).astype(np.float32), rng.random((5, 2, 4, 5)), rng.random((5, 4, 4))
    store(tmp_path / "indoor_flying2_data.hdf5", **{"davis/left/events": rows, "davis/left/image_raw_ts": np.arange(6) * 0.1, "davis/left/image_raw_event_inds": np.arange(6) * 10, "davis/left/image_raw": images, "velodyne/scans": scans, "velodyne/scans_ts": np.arange(3) * 0.2})
    base = "davis/left/"
    store(tmp_path / "indoor_flying2_gt.hdf5", **{base + "depth_image_raw": depth, base + "depth_image_raw_ts": truth, base + "flow_dist": flow, base + "flow_dist_ts": truth, base + "pose": pose, base + "pose_ts": truth, base + "blended_image_rect": images[:5], base + "blended_image_rect_ts": truth})
    r = datasets.mvsec(spark, str(tmp_path), "indoor_flying2")
    cells = {(p.idx, p.y, p.x): p.value for p in rasters.field_pixels(r.stream("depth")).collect()}
    assert cells == {(i, y, x): float(depth[i, y, x]) for i in range(5) for y in range(4) for x in range(5)}
    cells = {(p.idx, p.channel, p.y, p.x): p.value for p in rasters.field_pixels(r.stream("flow_hdf5")).collect()}
    assert cells[(4, 1, 3, 2)] == flow[4, 1, 3, 2] and len(cells) == 200
    assert {p.idx: p.matrix for p in r.stream("pose").collect()} == {i: pose[i].ravel().tolist() for i in range(5)}
    assert [s.shape for s in r.stream("velodyne").collect()] == [[7, 4]] * 3
    assert r.stream("images").orderBy("idx").first()["values"] == images[0].ravel().tolist()
    assert r.streams["depth_rect"] is None and r.streams["odometry_matrix"] is None
    held = datasets.mvsec_samples(r)
    assert len(held) == 6 and held[2]["depth"] == 2 and held[-1]["velodyne"] == 2 and held[3]["flow"] is None
    assert [s["frame_idx"] for s in held] == list(range(6)) == [s["frame_idx"] for s in held]
    assert r.index_to_time(-1) == 590_000
    with pytest.raises(IndexError):
        held[6]


def test_dsec_options_and_samples(spark, tmp_path):
    fake(spark, tmp_path)
    base = tmp_path / "DSEC" / "Train" / "thun_00_a"
    for d in ("events/left", "images/left", "flow"):
        (base / d).mkdir(parents=True)
    (tmp_path / "data" / "thun_00").mkdir(parents=True)
    arrays = {"events/x": np.array([0, 5, 639]), "events/y": np.array([0, 7, 479]), "events/t": np.array([0, 1500, 2500]), "events/p": np.array([0, 1, 1]), "t_offset": np.array([1000])}
    store(base / "events/left/events.h5", **arrays, ms_to_idx=np.array([0, 1, 2, 3]))
    shift = np.stack(np.meshgrid(np.arange(640), np.arange(480)), axis=2).astype(np.float32) + 1
    store(base / "events/left/rectify_maps.h5", rectify_map=shift)
    (base / "images/timestamps.txt").write_text("1000\n2000\n3000\n")
    (base / "images/left/exposure_timestamps.txt").write_text("990, 1010\n1990, 2010\n2990, 3010\n")
    (base / "flow/forward_timestamps.txt").write_text("1000, 2000\n2000, 3000\n")
    (base / "flow/backward_timestamps.txt").write_text("2001, 1000\n")
    root = str(tmp_path / "DSEC")
    assert layout.auxiliary_root(root, "thun_00_a") == str(tmp_path)
    r = datasets.dsec(spark, root, "thun_00_a", prerectify=True, check=True)
    assert [(e.idx, e.x, e.y) for e in r.events.orderBy("idx").collect()] == [(0, 1, 1), (1, 6, 8)]
    held = datasets.dsec_samples(datasets.dsec(spark, root, "thun_00_a"))
    assert [(s["num_events"], s["image_start"], s["image_end"], s["flow"], s["flow_backward"], s["disparity"]) for s in held] == [(1, 0, 1, 0, None, None), (1, 1, 2, 1, 0, None)]
    ms = datasets.dsec_ms_to_idx(spark, str(base / "events/left/events.h5"), 3)
    assert {m.ms: m.idx for m in ms.collect()} == {0: 0, 1: 1, 2: 2, 3: 3}
    with pytest.raises(ValueError, match="leaves"):
        datasets.dsec_ms_to_idx(spark, str(base / "events/left/events.h5"), 2)
    arrays["events/x"] = np.array([0, 5, 640])
    store(base / "events/left/events.h5", **arrays)
    with pytest.raises(Exception, match="off the sensor"):
        datasets.dsec(spark, root, "thun_00_a", check=True).events.collect()
    with pytest.raises(ValueError, match="split"):
        layout.dsec_sequence(root, "thun_00_a", "val")
