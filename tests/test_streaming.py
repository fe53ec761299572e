import numpy as np
import pandas as pd

from luxflow.operators import representations, temporal
from luxflow.streaming import live


def rows(n, seed):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.integers(0, 10_000, n)) + rng.choice([0, 0, 0, -900], n)
    return pd.DataFrame({"recording": "a", "idx": np.arange(n), "t_us": np.maximum(t, 0), "x": rng.integers(0, 4, n).astype("int32"), "y": rng.integers(0, 3, n).astype("int32"), "p": rng.random(n) < 0.5})


def test_batches_of_a_stream_equal_the_whole(spark, tmp_path):
    all_rows = rows(400, 1)
    for k in range(4):
        spark.createDataFrame(all_rows[k * 100 : (k + 1) * 100], live.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    shown = []
    stream = live.slice_counts(live.tail(spark, str(tmp_path / "in"), max_files=1), 1000)
    q = stream.writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    got = {(r.slice, r.y, r.x): (r.on, r.off) for r in spark.sql("SELECT slice, y, x, sum(on) AS on, sum(off) AS off FROM counts GROUP BY 1, 2, 3").collect()}
    df = spark.createDataFrame(all_rows, live.EVENTS)
    want = {(r.slice, r.y, r.x): (r.on, r.off) for r in representations.slice_counts(temporal.slices(df, 1000)).collect()}
    assert got == want
    newest = live.newest(live.slice_counts(live.tail(spark, str(tmp_path / "in"), max_files=4), 1000), lambda b: shown.append({r.slice for r in b.collect()}))
    newest.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start().awaitTermination()
    assert shown == [{max(k[0] for k in want)}]


def test_windows_with_watermark(spark, tmp_path):
    spark.createDataFrame(rows(200, 2), live.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = live.window_counts(live.tail(spark, str(tmp_path / "in")), 1000, 1000).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    got = {r.start_us: r.on + r.off for r in spark.table("w").collect()}
    assert got == (rows(200, 2)["t_us"] // 1000 * 1000).value_counts().to_dict()


def test_streamed_images_are_those_of_the_whole(spark, tmp_path):
    from luxflow.operators import reconstruction

    data = rows(300, 3).assign(t_us=lambda d: d["t_us"].cummax())
    for k in range(3):
        spark.createDataFrame(data[k * 100 : (k + 1) * 100], live.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: reconstruction.model("recurrent_unet", bins=2, base=2, encoders=1)
    stream = live.reconstructions(live.tail(spark, str(tmp_path / "in"), max_files=1), 1000, 3, 4, 2, run, encoders=1)
    q = stream.writeStream.format("memory").queryName("images").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    got = {(r.frame_idx, r.y, r.x): r.value for r in spark.table("images").collect()}
    sliced = temporal.slices(spark.createDataFrame(data, live.EVENTS), 1000).withColumnRenamed("slice", "window")
    cells = reconstruction.voxel_windows(sliced, 3, 4, 2).toPandas()
    frames, last = reconstruction.Frames(3, 4, 2, run(), 1), int(cells["window"].max())
    want = {}
    for number, part in cells[cells["window"] < last].groupby("window"):
        image = frames.step(*(part[c].to_numpy() for c in ("bin", "y", "x", "value")))
        want |= {(int(number), y, x): image[y, x] for y in range(3) for x in range(4)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_a_batch_of_any_size_is_held_in_pieces(monkeypatch):
    monkeypatch.setattr(live, "ROWS", 100)
    shaken = rows(1000, 4).sample(frac=1, random_state=1)
    pieces = list(live.ordered(iter([shaken[k : k + 30] for k in range(0, 1000, 30)])))
    assert max(map(len, pieces)) <= 100
    assert pd.concat(pieces).equals(rows(1000, 4)[["idx", "t_us", "x", "y", "p"]])
    assert len(next(live.ordered(iter([shaken[:70]])))) == 70


def test_an_unfinished_slice_stays_out_of_the_state(tmp_path, monkeypatch):
    import pickle

    from luxflow.operators import reconstruction

    monkeypatch.setattr(live, "HELD", 100)
    waiting, small, data = live.Waiting(str(tmp_path)), live.Waiting(str(tmp_path)), rows(2000, 5)
    for k in range(0, 2000, 40):
        waiting.add(data[k : k + 40])
    assert len(pickle.dumps(waiting)) < 10_000 and len(waiting.paths) > 10
    monkeypatch.setattr(live, "HELD", 5000)
    small.add(data)
    assert not small.paths and small.ends == waiting.ends == (data["t_us"].min(), data["t_us"].max())
    for got, want in zip(*(reconstruction.voxels(w.pieces, 3, 3, 4, w.ends) for w in (waiting, small)), strict=True):
        assert np.array_equal(got, want)
