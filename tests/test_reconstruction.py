import numpy as np
import pytest

from luxflow.operators import reconstruction, temporal
from luxflow.sources import generate


def slow_conv(x, w, b, stride):
    k, h, wd = w.shape[2], x.shape[1], x.shape[2]
    p = np.pad(x, ((0, 0), (k // 2, k // 2), (k // 2, k // 2)))
    return np.array([[[(p[:, i : i + k, j : j + k] * w[o]).sum() + b[o] for j in range(0, wd, stride)] for i in range(0, h, stride)] for o in range(len(w))])


def test_convolution():
    rng = np.random.default_rng(1)
    x, w, b = rng.standard_normal((2, 6, 8)), rng.standard_normal((3, 2, 3, 3)), rng.standard_normal(3)
    for stride in (1, 2):
        assert np.allclose(reconstruction.conv2d(x, w, b, stride), slow_conv(x, w, b, stride))
    assert np.allclose(reconstruction.upsample(np.ones((2, 3, 4))), 1) and reconstruction.upsample(x).shape == (2, 12, 16)


def test_state_goes_on():
    m = reconstruction.model("recurrent_unet", bins=2)
    x = np.random.default_rng(2).standard_normal((2, 16, 20))
    a, s = m(x, None)
    b, _ = m(x, s)
    assert a.shape == (16, 20) and (0 < a).all() and (a < 1).all() and not np.allclose(a, b)
    with pytest.raises(KeyError):
        reconstruction.model("convgru")


def test_frames_of_events(spark):
    from pyspark.sql import functions as F

    e = generate.events(spark, 300, 10, 14).withColumn("t_us", F.rint(F.col("t") * 1e6).cast("long"))
    got = reconstruction.reconstruct(temporal.count_windows(e, 100), 10, 14, 2, lambda: reconstruction.model("recurrent_unet", bins=2))
    rows = got.collect()
    assert len(rows) == 3 * 140 and all(0 <= r.level <= 255 for r in rows)
    v = reconstruction.voxel_windows(temporal.count_windows(e, 100), 10, 14, 2).toPandas()
    for _, cells in v.groupby("window"):
        assert abs(cells["value"].mean()) < 1e-9 and abs(cells["value"].std(ddof=0) - 1) < 1e-9


def test_recordings_have_states_of_their_own(spark):
    from pyspark.sql import functions as F

    e = generate.events(spark, 300, 10, 14).withColumn("t_us", F.rint(F.col("t") * 1e6).cast("long"))
    w = temporal.count_windows(e, 100)
    run = lambda: reconstruction.model("recurrent_unet", bins=2)
    alone = {(r.frame_idx, r.y, r.x): r.level for r in reconstruction.reconstruct(w, 10, 14, 2, run).collect()}
    both = w.withColumn("recording", F.lit("a")).unionByName(w.withColumn("recording", F.lit("b")))
    rows = reconstruction.reconstruct(both, 10, 14, 2, run, by=["recording"]).collect()
    for name in "ab":
        assert {(r.frame_idx, r.y, r.x): r.level for r in rows if r.recording == name} == alone
    assert reconstruction.parameter_count(run()) == sum(np.size(v) for v in run().weights.values()) > 1000
