import random

import pytest

from luxflow.operators import representations

SCHEMA = "slice long, y int, x int, on long, off long"


def slow_decay(rows, decay):
    top = max(r[0] for r in rows)
    held, out = {}, {}
    for k in range(top + 1):
        held = {p: (a * decay, b * decay) for p, (a, b) in held.items()}
        for s, y, x, a, b in rows:
            if s == k:
                old = held.get((y, x), (0.0, 0.0))
                held[y, x] = (old[0] + a, old[1] + b)
        out.update({(k, *p): v for p, v in held.items()})
    return out


@pytest.mark.parametrize(("decay", "bucket"), [(0.5, 32), (0.9, 3), (1.0, 4)])
def test_decayed_counts_have_no_horizon(spark, decay, bucket):
    rng = random.Random(4)
    rows = [(0, 0, 0, 10**9, 3)] + [(s, 1, x, rng.randrange(5), rng.randrange(5)) for s in range(70) for x in range(3) if rng.random() < 0.1] + [(110, 2, 2, 1, 0)]
    got = {(r.slice, r.y, r.x): (r.on, r.off) for r in representations.decayed_counts(spark.createDataFrame(rows, SCHEMA), decay, bucket=bucket).collect()}
    want = slow_decay(rows, decay)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    assert got[21, 0, 0][0] == pytest.approx(1e9 * decay**21)
    assert representations.decayed_counts(spark.createDataFrame([], SCHEMA), decay).count() == 0
