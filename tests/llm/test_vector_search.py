import numpy as np
import pytest

from luxflow.llm import ann, topk, vector_search


def table(spark, x, ids=None):
    rows = [(int(i), [float(c) for c in v], "a", 0) for i, v in zip(ids if ids is not None else range(len(x)), x, strict=True)]
    rows += [(None, [1.0] * x.shape[1], "b", 0), (1_000_000, None, "c", 0), (1_000_020, [float("nan")] * x.shape[1], "d", 0), (1_000_040, [1.0, None], "e", 0), (1_000_060, [], "f", 0), (1_000_100, [float("inf")] * x.shape[1], "g", 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id string, rank int")


def brute(x, ids, every, k, f):
    x = f(x.astype(np.float32).astype(np.float64))
    out = {}
    for i in np.nonzero(ids % every == 0)[0]:
        s = (x * x[i]).sum(axis=1)
        near = sorted((-a, b) for a, b in zip(s.tolist(), ids.tolist(), strict=True) if b != ids[i])[:k]
        out[int(ids[i])] = [(r + 1, b, -a) for r, (a, b) in enumerate(near)]
    return out


def rows_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 24))
    x[200:500] = x[0]
    x[600:700] = np.round(x[600:700], 1)
    x[700] = 0
    x[800:900] = x[100] + 0.01 * rng.standard_normal((100, 24))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def test_top_is_exact(spark, vectors, monkeypatch):
    ids = np.arange(len(vectors))
    want = brute(vectors, ids, 50, 5, lambda x: np.floor(x * 256))
    assert rows_of(topk.top(table(spark, vectors))) == want
    real = vector_search.search
    monkeypatch.setattr(topk, "search", lambda *a, **b: real(*a, **b, shard=200, block=10))
    assert rows_of(topk.top(table(spark, vectors).repartition(3))) == want


def test_ann_recall_and_scores(spark, vectors, monkeypatch):
    ids = np.arange(len(vectors))
    want = brute(vectors, ids, 20, 20, lambda x: x)
    del want[700]
    real = vector_search.search
    for small in (False, True):
        if small:
            monkeypatch.setattr(ann, "search", lambda *a, **b: real(*a, **b, shard=300, block=20))
        got = rows_of(ann.nearest(table(spark, vectors)))
        assert got.keys() == want.keys()
        hits = [len({b for _, b, _ in got[q]} & {b for _, b, _ in want[q]}) / 20 for q in want]
        assert np.mean(hits) >= 0.9
        x = vectors.astype(np.float32).astype(np.float64)
        for q, near in got.items():
            assert [r for r, _, _ in near] == list(range(1, 21))
            assert [(-s, i) for _, i, s in near] == sorted((-s, i) for _, i, s in near)
            assert all(abs(s - x[q] @ x[i]) < 1e-12 and i != q for _, i, s in near)
        assert [b for _, b, _ in got[220]] == [b for _, b, _ in want[220]]  # copies: the smallest ids


def test_few_and_none(spark):
    x = np.array([[1.0, 0.5], [0.5, 1.0], [0.2, 0.1]])
    got = rows_of(topk.top(table(spark, x, [0, 3, 4])))
    assert [b for _, b, _ in got[0]] == [3, 4]
    assert topk.top(table(spark, x).limit(0)).count() == 0
    assert ann.nearest(table(spark, x).limit(0)).count() == 0


def test_shards_and_leaves_are_pruned(vectors):
    """Of vectors in groups, few are scored, and the recall holds."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 64))[rng.integers(0, 40, 8000)] + 0.3 * rng.standard_normal((8000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    space, q = ann.Projected(64, 1.0 + 1e-9), x[::20]
    index = []

    class Seen(vector_search.KdTree):
        def __init__(self, *a):
            super().__init__(*a)
            index.append(self)

    keep, vector_search.KdTree = vector_search.KdTree, Seen
    try:
        places = vector_search.best_first(space, x, q, np.full(len(q), -np.inf), 21)
    finally:
        vector_search.KdTree = keep
    want = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :21]
    assert np.mean([len(set(a) & set(b)) / 21 for a, b in zip(places.tolist(), want.tolist(), strict=True)]) >= 0.9
    assert index[0].verified < 0.2 * len(q) * len(x)


def test_repeated_ids_wide_numbers_and_extra_columns(spark):
    rows = [(0, [3.0e6, 1.0]), (0, [1.0, 1.0]), (50, [2.0, 7.0]), (7, [9.0e12, 1.0]), (7, [9.0e12, 1.0]), (8, [9.0e12, 2.0])]
    df = spark.createDataFrame([(i, v, "x", 1, 2, 0.5) for i, v in rows], "vec_id long, embedding array<double>, shard string, query long, floor int, score double")
    got = rows_of(topk.top(df))
    q = {0: [256, 256], 50: [512, 1792], 7: [int(9.0e12) * 256, 256], 8: [int(9.0e12) * 256, 512]}  # of id 0 the least vector
    for i in (0, 50):
        s = sorted((-(q[i][0] * v[0] + q[i][1] * v[1]), j) for j, v in q.items() if j != i)
        assert got[i] == [(r + 1, j, min(-a, 2**63 - 1)) for r, (a, j) in enumerate(s)]


def test_one_vector_for_a_third_of_all(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 8))
    x[:200] = x[0]
    want = brute(x, np.arange(600), 50, 5, lambda x: np.floor(x * 256))
    assert rows_of(topk.top(table(spark, x))) == want
