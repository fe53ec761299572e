import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from luxflow.llm import simhash
from luxflow.llm.components import connected_components, local_components


def slow_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    rng = random.Random(3)
    for _ in range(200):
        t = "".join(rng.choice("abÉé A\n\t \x1c🙂") for _ in range(rng.randrange(0, 60)))
        assert simhash.fingerprint(t) == slow_print(t), repr(t)
    assert simhash.fingerprint(None) == 0 and simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("a b " * 20_000) == slow_print("a b " * 20_000)


def components(fps, ids):
    order = np.argsort(ids)
    a, b = np.nonzero(np.bitwise_count(fps[order][:, None] ^ fps[order][None]) <= 3)
    return dict(zip(ids[order].tolist(), ids[order][local_components(len(ids), a, b)].tolist(), strict=True))


@pytest.mark.parametrize("hot", [20000, 40])
def test_links_of_dense_groups(spark, hot):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base[rng.integers(0, 5, 500)]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    chain = np.array([((1 << 2 * k) - 1) & (1 << 64) - 1 for k in range(32)], np.uint64)
    fps = np.unique(np.concatenate([base, near, chain, [np.uint64(0), np.uint64(7)]]))
    rng.shuffle(fps)
    ids = np.arange(len(fps)) * 10
    df = spark.createDataFrame([(int(f), int(i)) for f, i in zip(fps.view(np.int64), ids, strict=True)], "fp long, rep long")
    found = {r.node: r.component for r in connected_components(simhash.near_links(df, tile=16, hot=hot)).collect()}
    want = components(fps, ids)
    assert {i: found.get(i, i) for i in want} == want


def test_bands_cover_radius():
    rng = random.Random(7)
    for total in (1000, 10**6, 10**9, 10**12):
        parts = simhash.bands(total, 3)
        for _ in range(200):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), 3):
                y ^= 1 << b
            assert any(all((x ^ y) >> s & ((1 << w) - 1) == 0 for s, w in ranges) for ranges in parts)


def test_rows(spark):
    rows = [(3, "a b c d", "x"), (2, "A B c d", "y"), (9, None, "z"), (8, "", "z"), (None, "", "z"), (None, "only one without an id here", "z"), (3, "a b c d", "x"), (1, " ".join(f"w{i}" for i in range(40_000)), "long")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    want = {3: 2, 2: 2, 9: 8, 8: 8, 1: 1}
    assert len(got) == len(rows)
    assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    assert sorted((r.component_id is None, r.component_id) for r in got if r.doc_id is None) == [(False, 8), (True, None)]
    assert simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string").limit(0)).count() == 0
    assert connected_components(spark.createDataFrame([(1, 1), (2, None)], "a long, b long")).count() == 0


def test_keep_one_without_or_with_repeated_ids(spark):
    texts = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "abcdefg"}
    rows = [(None, texts["a"], "x"), (None, texts["a"], "y"), (None, texts["b"], "x"), (7, texts["c"], "x"), (7, texts["d"], "x"), (7, texts["c"], "x"), (3, texts["d"], "x"), (None, texts["e"], "x"), (9, texts["e"], "x"), (1, texts["f"], "x"), (None, texts["g"], "x"), (None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ha string")
    got = sorted((tuple(r) for r in simhash.keep_one(df).collect()), key=repr)
    assert sorted((r[:2] for r in got), key=repr) == sorted([(None, texts["a"]), (None, texts["b"]), (7, texts["c"]), (3, texts["d"]), (9, texts["e"]), (1, texts["f"]), (None, texts["g"]), (None, None)], key=repr)
    for parts in (1, 5):
        again = simhash.keep_one(df.orderBy(F.desc("ha")).repartition(parts))
        assert again.columns == df.columns and sorted((tuple(r) for r in again.collect()), key=repr) == got
