import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from luxflow.llm import suffix_dedup


def brute(rows, window):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(x[i : i + window] for x in data for i in range(len(x) - window + 1))
    out = []
    for (d, _), x in zip(rows, data, strict=True):
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - window + 1):
            if seen[x[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        out.append((d if d is not None else -1, len(x), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(window, seed=2):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passages = [text(n) for n in (window // 2, window, window + 1, 2 * window, 5 * window)]
    rows = []
    for i in range(150):
        parts = [text(rng.randrange(0, 2 * window))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            parts += [p[rng.randrange(0, 4) : len(p) - rng.randrange(0, 4)], text(rng.randrange(0, window))]
        rows.append((i, "".join(parts)))
    for i in range(40):
        x = list(rows[i][1] or "z")
        x[rng.randrange(len(x)) if x else 0] = "#"
        rows.append((1000 + i, "".join(x)))
    rows += [(2000 + i, rows[i][1]) for i in range(30)]
    rows += [(3000, "a" * window), (3001, "a" * (window + 1)), (3002, "ab" * window), (3003, None), (3004, ""), (3005, "b" * 9 * window), (3005, "b" * 9 * window), (None, passages[3]), (None, "c" * (window - 1)), (3006, "c" * (window - 1))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{"window": 20, "gram": 5}, {"window": 41, "gram": 10, "block": 300}, {"window": 24, "gram": 6, "hot": 3}, {"window": 400, "gram": 100}, {"window": 17, "gram": 3}])
def test_against_brute_force(spark, options):
    rows = corpus(options["window"])
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, n_bytes int").repartition(5)
    got = [(r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.dedup(df, **options).collect()]
    assert sorted(got) == brute(rows, options["window"])


@pytest.mark.parametrize("window", [14, 15, 17, 18, 19, 20, 21, 22, 24, 31, 45, 59, 61])
def test_blocks_are_sorted_suffixes(window):
    rng = random.Random(window)
    texts = ["".join(rng.choice("ab") for _ in range(window + rng.randrange(0, 9))).encode() for _ in range(120)] + [b"a" * (window + 5)] * 2
    anchor = np.array([rng.randrange(0, 6) for _ in texts])
    bucket = np.array([rng.randrange(0, 3) for _ in texts])
    order, heads = suffix_dedup.sorted_classes(texts, anchor, bucket, window)
    own = [(int(b), int(a) - i, t[i : i + window]) for t, a, b in zip(texts, anchor, bucket, strict=True) for i in range(len(t) - window + 1)]
    got = [own[i] for i in order.tolist()]
    assert [i == 0 or got[i] != got[i - 1] for i in range(len(got))] == heads.tolist()
    assert len(set(own)) == int(heads.sum())


def test_empty(spark):
    assert suffix_dedup.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def thue_morse(a, b, n):
    out = a + b
    while len(out) < n:
        out += out.translate(bytes.maketrans(a + b, b + a))
    return out[:n]


def test_texts_that_collide_in_polynomial_hashes_stay(spark):
    """Thue-Morse patterns and their swaps have equal polynomial hashes modulo 2^64 for any base."""
    rng = random.Random(5)
    middle = bytes(rng.choice(b"abcdefgh") for _ in range(64))
    one, two = thue_morse(b"-", b"Y", 256), thue_morse(b"Y", b"-", 256)
    rows = [(0, (one + middle + one).decode()), (1, (two + middle + two).decode())]
    got = suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed) for r in got} == {0: (576, 0), 1: (576, 0)}


def test_very_long_text(spark):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh ") for _ in range(600_000))
    rows = [(0, long), (1, "x" * 300 + long[250_000:250_700] + "y" * 300), (2, long[:399])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (600_000, 700, 1), 1: (1300, 700, 1), 2: (399, 0, 0)}


def brute_clean(rows, window, words):
    """Rows that stay, with the bytes left: without strings of `window` bytes and passages of `words` words that recur."""
    data = [(t or "").encode() for _, t in rows]
    found = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", x)] for x in data]
    strings = Counter(x[i : i + window] for x in data for i in range(len(x) - window + 1))
    passages = Counter(tuple(x[a:b] for a, b in f[i : i + words]) for x, f in zip(data, found, strict=True) for i in range(len(f) - words + 1))
    out = []
    for (d, t), x, f in zip(rows, data, found, strict=True):
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - window + 1):
            if strings[x[i : i + window]] > 1:
                gone[i : i + window] = True
        covered = {j for i in range(len(f) - words + 1) if passages[tuple(x[a:b] for a, b in f[i : i + words])] > 1 for j in range(i, i + words)}
        for j in covered:
            gone[f[j][0] : f[j + 1][0] if j + 1 in covered else f[j][1]] = True
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g).decode("utf-8", "ignore")
        if not gone.any() or kept.strip():
            out.append((d if d is not None else -1, kept if gone.any() else t))
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{"window": 60, "gram": 12, "words": 9}, {"window": 60, "gram": 12, "words": 9, "block": 300}, {"window": 41, "gram": 10, "words": 8, "hot": 3}, {"window": 400, "gram": 64, "words": 50}])
def test_passages_of_words_against_brute_force(spark, options):
    rng = random.Random(options["words"])
    text = lambda n: "".join(rng.choice(["ab", "c", "dé", "the", "of"]) + rng.choice([" ", " ", "\n", "  "]) for _ in range(n))
    respaced = lambda t: re.sub(r"\s+", lambda m: rng.choice([" ", "\t", "\n\n"]), t)
    words = options["words"]
    passages = [text(n) for n in (words - 1, words, words + 1, 2 * words)]
    rows = [(i, text(rng.randrange(1, 2 * words)) + respaced(rng.choice(passages)) + text(rng.randrange(0, words))) for i in range(80)]
    rows += [(100 + i, passages[i]) for i in range(4)] + [(200, "  " + passages[3] + " " + passages[2]), (201, rows[3][1]), (202, "x " * 3 * words), (203, "y" * 900), (204, None), (205, " "), (205, " "), (None, passages[1]), (206, text(words)), (207, rows[4][1])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, words int").repartition(3)
    got = [(r.doc_id if r.doc_id is not None else -1, r.text) for r in suffix_dedup.clean(df, **options).collect()]
    assert sorted(got, key=repr) == brute_clean(rows, options["window"], words)
