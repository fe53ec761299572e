import hashlib
import random
import re

import pytest

from luxflow.llm import substring_dedup


def brute(rows, window):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, 1 << 70), d if d is not None else 1 << 64)
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < (d if d is not None else 1 << 64):
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d if d is not None else -1, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(60)] + ["the", "of", "a"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passages = [text(n) for n in (13, 14, 20, 40, 12)]
    rows = []
    for i in range(150):
        parts = [text(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(passages), text(rng.randrange(0, 30))]
        rows.append((i * 3, rng.choice([" ", "\n", "  "]).join(parts)))
    rows += [(1000 + i, rows[i][1]) for i in range(30)]
    for i in range(30, 60):
        w = rows[i][1].split()
        if w:
            w[rng.randrange(len(w))] = "changed"
        rows.append((i * 3 + 1, " ".join(w)))
    rows += [(5, "x " * 300), (6, "x " * 40), (6, "x " * 40), (7, None), (8, ""), (9, "a b c"), (10, "a b c"), (None, rows[0][1]), (None, "q " * 30), (None, "q " * 30), (11, rows[1][1] + "\x0b" + rows[2][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"block": 400}, {"hot": 3}])
def test_against_brute_force(spark, options):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, h int").repartition(5)
    got = [(r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in substring_dedup.dedup(df, **options).collect()]
    assert sorted(got) == brute(rows, 13)


def test_empty(spark):
    assert substring_dedup.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
