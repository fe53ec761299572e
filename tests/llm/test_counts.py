import random

import numpy as np
import pytest

from luxflow.llm import recurrence, substring_dedup
from luxflow.llm.recurrence import Units, Wanted, byte_units, counted, keyed_texts, word_units


def sides(units, text):
    found = recurrence.anchors(units, [0], [b"k" * 16], [text])
    return np.concatenate([found.left[found.lefts], found.right[found.rights]]).tolist()


@pytest.mark.parametrize(("units", "limit"), [(Units(word_units, 13, 4), 1 << 19), (Units(word_units, 13, 4), 50), (Units(byte_units, 40, 8), 50)])
def test_sides_are_counted_over_distinct_texts(spark, units, limit):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(40)) for _ in range(n))
    shared, own = text(40), text(30)
    texts = [f"{text(40)} {shared} {text(30)}" if i % 3 else text(80) for i in range(30)] + [f"{own} {text(20)} {own}", "", None, "ab " * 60]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 - i, t) for i, t in enumerate(texts)]  # copies are no recurrence
    times = {}
    for t in texts:
        for h in sides(units, t or ""):
            times[h] = times.get(h, 0) + 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [r.h for r in counted(keyed_texts(df), units, Wanted(), limit).collect()]
    assert sorted(got) == sorted(h for h, n in times.items() if n > 1) and got


def test_counts_are_shuffled_in_packs():
    """Not a row for each side of an anchor: that was most of the JVM's work in that step of op9."""
    h = np.random.default_rng(7).integers(-(1 << 63), 1 << 63, 400_000, dtype=np.int64)
    packs = recurrence._packed(np.append(h, h[:1000]), np.arange(401_000))
    assert packs.num_rows <= 1 << recurrence.PART_LOG
    assert sorted(recurrence._again(packs.column("pairs").to_pylist()).column("h").to_pylist()) == sorted(h[:1000].tolist())


@pytest.mark.parametrize("window", [1, 2, 3, 5, 13, 14, 15])
def test_first_docs_of_any_window(window):
    rng = random.Random(window)
    for _ in range(40):
        texts = [b" ".join(rng.choice([b"a", b"b"]) for _ in range(window + rng.randrange(0, 9))) for _ in range(rng.randrange(1, 30))]
        docs = np.array([rng.randrange(50) for _ in texts])
        least = {}
        split = [t.split() for t in texts]
        own = [(tuple(w[i : i + window]), d) for w, d in zip(split, docs.tolist(), strict=True) for i in range(len(w) - window + 1)]
        for k, d in own:
            least[k] = min(least.get(k, 99), d)
        got = substring_dedup.first_docs(texts, docs, np.array([rng.random() < 0.2 for _ in texts]), window)
        assert got.tolist() == [least[k] for k, _ in own]


def test_automata_are_small(monkeypatch):
    """A phrase takes a node for each character: 39 before, of three for each word."""
    rng = random.Random(9)
    passage = [str(rng.randrange(10**5)).encode() for _ in range(60)]
    texts = [b" ".join([b"x%d" % i, *passage]) for i in range(5)]
    sizes = []
    automaton = substring_dedup.ahocorasick.Automaton

    class Watched:
        def __init__(self, *a):
            self.real = automaton(*a)

        def add_word(self, word, i):
            sizes.append(len(word))
            return self.real.add_word(word, i)

        def __getattr__(self, name):
            return getattr(self.real, name)

    monkeypatch.setattr(substring_dedup.ahocorasick, "Automaton", Watched)
    substring_dedup.first_docs(texts, np.arange(5), np.zeros(5, bool), 13)
    assert len(sizes) == 48 and max(sizes) <= 12
