import random

import pytest

from luxflow.llm import recurrence, substring_dedup, suffix_dedup


@pytest.mark.parametrize(("method", "phrase"), [(substring_dedup, 6), (suffix_dedup, 18)])
def test_a_common_phrase_sends_nothing(spark, monkeypatch, method, phrase):
    """An anchor that recurs without half a window beside it has no window that recurs."""
    held = {}

    def written(df, name):
        made = real(df, name)
        held.setdefault(name, []).append(made.count())
        return made

    real = recurrence.written
    monkeypatch.setattr(recurrence, "written", written)
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(n))
    phrase = words(phrase)
    rows = [(i, f"{words(60)} {phrase} {words(60)}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert method.dedup(docs).where("n_removed > 0").count() == 0
    assert sum(held["places"]) <= 5
    shared = words(60)  # more than a window, in words and in bytes
    held.clear()
    docs = spark.createDataFrame([*rows, (1000, shared + " x"), (1001, "y " + shared)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in method.dedup(docs).where("n_removed > 0").collect()}
    assert got == ({1001: 60} if method is substring_dedup else {1000: len(shared), 1001: len(shared)})
    assert 2 <= sum(held["places"]) <= 40
