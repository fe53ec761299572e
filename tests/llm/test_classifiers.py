import random
import zlib

from luxflow.llm import langid, toxicity

from test_pipeline import EN, FR, words


def test_codewords_are_apart():
    for n in (1, 2, 3, 4, 7, 12, 40):
        code = langid.codewords(n)
        assert code.shape[0] == n
        assert len({tuple(r) for r in code.tolist()}) == n


def test_languages_held_out(spark):
    rng = random.Random(1)
    stems = {"en": EN, "fr": FR, "de": ["sch", "ung", "keit", "ß", "ü", "ein", "pf", "tz"]}
    rows = [(i, words(rng, stems[c], rng.randrange(5, 100)), c, "de" if i % 3 else "fr") for i in range(600) for c in [rng.choice(list(stems))]]
    rows += [(1000, None, "en", "x"), (1001, "12 !?", "en", "x"), (1002, "", None, "x"), (None, rows[0][1], None, "x"), (1003, rows[1][1] * 300, rows[1][2], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = langid.identify(df, sample=300).collect()
    want = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == want[r.doc_id] for r in held) / len(held) > 0.95
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (1000, 1001, 1002)} == {i: ("und", 0.0) for i in (1000, 1001, 1002)}
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(rows)
    assert langid.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(df.where("lang IS NULL")).collect()} == {"und"}


def test_toxic_held_out(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(1500):
        bad = rng.random() < 0.2
        t = words(rng, EN, rng.randrange(5, 60)).split()
        for _ in range(3 if bad else 0):
            t.insert(rng.randrange(len(t)), rng.choice(["Grobnik", "zuvvle", "krask!"]))
        rows.append((i, " ".join(t), "en"))
        if rng.random() < 0.6:
            labels.append((i, 0, int(bad)))
    rows += [(2000, None, "en"), (2001, "", "en"), (None, "Grobnik krask", "en")]
    labels += [(None, 0, 1), (2000, None, None), (labels[0])]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(d, lab).collect()}
    truth = {r[0]: any(w in r[1] for w in ("Grobnik", "zuvvle", "krask!")) for r in rows[:1500]}
    held = [i for i in truth if got[i].held_out]
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert got[2000].score == got[2001].score
    assert toxicity.score(d.limit(0), lab).count() == 0
    assert {r.score for r in toxicity.score(d, lab.limit(0)).collect()} == {0.0}


def test_toxic_sample_of_repeated_ids_is_bounded(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(1, f"Grobnik {words(rng, EN, 6)} {i}") for i in range(400)] + [(i, words(rng, EN, 8)) for i in range(10, 310)]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 1)] + [(i, int(i % 7 == 0)) for i in range(10, 310)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity.ToxicityModel, "fit", classmethod(lambda cls, toxic, plain, prior: seen.append([x.tolist() for x in toxic])))
    for parts in (1, 6):
        try:
            toxicity.train(d.repartition(parts), lab)
        except AttributeError:  # there is no model to calibrate
            pass
    assert len(seen[0]) <= 1 + sum(i % 7 == 0 for i in range(10, 310))
    assert seen[0] == seen[1]


def test_more_languages_than_a_short_list(spark):
    """Every language has its share of the sample, however many there are, and which comes last in the alphabet makes no difference."""
    rng = random.Random(11)
    stems = {f"l{k:02d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(6)] for k in range(30)}
    rows = [(100 * k + i, words(rng, stems[lang], 30), lang) for k, lang in enumerate(stems) for i in range(40)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=600).collect()}
    held = [(i, lang) for i, _, lang in rows if got[i].held_out]
    assert sum(got[i].lang_pred == lang for i, lang in held) / len(held) > 0.9


def test_labels_that_contradict(spark):
    """A label is toxic if any row of its id says so, and a text's words beyond the bound are not learnt from."""
    rng = random.Random(12)
    rows = [(i, ("Grobnik " if i % 4 == 0 else "") + words(rng, EN, 30)) for i in range(600)]
    lab = [(i, int(i % 4 == 0)) for i in range(400)] + [(i, 0) for i in range(0, 400, 8)]
    d, both = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(lab, "doc_id long, toxic int")
    once = spark.createDataFrame(lab[:400], "doc_id long, toxic int")
    scores = [sorted((r.doc_id, r.score) for r in toxicity.score(d, x).collect()) for x in (both, once)]
    assert scores[0] == scores[1]
    assert len(toxicity.score(d, once, words=3).collect()) == 600
