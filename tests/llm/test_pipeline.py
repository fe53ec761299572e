import random
from collections import defaultdict

import corpus_pipeline
from luxflow.llm import langid, simhash, suffix_dedup


def words(rng, stems, n):
    return " ".join(rng.choice(stems) + rng.choice(stems) for _ in range(n)).capitalize() + "."


EN, FR = ["the", "ing", "and", "shr", "ould", "ough", "wh", "ed"], ["eau", "que", "oir", "elle", "ç", "é", "ment", "oux"]


def documents(rng):
    rows = [(i, words(rng, EN if i % 2 else FR, 150), "en" if i % 2 else "fr", "s", 0) for i in range(200)]
    shared = words(rng, EN, 100)
    for i in range(3):
        rows.append((300 + i, words(rng, EN, 120) + "\n" + shared + "\n" + words(rng, EN, 120), "en", "s", 0))
    rows += [(400 + i, rows[i][1], rows[i][2], "s", 0) for i in range(20)]
    rows.append((500, rows[5][1].replace("the", "teh", 1), "en", "s", 0))
    rows += [(600, "1234 5678 !!", "en", "s", 0), (601, "", "en", "s", 0), (602, None, None, None, None)]
    rows.append((700, words(rng, FR, 80) + " bob@example.com " + words(rng, FR, 80), "fr", "s", 0))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    rng = random.Random(6)
    rows = documents(rng)
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    by_id = {r[0]: r for r in rows}
    held = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = corpus_pipeline.written(stage(spark, held, str(tmp_path)), name)
        assert held.columns == docs.columns
        kept[name] = {r.doc_id: r.text for r in held.collect()}
    assert set(by_id) - set(kept["language_id"]) == {600, 601, 602}
    found = defaultdict(set)
    for r in simhash.near_duplicates(spark.createDataFrame([by_id[i] for i in kept["language_id"]], SCHEMA)).collect():
        found[r.component_id].add(r.doc_id)
    assert set(kept["simhash_near_dedup"]) == set(found)
    assert not {400, 401, 419, 500} & set(kept["simhash_near_dedup"])
    shared = by_id[300][1].split("\n")[1]
    assert all(shared[50:-50] not in t for t in kept["suffix_array_dedup"].values())
    assert all(kept["suffix_array_dedup"][i] == by_id[i][1] for i in range(200) if i in kept["simhash_near_dedup"])
    assert "<EMAIL>" in kept["pii"][700] and "@" not in kept["pii"][700]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept["pii"])


def test_short_passages_of_many_words(spark):
    """Passages of over 50 words that take fewer than 400 bytes go, those of fewer words stay."""
    rng = random.Random(9)
    long, short = words(rng, ["a", "be", "sea"], 55), words(rng, ["a", "be", "sea"], 45)
    assert len(long) < 400
    rows = [(i, " ".join([words(rng, EN, 80), long.replace(" ", "\n", i), words(rng, EN, 80)]), "en", "s", 0) for i in range(3)]
    rows += [(10 + i, " ".join([words(rng, EN, 80), short, words(rng, EN, 80)]), "en", "s", 0) for i in range(3)]
    stage = dict(corpus_pipeline.STAGES)["suffix_array_dedup"]
    got = {r.doc_id: r for r in stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    for i, text, *_ in rows:
        left = " ".join(got[i].text.split())
        assert left == " ".join(text.split()).replace(long + " ", "") and got[i].n_chars == len(got[i].text)
        assert (short in left) == (i >= 10)


def test_empty_and_clashing_names(spark):
    empty = spark.createDataFrame([], SCHEMA + ", key string, h int, copies int, c0 int, component_id int")
    rows = spark.createDataFrame([(1, "the shed ould", "en", "a", 3, "k", 1, 2, 3, 4), (1, "the shed ould", "en", "a", 3, "k", 1, 2, 3, 4), (None, "x", None, None, None, None, None, None, None, None)], empty.schema)
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, empty, "").collect() == [] and last(spark, rows, "").count() == 3
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, "").collect() == [], name
        got = stage(spark, rows, "")
        assert got.columns == rows.columns, name
        got.collect()
    assert suffix_dedup.clean(rows).count() == 3
    assert langid.identify(rows).count() == 3
