import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from luxflow.llm.packing import packed, plan
from luxflow.llm.word_bpe import WordBpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def used(made):
    out = Counter()
    for lengths, times in made:
        for n in lengths:
            out[n] += times
    return out


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=20))
def test_plan_uses_all_within_limit(counts):
    made = plan(counts, 40)
    assert used(made) == Counter(counts)
    assert all(sum(lengths) <= 40 and times > 0 for lengths, times in made)


def test_plan_is_near_the_bound():
    rng = random.Random(1)
    counts = Counter(min(2048, int(rng.lognormvariate(6.3, 0.9)) + 1) for _ in range(50_000))
    made = plan(counts)
    bound = -(-sum(n * c for n, c in counts.items()) // 2048)
    assert bound <= sum(t for _, t in made) <= bound + 3 + bound // 1000


def test_words_as_the_library():
    lib = Tokenizer.from_file(PATH)
    lib.encode_special_tokens = True
    rng = random.Random(2)
    alphabet = "abTHé ÉßſǅȺ'sdlve.,!?12²¼ª_\n\t \u0085\x1c​<|endoftext|>ÀẞİΣ日🙂́"
    texts = ["", " ", "It's WE'LL 's ''s", "<|endoftext|> <|startoftext|>", "x" * 5000, *("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(1500))]
    texts += ["".join(rng.choice(alphabet[:30]) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    coder = WordBpe(PATH, cache=100)
    for i in range(0, len(texts), 50):
        for t, raw in zip(texts[i : i + 50], coder.encode_raw(texts[i : i + 50]), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_packed(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["the", "cat", "sat", "o'clock", "zzyzx"]) for _ in range(rng.randrange(0, 200))), 7) for i in range(300)]
    docs += [(900, "word " * 5000, 1), (901, None, 2), (902, "", 3), (902, "", 3), (None, "null id", 4)]
    rows = packed(spark.createDataFrame(docs, "doc_id long, text string, length int"), PATH, 256).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // 256) + 2
    long = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 900)
    assert long == [(k, k * 256, min(256, 5001 - k * 256)) for k in range(20)]
    assert sorted(r.length for r in rows if r.doc_id in (901, 902)) == [1, 1, 1]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packed(empty, PATH).count() == 0
