import random

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from luxflow.llm.sentencepiece_codec import Codec, digests

PATH = public_tokenizers.path("piece_bpe_32k.model")
CODEC = Codec(PATH)
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(texts):
    for text, ids in zip(texts, CODEC.encode(texts), strict=True):
        want = SP.encode(text, add_bos=True, add_eos=True)
        assert ids.tolist() == want, repr(text)
        assert CODEC.decode(want) == SP.decode(want), repr(text)


def test_edges():
    same(["", " ", "  ", "\n", "a", " a", "a ", "a\n\n b", "▁a▁▁b", "\x00", "<s></s><unk><0x0A>", "a" * 3000, " " * 1001, "ab" * 700, "=" * 513, "x \t y\r\n", "日本語のテキスト", "🙂🙃", "é é ﬁ İ", "aaaabaaabaab" * 40, "1234567890" * 30])


def test_random_runs():
    rng = random.Random(3)
    same(["".join(rng.choice("ab tehin.\n ,-=é") for _ in range(rng.randrange(1, 300))) for _ in range(400)])
    same(["".join(rng.choice("abt") for _ in range(rng.randrange(1, 400))) for _ in range(200)])
    same(["".join(rng.choice(" =-_*#") for _ in range(rng.randrange(1, 200))) for _ in range(200)])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    same([text])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 700), max_size=30))
def test_decode_any_ids(ids):
    assert CODEC.decode(ids) == SP.decode(ids)


def test_query_rows(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "He said so", "z")], "doc_id long, text string, n_tokens string")
    got = digests(rows, PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, len(SP.encode("He said so")) + 2), (1, 2), (2, 2), (2, 2)]
    assert digests(rows.limit(0), PATH).count() == 0
