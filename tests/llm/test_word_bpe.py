import random

import public_tokenizers

from luxflow.llm.common import WordCache
from luxflow.llm.word_bpe import WordBpe

PATH = public_tokenizers.path("word_bpe_49k.json")


class Counting:
    """A tokenizer that counts the texts sent to it."""

    def __init__(self, of):
        self.of, self.sent = of, 0

    def encode_batch_fast(self, texts, **options):
        self.sent += len(texts)
        return self.of.encode_batch_fast(texts, **options)


def test_new_words_go_to_the_library_in_one_text():
    coder = WordBpe(PATH)
    held = {name: Counting(x) for name, x in vars(coder).items() if hasattr(x, "encode_batch_fast")}
    vars(coder).update(held)
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefgé", k=6)) for _ in range(200)) + ", and so on." for _ in range(10)]
    got = coder.encode_raw(texts)
    assert sum(x.sent for x in held.values()) <= 2
    assert got == WordBpe(PATH)._library(texts)


def test_any_text_equals_the_library():
    coder = WordBpe(PATH)
    rng = random.Random(1)
    parts = ["'s", "'", "'LL", "a", "B", "é", "İ", "ı", "ǅ", "1", "½", "ª", "\xa0", "\x85", "\x1c", "́", " ", " ", "\n", "...", ".", ",", "(", "-", "<|endoftext|>", "!", "ß", "\xad", "µ", "日", "\x00", "’s", "Ω", "ŉ"]
    for some in (parts, [p for p in parts if p.isascii() and p.isprintable()], [p for p in parts if not coder.odd(p)]):
        texts = ["".join(rng.choices(some, k=rng.randrange(0, 14))) for _ in range(5000)]
        assert coder.encode_raw(texts) == coder._library(texts)


def test_what_is_missing_is_found_without_a_walk_through_the_cache():
    class Walked(WordCache):
        walks = 0

        def keys(self):
            self.walks += 1
            return super().keys()

        def __iter__(self):
            self.walks += 1
            return super().__iter__()

    cache = Walked(1 << 20)
    cache.add(["a", "b"], [b"1", b"2"])
    cache.trim()
    cache.older = {"c": b"3"}
    assert sorted(cache.missing({"a", "c", "d"})) == ["d"]
    assert cache.walks == 0 and cache["c"] == b"3"
