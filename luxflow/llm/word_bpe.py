"""Ids of a word-level BPE of the tokenizers library, each distinct word and run of words without spaces encoded once and held in a bounded cache."""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from itertools import accumulate

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

from .common import WordCache, worker_held

#: Split pattern and normaliser of the vocabulary that the fast way below repeats; other files take the library's way throughout.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: What each character up to U+00FF is: a letter or number, a space, a mark, or (0) a control character.
_KIND = bytes(0 if c < 9 or 13 < c < 32 or 126 < c < 160 else 32 if chr(c).isspace() else 97 if unicodedata.category(chr(c))[0] in "LN" else 44 for c in range(256))
#: Marks that are set apart from words before the split by spaces, where no two marks are neighbours.
_MARKS = tuple('.,;:!?"()-/')

_CHARS = [chr(c) for c in range(0x250)] + sorted({x for c in range(0x250) for x in chr(c).lower() if ord(x) >= 0x250})


class WordBpe:
    """encode_raw(texts): each text's ids, little-endian unsigned 32-bit, without special tokens; their strings in a text are ordinary text.

    Texts of Latin letters up to U+024F without control characters are lower-cased and
    split here; others go to the library whole. Words, which are normal then, skip the
    library's normaliser, and go to it in one text: the last id of each, and no other, is
    of a token that ends words.
    """

    def __init__(self, path: str, cache: int = 96 << 20):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        kinds = [p["type"] for p in (parts["normalizer"] or {}).get("normalizers", [])]
        splits = [p.get("pattern") for p in (parts["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.known = kinds == ["NFC", "Replace", "Lowercase"] and splits == [{"Regex": SPLIT}, None]
        letters, numbers = ("".join(re.escape(c) for c in _CHARS if unicodedata.category(c)[0] == k) for k in "LN")
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\s{letters}{numbers}]+").findall
        self.odd = re.compile("[^\t-\r -~\xa0-ɏ]|İ").search
        self.cache = WordCache(cache)
        suffix = parts["model"].get("end_of_word_suffix")
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if suffix and token.endswith(suffix)]] = True
        self.words = Tokenizer.from_file(path)
        self.words.encode_special_tokens = True
        if self.known:
            self.words.normalizer = None
            self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of each of words that the split has made."""
        ids = np.array(self.words.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.nonzero(self.ends[ids])[0] + 1)).tolist() if len(ids) else []
        if len(ends) != len(words):  # a vocabulary of another kind
            return self._library(words)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _runs(self, text: str) -> list[str] | None:
        """Parts of text between spaces, or words and marks, that can be split one by one; None: the library has to take it whole."""
        if not self.known:
            return None
        try:
            kinds = text.encode("latin-1").translate(_KIND)
        except UnicodeEncodeError:
            return None if self.odd(text) else text.lower().split()
        if b"\0" in kinds:
            return None
        text = text.lower()
        if b",," not in kinds:
            for mark in _MARKS:
                if mark in text:
                    text = text.replace(mark, f" {mark} ")
        return text.split()

    def _learn(self, runs: list[str]) -> None:
        """Puts runs, which hold no space and aren't in the cache, into it."""
        cache = self.cache
        words = [r for r in runs if r.isalpha()]
        split = {r: self.split(r) for r in runs if not r.isalpha()}
        words += cache.missing(set().union(*split.values()).difference(words))
        for i in range(0, len(words), 20_000):
            cache.add(words[i : i + 20_000], self._words(words[i : i + 20_000]))
        several = [r for r, s in split.items() if len(s) > 1]
        cache.add(several, [b"".join(map(cache.__getitem__, split[r])) for r in several])

    def encode_raw(self, texts: list[str]) -> list[bytes]:
        cache, split = self.cache, list(map(self._runs, texts))
        runs = [r for s in split if s for r in s]
        ids = list(map(cache.get, runs))
        new = [i for i, x in enumerate(ids) if x is None]
        self._learn(cache.missing({runs[i] for i in new}))
        for i in new:
            ids[i] = cache[runs[i]]
        other = iter(self._library([t for t, s in zip(texts, split, strict=True) if s is None]))
        ends = list(accumulate(len(s or ()) for s in split))
        out = [next(other) if s is None else b"".join(ids[a:b]) for s, a, b in zip(split, [0, *ends], ends)]
        cache.trim()
        return out


def word_bpe(path: str) -> WordBpe:
    """One per Python worker, so that its tasks share what they have encoded."""
    return worker_held(("word_bpe", path), lambda: WordBpe(path))
