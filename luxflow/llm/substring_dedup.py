"""Removal of word passages that occur in an earlier document, by automata of repeated phrases.

Recurring 13-word windows are confirmed bucket by bucket, compiled into Aho-Corasick
automata, one shard per block of buckets, and the text round every anchor that recurs,
of all documents, is streamed through its shard to find each occurrence.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import thrifty
from .recurrence import Units, affected, blocks, decided, joined_words, key_bits, keyed_texts, merged, split_by, spread, window_runs, word_units

WINDOW, GRAM, HOT, BLOCK = 13, 4, 4_000, 1_000_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)

#: Words from one gram of a window to the next, and characters of a gram in the automata.
STRIDE, LETTERS = 3, 3


def _grams(words: np.ndarray, width: int) -> np.ndarray:
    """The number of the `width` words from each place on; equal words, and only they, have equal numbers."""
    out, done = words, 1
    while done < width:
        step = min(done, width - done)
        out = np.unique(out[:-step] << 32 | out[step:], return_inverse=True)[1]
        done += step
    return out


def _coded(symbols: np.ndarray) -> str:
    """LETTERS characters for each number, of an alphabet of their own each, so that matches start at symbols; -1: a separator."""
    base = 2
    while base**LETTERS <= int(symbols.max(initial=0)):
        base += 1
    out, rest = np.empty((len(symbols), LETTERS), "<u4"), symbols
    for k in range(LETTERS):
        out[:, k], rest = 0x100 + k * base + rest % base, rest // base
    out[symbols < 0] = 0x10FFFF
    return out.tobytes().decode("utf-32-le")


def first_docs(texts: list[bytes], docs: np.ndarray, several: np.ndarray, window: int) -> np.ndarray:
    """Per window of each text (words joined by spaces), one after another: the smallest of docs among the texts that hold it.

    several: the text is in more than one document. Windows that don't recur get their own text's.
    The automaton reads a window as the few word grams, STRIDE words apart, that just cover
    it; a text is as many streams of grams as there are words in a stride.
    """
    number: dict[bytes, int] = defaultdict(count().__next__)
    split = [t.split(b" ") for t in texts]
    size = np.fromiter(map(len, split), np.int64, len(split))
    words = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(size.sum()))
    stride = min(STRIDE, window)
    length = window // stride
    width = window - stride * (length - 1)
    gram = _grams(words, width)
    begin, grams, windows = np.cumsum(size) - size, size - width + 1, size - window + 1
    own, local = spread(np.arange(len(texts)), grams)
    of = gram[begin[own] + local]
    phase = local % stride
    at = (np.cumsum(grams + stride) - grams - stride)[own] + phase * (grams // stride)[own] + np.minimum(phase, (grams % stride)[own]) + phase + local // stride
    stream = np.full(int((grams + stride).sum()), -1, np.int64)  # a separator after each phase of each text
    stream[at] = of
    place = at[local < windows[own]]
    own = np.repeat(np.arange(len(texts)), windows)
    with np.errstate(over="ignore"):
        mixed = np.zeros(len(place), np.uint64)
        for j in range(length):
            mixed = (mixed + stream[place + j].astype(np.uint64) + np.uint64(1)) * _FACTOR
            mixed ^= mixed >> np.uint64(31)
    _, one, group, times = np.unique(mixed, return_index=True, return_inverse=True, return_counts=True)
    confirmed = times > 1
    confirmed[group[several[own]]] = True
    phrases = place[one[confirmed]]
    out = docs[own].copy()
    if not len(phrases):
        return out
    used = np.unique(stream[phrases[:, None] + np.arange(length)])
    rank = np.searchsorted(used, stream)
    met = used[np.minimum(rank, len(used) - 1)] == stream
    text = _coded(np.where(met, rank, -1))  # a gram that no phrase has separates, too
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, p in enumerate((phrases * LETTERS).tolist()):
        automaton.add_word(text[p : p + LETTERS * length], i)
    automaton.make_automaton()
    hits = np.fromiter((end << 32 | phrase for end, phrase in automaton.iter(text)), np.int64)
    where, phrase = (hits >> 32) // LETTERS - length + 1, hits & 0xFFFFFFFF
    row = np.full(len(stream), -1, np.int64)
    row[place] = np.arange(len(place))
    found = row[where]
    least = np.full(len(phrases), np.iinfo(np.int64).max)
    np.minimum.at(least, phrase, docs[own[found]])
    out[found] = least[phrase]
    return out


def _found(window: int, limit: int):
    """Per context, its runs of windows that a document of smaller id than its largest has, and that id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit):
            count = np.fromiter((t.count(b" ") + 1 for t in block.text), np.int64, len(block.text)) - window + 1
            first = first_docs(block.text, block.least, block.least < block.most, window)
            own, a, b, doc = window_runs(first < np.repeat(block.most, count), first, count, window)
            yield block.batch(own, a, b, doc)

    return run


def _left(text: str | None, copy: bool, spans: list[dict] | None, window: int) -> tuple[int, int, bytes]:
    """Words, words that go, and those left, joined."""
    joined = joined_words(text or "")
    n = joined.count(b" ") + 1 if joined else 0
    if copy and n >= window:
        return n, n, b""
    if not spans:
        return n, 0, joined
    words = joined.split(b" ")
    for s, e in reversed(merged([(x["start"], x["end"]) for x in spans])):
        del words[s:e]
    return n, n - len(words), b" ".join(words)


SCHEMA = "doc_id long, n_words long, n_removed long, kept binary"


def _batch(ids: pa.Array, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([ids, pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_removed, kept), one row per input row; kept: the words left, joined by one space, as UTF-8.

    Each word in a window of `window` words that also starts in a document of smaller
    doc_id goes. Of documents with one text, all but that of the smallest id have all
    their windows in it; texts of fewer words than a window stay. A null doc_id counts
    as larger than any other. Of an anchor with over `hot` contexts each window has an
    automaton's bucket of its own.
    """
    units = Units(word_units, window, gram)
    texts = keyed_texts(docs)
    spans = decided(texts, units, hot, _found(window, block)).where("before < doc").drop("before")
    changed = affected(texts, spans, per_doc=True)
    keys = key_bits(changed)

    def whole(rows: pa.RecordBatch) -> pa.RecordBatch:
        return _batch(rows.column("doc_id"), [_left(t, False, None, window) for t in rows.column("text").to_pylist()])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            columns = (rows.column(c).to_pylist() for c in ("text", "copy", "spans"))
            yield _batch(rows.column("doc_id"), [_left(t, bool(c), s, window) for t, c, s in zip(*columns, strict=True)])

    copy = F.when(F.col("doc_id").isNull(), F.col("least").isNotNull()).otherwise(F.col("doc_id") > F.col("least"))
    rest = split_by(texts, keys, texts.schema, None).join(changed, "key", "left").select("doc_id", copy.alias("copy"), "spans", "text")
    return split_by(texts, keys, SCHEMA, whole).unionAll(rest.mapInArrow(thrifty(cut), SCHEMA))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of dedup."""
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
