"""Removal of byte strings that occur more than once, by blockwise suffix sorting with a difference cover.

The suffixes to sort are the windows of recurring anchors; a bucket holds those of one
anchor, and a block of buckets is sorted at a time. Long ties are never compared byte
by byte: suffixes at the places of a difference cover of period 7 get ranks first, by
doubling, and any suffix is ordered by the few bytes up to its next covered place, the
rank there, and the few bytes after it. Memory is that of one block.

clean can remove passages of words that occur more than once, too, whatever their number
of bytes: there the suffixes begin at words, and get their ranks by doubling.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import thrifty
from .recurrence import Units, affected, blocks, byte_units, decided, key_bits, keyed_texts, merged, split_by, spread, window_runs, word_units

WINDOW, GRAM, HOT, BLOCK = 400, 64, 4_000, 1_000_000

#: Every difference modulo 7 is one of two of these.
PERIOD, COVER = 7, (0, 1, 3)

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _ranks(values: np.ndarray) -> np.ndarray:
    """Each value's place among the distinct values."""
    order = np.argsort(values)
    ordered = values[order]
    out = np.empty(len(values), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
    return out


def sorted_classes(texts: list[bytes], anchor: np.ndarray, bucket: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of texts that have at least `window` bytes, one text after another, sorted by bucket, distance to the anchor and their first `window` bytes: their order, and which begin a class of equals.

    anchor: the place of the bucket's anchor in each text, from which the cover is
    counted; only suffixes equally far from their anchors can be equal.
    """
    if window < 2 * PERIOD or window % PERIOD == 2:  # nine bytes would be left beside the covered ones
        raise ValueError("window must be 14 or more, and not 2 modulo 7")
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts) + bytes(16), np.uint8)
    n = int(size.sum())
    begin = np.cumsum(size) - size
    eight = np.zeros(n + 8, np.uint64)  # eight bytes from each place on, first byte highest
    for k in range(8):
        eight = eight << np.uint64(8) | data[k : k + n + 8]
    place = np.arange(n)
    phase = ((place - np.repeat(begin + anchor, size)) % PERIOD).astype(np.int8)
    covered = np.isin(phase, COVER)
    cover = place[covered]
    number = np.zeros(n, np.int64)
    number[covered] = np.arange(len(cover))
    rank, length = _ranks(eight[cover] >> np.uint64(8)), PERIOD  # of the first `length` bytes from each covered place on

    def joined(step: int) -> np.ndarray:
        return _ranks(rank << 32 | rank[number[np.minimum(cover + step, n - 1)]])

    whole = (window - max(COVER)) // PERIOD * PERIOD  # covered bytes of a window, wherever its first covered place is
    while 2 * length <= whole:
        rank, length = joined(length), 2 * length
    if length < whole:
        rank = joined(whole - length)
    count = size - window + 1
    own = np.repeat(np.arange(len(texts)), count)
    start = np.repeat(begin, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    ahead = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])[phase[start]]
    bits = (8 * ahead).astype(np.uint64)
    rest = window - whole  # bytes before the covered place and after the covered bytes: eight at most
    after = eight[start + ahead + whole] >> np.uint64(64 - 8 * rest) << np.uint64(64 - 8 * rest) if rest < 8 else eight[start + ahead + whole]
    lead = np.where(ahead > 0, eight[start] & ~(np.uint64(0xFFFFFFFFFFFFFFFF) >> bits), np.uint64(0))
    edge = lead | (after >> bits) & ~(np.uint64(0xFFFFFFFFFFFFFFFF) >> np.uint64(8 * rest) if rest < 8 else np.uint64(0))
    widest = int(count.max()) + int(np.abs(anchor).max()) + 1
    group = _ranks(bucket[own] * (2 * widest) + (np.repeat(begin + anchor, count) - start) + widest)
    main = group << 32 | rank[number[start + ahead]]
    order = np.lexsort((edge, main))
    main, edge = main[order], edge[order]
    return order, np.concatenate([[True], (main[1:] != main[:-1]) | (edge[1:] != edge[:-1])])


def recurs(texts: list[bytes], anchor: np.ndarray, bucket: np.ndarray, times: np.ndarray, window: int) -> np.ndarray:
    """Per suffix, in the order of the texts: its first `window` bytes are those of another; a text of `times` over 1 is its own copy."""
    order, heads = sorted_classes(texts, anchor, bucket, window)
    if not len(order):
        return np.empty(0, bool)
    own = np.repeat(times, np.fromiter(map(len, texts), np.int64, len(texts)) - window + 1)
    label = np.cumsum(heads) - 1
    total = np.bincount(label, own[order])
    out = np.empty(len(order), bool)
    out[order] = total[label] > 1
    return out


def words_recur(texts: list[bytes], times: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Per suffix of each text (words joined by spaces) that begins at a word and has at least `window` of them, in the order of the texts: its first `window` words are those of another; a text of `times` over 1 is its own copy. Also the number of such suffixes of each text."""
    split = [t.split(b" ") for t in texts]
    size = np.fromiter(map(len, split), np.int64, len(split))
    number = {w: i for i, w in enumerate(sorted(set(chain.from_iterable(split))))}
    rank = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(size.sum()))  # of the first `length` words from each place on
    length = 1
    while length < window:
        step = min(length, window - length)
        rank = _ranks(rank[:-step] << 32 | rank[step:])
        length += step
    count = size - window + 1
    own, local = spread(np.arange(len(texts)), count)
    label = rank[(np.cumsum(size) - size)[own] + local]
    return np.bincount(label, times[own])[label] > 1, count


def _found(window: int, limit: int, words: bool = False):
    """Per context, its runs of windows that occur elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit):
            if words:
                mask, count = words_recur(block.text, block.times, window)
            else:
                count = np.fromiter(map(len, block.text), np.int64, len(block.text)) - window + 1
                mask = recurs(block.text, block.at, block.bucket, block.times, window)
            own, a, b, _ = window_runs(mask, np.zeros(len(mask), np.int8), count, window)
            yield block.batch(own, a, b, None)

    return run


def _byte_spans(data: bytes, spans: list[dict], copies: int, words: int) -> list[tuple[int, int]]:
    """Spans of bytes for spans of bytes and of words."""
    passages = merged([(s["start"], s["end"]) for s in spans if words and s["words"]])
    if not passages and not (words and copies > 1):
        return [(s["start"], s["end"]) for s in spans]
    found = [m.span() for m in _WORD.finditer(data)]
    if copies > 1 and len(found) >= words:
        return [(0, len(data))]
    return [(s["start"], s["end"]) for s in spans if not s["words"]] + [(found[a][0], found[b - 1][1]) for a, b in passages]


def _left(text: str | None, copies: int, spans: list[dict] | None, window: int, words: int = 0) -> tuple[int, int, int, bytes]:
    """Bytes, bytes that go, runs that go, and the bytes left; with words, white space alone isn't left."""
    data = (text or "").encode("utf-8", "surrogatepass")
    gone = [(0, len(data))] if copies > 1 and len(data) >= window else merged(_byte_spans(data, spans or [], copies, words))
    parts, at = [], 0
    for a, b in gone:
        parts.append(data[at:a])
        at = b
    kept = b"".join([*parts, data[at:]])
    if words and gone and not kept.strip():
        gone, kept = [(0, len(data))], b""
    return len(data), len(data) - len(kept), len(gone), kept


def _changed(texts: DataFrame, window: int, gram: int, hot: int, block: int, words: int = 0) -> DataFrame:
    """(key, copies, spans) of the texts that lose bytes; with words, a span also tells whether it counts words."""
    spans = decided(texts, Units(byte_units, window, gram), hot, _found(window, block)).select("key", "start", "end")
    if words:
        passages = decided(texts, Units(word_units, words, max(words // 6, 1)), hot, _found(words, block, words=True)).select("key", "start", "end")
        spans = spans.withColumn("words", F.lit(False)).unionAll(passages.withColumn("words", F.lit(True)))
    return affected(texts, spans, per_doc=False).select("key", "copies", "spans")


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _batch(ids: pa.Array, rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    return pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept), one row per input row; kept: the bytes left.

    Each byte in a string of `window` bytes of one document that also starts elsewhere,
    in it or another, goes; all occurrences do. n_spans: maximal removed runs. Null texts
    are empty; of texts that occur as they are in several rows all bytes go, unless
    shorter than window. window is 14 at least, and not 2 modulo 7. Of an anchor with
    over `hot` contexts each window is sorted in a bucket of its own.
    """
    texts = keyed_texts(docs)
    changed = _changed(texts, window, gram, hot, block)
    keys = key_bits(changed)

    def whole(rows: pa.RecordBatch) -> pa.RecordBatch:
        return _batch(rows.column("doc_id"), [_left(t, 1, None, window) for t in rows.column("text").to_pylist()])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            columns = (rows.column(c).to_pylist() for c in ("text", "copies", "spans"))
            yield _batch(rows.column("doc_id"), [_left(t, c or 1, s, window) for t, c, s in zip(*columns, strict=True)])

    rest = split_by(texts, keys, texts.schema, None).join(changed, "key", "left").select("doc_id", "copies", "spans", "text")
    return split_by(texts, keys, SCHEMA, whole).unionAll(rest.mapInArrow(thrifty(cut), SCHEMA))


def clean(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, block: int = BLOCK, words: int = 0) -> DataFrame:
    """docs, in their own columns, without the bytes that dedup removes; rows that lose their whole text go. Halves of characters at a cut go too.

    With words, each passage of so many words (runs of other than white space) that also
    starts elsewhere goes as well, whatever white space is between them, and the white
    space between words that go; both are judged on the input. Texts that occur as they are
    in several rows go from that many words on.
    """
    texts = keyed_texts(docs)
    changed = _changed(texts, window, gram, hot, block, words)
    keys = key_bits(changed)
    columns, at = docs.columns, docs.columns.index("text")
    text = F.coalesce(docs["text"], F.lit(""))
    tagged = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.unhex(F.md5(text.cast("binary"))).alias("key"))

    def whole(rows: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rows.column(f"c{i}") for i in range(len(columns))], columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = [], []
            for i, (text, copies, spans) in enumerate(zip(*(batch.column(c).to_pylist() for c in (f"c{at}", "copies", "spans")), strict=True)):
                _, gone, _, kept = _left(text, copies or 1, spans, window, words)
                left = kept.decode("utf-8", "ignore") if gone else text
                if left or not text:
                    texts.append(left)
                    rows.append(i)
            held = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else held.column(f"c{i}") for i in range(len(columns))], columns)

    rest = split_by(tagged, keys, tagged.schema, None).join(changed, "key", "left").select(*[f"c{i}" for i in range(len(columns))], "copies", "spans")
    return split_by(tagged, keys, docs.schema, whole).unionAll(rest.mapInArrow(thrifty(cut), docs.schema))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of dedup."""
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
