"""Best-fit packing of documents into sequences of bounded length, by exact-complement hashing.

Which lengths share a sequence depends only on how many pieces there are of each
length, a table of at most `limit` rows whatever the input. The plan is made on that
table; pieces then take the plan's places by their rank among pieces of their length.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunked, columns, texts_of, thrifty, written
from .word_bpe import word_bpe

LIMIT = 2048


class Gaps:
    """Which lengths, pairs and triples of lengths fill a gap exactly, under availability counts."""

    def __init__(self, counts: dict[int, int], limit: int):
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.limit = limit
        self._index()

    def _index(self) -> None:
        """Sets of sums as bits: bit s is set if some single length, or pair or triple of lengths, sums to s."""
        mask = (1 << (self.limit + 1)) - 1
        self.lengths = sorted(self.left, reverse=True)
        self.singles = sum(1 << n for n in self.lengths)
        self.pairs = self.triples = 0
        for n in self.lengths:
            self.pairs |= self.singles << n & mask
        for n in self.lengths:
            self.triples |= self.pairs << n & mask

    def take(self, lengths: Counter, times: int) -> None:
        gone = False
        for n, c in lengths.items():
            self.left[n] -= c * times
            if not self.left[n]:
                del self.left[n]
                gone = True
        if gone:
            self._index()

    def _has(self, used: Counter, *more: int) -> bool:
        need = Counter(more)
        return all(self.left.get(n, 0) - used[n] >= c for n, c in need.items())

    def _pair(self, gap: int, used: Counter, first: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        if gap < 2 or not self.pairs >> gap & 1:
            return None
        for a in self.lengths:
            if a < gap and 2 * a >= gap and self.singles >> (gap - a) & 1 and self._has(used, *first, a, gap - a):
                return (*first, a, gap - a)
        return None

    def exact(self, gap: int, used: Counter) -> tuple[int, ...] | None:
        """At most three available lengths that sum to gap, beside those used."""
        if not gap:
            return ()
        if self._has(used, gap):
            return (gap,)
        if found := self._pair(gap, used):
            return found
        if not self.triples >> gap & 1:
            return None
        for a in self.lengths:
            if a < gap - 1 and 3 * a >= gap and self.pairs >> (gap - a) & 1 and (found := self._pair(gap - a, used, (a,))):
                return found
        return None

    def largest(self, gap: int, used: Counter) -> int | None:
        return next((n for n in self.lengths if n <= gap and self._has(used, n)), None)


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, number of such sequences) that use up counts (length -> pieces), all within limit.

    From the longest length on: add the longest that fit until at most three more fill
    the sequence exactly, and repeat that combination as often as the counts allow.
    What fills nothing exactly goes best-fit, longest first, into the fullest
    sequence with room.
    """
    gaps = Gaps(counts, limit)
    out: list[tuple[tuple[int, ...], int]] = []
    rest: Counter = Counter()
    while gaps.left:
        base = [gaps.lengths[0]]
        used = Counter(base)
        while (fill := gaps.exact(limit - sum(base), used)) is None and (more := gaps.largest(limit - sum(base), used)) is not None:
            base.append(more)
            used[more] += 1
        if fill is None:
            rest[base[0]] += gaps.left[base[0]]
            gaps.take(Counter(base[:1]), gaps.left[base[0]])
            continue
        used.update(fill)
        times = min(gaps.left[n] // c for n, c in used.items())
        gaps.take(used, times)
        out.append(((*base, *fill), times))
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for n in sorted(rest, reverse=True):
        left = rest[n]
        while left:
            gap = min((g for g in bins if g >= n), default=None)
            if gap is None:
                fit = min(limit // n, left)
                bins.setdefault(limit - fit * n, []).append(((n,) * fit, left // fit))
                left %= fit
                continue
            held, times = bins[gap].pop()
            if not bins[gap]:
                del bins[gap]
            if times > left:
                bins.setdefault(gap, []).append((held, times - left))
            used_now = min(times, left)
            bins.setdefault(gap - n, []).append(((*held, n), used_now))
            left -= used_now
    return out + [x for held in bins.values() for x in held]


def pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and end_id, cut where longer than limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder, end = word_bpe(tokenizer), np.array([end_id], "<u4").tobytes()
        for ids, texts in columns(batches, "doc_id", "text"):
            out: tuple[list, ...] = ([], [], [], [], [])
            raws = (raw for part in chunked(((t, len(t)) for t in texts), 1_000_000) for raw in coder.encode_raw(part))
            for doc_id, raw in zip(ids, raws, strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * limit)):
                    part = raw[at : at + 4 * limit]
                    for column, value in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts_of(docs).mapInArrow(thrifty(run, "word_bpe"), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _places(made: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Per place of the plan, in order of (length, first rank): that pair as one number, the first sequence, the offset."""
    at: Counter = Counter()
    key, sequence, offset, first = [], [], [], 0
    for lengths, times in made:
        place = 0
        for n in lengths:
            key.append(n << 48 | at[n])
            sequence.append(first)
            offset.append(place)
            at[n] += times
            place += n
        first += times
    order = np.argsort(np.array(key, np.int64))
    return tuple(np.array(x, np.int64)[order] for x in (key, sequence, offset))


def pack(cut: DataFrame, limit: int = LIMIT, bucket: int = 50_000) -> DataFrame:
    """cut (doc_id, piece, length, ...) with sequence_id and offset: sequences of at most limit, gapless from 0.

    A piece's rank among those of its length is its rank in a hash bucket of about
    `bucket` pieces plus the sizes of the buckets before, so no length, however
    common, is ranked in one task.
    """
    cut = written(cut, "pieces")
    buckets = cut.count() // bucket + 1
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `limit` rows
    places = cut.sparkSession.sparkContext.broadcast(_places(plan(counts, limit)))  # bounded by limit, not by the input
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = cut.withColumn("own", own).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own") - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sequence, offset = places.value
        for batch in batches:
            names = batch.schema.names
            length, rank = (batch.column(names.index(n)).to_numpy() for n in ("length", "rank"))
            at = np.searchsorted(key, length << 48 | rank, "right") - 1
            ids = sequence[at] + rank - (key[at] & (1 << 48) - 1)
            held = [batch.column(names.index(n)) for n in kept]
            yield pa.RecordBatch.from_arrays([*held, pa.array(ids), pa.array(offset[at])], [*kept, "sequence_id", "offset"])

    kept = [c for c in cut.columns if c != "bucket"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name != "bucket")
    return ranked.select(*kept, "rank").mapInArrow(run, f"{schema}, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece; repeated rows are packed each.

    Null and empty texts are one end id. Rows with a null doc_id are packed like others.
    """
    return pack(pieces(docs, tokenizer, limit), limit)
