"""Passages that recur across texts, found without pairing texts or shuffling whole ones.

A text is a run of units (bytes or words). Of each window of units the anchor is the
k-gram of least hash in it, the leftmost of equals, so equal windows have the same
anchor at the same place. Any window holds at least half of its other units on one side
of its anchor, so the anchor with that half, left or right, recurs if the window does:
these two sides are counted over all distinct texts. The text round each anchor with a
side that recurs (the windows that it anchors: its context) is known by a 128-bit BLAKE2
digest; of the places with one digest, one sends the text to the anchor's bucket,
and all windows of a bucket are compared there. What is found for a context is joined
to its places, and only texts in which something was found are shuffled to have it
removed.

An anchor with over `hot` different contexts (a common line) would make one
bucket too large. Each of its windows is a context of its own, with a bucket named by its
digest, and goes through the same steps, so no bucket outgrows a task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import texts_of, thrifty, written
from .hashing import Spans, sliding_min

#: Bits of a filter that every task gets: 16 MB, whatever the input.
FILTER_LOG = 27

#: Bits of the ranges of hashes that are counted together.
PART_LOG = 13
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Units:
    """How texts are cut into units, and how many make a window and an anchor.

    cut(texts) gives the bytes of all texts, one after another, that windows are
    compared by, each unit's start and end in them, and each text's number of units.
    """

    cut: Callable[[list[str]], tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]
    window: int
    gram: int


def byte_units(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = b"".join(raw)
    at = np.arange(len(data) + 1)
    return data, at[:-1], at[1:], np.fromiter(map(len, raw), np.int64, len(raw))


_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def joined_words(text: str) -> bytes:
    """The words of text, joined by one space."""
    raw = text.encode("utf-8", "surrogatepass").translate(_SPACES)
    return b" ".join(raw.split()) if b"  " in raw or raw[:1] == b" " or raw[-1:] == b" " else raw


def word_units(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    raw = list(map(joined_words, texts))
    data = b" ".join(filter(None, raw))
    spaces = np.nonzero(np.frombuffer(data, np.uint8) == 32)[0]
    count = np.fromiter((r.count(b" ") + 1 if r else 0 for r in raw), np.int64, len(raw))
    if not data:
        return data, spaces, spaces, count
    return data, np.concatenate([[0], spaces + 1]), np.append(spaces, len(data)), count


@dataclass
class Batch:
    """Texts with their doc_ids and keys, the bytes of all, and their anchors in order.

    Of an anchor: its bucket, text, unit, the first window that it anchors and the one
    after the last (counted from the text's start), its context's place in data, the
    hashes of it with half a window's other units to the left and to the right, and
    whether its context reaches as far; begin: where each text's units begin, of all.
    """

    docs: list[int]
    keys: list[bytes]
    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    begin: np.ndarray
    text: np.ndarray
    h: np.ndarray
    unit: np.ndarray
    first: np.ndarray
    last: np.ndarray
    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    right: np.ndarray
    lefts: np.ndarray
    rights: np.ndarray

    def only(self, hit: np.ndarray) -> Batch:
        """With those anchors only."""
        return replace(self, **{n: getattr(self, n)[hit] for n in ("text", "h", "unit", "first", "last", "low", "high", "left", "right", "lefts", "rights")})

    def digests(self) -> np.ndarray:
        """Each context's 128-bit digest, as two numbers."""
        data, made = self.data, hashlib.blake2b
        raw = b"".join([made(data[a:b], digest_size=16).digest() for a, b in zip(self.low.tolist(), self.high.tolist(), strict=True)])
        return np.frombuffer(raw, "<i8").reshape(-1, 2)

    def windows(self, window: int) -> Batch:
        """Each window as a context of its own, in a bucket named by its digest."""
        which, local = spread(np.arange(len(self.h)), self.last - self.first)
        own = self.only(which)
        text, first = own.text, own.first + local
        at = self.begin[text] + first
        out = replace(own, first=first, last=first + 1, low=self.starts[at], high=self.ends[at + window - 1])
        return replace(out, h=np.ascontiguousarray(out.digests()[:, 0]))


def anchors(units: Units, docs: list[int], keys: list[bytes], texts: list[str]) -> Batch:
    data, starts, ends, count = units.cut(texts)
    begin = np.cumsum(count) - count
    n, reach = len(starts), units.window - 1
    owner = np.repeat(np.arange(len(texts)), count)
    inside = np.nonzero(owner[: max(n - reach, 0)] == owner[reach:])[0]
    if not len(inside):
        return Batch(docs, keys, data, starts, ends, begin, *[np.empty(0, np.int64)] * 9, *[np.empty(0, bool)] * 2)
    spans = Spans(np.frombuffer(data, np.uint8))
    keyed = spans.rough(starts[: n - units.gram + 1], ends[units.gram - 1 :]) & np.uint64(0xFFFFFFFF00000000)
    keyed |= np.arange(len(keyed), dtype=np.uint64)
    least = sliding_min(keyed, units.window - units.gram + 1)[inside]
    turn = np.nonzero((least[1:] != least[:-1]) | (inside[1:] != inside[:-1] + 1))[0] + 1
    head = np.concatenate([[0], turn])
    first, last = inside[head], inside[np.append(turn, len(inside)) - 1] + 1
    unit = (least[head] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = owner[first]
    low, high = starts[first], ends[last + units.window - 2]
    h = spans.of(starts[unit], ends[unit + units.gram - 1]).view(np.int64)
    half, end = (units.window - units.gram + 1) // 2, unit + units.gram - 1
    lefts, rights = unit - half >= first, end + half <= last + units.window - 2
    left = ~spans.of(starts[np.maximum(unit - half, 0)], ends[end]).view(np.int64)
    right = spans.of(starts[unit], ends[np.minimum(end + half, n - 1)]).view(np.int64)
    return Batch(docs, keys, data, starts, ends, begin, text, h, unit - begin[text], first - begin[text], last - begin[text], low, high, left, right, lefts, rights)


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): equal texts, and only they, have equal keys."""
    return texts_of(docs).select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text")


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            yield from zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in names), strict=True)


Filter = Callable[[], "np.ndarray | None"]


@dataclass(frozen=True)
class Wanted:
    """Which anchors a pass is after: those with a side in the filter `sides` that are in the filter `inside`; with split, each of their windows, of those in the filter `windows`."""

    sides: Filter = lambda: None
    inside: Filter = lambda: None
    split: bool = False
    windows: Filter = lambda: None

    def here(self, window: int) -> Callable[[Batch], Batch]:
        """The choice, in a task, which unpacks the filters once."""
        sides, inside, windows = self.sides(), self.inside(), self.windows()

        def of(found: Batch) -> Batch:
            if sides is not None:
                found = found.only(np.nonzero(marked(sides, found.left) & found.lefts | marked(sides, found.right) & found.rights)[0])
            if inside is not None:
                found = found.only(np.nonzero(marked(inside, found.h))[0])
            if self.split:
                found = found.windows(window)
                if windows is not None:
                    found = found.only(np.nonzero(marked(windows, found.h))[0])
            return found

        return of


def _met(batches: Iterator[pa.RecordBatch], units: Units, wanted: Wanted, size: int = 1 << 16) -> Iterator[Batch]:
    """The distinct texts of a task, about size characters at a time, with their wanted anchors.

    A text comes again if a smaller doc_id has it; a null one counts as the largest.
    """
    seen: dict[bytes, int] = {}
    docs: list[int] = []
    keys: list[bytes] = []
    texts: list[str] = []
    total = 0
    chosen = wanted.here(units.window)
    for doc_id, key, text in _rows(batches, "doc_id", "key", "text"):
        doc = LAST if doc_id is None else doc_id
        if seen.get(key, LAST + 1) <= doc:
            continue
        seen[key] = doc
        docs.append(doc)
        keys.append(key)
        texts.append(text)
        total += len(text)
        if total > size:
            yield chosen(anchors(units, docs, keys, texts))
            docs, keys, texts, total = [], [], [], 0
    if texts:
        yield chosen(anchors(units, docs, keys, texts))


def _packed(h: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    """(part, pairs): the distinct h, each with a key of its texts, and with that key's complement too if they are more than one; a row for all that share their leading bits."""
    order = np.argsort(h.view(np.uint64))
    h, key = h[order], key[order]
    start = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0]
    several = np.minimum.reduceat(key, start) < np.maximum.reduceat(key, start)
    times = 1 + several
    h, key = np.repeat(h[start], times), np.repeat(key[start], times)
    key[(np.cumsum(times) - 1)[several]] ^= -1
    part = (h.view(np.uint64) >> np.uint64(64 - PART_LOG)).astype(np.int32)
    cut = np.concatenate([[0], np.nonzero(part[1:] != part[:-1])[0] + 1])
    offsets = np.append(cut, len(h)).astype(np.int32) * 16
    pairs = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(offsets), pa.py_buffer(np.column_stack([h, key]).tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(part[cut]), pairs], ["part", "pairs"])


def _again(pairs: list[bytes]) -> pa.RecordBatch:
    """The h that have more than one key."""
    both = np.frombuffer(b"".join(pairs), np.int64).reshape(-1, 2)
    order = np.argsort(both[:, 0])
    h, key = both[order, 0], both[order, 1]
    start = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0]
    met = np.minimum.reduceat(key, start) < np.maximum.reduceat(key, start)
    return pa.RecordBatch.from_arrays([pa.array(h[start[met]])], ["h"])


def counted(texts: DataFrame, units: Units, wanted: Wanted, limit: int = 1 << 19) -> DataFrame:
    """(h) of the sides of anchors, with split of the windows, met in two distinct texts, or twice in one.

    Shuffled are packs of about limit of them, in a row for each of 2^PART_LOG ranges of
    h, not a row each; the ranges are counted one after another, about limit at a time.
    """

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for found in _met(batches, units, wanted):
            h, text = found.h, found.text
            if not wanted.split:
                h, text = (np.concatenate([a[found.lefts], b[found.rights]]) for a, b in ((found.left, found.right), (text, text)))
            if not len(h):
                continue
            order = np.lexsort((h, text))
            h, text = h[order], text[order]
            start = np.nonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])]))[0]
            keys = np.fromiter(map(key_hash, found.keys), np.int64, len(found.keys))[text[start]]
            twice = np.diff(np.append(start, len(h))) > 1
            held.append((np.concatenate([h[start], h[start[twice]]]), np.concatenate([keys, ~keys[twice]])))
            if sum(len(x) for x, _ in held) >= limit:
                yield _packed(*map(np.concatenate, zip(*held, strict=True)))
                held.clear()
        if held:
            yield _packed(*map(np.concatenate, zip(*held, strict=True)))

    def recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size, last = 0, None
        for part, pairs in _rows(batches, "part", "pairs"):
            if part != last and size >= 16 * limit:
                yield _again(held)
                held.clear()
                size = 0
            held.append(pairs)
            size, last = size + len(pairs), part
        if held:
            yield _again(held)

    made = texts.select("doc_id", "key", "text").mapInArrow(thrifty(packs), "part int, pairs binary")
    return made.repartition("part").sortWithinPartitions("part").mapInArrow(thrifty(recurring), "h long")


def _mixed(context: np.ndarray, found: Batch) -> np.ndarray:
    """A number for each place, by which the one that sends a context's text is chosen: it hangs on the context, the text and the document."""
    x = np.fromiter(map(key_hash, found.keys), np.int64, len(found.keys)).view(np.uint64) + np.array(found.docs, np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        x = (x[found.text] ^ context.view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
    return x.view(np.int64)


PLACES = "h long, c1 long, c2 long, key binary, doc long, first int, last int, number long"


def placed(texts: DataFrame, units: Units, wanted: Wanted) -> DataFrame:
    """PLACES of the wanted anchors of the distinct texts of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _met(batches, units, wanted):
            if not len(found.h):
                continue
            c, keys, docs = found.digests(), pa.array(found.keys, pa.binary()), np.array(found.docs, np.int64)
            c1, c2 = (np.ascontiguousarray(c[:, i]) for i in (0, 1))
            columns = [pa.array(found.h), pa.array(c1), pa.array(c2), keys.take(pa.array(found.text)), pa.array(docs[found.text]), pa.array(found.first.astype(np.int32)), pa.array(found.last.astype(np.int32)), pa.array(_mixed(c1, found))]
            yield pa.RecordBatch.from_arrays(columns, ["h", "c1", "c2", "key", "doc", "first", "last", "number"])

    return texts.mapInArrow(thrifty(run), PLACES)


CONTEXTS = "h long, c1 long, c2 long, at int, least long, most long, times long, text binary"


def sent(texts: DataFrame, units: Units, wanted: Wanted, numbers: Filter) -> DataFrame:
    """CONTEXTS rows with the text of each context, from the place whose number is in the filter (or a few more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        senders = numbers()
        for found in _met(batches, units, wanted):
            if not len(found.h):
                continue
            c = found.digests()
            hit = np.nonzero(marked(senders, _mixed(np.ascontiguousarray(c[:, 0]), found)))[0]
            _, one = np.unique(np.column_stack([c[hit], found.h[hit]]), axis=0, return_index=True)  # once for each batch of texts
            hit = hit[one]
            own, c = found.only(hit), c[hit]
            none = pa.nulls(len(hit), pa.int64())
            body = pa.array([own.data[a:b] for a, b in zip(own.low.tolist(), own.high.tolist(), strict=True)], pa.binary())
            columns = [pa.array(own.h), pa.array(np.ascontiguousarray(c[:, 0])), pa.array(np.ascontiguousarray(c[:, 1])), pa.array((own.unit - own.first).astype(np.int32)), none, none, none, body]
            yield pa.RecordBatch.from_arrays(columns, ["h", "c1", "c2", "at", "least", "most", "times", "text"])

    return texts.mapInArrow(thrifty(run), CONTEXTS)


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """Bytes of a filter with a bit set for the leading bits of each value of a long column."""
    bit = F.shiftrightunsigned(column, 64 - FILTER_LOG)
    parts = hashes.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 32768).alias("part")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits"))
    out = np.zeros((1 << FILTER_LOG) // 8, np.uint8)
    for r in parts.toLocalIterator():  # at most 4096 rows of 4 kB
        out[r["part"] * 4096 : r["part"] * 4096 + len(r["bits"])] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def sent_filter(spark: SparkSession, bits: np.ndarray | None) -> Callable[[], np.ndarray | None]:
    """A function that gives bits in a task; a filter with few bits set is small on its way there."""
    if bits is None:
        return lambda: None
    held = spark.sparkContext.broadcast(zlib.compress(bits.tobytes(), 1))
    return lambda: np.frombuffer(zlib.decompress(held.value), np.uint8)


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes.view(np.uint64) >> np.uint64(64 - FILTER_LOG)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def key_hash(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def decided(texts: DataFrame, units: Units, hot: int, compare: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """(key, doc, start, end, before) of the runs of units that compare has found, in each text that has them.

    compare: gets CONTEXTS rows sorted by h and context, and gives (h, c1, c2, a, b,
    before) for runs of windows.
    """
    spark = texts.sparkSession

    def filtered(hashes: DataFrame, column: str = "h") -> Filter:
        return sent_filter(spark, bitmap(hashes, column))

    def held(wanted: Wanted) -> tuple[DataFrame, DataFrame]:
        places = written(placed(texts, units, wanted), "places")
        return places, written(places.groupBy("h", "c1", "c2").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("times"), F.min("number").alias("number")), "contexts")

    def compared(wanted: Wanted, places: DataFrame, stats: DataFrame) -> DataFrame:
        body = sent(texts, units, wanted, filtered(stats, "number"))
        blank = stats.select("h", "c1", "c2", F.lit(None).cast("int").alias("at"), "least", "most", "times", F.lit(None).cast("binary").alias("text"))
        rows = body.unionAll(blank).repartition("h").sortWithinPartitions("h", "c1", "c2")
        runs = rows.mapInArrow(thrifty(compare), "h long, c1 long, c2 long, a int, b int, before long")
        return places.join(runs, ["h", "c1", "c2"]).select("key", "doc", (F.col("first") + F.col("a")).alias("start"), (F.col("first") + F.col("b")).alias("end"), "before")

    plain = Wanted(sides=filtered(counted(texts, units, Wanted())))
    places, stats = held(plain)
    crowded = written(stats.groupBy("h").count().where(F.col("count") > hot).select("h"), "crowded")
    if crowded.isEmpty():
        return compared(plain, places, stats)
    split = replace(plain, inside=filtered(crowded), split=True)
    split = replace(split, windows=filtered(counted(texts, units, split)))
    return compared(plain, places, stats.join(crowded, "h", "left_anti")).unionAll(compared(split, *held(split)))


@dataclass
class Block:
    """Distinct contexts of whole buckets: bucket number, h and digest, the anchor's place, text, smallest and largest doc_id, number of places."""

    bucket: np.ndarray
    h: np.ndarray
    c1: np.ndarray
    c2: np.ndarray
    at: np.ndarray
    text: list[bytes]
    least: np.ndarray
    most: np.ndarray
    times: np.ndarray

    def batch(self, own: np.ndarray, a: np.ndarray, b: np.ndarray, before: np.ndarray | None) -> pa.RecordBatch:
        """What was found for contexts own."""
        last = pa.nulls(len(a), pa.int64()) if before is None else pa.array(before)
        return pa.RecordBatch.from_arrays([pa.array(self.h[own]), pa.array(self.c1[own]), pa.array(self.c2[own]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), last], ["h", "c1", "c2", "a", "b", "before"])


def blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[Block]:
    """Rows of CONTEXTS, sorted by h and digest, as blocks of about limit bytes; buckets of one context met in one place hold nothing and are left out."""
    kept: list[tuple] = []
    bucket: list[list] = []
    size, number = 0, 0

    def close() -> None:
        nonlocal number, size
        bucket[:] = [c for c in bucket if c[7]]  # a text may be sent that isn't asked for
        if len(bucket) > 1 or any(c[7] > 1 for c in bucket):
            kept.extend((number, *c) for c in bucket)
            size += sum(len(c[4]) for c in bucket)
            number += 1
        bucket.clear()

    def cut() -> Block:
        columns = list(zip(*kept, strict=True))
        kept.clear()
        return Block(*[np.array(c, np.int64) for c in columns[:5]], list(columns[5]), *[np.array(c, np.int64) for c in columns[6:]])

    for h, c1, c2, at, least, most, times, text in _rows(batches, "h", "c1", "c2", "at", "least", "most", "times", "text"):
        if bucket and bucket[-1][0] != h:
            close()
            if size > limit:
                yield cut()
                size, number = 0, 0
        if not bucket or bucket[-1][1] != c1 or bucket[-1][2] != c2:
            bucket.append([h, c1, c2, None, b"", LAST, -LAST - 1, 0])
        own = bucket[-1]
        if text is not None:
            own[3], own[4] = at, text
        else:
            own[5], own[6], own[7] = least, most, times
    close()
    if kept:
        yield cut()


def spread(values: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per item of a list of lists, one after another: its list's value, and its number in the list."""
    return np.repeat(values, count), np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def window_runs(mask: np.ndarray, value: np.ndarray, count: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts' windows one after another, count[i] of context i -> context, start and end unit, value of each run of marked windows of one value."""
    own, local = spread(np.arange(len(count)), count)
    turn = np.concatenate([[True], (own[1:] != own[:-1]) | (value[1:] != value[:-1])])
    before = np.concatenate([[False], mask[:-1]]) & ~turn
    after = np.concatenate([mask[1:], [False]]) & ~np.concatenate([turn[1:], [True]])
    start, end = np.nonzero(mask & ~before)[0], np.nonzero(mask & ~after)[0]
    return own[start], local[start], local[end] + window, value[start]


def affected(texts: DataFrame, spans: DataFrame, per_doc: bool) -> DataFrame:
    """(key, least, copies, spans) of the texts in which spans were found or that occur in several rows.

    spans: (key, doc, start, end) and what else a span tells; per_doc: those of a text
    count only where doc is the smallest id that has it.
    """
    copies = texts.select("key", "doc_id").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    by = ["key", "doc"] if per_doc else ["key"]
    listed = spans.groupBy(*by).agg(F.collect_set(F.struct(*[c for c in spans.columns if c not in ("key", "doc")])).alias("spans"))  # no more than a text has units
    if per_doc:
        copies = copies.withColumn("doc", F.coalesce("least", F.lit(LAST)))
    found = copies.join(listed, by, "left").where("copies > 1 OR spans IS NOT NULL")
    return written(found.select("key", "least", "copies", "spans"), "affected")


def key_bits(found: DataFrame) -> np.ndarray:
    """A filter of the keys of affected texts."""
    # as key_hash: the first eight bytes, the first one lowest
    swapped = F.concat(*[F.substring("key", i, 1) for i in range(8, 0, -1)])
    number = F.conv(F.hex(swapped), 16, -10).cast("long")
    return bitmap(found.select(number.alias("k")), "k")


def split_by(texts: DataFrame, bits: np.ndarray, schema, passed: Callable[[pa.RecordBatch], pa.RecordBatch] | None) -> DataFrame:
    """Rows whose key is not in the filter, as passed makes them; without passed, the rows whose key is."""
    held = sent_filter(texts.sparkSession, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside_of = held()
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("key")).to_pylist()
            inside = marked(inside_of, np.fromiter(map(key_hash, keys), np.int64, len(keys)))
            rows = batch.filter(pa.array(inside if passed is None else ~inside))
            yield rows if passed is None else passed(rows)

    return texts.mapInArrow(thrifty(run), schema)
