"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints by exclusive-or and bit counts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, lean, texts_of, thrifty, written
from .components import connected_components, local_components

SHINGLE, SEED, RADIUS, TILE = 3, 42, 3, 2048


def fingerprint(text: str | None) -> int:
    """Majority bits of XXH64 over the word 3-shingles of text, A-Z lower-cased; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[: -SHINGLE])]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :], strict=True)], dtype=np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in columns(batches, "doc_id", "text"):
        fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps)], ["doc_id", "fp"])


def bands(distinct: int, radius: int) -> list[list[tuple[int, int]]]:
    """Bit ranges (start, width) to agree on; of `parts` ranges, two values within radius differ in radius at most.

    More parts make longer keys, so that a bucket holds a few values by chance at any input size.
    """
    for parts in range(radius + 1, 12):
        kept = parts - radius
        if distinct <= 2 ** (64 * kept // parts) * 4 or comb(parts, radius) > 60:
            break
    cuts = [round(i * 64 / parts) for i in range(parts + 1)]
    return [[(cuts[i], cuts[i + 1] - cuts[i]) for i in chosen] for chosen in combinations(range(parts), kept)]


def _tiles(order: np.ndarray, fp: np.ndarray, pops: np.ndarray, radius: int, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among order's values, which are sorted by bit count: tile by tile, whole tile pairs skipped by bit count."""
    n = len(order)
    label = np.arange(n)
    for i in range(0, n, tile):
        a = order[i : i + tile]
        for j in range(i, n, tile):
            b = order[j : j + tile]
            if pops[b[0]] - pops[a[-1]] > radius:
                break
            x, y = np.nonzero(np.bitwise_count(fp[a][:, None] ^ fp[b][None, :]) <= radius)
            x, y = x + i, y + j
            apart = label[x] != label[y]
            if apart.any():
                label = local_components(n, np.concatenate([np.arange(n), x[apart]]), np.concatenate([label, y[apart]]))
    child = np.nonzero(label != np.arange(n))[0]
    return order[child], order[label[child]]


def _links(radius: int, tile: int):
    """Rows sorted by bucket key come in; the links of a spanning forest of each bucket go out."""

    def bucket_links(key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        pops = np.bitwise_count(fp).astype(np.int16)
        order = np.lexsort((pops, key))
        cuts = np.nonzero(np.diff(key[order]))[0] + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
        size = ends - starts
        small = size <= 32
        near, far = [], []
        for n in np.unique(size[small & (size > 1)]).tolist():  # buckets of n values: a tile each, many tiles at once
            begin = starts[size == n]
            upper = np.triu(np.ones((n, n), bool), 1)
            for i in range(0, len(begin), max(1, (1 << 18) // n**2)):
                at = order[begin[i : i + max(1, (1 << 18) // n**2), None] + np.arange(n)]
                at = at[(np.diff(pops[at], axis=1) <= radius).any(axis=1)]  # bit counts, in order, all too far apart: no tile
                tile_fp = fp[at]
                hit = (np.bitwise_count(tile_fp[:, :, None] ^ tile_fp[:, None, :]) <= radius) & upper
                own, x, y = np.nonzero(hit)
                near.append(at[own, x])
                far.append(at[own, y])
        if near:
            a, b = np.concatenate(near), np.concatenate(far)
            label = local_components(len(key), a, b)
            child = np.nonzero(label != np.arange(len(key)))[0]
            near, far = [child], [label[child]]
        for s, e in zip(starts[~small].tolist(), ends[~small].tolist(), strict=True):
            a, b = _tiles(order[s:e], fp, pops, radius, tile)
            near.append(a)
            far.append(b)
        a = np.concatenate([*near, np.empty(0, np.int64)]).astype(np.int64)
        b = np.concatenate([*far, np.empty(0, np.int64)]).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cut = int(np.searchsorted(now[0], now[0][-1], "left"))  # the last bucket may go on
            if cut:
                key, fp, rep = (np.concatenate([*(h[i] for h in held), now[i][:cut]]) for i in range(3))
                yield bucket_links(key, fp.astype(np.int64).view(np.uint64), rep)
                held = []
            held.append(tuple(x[cut:] for x in now))
        if held:
            key, fp, rep = (np.concatenate([h[i] for h in held]) for i in range(3))
            yield bucket_links(key, fp.astype(np.int64).view(np.uint64), rep)

    return run


def near_links(values: DataFrame, radius: int = RADIUS, tile: int = TILE, hot: int = 20000) -> DataFrame:
    """Distinct (fp, rep) -> links (a, b) between reps that span every group of values within radius.

    Two 64-bit values within radius agree on all but radius of `parts` bit ranges, so
    each value goes to one bucket per choice of ranges, and each bucket is compared
    exactly. A bucket of over `hot` values is dealt over cells: a cell holds the values
    of two bit counts that differ by radius at most, and of two hash classes.
    """
    total = values.count()
    keys = []
    for number, ranges in enumerate(bands(total, radius)):
        parts = [F.shiftrightunsigned("fp", start).bitwiseAND((1 << width) - 1 if width < 64 else -1) for start, width in ranges]
        keys.append(F.xxhash64(F.lit(number), *parts))
    rows = values.where("rep IS NOT NULL").select(F.explode(F.array(*keys)).alias("key"), "fp", "rep")
    sizes = rows.groupBy("key").count().where(F.col("count") > hot)
    sizes = written(sizes, "hot-buckets")
    if not sizes.isEmpty():
        pop = F.bit_count("fp")
        marked = rows.join(sizes, "key", "left")
        warm = marked.where("count IS NULL").select("key", "fp", "rep")
        classes = F.ceil(F.col("count") / hot).cast("int")
        own = F.pmod(F.xxhash64("fp", F.lit(1)), classes).cast("int")
        cells = marked.where("count IS NOT NULL").select("key", "fp", "rep", pop.alias("pop"), own.alias("own"), classes.alias("classes"))
        cells = cells.select("*", F.explode(F.sequence(F.col("pop") - radius, F.col("pop") + radius)).alias("other_pop"))
        cells = cells.select("*", F.explode(F.sequence(F.lit(0), F.col("classes") - 1)).alias("other"))
        mine, theirs = F.struct("pop", "own"), F.struct(F.col("other_pop").alias("pop"), F.col("other").alias("own"))
        cells = cells.select(F.xxhash64("key", F.least(mine, theirs), F.greatest(mine, theirs)).alias("key"), "fp", "rep")
        rows = warm.unionAll(cells)
    rows = rows.repartition(max(8, min(4000, total // 20000 + 1)), "key").sortWithinPartitions("key")
    return rows.mapInArrow(thrifty(_links(radius, tile)), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    Null and wordless texts have fingerprint zero and link like any other. Equal
    fingerprints are one node, so copies are never paired. Rows with a null doc_id
    get the component of their fingerprint's other rows, or null if it has none.
    """
    fps = written(texts_of(docs).mapInArrow(thrifty(_fingerprints), "doc_id long, fp long"), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    found = connected_components(near_links(nodes, radius, tile))
    labelled = nodes.join(found, nodes["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(labelled, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, ha, hb, texts in columns(batches, "doc_id", "ha", "hb", "text"):
        fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ha, pa.int64()), pa.array(hb, pa.int64()), pa.array(fps)], ["doc_id", "ha", "hb", "fp"])


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near-copies: of each component the row with the smallest doc_id stays, in its own columns.

    Rows are told apart by a 128-bit hash of id, text and the other columns (but maps),
    so null and repeated ids keep one row for each component too; rows without an id
    come last. Of equal ids the row of least hash stays, the same one in every run.
    """
    lean(docs.sparkSession)
    own = [docs["doc_id"].isNull(), docs["doc_id"].cast("long"), docs["text"].isNull(), docs["text"]]
    own += [docs[f.name] for f in docs.schema if f.name not in ("doc_id", "text") and "map<" not in f.dataType.simpleString()]
    ha, hb = (F.xxhash64(F.lit(i), *own) for i in (0, 1))
    marked = docs.select(docs["doc_id"].cast("long").alias("doc_id"), ha.alias("ha"), hb.alias("hb"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "ha", "hb")).alias("first")
    nodes = written(marked.mapInArrow(thrifty(_fingerprinted), "doc_id long, ha long, hb long, fp long").groupBy("fp").agg(first), "nodes")
    found = connected_components(near_links(nodes.select("fp", F.col("fp").alias("rep"))))
    grouped = nodes.join(found, nodes["fp"] == found["node"], "left").groupBy(F.coalesce("component", "fp").alias("group")).agg(F.min("first").alias("first"))
    kept = grouped.select("first.ha", "first.hb")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), ha.alias("ha"), hb.alias("hb")).dropDuplicates(["ha", "hb"])
    return rows.join(kept, ["ha", "hb"], "left_semi").select("row.*")
