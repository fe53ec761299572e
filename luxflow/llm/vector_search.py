"""Search of all vectors for a stated set of query vectors: kd-split shards, visited only where a query's bound is worth it.

Vectors are dealt over shards by the median splits of a bounded sample, so a shard is a
box in space. Each distinct query vector first goes to its most promising shard, then
to a few more, then to all whose box may hold something better than what it has found,
so what is shipped follows the bounds, not queries times shards. In a shard a kd-tree
with tight boxes is searched best-first for many queries at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import thrifty, written
from .folds import share

#: Vectors of the sample whose median splits make the shards, and shards at most: their boxes reach the driver and every task.
SAMPLE, SHARDS = 1 << 16, 4096


class Space(Protocol):
    """How vectors are indexed and compared; bounds and scores: higher is better."""

    leaf: int

    def points(self, vectors: np.ndarray) -> np.ndarray: ...

    def bounds(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """(queries x boxes) how promising a box is."""

    def enough(self, queries: np.ndarray, bound: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Nothing of that bound needs a look, with that k-th score at hand (-inf: too few yet)."""

    def score(self, queries: np.ndarray, rows: np.ndarray, index: KdTree, at: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Scores of vectors at for queries rows; -inf for those not worth one."""

    def best(self, vectors: np.ndarray, queries: np.ndarray, width: int) -> np.ndarray | None:
        """Places of the best, where the tree can't tell them; else None."""


def usable(vectors: DataFrame, component: Callable | None = None) -> DataFrame:
    """(vec_id, vec) of the rows with an id and a vector without null or non-finite components; component maps each."""
    vec = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).where("vec_id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0")
    rows = rows.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return rows if component is None else rows.withColumn("vec", F.transform("vec", component))


class KdTree:
    """Median splits of the widest side, with each node's tight box; node 0 is the root, a leaf has members."""

    def __init__(self, points: np.ndarray, size: int, most: int | None = None):
        self.points = points
        self.axis, self.cut, self.left, self.right = [], [], [], []
        self.members: list[np.ndarray | None] = []
        low, high = [], []

        def node(at: np.ndarray) -> int:
            own = points[at]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            for column, value in ((self.axis, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.members, at)):
                column.append(value)
            return len(self.axis) - 1

        todo, leaves = [node(np.arange(len(points)))], 1
        while todo and (most is None or leaves < most):
            # the fullest first where their number is bounded, so that all end about equally full
            n = todo.pop() if most is None else todo.pop(int(np.argmax([len(self.members[i]) for i in todo])))
            at = self.members[n]
            axis = int((high[n] - low[n]).argmax())
            if len(at) <= size or high[n][axis] == low[n][axis]:
                continue
            side = points[at, axis]
            cut = float(np.partition(side, (len(at) - 1) // 2)[(len(at) - 1) // 2])
            if cut == high[n][axis]:  # half the points share the highest value
                cut = float(side[side < cut].max())
            self.axis[n], self.cut[n], self.members[n] = axis, cut, None
            self.left[n], self.right[n] = node(at[side <= cut]), node(at[side > cut])
            todo += [self.left[n], self.right[n]]
            leaves += 1
        self.low, self.high = np.stack(low), np.stack(high)
        self.left, self.right = np.array(self.left), np.array(self.right)

    def splits(self) -> tuple[np.ndarray, ...]:
        """axis (-1: a leaf), cut, left, right, and a leaf's number, by node."""
        axis = np.array(self.axis)
        return axis, np.array(self.cut), self.left, self.right, np.cumsum(axis < 0) - 1


def leaf_of(points: np.ndarray, splits: tuple[np.ndarray, ...]) -> np.ndarray:
    axis, cut, left, right, number = splits
    node = np.zeros(len(points), np.int64)
    while (inner := np.nonzero(axis[node] >= 0)[0]).size:
        at = node[inner]
        node[inner] = np.where(points[inner, axis[at]] <= cut[at], left[at], right[at])
    return number[node]


class Best:
    """The `width` highest scores so far of each query, with their places; equal scores by the smaller place."""

    def __init__(self, queries: int, width: int):
        self.scores = np.full((queries, width), -np.inf)
        self.places = np.full((queries, width), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, scores: np.ndarray, places: np.ndarray) -> None:
        in_reach = (scores >= self.scores[rows, -1:]) & (scores > -np.inf)
        count = in_reach.sum(axis=1)
        better = np.nonzero(count)[0]
        if not len(better):
            return
        rows, scores, most = rows[better], scores[better], int(count.max())
        width, own = self.scores.shape[1], np.broadcast_to(places, scores.shape)
        if 2 * most < scores.shape[1]:  # most columns are out of every row's reach
            at = np.argpartition(-scores, most - 1, axis=1)[:, :most]
            scores, own = np.take_along_axis(scores, at, 1), np.take_along_axis(own, at, 1)
        all_scores = np.concatenate([self.scores[rows], scores], axis=1)
        all_places = np.concatenate([self.places[rows], own], axis=1)
        all_places[all_scores == -np.inf] = np.iinfo(np.int64).max
        order = np.lexsort((all_places, -all_scores), axis=1)[:, :width]
        self.scores[rows], self.places[rows] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_places, order, 1)


def best_first(space: Space, vectors: np.ndarray, queries: np.ndarray, floors: np.ndarray, width: int, block: int = 2048) -> np.ndarray:
    """Places of the `width` best of vectors for each query (those with equal scores by place; beyond the last: a huge number)."""
    if (known := space.best(vectors, queries, width)) is not None:
        return known
    tree = KdTree(space.points(vectors), space.leaf)
    tree.vectors = vectors
    out = []
    for i in range(0, len(queries), block):
        q, floor = queries[i : i + block], floors[i : i + block]
        best = Best(len(q), width)
        bounds = space.bounds(q, tree.low, tree.high)
        open_ = np.full(bounds.shape, -np.inf)
        open_[:, 0] = bounds[:, 0]
        active, step = np.arange(len(q)), 1
        while len(active):
            step = min(step, bounds.shape[1])
            front = open_[active]
            node = np.argpartition(-front, step - 1, axis=1)[:, :step]  # the `step` most promising open nodes of each query
            bound = np.take_along_axis(front, node, 1)
            kth = np.maximum(best.scores[active, -1], floor[active])
            again = np.repeat(np.arange(len(active)), step)
            go = ~space.enough(q[active][again], bound.ravel(), kth[again]) & (bound.ravel() > -np.inf)
            row, node = active[again[go]], node.ravel()[go]
            active = active[go.reshape(-1, step).any(axis=1)]
            open_[row, node] = -np.inf
            inner = tree.left[node] >= 0
            for child in (tree.left, tree.right):
                open_[row[inner], child[node[inner]]] = bounds[row[inner], child[node[inner]]]
            order = np.argsort(node, kind="stable")
            order = order[~inner[order]]
            for part in np.split(order, np.nonzero(np.diff(node[order]))[0] + 1) if len(order) else ():
                at, rows = tree.members[node[part[0]]], row[part]
                best.add(rows, space.score(q, rows, tree, at, np.maximum(best.scores[rows, -1], floor[rows])), at)
            step = min(2 * step, 16)
        out.append(best.places)
    return np.concatenate(out)


def _stacked(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _lists(values: np.ndarray, count: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(values))


def _by_bytes(x: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct rows of x in order of their smallest id, and the `keep` smallest ids of each."""
    by = np.argsort(ids, kind="stable")
    x, ids = np.ascontiguousarray(x[by]) + 0.0, ids[by]
    _, first, group = np.unique(x.view(f"V{x.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
    order = np.argsort(first)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    group = place[group.ravel()]
    at = np.argsort(group, kind="stable")
    return x[np.sort(first)], [m[:keep] for m in np.split(ids[at], np.nonzero(np.diff(group[at]))[0] + 1)]


def search(vectors: DataFrame, every: int, k: int, space: Callable[[int], Space], score: Callable[[np.ndarray, np.ndarray], list], score_type: str, shard: int = 16384, block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of (vec_id, vec) whose id is divisible by every, the k best of all rows with other ids.

    space(dimensions) and score must be functions of their arguments alone. Only vectors
    of one length are compared. Of rows that repeat an id, the one with the least
    vector, component by component, counts. Equal vectors are indexed once, with their
    k + 1 smallest ids, and asked for once, so a vector that a third of all rows share
    is one vector of its shard.
    """
    spark = vectors.sparkSession
    vectors = written(vectors, "vectors")
    repeated = written(vectors.groupBy("vec_id").count().where("count > 1").select("vec_id"), "repeated")
    if not repeated.isEmpty():
        once = vectors.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("vec").alias("vec"))
        vectors = written(vectors.join(repeated, "vec_id", "left_anti").unionByName(once), "vectors")
    lengths = vectors.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()  # shards are made for the commonest
    schema = "query_id long, rank int, vec_id long, score " + score_type
    if not lengths:
        return spark.createDataFrame([], schema)
    width, total = lengths[0]["d"], lengths[0]["count"]
    main = space(width)
    shards = min(SHARDS, total // shard + 1)
    # any such sample does: it shapes the shards, not what is found in them
    sample = vectors.where(F.size("vec") == width).where(share(F.col("vec_id"), 5) < min(1.0, SAMPLE / total)).limit(2 * SAMPLE).select("vec").toPandas()["vec"] if shards > 1 else []
    splits = KdTree(main.points(np.stack(sample) + 0.0), 1, shards).splits() if len(sample) else None

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec, ids = batch.column(batch.schema.get_field_index("vec")), batch.column(batch.schema.get_field_index("vec_id")).to_numpy()
            sizes = np.diff(vec.offsets.to_numpy())
            for d in np.unique(sizes).tolist():
                at = np.nonzero(sizes == d)[0]
                x, members = _by_bytes(_stacked(vec.take(pa.array(at))), ids[at], k + 1)
                points = space(d).points(x)
                own = np.full(len(x), -d) if d != width else leaf_of(points, splits) if splits is not None else np.zeros(len(x), np.int64)
                count = np.fromiter(map(len, members), np.int64, len(members))
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), _lists(x.ravel(), np.full(len(x), d)), _lists(points.ravel(), np.full(len(x), points.shape[1])), _lists(np.concatenate(members), count)], ["shard", "vec", "point", "ids"])

    held = written(vectors.mapInArrow(thrifty(dealt), "shard long, vec array<double>, point array<double>, ids array<long>"), "shards")
    dims = main.points(np.zeros((1, width))).shape[1]
    ends = held.groupBy("shard").agg(F.count("*").alias("n"), *[f(F.get("point", F.lit(i))).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(dims)]).collect()  # SHARDS rows at most, and one for each other length
    number = np.array([r["shard"] for r in ends])
    chunks = {r["shard"]: r["n"] // (4 * shard) + 1 for r in ends}
    boxes = sorted((r for r in ends if r["shard"] >= 0), key=lambda r: r["shard"])
    low, high = (np.array([[r[f"{n}{i}"] for i in range(dims)] for r in boxes]) for n in ("low", "high"))
    names = np.array([r["shard"] for r in boxes], np.int64)
    del ends, number

    queries = written(vectors.where(F.col("vec_id") % every == 0), "queries")
    asked = written(queries.groupBy("vec").agg(F.min("vec_id").alias("query")).withColumn("floor", F.lit(None).cast("double")).withColumn("done", F.lit(0)), "asked")

    def routed(most: int):
        """Of each query's shards in falling order of their bounds, those from place `done` to `most` that are worth a look."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                vec, query, floor, done = (batch.column(batch.schema.get_field_index(c)) for c in ("vec", "query", "floor", "done"))
                sizes = np.diff(vec.offsets.to_numpy())
                other = np.nonzero((sizes != width) & (done.to_numpy() == 0))[0]
                row, to = [other], [-sizes[other].astype(np.int64)]
                at = np.nonzero(sizes == width)[0]
                if len(at):
                    q, kth = _stacked(vec.take(pa.array(at))) + 0.0, np.nan_to_num(floor.to_numpy(zero_copy_only=False)[at].astype(float), nan=-np.inf)
                    bound = main.bounds(q, low, high)
                    order = np.argsort(-bound, axis=1, kind="stable")
                    for j in range(int(done.to_numpy().min()), min(most, len(names))):
                        mine = order[:, j]
                        hit = ~main.enough(q, bound[np.arange(len(q)), mine], kth)
                        row.append(at[hit])
                        to.append(names[mine[hit]])
                row, to = np.concatenate(row), np.concatenate(to)
                yield pa.RecordBatch.from_arrays([pa.array(to), *[c.take(pa.array(row)) for c in (query, vec, floor)]], ["shard", "query", "asked", "floor"])

        return run

    def one(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: tuple[list, ...] = ([], [], [])
        if len(queries) and len(rows):
            count = rows["ids"].str.len().to_numpy()
            stacked = np.repeat(np.stack(rows["vec"].to_numpy()), count, axis=0)
            x, members = _by_bytes(stacked, np.concatenate(rows["ids"].to_numpy()).astype(np.int64), k + 1)
            q, floors = np.stack(queries["asked"].to_numpy()) + 0.0, queries["floor"].to_numpy(np.float64, na_value=-np.inf)
            places = best_first(space(q.shape[1]), x, q, floors, k + 1)
            for name, vector, found, floor in zip(queries["query"].tolist(), q, places, floors, strict=True):
                found = found[found < len(x)]
                near = [(-s, i) for s, p in zip(score(x[found], vector), found.tolist(), strict=True) if s >= floor - 1e-9 * abs(floor) for i in members[p].tolist()]
                near = sorted(near)[: k + 1]
                out[0].extend([name] * len(near))
                out[1].extend(i for _, i in near)
                out[2].extend(-s for s, _ in near)
        return pd.DataFrame({"query": np.array(out[0], np.int64), "vec_id": np.array(out[1], np.int64), "score": np.array(out[2], np.int64 if score_type == "long" else float)})

    def round_(asked: DataFrame, most: int) -> DataFrame:
        sent = written(asked.mapInArrow(thrifty(routed(most)), "shard long, query long, asked array<double>, floor double"), "sent")
        parts = {r["shard"]: r["n"] // block + 1 for r in sent.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # as the boxes: SHARDS rows at most
        if not parts:
            return spark.createDataFrame([], f"query long, vec_id long, score {score_type}")
        plan = spark.createDataFrame([(s, p, chunks[s]) for s, p in parts.items() if s in chunks], "shard long, parts long, chunks long")
        there = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
        a = sent.join(F.broadcast(plan), "shard").select("shard", F.pmod(F.xxhash64("query"), F.col("parts")).alias("part"), F.explode(there).alias("chunk"), "query", "asked", "floor")
        b = held.join(F.broadcast(plan), "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("vec"), F.col("chunks")).alias("chunk"), "vec", "ids")
        by = ["shard", "part", "chunk"]
        return written(a.groupBy(*by).cogroup(b.groupBy(*by)).applyInPandas(lambda x, y: one(x, y), f"query long, vec_id long, score {score_type}"), "round")

    place = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best: DataFrame | None = None
    at = 0
    for most in (1, 4, max(len(names), 4)):
        if at and at >= len(names):
            break
        now = asked
        if best is not None:
            floors = best.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("low")).select("query", F.when(F.col("n") > k, F.col("low").cast("double")).alias("least"))
            now = asked.join(floors, "query", "left").select("vec", "query", F.col("least").alias("floor"), F.lit(at).alias("done"))
        found = round_(now, most)
        found = found if best is None else best.unionByName(found)
        best = written(found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k + 1).drop("place"), "best")
        at = most
    # each query id has its vector's list, without itself
    lists = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("near"))  # k + 1 each
    lists = asked.join(lists, "query").select("vec", "near")
    own = queries.join(lists, "vec").select(F.col("vec_id").alias("query_id"), "near")
    own = own.withColumn("near", F.slice(F.filter("near", lambda c: c["vec_id"] != F.col("query_id")), 1, k))
    return own.select("query_id", F.posexplode("near").alias("at", "c")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("c.vec_id").alias("vec_id"), (-F.col("c.s")).alias("score"))
