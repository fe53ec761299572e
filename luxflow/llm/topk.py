"""Exact top-k by integer inner product: a kd-tree per shard with tight boxes, best-first by the box bound, k-th score passed on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector_search import KdTree, search, usable

K, EVERY, LEAF = 5, 50, 128
#: Largest and smallest long.
TOP, BOTTOM = (1 << 63) - 1, -(1 << 63)


class Whole:
    """Vectors of whole numbers by their inner product; a box's bound is the largest that its corners allow."""

    leaf = LEAF

    def points(self, vectors: np.ndarray) -> np.ndarray:
        return vectors

    def bounds(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T

    def enough(self, queries: np.ndarray, bound: np.ndarray, kth: np.ndarray) -> np.ndarray:
        return bound + 1e-12 * np.abs(bound) < kth  # an equal bound may hide a tie of smaller id

    def score(self, queries: np.ndarray, rows: np.ndarray, index: KdTree, at: np.ndarray, kth: np.ndarray) -> np.ndarray:
        return queries[rows] @ index.vectors[at].T


    def best(self, vectors: np.ndarray, queries: np.ndarray, width: int) -> np.ndarray | None:
        """Places of the best, where sums may leave the whole numbers that doubles hold."""
        if not _wide(vectors, queries):
            return None
        out = np.full((len(queries), width), np.iinfo(np.int64).max)
        for row, q in enumerate(queries):
            found = sorted((-s, i) for i, s in enumerate(_products(vectors, q)))[:width]
            out[row, : len(found)] = [i for _, i in found]
        return out


def _wide(x: np.ndarray, q: np.ndarray) -> bool:
    return bool(len(x)) and float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] >= 1 << 53


def _products(x: np.ndarray, q: np.ndarray) -> list[int]:
    """Inner products as Python's integers."""
    by = [int(b) for b in q.tolist()]
    return [sum(int(a) * b for a, b in zip(row, by, strict=True)) for row in x.tolist()]


def exact_products(x: np.ndarray, q: np.ndarray) -> list[int]:
    if _wide(x, q):
        return [max(BOTTOM, min(TOP, s)) for s in _products(x, q)]
    return (x * q).sum(axis=1).astype(np.int64).tolist()


def top(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) over floor(256 * component), for each row whose vec_id is divisible by every.

    Sums of products are exact whole numbers; those that no long holds count as the
    nearest long. Rows without an id, and vectors that are null, empty or hold null or
    non-finite components, take no part. Of rows that repeat an id, the one with the
    least vector counts.
    """
    rows = usable(vectors, lambda x: F.floor(x * 256.0).cast("double"))
    return search(rows, every, k, lambda _: Whole(), exact_products, "long")
