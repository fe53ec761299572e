"""Approximate nearest neighbours by inner product: few stable projections in a kd-tree, true scores until a chi-square test holds.

Vectors get one more component that makes all equally long, so the largest inner
product is the least distance. For a vector at distance d, the squared distance of
projections onto m Gaussian directions is d^2 times a chi-square variable of m degrees,
which says how likely a nearer one can lie beyond the projections seen so far.
"""

from __future__ import annotations

from math import factorial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector_search import KdTree, search, usable

#: SURE: a neighbour at the k-th distance is looked at with that probability, a nearer one with more.
K, EVERY, DIRECTIONS, SURE, LEAF = 20, 20, 16, 0.9, 128


def chi_square(x: np.ndarray, m: int = DIRECTIONS) -> np.ndarray:
    """Distribution function for an even number of degrees."""
    half = np.maximum(x, 0) / 2
    return 1 - np.exp(-half) * sum(half**i / factorial(i) for i in range(m // 2))


def chi_square_at(p: float, m: int = DIRECTIONS) -> float:
    """Where the distribution function is p."""
    low, high = 0.0, 100.0 * m
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(np.float64(mid), m) < p else (low, mid)
    return high


class Projected:
    """Vectors of norm `top` squared at most, by their projections; a box's bound is the least squared projected distance, negative."""

    leaf = LEAF

    def __init__(self, dimensions: int, top: float, sure: float = SURE, seed: int = 11):
        self.top, self.limit = top, chi_square_at(sure)
        self.directions = np.random.default_rng(seed).standard_normal((dimensions + 1, DIRECTIONS))

    def points(self, vectors: np.ndarray) -> np.ndarray:
        norms = np.einsum("ij,ij->i", vectors, vectors)
        return np.column_stack([vectors, np.sqrt(np.maximum(self.top - norms, 0))]) @ self.directions

    def bounds(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        points = queries @ self.directions[:-1]
        gap = np.zeros((len(queries), len(low)))
        for d in range(DIRECTIONS):
            p = points[:, d, None]
            gap += np.maximum(np.maximum(low[:, d] - p, p - high[:, d]), 0) ** 2
        return -gap

    def _reach(self, queries: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """The squared projected distance at which the chi-square test holds for the k-th score."""
        return self.limit * np.maximum(self.top + np.einsum("ij,ij->i", queries, queries) - 2 * kth, 1e-12 * self.top)

    def enough(self, queries: np.ndarray, bound: np.ndarray, kth: np.ndarray) -> np.ndarray:
        return -bound > self._reach(queries, kth)

    def score(self, queries: np.ndarray, rows: np.ndarray, index: KdTree, at: np.ndarray, kth: np.ndarray) -> np.ndarray:
        q = queries[rows]
        a, b = q @ self.directions[:-1], index.points[at]
        apart = np.einsum("ij,ij->i", a, a)[:, None] - 2 * a @ b.T + np.einsum("ij,ij->i", b, b)
        row, place = np.nonzero(apart <= self._reach(q, kth)[:, None] * (1 + 1e-9))
        out = np.full(apart.shape, -np.inf)
        out[row, place] = np.einsum("ij,ij->i", q[row], index.vectors[at[place]])
        index.verified = getattr(index, "verified", 0) + len(row)
        return out

    def best(self, vectors: np.ndarray, queries: np.ndarray, width: int) -> None:
        return None


def nearest(vectors: DataFrame, every: int = EVERY, k: int = K, sure: float = SURE) -> DataFrame:
    """(query_id, rank, vec_id, score) for each row whose vec_id is divisible by every.

    Rows without an id, and vectors that are null, zero, empty or hold null or
    non-finite components, take no part. Of rows that repeat an id, the one with the
    least vector counts. Only vectors whose projection is within reach of the chi-square
    test are scored; sure is the probability that a k-th neighbour is among them.
    """
    rows = usable(vectors).where(F.exists("vec", lambda x: x != 0))
    most = rows.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    top = float(most or 0.0) * (1 + 1e-9)
    return search(rows, every, k, lambda d: Projected(d, top, sure), lambda x, q: (x * q).sum(axis=1).tolist(), "double")
