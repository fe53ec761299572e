"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 with edges a-b: the smallest node of each one's component."""
    label = np.arange(n)
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while (jump := label[label]).tobytes() != label.tobytes():
            label = jump
    return label


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) long edges -> (node, component): the smallest node that each node of an edge reaches.

    Rounds of contraction: each node points to its smallest neighbour, pointers are
    doubled until they are roots, and edges are redrawn between roots. A round at
    least halves the nodes that still have edges. Minima are combined before the
    shuffle, so a hub costs no more than any node; joins of a hub's edges are left to
    adaptive skew handling. Rows with a null end and loops are ignored.
    """
    edges = written(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct(), "edges")
    found = None
    while True:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if edges.isEmpty():
            break
        points = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")), "points")
        while True:
            nxt = points.alias("p").join(points.select(F.col("node").alias("at"), F.col("root").alias("onward")), F.col("root") == F.col("at"), "left")
            nxt = written(nxt.select("node", F.coalesce("onward", "root").alias("root"), (F.coalesce("onward", "root") != F.col("root")).alias("moved")), "jumps")
            moved = not nxt.where("moved").isEmpty()
            points = nxt.select("node", "root")
            if not moved:
                break
        step = points
        if found is None:
            found = step
        else:  # earlier roots may now hang below others
            new = step.select(F.col("node").alias("at"), F.col("root").alias("onward"))
            found = written(found.join(new, F.col("root") == F.col("at"), "left").select("node", F.coalesce("onward", "root").alias("root")), "found")
        left = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = written(edges.join(left, "a").join(right, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.select("node", F.col("root").alias("component"))
