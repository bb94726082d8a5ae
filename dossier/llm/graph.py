"""Connected components by alternating stars, and local spanning stars inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a long, b long); component: the smallest node reachable.

    Each round replaces the edges of a node by edges to the smallest neighbour (larger neighbours
    first, then smaller ones), until every edge is (node, smallest of its component). The rounds grow
    with the logarithm of a component's size. Each round is written in the shared folder, so that a
    lost executor costs one round at most; per-node minima are combined before the shuffle.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while True:
        large = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        low = large.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        grown = large.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = grown.groupBy("u").agg(F.min("v").alias("m"))
        small = grown.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select("u", "m")).distinct()
        after = materialize(small, "edges")
        was, mark = mark, _mark(after)
        discard(now)
        now = after
        if mark == was:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i[k] and j[k] for all k; ``root`` maps each item to the first item of its set."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            flat = root[root]
            if np.array_equal(flat, root):
                break
            root[:] = flat
