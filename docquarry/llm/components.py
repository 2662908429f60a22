"""Connected components of an undirected graph, by alternating large and small stars.

Each partition first contracts the edges it happens to hold to stars, which leaves fewer edges
than nodes. A round is then two shuffles on the node and one to drop repeats, and is cut with
``checkpoint``; a partition handles its rows as flat arrays, so a hub is rows like any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.runtime import checkpoint


def _contract(batches):
    """The edges of a partition as stars around each part's least node (union-find on numbered nodes)."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    a, b = t["a"].to_numpy(), t["b"].to_numpy()
    nodes, inverse = np.unique(np.r_[a, b], return_inverse=True)
    a, b = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(nodes))
    while True:  # hook the greater root on the lesser, then halve all paths
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        x, y = x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    far = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], names=["a", "b"])


def _stars(large: bool):
    """One star operation on rows (a, b) that a partition holds for all its nodes ``a``."""

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        a, b = t["a"].to_numpy(), t["b"].to_numpy()
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        keep = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        a, b = a[keep], b[keep]
        fresh = np.r_[True, a[1:] != a[:-1]]
        least = b[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        if large:
            m = np.minimum(a, least)
            far = b > a
            x, y = b[far], m[far]
        else:
            first = np.flatnonzero(fresh)
            far = b != least
            x, y = np.r_[b[far], a[first]], np.r_[least[far], b[first]]
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return run


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` has a > b. Large: each node's greater neighbours point to the least of it and its neighbours.
    Small: a node and its lesser neighbours point to the least of them. One shuffle each."""
    if large:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return edges.repartition("a").mapInArrow(_stars(large), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b: longs); the root is the component's least node."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = checkpoint(e.mapInArrow(_contract, "a long, b long").dropDuplicates())
    seen = None
    while True:
        state = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if not state.n or seen == (state.n, state.x):
            break
        seen = (state.n, state.x)
        e = checkpoint(_star(_star(e, True), False).dropDuplicates())
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
