"""Exact nearest neighbours of query vectors among all, by KD-trees per shard.

Vectors are dealt to shards by median splits of a bounded sample, so that a shard is a region of
space. Each shard builds a KD-tree: nodes split at the median of their widest dimension, and
carry the tight box of their own points. A search goes through a tree best-first: the node whose
box lies nearest comes next, a block of queries at a time, each query dropping out of
every node whose box is farther than its own k-th distance so far.

The k-th distance is propagated. First every query searches the shard it lies in; then it is sent
only to those shards whose box is nearer than what it has found, with that distance as the bound
to beat; the lists are merged. No neighbour is missed, whatever the sample was.

Queries are the rows that ``queries`` names (every row by default), points are all rows. Of equal vectors, only the k + 1 smallest
identifiers can be among anyone's k nearest, so only those are points: a hot vector costs k + 1 of them. A shard
has about ``SHARD_ROWS`` points, more when there would be over ``MAX_SHARDS`` shards, so
the shards' boxes, which all workers get, have a fixed largest size; a shard of more than ``PART_ROWS``
points is several trees, each over a part of its points, and its queries go to all of them. Queries stream past a
tree, in chunks that run at the same time. How many shards a query
visits depends on the data; without clusters in high dimension it is most of them, as for
every exact method.

Distances are Euclidean, computed from differences in double precision and compared together with the
identifier: ties go to the smaller one. Defined cases: rows with a null identifier or a null or
empty vector, or null, NaN or infinite components, are neither queries nor neighbours; a vector meets only
vectors of its own length; an identifier on several rows counts once, with the vector that sorts first;
a vector is no neighbour of itself, equal vectors of others are; with fewer than k others the list is shorter; an
empty table gives no rows; columns other than the identifier and the vector are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docquarry.runtime import checkpoint

SHARD_ROWS = 1 << 14
MAX_SHARDS = 1 << 11
PART_ROWS = 1 << 16
SAMPLE = 1 << 15
LEAF = 256
BLOCK = 256
CHUNK_ROWS = 1 << 17
FOUND = "vec_id long, neighbor_id long, d2 double"


class Tree:
    """KD-tree over the rows of ``x``; node i has children 2i+1 and 2i+2."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x = x
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(x)) / leaf))))
        size = (1 << (self.depth + 1)) - 1
        self.low = np.full((size, x.shape[1]), np.inf)
        self.high = np.full((size, x.shape[1]), -np.inf)
        self.rows: list[np.ndarray] = [np.zeros(0, np.int64)] * size
        self.norm = (x * x).sum(axis=1)
        at = {0: np.arange(len(x))}
        for node in range(size):
            rows = at.pop(node)
            if len(rows):
                self.low[node], self.high[node] = x[rows].min(axis=0), x[rows].max(axis=0)
            if 2 * node + 2 < size:
                mid = len(rows) // 2
                if len(rows):
                    rows = rows[np.argpartition(x[rows, int((self.high[node] - self.low[node]).argmax())], mid)]
                at[2 * node + 1], at[2 * node + 2] = rows[:mid], rows[mid:]
            else:
                self.rows[node] = rows

    def bounds(self, q: np.ndarray, node: int) -> np.ndarray:
        return gaps(q, self.low[node], self.high[node])


def gaps(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each row of ``q`` to a box; infinite to an empty one."""
    if low[0] > high[0]:
        return np.full(len(q), np.inf)
    return (np.maximum(0, np.maximum(low - q, q - high)) ** 2).sum(axis=1)


def search(tree: Tree, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, beat: np.ndarray):
    """(distances², identifiers) of the k nearest of each query, as rows padded with infinity.

    Nothing beyond ``beat`` is looked for; a row of the identifier ``own`` does not count.
    """
    n = len(q)
    best = np.full((n, k), np.inf)
    near = np.full((n, k), np.iinfo(np.int64).max)
    norm = (q * q).sum(axis=1)
    heap = [(0.0, 0, tree.bounds(q, 0))]
    while heap:
        _, node, bound = heapq.heappop(heap)
        reach = np.minimum(beat, best[:, -1])
        rows = np.flatnonzero(bound <= reach)
        if not len(rows):
            continue
        if 2 * node + 2 < len(tree.low):
            for child in (2 * node + 1, 2 * node + 2):
                b = np.full(n, np.inf)
                b[rows] = tree.bounds(q[rows], child)
                b[b > reach] = np.inf
                least = float(b.min())
                if least < np.inf:
                    heapq.heappush(heap, (least, child, b))
            continue
        there = tree.rows[node]
        rough = norm[rows, None] + tree.norm[there] - 2 * (q[rows] @ tree.x[there].T)
        slack = 1e-9 * (norm[rows, None] + tree.norm[there] + 1)
        i, j = np.nonzero((rough <= reach[rows, None] + slack) & (ids[there] != own[rows, None]))
        if not len(i):
            continue
        # The rough distances only narrow down; what counts is taken from differences.
        if len(i) > 8 * k * len(rows):
            kth = np.partition(rough, min(k + 1, rough.shape[1] - 1), axis=1)[:, min(k + 1, rough.shape[1] - 1)]
            keep = rough[i, j] <= kth[i] + 2 * slack[i, j]
            i, j = i[keep], j[keep]
        exact = ((q[rows[i]] - tree.x[there[j]]) ** 2).sum(axis=1)
        hit = np.unique(rows[i])
        d = np.concatenate([exact, best[hit].ravel()])
        m = np.concatenate([ids[there[j]], near[hit].ravel()])
        who = np.concatenate([rows[i], np.repeat(hit, k)])
        order = np.lexsort((m, d, who))
        who, d, m = who[order], d[order], m[order]
        first = np.searchsorted(who, hit)
        take = first[:, None] + np.arange(k)
        best[hit], near[hit] = d[take], m[take]
    return best, near


def _found(own, best, near, beat):
    i, j = np.nonzero((best <= beat[:, None]) & np.isfinite(best))
    return pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(near[i, j]), pa.array(best[i, j])], names=["vec_id", "neighbor_id", "d2"])


def _matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), np.float64).reshape(-1, dim)


def splits(sample: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """(dimension, value) of the ``2**depth - 1`` median splits of the sample."""
    out, at = [], {0: sample}
    for node in range((1 << depth) - 1):
        x = at.pop(node)
        d = int((x.max(axis=0) - x.min(axis=0)).argmax()) if len(x) else 0
        v = float(np.median(x[:, d])) if len(x) else 0.0
        out.append((d, v))
        at[2 * node + 1], at[2 * node + 2] = x[x[:, d] < v], x[x[:, d] >= v]
    return out


def _dealer(cuts: dict[int, list[tuple[int, float]]]):
    def run(batches):
        for b in batches:
            dims = np.asarray(b.column("dim"))
            shard = np.zeros(b.num_rows, np.int64)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                x = _matrix(b.column("v").take(pa.array(rows)), int(dim))
                node = np.zeros(len(rows), np.int64)
                tree = cuts.get(int(dim), [])
                if tree:
                    d, v = np.array([c[0] for c in tree]), np.array([c[1] for c in tree])
                    while node[0] < len(tree):
                        node = 2 * node + 1 + (x[np.arange(len(x)), d[node]] >= v[node])
                shard[rows] = node
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard)], names=[*b.schema.names, "shard"])

    return run


def neighbors(
    vectors: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, chunk_rows: int = CHUNK_ROWS, queries: str = "true", max_shards: int = MAX_SHARDS, part_rows: int = PART_ROWS
) -> DataFrame:
    """(vec_id, rank, neighbor_id, distance): the k nearest others of every query, from rank 1.

    ``queries`` is a condition on the identifier, called vec_id in it.
    """
    v = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0")
    v = v.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    v = v.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    v = checkpoint(v)
    cuts: dict[int, list[tuple[int, float]]] = {}
    for r in v.groupBy("dim").count().collect():  # one row for each length of vectors
        shards = min(max_shards, max(1, r["count"] // shard_rows))
        depth = int(np.ceil(np.log2(shards)))
        if depth:
            part = v.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
            cuts[r["dim"]] = splits(_matrix(part.column("v"), r["dim"]), depth)
    equal = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    points = v.withColumn("equal", equal).where(F.col("equal") <= k + 1).select("vec_id", "v", "dim")
    points = checkpoint(points.mapInArrow(_dealer(cuts), "vec_id long, v array<double>, dim int, shard long"))
    # A row a shard, so ``max_shards`` for each length of vectors.
    parts = F.broadcast(points.groupBy("dim", "shard").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts")))
    points = points.join(parts, ["dim", "shard"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
    asked = v.where(queries).mapInArrow(_dealer(cuts), "vec_id long, v array<double>, dim int, shard long")
    asked = checkpoint(asked.withColumn("kth", F.lit(float("inf"))))
    rank = F.row_number().over(W.partitionBy("vec_id").orderBy("d2", "neighbor_id"))
    found = checkpoint(_visit(points, asked, parts, k, chunk_rows).withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"))
    if any(cuts.values()):
        kth = found.groupBy("vec_id").agg(F.max("d2").alias("far"), F.count("*").alias("n")).where(F.col("n") >= k).select("vec_id", "far")
        asked = asked.join(kth, "vec_id", "left").withColumn("kth", F.coalesce("far", "kth")).drop("far")
        found = found.unionByName(_visit(points, _sent(points, asked), parts, k, chunk_rows))
    out = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("vec_id", "rank", "neighbor_id", F.sqrt("d2").alias("distance"))


def _boxes(batches):
    """The tight box of each shard's part in this partition."""
    low: dict[tuple[int, int], np.ndarray] = {}
    high: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        dims, shard = np.asarray(b.column("dim")), np.asarray(b.column("shard"))
        for dim, s in {*zip(dims.tolist(), shard.tolist())}:
            x = _matrix(b.column("v").take(pa.array(np.flatnonzero((dims == dim) & (shard == s)))), dim)
            key = dim, s
            low[key] = np.minimum(low.get(key, np.inf), x.min(axis=0))
            high[key] = np.maximum(high.get(key, -np.inf), x.max(axis=0))
    keys = list(low)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64()), pa.array([low[k].tolist() for k in keys], pa.list_(pa.float64())), pa.array([high[k].tolist() for k in keys], pa.list_(pa.float64()))],
        names=["dim", "shard", "low", "high"],
    )


def _sent(points: DataFrame, asked: DataFrame) -> DataFrame:
    """Each query for every shard but its own whose box is within its k-th distance."""
    held = points.select("dim", "shard", "v").mapInArrow(_boxes, "dim int, shard long, low array<double>, high array<double>")
    each = held.select("dim", "shard", F.posexplode(F.arrays_zip("low", "high")).alias("i", "x")).groupBy("dim", "shard", "i").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    got = each.orderBy("dim", "shard", "i").toPandas()  # a row a shard and dimension
    for dim, own in got.groupby("dim"):
        dim = int(dim)
        boxes[dim] = own.shard.to_numpy()[::dim], own.low.to_numpy().reshape(-1, dim), own.high.to_numpy().reshape(-1, dim)

    def route(batches):
        for b in batches:
            dims, shard, kth = np.asarray(b.column("dim")), np.asarray(b.column("shard")), np.asarray(b.column("kth"))
            rows, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                x = _matrix(b.column("v").take(pa.array(own)), dim)
                for s, low, high in zip(*boxes[dim]):
                    go = own[(shard[own] != s) & (gaps(x, low, high) <= kth[own])]
                    rows.append(go), to.append(np.full(len(go), s))
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(at), b.column("v").take(at), b.column("dim").take(at), pa.array(np.concatenate(to)), b.column("kth").take(at)], names=["vec_id", "v", "dim", "shard", "kth"])

    columns = ["vec_id", "v", "dim", "shard", "kth"]
    return asked.select(columns).mapInArrow(route, "vec_id long, v array<double>, dim int, shard long, kth double")


def _visit(points: DataFrame, queries: DataFrame, parts: DataFrame, k: int, chunk_rows: int) -> DataFrame:
    """The k nearest points, within ``kth``, that each query finds in each part of the shard it is sent to."""
    columns = ["dim", "shard", "part", "chunk", "kind", "vec_id", "v", "kth"]
    queries = queries.join(parts, ["dim", "shard"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    # A row a shard and part; the points of a part go along with every chunk of its queries.
    load = queries.groupBy("dim", "shard", "part").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks"))
    asked = queries.join(load, ["dim", "shard", "part"]).withColumns({"chunk": F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int"), "kind": F.lit(1)})
    held = points.join(load, ["dim", "shard", "part"]).withColumns({"chunk": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), "kind": F.lit(0), "kth": F.lit(None).cast("double")})
    both = held.select(columns).unionByName(asked.select(columns)).repartition("dim", "shard", "part", "chunk").sortWithinPartitions("dim", "shard", "part", "chunk", "kind")

    def run(batches):
        """A group's points come before its queries; the tree is built when the first query comes."""
        at, tree, held, ids = None, None, [], None
        for b in batches:
            keys = np.stack([np.asarray(b.column(c)).astype(np.int64) for c in ("dim", "shard", "part", "chunk", "kind")], axis=1)
            turns = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else []
            for start, end in zip(turns, [*turns[1:], len(keys)]):
                *group, kind = keys[start].tolist()
                if group != at:
                    at, tree, held = group, None, []
                rows = b.slice(start, end - start)
                if kind == 0:
                    held.append((np.asarray(rows.column("vec_id")), _matrix(rows.column("v"), group[0])))
                    continue
                if tree is None and not held:
                    continue
                if tree is None:
                    ids, tree = np.concatenate([i for i, _ in held]), Tree(np.concatenate([x for _, x in held]))
                    held = []
                q, own, beat = _matrix(rows.column("v"), group[0]), np.asarray(rows.column("vec_id")), np.asarray(rows.column("kth"))
                for s in range(0, len(q), BLOCK):
                    part = slice(s, s + BLOCK)
                    best, near = search(tree, ids, q[part], own[part], k, beat[part])
                    yield _found(own[part], best, near, beat[part])

    return both.mapInArrow(run, FOUND)


#: The identifiers whose vectors :data:`ORACLE` and the registered query search for.
ASKED = "vec_id % 100 = 0"
ORACLE = f"""
WITH v AS (SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 GROUP BY vec_id),
 d AS (SELECT a.vec_id, b.vec_id AS neighbor_id, list_distance(a.v, b.v) AS d FROM (SELECT * FROM v WHERE {ASKED}) a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
 r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), neighbor_id) AS rank FROM d)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor_id, round(d, 5) AS distance FROM r WHERE rank <= 10
"""
