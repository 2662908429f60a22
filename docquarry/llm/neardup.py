"""Near-duplicate documents by b-bit MinHash and a multi-index Hamming join.

A document's shingles are its pairs of neighbouring words (lower case, without punctuation at
the edges). Its signature has ``POSITIONS`` values of 16 bits, the low bits of as many
independent minima over the shingles. Two documents are linked when their signatures differ in
at most ``RADIUS`` positions; at 22 of 64 that is an estimated Jaccard similarity of 0.66.

The join misses no link. The positions are split in ``CHUNKS`` chunks; by the pigeonhole
principle two signatures within the radius differ in at most one position of some chunk (11
chunks with two differences each and one with one would already make 23). So a signature is
filed, for every chunk and every one of its positions, under the chunk's other values: one key
for each position, 64 in all. A pair within the radius shares a key.

Nothing is squared that need not be. Equal signatures are one node. The nodes of a key are
first held against the key's least node only; those within half the radius of one make a ball
around it, and by the triangle inequality the nodes of a ball are all linked. What is left are
pairs of nodes of different balls under a key, verified on the whole signature and counted under the first of
the keys that they share. A key with more than ``TILE`` nodes is dealt to tiles, where its
largest ball meets the other nodes but never itself; no key is ever held by one task.

Defined cases: rows that share identifier and text are one document, rows that share only the
identifier are documents of their own (classes with the same smallest identifier then share it as their name); a document without words (null, empty, punctuation only)
has no signature, no links and a class of its own; one with a single word has that word as its
shingle; null identifiers are left out; an empty table gives no rows; columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.components import components
from docquarry.llm.tiles import cuts, ragged, tiled, whole_groups
from docquarry.llm.words import mix, numbered, slices, split, word_hashes
from docquarry.runtime import checkpoint

POSITIONS, RADIUS, CHUNKS = 64, 22, 12
TILE = 2048
PAIRS = 1 << 17
EDGES = ".,;:!?\"'()[]{}<>|#$%&*+-=/\\_~`^@"
_RNG = np.random.default_rng(20240607)
_XOR = _RNG.integers(0, 1 << 32, POSITIONS, dtype=np.uint64).astype(np.uint32)
_MUL = (_RNG.integers(0, 1 << 32, POSITIONS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def shingles(words: pa.Array, codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each distinct shingle, ordered by document."""
    plain = pc.utf8_trim(pc.utf8_lower(words), characters=EDGES)
    empty = np.asarray(pc.equal(pc.binary_length(plain), 0))
    if empty.any():
        full = ~empty[codes]
        codes, doc = codes[full], doc[full]
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = word_hashes(plain)[codes]
    inner = doc[1:] == doc[:-1]
    pairs = mix(h[:-1][inner] * np.uint64(3) + h[1:][inner])
    at = doc[1:][inner]
    alone = np.flatnonzero(np.r_[True, ~inner] & np.r_[~inner, True])
    pairs, at = np.r_[pairs, h[alone]], np.r_[at, doc[alone]]
    order = np.argsort(at, kind="stable")
    return at[order], pairs[order]


def minima(at: np.ndarray, hashes: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents that have any shingle, their signatures as rows of 16-bit values)."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros((0, POSITIONS), np.uint16)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first), POSITIONS), np.uint16)
    x = np.empty_like(h)
    y = np.empty_like(h)
    for k in range(POSITIONS):
        np.bitwise_xor(h, _XOR[k], out=x)
        np.multiply(x, _MUL[k], out=x)
        np.right_shift(x, 15, out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint32(0x2C1B3C6D), out=x)
        low = np.minimum.reduceat(x, first)
        out[:, k] = (low ^ (low >> np.uint32(16))).astype(np.uint16)
    return at[first], out


def _signatures(batches):
    for b in slices(batches, "text"):
        s = split(b.column("text"))
        docs, sig = minima(*shingles(s.words, s.codes, s.doc), b.num_rows)
        flat = pa.array(np.ascontiguousarray(sig).view(np.uint8).ravel())
        sigs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(POSITIONS * 2), len(sig), [None, flat.buffers()[1]]).cast(pa.binary())
        at = np.full(b.num_rows, -1)
        at[docs] = np.arange(len(docs))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), sigs.take(pa.array(at, mask=at < 0))], names=["doc_id", "row", "sig"])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, row, sig): one row for each identifier and text; ``row`` is the text's hash, ``sig`` null without words."""
    d = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.withColumn("row", F.xxhash64("text")).mapInArrow(_signatures, "doc_id long, row long, sig binary").dropDuplicates(["doc_id", "row"])


def chunks(positions: int = POSITIONS, n: int = CHUNKS) -> list[list[int]]:
    return [list(map(int, c)) for c in np.array_split(np.arange(positions), n)]


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, POSITIONS)


def _keys(batches):
    """Files each signature under every chunk without one of its positions; the low six bits are the position."""
    parts = chunks()
    for b in batches:
        if not b.num_rows:
            continue
        sig = _matrix(b.column("sig")).astype(np.uint64)
        tagged = mix(sig * np.uint64(POSITIONS) + np.arange(POSITIONS, dtype=np.uint64))
        keys = np.empty((len(sig), POSITIONS), np.uint64)
        for chunk in parts:
            whole = tagged[:, chunk].sum(axis=1, dtype=np.uint64)
            for p in chunk:
                keys[:, p] = mix(whole - tagged[:, p] + np.uint64(p * 0x9E3779B97F4A7C15 % (1 << 64))) & ~np.uint64(63) | np.uint64(p)
        ids = np.repeat(np.asarray(b.column("node")), POSITIONS)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], names=["key", "node"])


def _close(batches):
    """Of pairs of nodes, those within half the radius."""
    for b in batches:
        if b.num_rows:
            near = (_matrix(b.column("sa")) != _matrix(b.column("sb"))).sum(axis=1) <= RADIUS // 2
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(near)) for c in (b.column("node"), b.column("lead"))], names=["node", "lead"])


def first_shared(differ: np.ndarray) -> np.ndarray:
    """The first position whose key two signatures share, for rows of where they differ (within the radius)."""
    begin = np.array([c[0] for c in chunks()])
    held = np.add.reduceat(differ, begin, axis=1, dtype=np.int64)
    at = (held <= 1).argmax(axis=1)
    inside = (np.arange(POSITIONS) >= begin[at][:, None]) & (np.arange(POSITIONS) < np.r_[begin[1:], POSITIONS][at][:, None])
    return np.where(held[np.arange(len(at)), at] == 0, begin[at], (differ & inside).argmax(axis=1))


def _cross(batches):
    """Links between nodes of different balls that meet in a tile: (node, null, linked documents) and (ball, ball, null)."""
    for t in whole_groups(batches, ["key", "ti", "tj"]):
        key, ti, tj, side, ball, node, weight = (t[c].to_numpy().astype(np.int64) for c in ("key", "ti", "tj", "side", "ball", "node", "weight"))
        sig = _matrix(t["sig"])
        order = np.lexsort((ball, side, tj, ti, key))
        key, ti, tj, side, ball, node, weight, sig = (x[order] for x in (key, ti, tj, side, ball, node, weight, sig))
        n = len(key)
        tile = np.r_[True, (key[1:] != key[:-1]) | (ti[1:] != ti[:-1]) | (tj[1:] != tj[:-1])]
        run = tile | np.r_[True, (side[1:] != side[:-1]) | (ball[1:] != ball[:-1])]

        def ends(fresh):
            at = np.flatnonzero(fresh)
            return np.r_[at[1:], n][np.cumsum(fresh) - 1]

        stop = ends(tile)
        # On the diagonal, partners are the balls that come after; elsewhere the other side.
        start = np.where(ti == tj, ends(run), np.where(side == 0, ends(tile | np.r_[True, side[1:] != side[:-1]]), stop))
        count = stop - start
        linked = np.zeros(n, np.int64)
        balls = []
        for f, to in cuts(count, PAIRS):
            y, x = ragged(start[f:to], count[f:to])
            x = x + f
            other = ball[x] != ball[y]
            x, y = x[other], y[other]
            differ = sig[x] != sig[y]
            near = np.flatnonzero(differ.sum(axis=1) <= RADIUS)
            near = near[first_shared(differ[near]) == (key[x[near]] & 63)]
            x, y = x[near], y[near]
            linked += np.bincount(x, weight[y], n).astype(np.int64) + np.bincount(y, weight[x], n).astype(np.int64)
            balls.append(np.unique(np.stack([ball[x], ball[y]], axis=1), axis=0))
        pairs = np.unique(np.concatenate(balls), axis=0) if balls else np.zeros((0, 2), np.int64)
        has = np.flatnonzero(linked)
        blank = np.zeros(len(has), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[node[has], pairs[:, 0]]), pa.array(np.r_[blank, pairs[:, 1]], mask=np.arange(len(has) + len(pairs)) < len(has)), pa.array(np.r_[linked[has], np.zeros(len(pairs), np.int64)])],
            names=["a", "b", "n"],
        )


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, row, node) of every document, node null without a signature; (node, root, links) of every node)."""
    members = checkpoint(signatures(docs))
    signed = members.where("sig is not null")
    nodes = checkpoint(signed.groupBy("sig").agg(F.count("*").alias("weight")).withColumn("node", F.monotonically_increasing_id()))
    filed = nodes.select("sig", "node").mapInArrow(_keys, "key long, node long")
    lead = filed.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    filed = checkpoint(filed.join(lead, "key"))
    sig = nodes.select("node", "sig")
    pairs = filed.where("node <> lead").select("node", "lead").distinct()
    pairs = pairs.join(sig.withColumnRenamed("sig", "sa"), "node").join(sig.select(F.col("node").alias("lead"), F.col("sig").alias("sb")), "lead")
    balls = checkpoint(pairs.select("node", "lead", "sa", "sb").mapInArrow(_close, "node long, lead long").groupBy("node").agg(F.min("lead").alias("ball")))
    # A key all of whose nodes are of one ball has nothing left to verify.
    held = filed.select("key", "node").join(balls, "node", "left").select("key", "node", F.coalesce("ball", "node").alias("ball"))
    mixed = held.groupBy("key").agg(F.min("ball").alias("low"), F.max("ball").alias("high"), F.count("*").alias("size")).where("low <> high").select("key", "size")
    held = checkpoint(held.join(mixed, "key"))
    big = held.where(F.col("size") > TILE).groupBy("key", "ball").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("ball", "c").alias("largest"))
    rows = held.join(big, "key", "left").withColumn("main", F.coalesce(F.col("ball") == F.col("largest"), F.lit(False))).drop("largest", "size")
    rows = tiled(rows, "node", TILE).join(nodes, "node")
    met = rows.repartition("key", "ti", "tj").sortWithinPartitions("key", "ti", "tj").mapInArrow(_cross, "a long, b long, n long")
    met = checkpoint(met)
    edges = balls.select(F.col("node").alias("a"), F.col("ball").alias("b")).unionByName(met.where("b is not null").select("a", "b"))
    roots = components(edges)
    none = {c: F.lit(None).cast("long").alias(c) for c in ("weight", "ball", "links", "root")}
    parts = [
        nodes.select("node", "weight", none["ball"], none["links"], none["root"]),
        balls.select("node", none["weight"], "ball", none["links"], none["root"]),
        met.where("b is null").select(F.col("a").alias("node"), none["weight"], none["ball"], F.col("n").alias("links"), none["root"]),
        roots.select("node", none["weight"], none["ball"], none["links"], "root"),
    ]
    each = reduce(DataFrame.unionByName, parts).groupBy("node").agg(F.max("weight").alias("weight"), F.coalesce(F.max("ball"), "node").alias("ball"), F.coalesce(F.sum("links"), F.lit(0)).alias("cross"), F.coalesce(F.max("root"), "node").alias("root"))
    each = checkpoint(each)
    inside = each.groupBy("ball").agg(F.sum("weight").alias("inside"))
    each = each.join(inside, "ball").select("node", "root", (F.col("inside") - 1 + F.col("cross")).alias("links"))
    known = signed.join(sig, "sig").select("doc_id", "row", "node")
    return known.unionByName(members.where("sig is null").select("doc_id", "row", F.lit(None).cast("long").alias("node"))), each


def near_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links) for every document.

    A class is a component of the links, known by its smallest identifier; ``n_links`` is the exact
    number of other documents within the radius of this one, copies counted each.
    """
    members, nodes = _linked(docs)
    each = checkpoint(members.join(nodes, "node", "left"))
    least = each.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return each.join(least, "root", "left").select("doc_id", F.coalesce("least", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def drop_near(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without all but the smallest identifier (then text hash) of each class.

    Rows without a signature or an identifier stay, and so do repeated rows of the document that stays.
    """
    members, nodes = _linked(docs)
    each = checkpoint(members.join(nodes, "node").select("root", "doc_id", "row"))
    several = each.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    gone = each.join(several, "root").where("doc_id <> first.doc_id or row <> first.row").select(F.col("doc_id").alias("__doc"), F.col("row").alias("__row"))
    plain, names = numbered(docs, ("doc_id", "text"))
    at = (plain["doc_id"].cast("long") == gone["__doc"]) & (F.xxhash64(plain["text"].cast("string")) == gone["__row"])
    return plain.join(gone, at, "left_anti").toDF(*names)
