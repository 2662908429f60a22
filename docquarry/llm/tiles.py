"""Pairs under a key without a task that holds the key: rows are dealt to tiles of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiled(rows: DataFrame, row: str, block: int) -> DataFrame:
    """``rows`` (key, main, ...) with ``ti``, ``tj`` and ``side``, each as often as it has tiles to stand in.

    Any two rows of a key meet in exactly one tile, but for two ``main`` ones of a key with more than
    ``block`` rows, which meet in none. On the diagonal (ti = tj) all rows of a tile meet,
    elsewhere those of side 0 meet those of side 1. A tile has about ``2 * block`` rows at most.
    """
    sizes = rows.groupBy("key").agg(F.count_if("main").alias("m"), F.count_if(~F.col("main")).alias("r")).where(F.col("m") + F.col("r") > block)
    sizes = sizes.select("key", F.greatest(F.ceil(F.col("r") / block), F.lit(1)).cast("int").alias("nr"), F.ceil(F.col("m") / block).cast("int").alias("nm"))
    out = rows.join(sizes, "key", "left")
    own = F.pmod(F.xxhash64(row), F.when(F.col("main"), F.col("nm")).otherwise(F.col("nr"))).cast("int")
    out = out.withColumn("own", own)
    zero = F.lit(0).cast("int")

    def tile(i, j, side):
        return F.struct(i.cast("int").alias("ti"), j.cast("int").alias("tj"), side.cast("int").alias("side"))

    own, nr, nm = F.col("own"), F.col("nr"), F.col("nm")
    rest = F.transform(F.sequence(zero, nr - 1), lambda j: tile(F.least(own, j), F.greatest(own, j), (own > j)))
    others = F.when(nm > 0, F.transform(F.sequence(zero, F.greatest(nm - 1, zero)), lambda j: tile(own, nr + j, zero))).otherwise(F.expr("array()").cast("array<struct<ti:int,tj:int,side:int>>"))
    main = F.transform(F.sequence(zero, nr - 1), lambda i: tile(i, nr + own, F.lit(1)))
    places = F.when(nr.isNull(), F.array(tile(zero, zero, zero))).when(F.col("main"), main).otherwise(F.concat(rest, others))
    return out.withColumn("tile", F.explode(places)).select(*[F.col(c) for c in rows.columns], "tile.ti", "tile.tj", "tile.side")


def whole_groups(batches, columns: list[str], rows: int = 1 << 14):
    """Tables of about ``rows`` rows, cut only where ``columns`` change; the batches come ordered by them."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        turn = np.zeros(len(t) - 1, bool)
        for c in columns:
            x = t[c].to_numpy()
            turn |= x[1:] != x[:-1]
        last = np.flatnonzero(turn)
        if len(last):
            yield t.slice(0, last[-1] + 1)
            t = t.slice(last[-1] + 1).combine_chunks()
        held, size = t.to_batches(), len(t)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def ragged(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places start, start + 1, ..., of each row in turn; the row of each)."""
    row = np.repeat(np.arange(len(size)), size)
    return np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + start[row], row


def cuts(size: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Stretches of rows whose sizes come to about ``most``, without those that have none."""
    if not len(size) or not size.any():
        return []
    group = np.cumsum(size) // most
    at = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(size)]
    return [(f, to) for f, to in zip(at, at[1:]) if size[f:to].any()]
