"""Exact de-duplication by a tree merge of sorted digest runs.

Every partition of the documents makes one run: (digest, proof, doc_id, copies), sorted by
digest, with one entry for each distinct text and the smallest identifier seen for it. Runs are
then exchanged in binomial rounds, whose stride doubles: in a round, partitions that differ in
one bit of their number swap the parts of their runs by the matching bit of the digest, and each
merges the sorted runs it gets, keeping the verified smallest identifier again. After the last
round every partition owns one range of digests and nothing is left to compare. An entry moves
once a round, a partition never holds more than its share, and no partition sees a whole table.
With a larger ``fan_in`` several bits go in one round.

The digest that orders a run has 64 bits. Two entries merge only when their proof agrees too:
the SHA-256 of the text and its length, so a collision of digests never joins two texts.

Defined cases: null texts equal one another (as in GROUP BY) and differ from empty ones; a null
identifier counts as larger than any other, the largest long too; repeated rows are copies; an empty table gives no
rows; columns other than doc_id and text are ignored, and come back as they were under any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.words import numbered

RUN = "d long, v binary, doc_id long, n long"
_ARROW = pa.schema([("d", pa.int64()), ("v", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64())])
_LAST = np.iinfo(np.int64).max


def proof():
    """The digest columns of a text: what orders a run, and what proves two texts equal."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sign = F.when(F.col("text").isNull(), F.lit("0")).otherwise(F.lit("1"))
    return (
        F.xxhash64(text, sign).alias("d"),
        F.unhex(F.concat(F.sha2(text, 256), F.lpad(F.hex(F.length(text)), 8, "0"), F.lit("0"), sign)).alias("v"),
    )


def _merge(batches):
    """Merges the runs that reached this partition; one entry a text, smallest doc_id, all copies."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts).combine_chunks()
    d = t["d"].to_numpy()
    # What arrives is a row of sorted runs; a stable sort (timsort) finds them and merges them.
    order = np.argsort(d, kind="stable")
    d = d[order]
    v = t["v"].take(pa.array(order)).to_pylist()
    got = t["doc_id"].take(pa.array(order))
    known = np.asarray(got.is_valid())
    ids = np.where(known, np.asarray(got.fill_null(0)), _LAST)
    n = t["n"].to_numpy()[order]
    fresh = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
    keep, least, some, copies = [], [], [], []
    for start, end in zip(fresh.tolist(), [*fresh[1:].tolist(), len(d)]):
        if end - start == 1:
            keep.append(start), least.append(ids[start]), some.append(known[start]), copies.append(n[start])
            continue
        seen: dict[bytes, int] = {}
        for i in range(start, end):
            at = seen.get(v[i])
            if at is None:
                seen[v[i]] = len(keep)
                keep.append(i), least.append(ids[i]), some.append(known[i]), copies.append(n[i])
            else:
                least[at] = min(least[at], ids[i])
                some[at] = some[at] or known[i]
                copies[at] += n[i]
    yield pa.RecordBatch.from_arrays(
        [pa.array(d[keep]), pa.array([v[i] for i in keep], pa.binary()), pa.array(np.asarray(least, np.int64), mask=~np.asarray(some, bool)), pa.array(np.asarray(copies, np.int64))],
        schema=_ARROW,
    )


def tree_merge(docs: DataFrame, fan_in: int = 2, ranges: int | None = None) -> DataFrame:
    """One row (d, v, doc_id, n) for each distinct text: the smallest doc_id, and how many rows hold it.

    ``ranges`` is the number of digest ranges at the end, rounded up to a power of ``fan_in``;
    by default the session's shuffle partitions. ``fan_in`` is a power of two.
    """
    spark = docs.sparkSession
    bits = max(1, fan_in.bit_length() - 1)
    wanted = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rounds = max(1, -(-max(1, (wanted - 1).bit_length()) // bits))
    total = 1 << (bits * rounds)
    run = docs.select(*proof(), F.col("doc_id").cast("long").alias("doc_id"), F.lit(1).cast("long").alias("n")).sortWithinPartitions("d").mapInArrow(_merge, RUN)
    # A partition past the last range starts at its number modulo the ranges.
    run = run.withColumn("p", F.pmod(F.spark_partition_id(), F.lit(total)))
    for r in range(rounds):
        low = r * bits
        mask = ((1 << bits) - 1) << low
        target = F.col("p").bitwiseAND(F.lit(total - 1 - mask)).bitwiseOR(F.col("d").bitwiseAND(F.lit(mask).cast("long")).cast("int"))
        run = run.withColumn("p", target.cast("int")).repartitionById(total, "p").drop("p").mapInArrow(_merge, RUN)
        run = run.withColumn("p", F.spark_partition_id())
    return run.drop("p")


def exact_dedup(docs: DataFrame, fan_in: int = 2) -> DataFrame:
    """(doc_id, n_copies): the documents that stay, one for each distinct text."""
    return tree_merge(docs, fan_in).select("doc_id", F.col("n").alias("n_copies"))


def drop_copies(docs: DataFrame, fan_in: int = 2) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with the columns of ``docs``.

    Repeated rows of one identifier and text leave one row.
    """
    kept = tree_merge(docs, fan_in).select(F.col("d").alias("__d"), F.col("v").alias("__v"), F.col("doc_id").alias("__i"))
    plain, names = numbered(docs, ("doc_id", "text"))
    own = plain.columns
    d, v = proof()
    marked = plain.withColumns({"__d": d, "__v": v, "__i": F.col("doc_id").cast("long")})
    at = (marked["__d"] == kept["__d"]) & (marked["__v"] == kept["__v"]) & marked["__i"].eqNullSafe(kept["__i"])
    return marked.join(kept, at, "left_semi").dropDuplicates(["__d", "__v", "__i"]).select(own).toDF(*names)
