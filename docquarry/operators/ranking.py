"""Sorted sets, rate windows and latest-row-per-key, as window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _order(score: str, member: str, rev: bool):
    return [F.desc(score), F.desc(member)] if rev else [F.asc(score), F.asc(member)]


def zrank(df: DataFrame, keys: list[str], member: str, score: str, rev: bool = False) -> DataFrame:
    """``rank`` from 0 by score, ties by member; reversed, both fall."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*_order(score, member, rev))) - 1)


def zrange(df: DataFrame, keys: list[str], member: str, score: str, start: int, stop: int, rev: bool = False) -> DataFrame:
    """Ranks ``start`` to ``stop``, both included; negative ones count from the end."""
    ranked = zrank(df, keys, member, score, rev).withColumn("__n", F.count("*").over(W.partitionBy(*keys)))
    low, high = (F.lit(int(x)) if x >= 0 else F.col("__n") + int(x) for x in (start, stop))
    return ranked.where((F.col("rank") >= low) & (F.col("rank") <= high)).drop("__n")


def zrange_by_score(df: DataFrame, score: str, member: str, low: float, high: float) -> DataFrame:
    return df.where(F.col(score).between(low, high)).orderBy(score, member)


def latest_per_key(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The whole row with the greatest ``by`` of each key, by one aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(by)).alias("__r")).select(*keys, "__r.*")


def rate_window(df: DataFrame, keys: list[str], at_ms: str, window_ms: int) -> DataFrame:
    """``in_window``: how many starts lie in the ``window_ms`` that end with each row; a row without a time has none.

    Time is parted in stretches of the window's length, and a row also counts in the stretch after its own: so a
    key with most of the rows is as many groups as it has stretches.
    """
    own = F.floor(F.col(at_ms) / window_ms).cast("long")
    parts = df.withColumn("__p", F.explode(F.array(F.struct(own.alias("b"), F.lit(True).alias("own")), F.struct((own + 1).alias("b"), F.lit(False).alias("own")))))
    held = F.count(F.col(at_ms)).over(W.partitionBy(*keys, "__p.b").orderBy(at_ms).rangeBetween(-window_ms + 1, 0))
    return parts.withColumn("in_window", held).where("__p.own").drop("__p")


def counts_by_status(df: DataFrame, status: str, all_statuses: list[str]) -> DataFrame:
    """A row for each status, 0 where there are no rows."""
    held = df.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    wanted = df.sparkSession.createDataFrame([(s,) for s in all_statuses], "status string")
    return wanted.join(held, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
