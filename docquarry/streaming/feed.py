"""Change feed, live-query deltas and last-write-wins merging.

A feed is a table (seq, coll, doc_id, op, version, ts, source, pushed). Versions are strings that
compare in time: 15 digits of milliseconds, the node, 12 digits of a counter.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.runtime import checkpoint, large

FEED = "seq long, coll string, doc_id string, op string, version string, ts long, source string, pushed boolean"


def make_version(ts_ms: Column, node: Column, seq: Column) -> Column:
    return F.concat(F.lpad(ts_ms.cast("string"), 15, "0"), F.lit(":"), node, F.lit(":"), F.lpad(seq.cast("string"), 12, "0"))


def feed_since(feed: DataFrame, since: int, coll: str | None = None, limit: int = 1000) -> DataFrame:
    """Entries after ``since`` in order."""
    rows = feed.where(F.col("seq") > since)
    return (rows.where(F.col("coll") == coll) if coll else rows).orderBy("seq").limit(limit)


def current_seq(feed: DataFrame) -> DataFrame:
    return feed.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("seq"))


def compact(feed: DataFrame, keep_last: int = 1000, syncing: bool = False) -> DataFrame:
    """Drops entries more than ``keep_last`` numbers back, but while syncing no local one that isn't pushed."""
    last = current_seq(feed).select((F.col("seq") - keep_last).alias("__floor"))
    stay = F.col("seq") > F.col("__floor")
    if syncing:
        stay = stay | ((F.col("source") == "local") & ~F.col("pushed"))
    return feed.crossJoin(F.broadcast(last)).where(stay).drop("__floor")  # one row


def pending(feed: DataFrame, docs: DataFrame | None = None, id_: str = "_id") -> DataFrame:
    """The latest local change of each document that isn't pushed; an upsert whose document is gone is a delete."""
    rest = [c for c in feed.columns if c not in ("coll", "doc_id")]
    last = feed.where("source = 'local' AND NOT pushed").groupBy("coll", "doc_id").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("coll", "doc_id", "r.*")
    if docs is not None:
        there = docs.select(F.col(id_).cast("string").alias("doc_id"), F.lit(True).alias("__there"))
        last = last.join(large(there), "doc_id", "left").withColumn("op", F.when(F.col("__there").isNull(), "delete").otherwise(F.col("op"))).drop("__there")
    return last.select(*feed.columns)


def mark_pushed(feed: DataFrame, done: DataFrame) -> DataFrame:
    """``done`` (coll, doc_id, seq): local entries of those documents up to that number count as pushed."""
    upto = done.groupBy("coll", "doc_id").agg(F.max("seq").alias("__upto"))
    out = feed.join(large(upto), ["coll", "doc_id"], "left").withColumn("pushed", F.col("pushed") | F.coalesce(F.col("seq") <= F.col("__upto"), F.lit(False)))
    return out.select(*feed.columns)


def merge_lww(local: DataFrame, remote: DataFrame, id_: str = "_id", version: str = "version", deleted: str = "deleted") -> DataFrame:
    """The merged state with ``outcome``: local, applied, echo, remote (it won), local_won.

    The greater version string wins; of several remote changes to a document only the last counts. A
    deletion stays as a row with ``deleted`` true, so that an older upsert cannot bring it back.
    """
    rest = [c for c in local.columns if c != id_]
    newest = remote.groupBy(id_).agg(F.max_by(F.struct(*rest), version).alias("__remote"))
    have = local.select(id_, F.struct(*rest).alias("__local"))
    both = have.join(newest, id_, "full")
    lv, rv = F.col(f"__local.{version}"), F.col(f"__remote.{version}")
    outcome = F.when(F.col("__remote").isNull(), "local").when(F.col("__local").isNull(), "applied").when(lv == rv, "echo").when(rv > lv, "remote").otherwise("local_won")
    both = both.withColumn("outcome", outcome)
    chosen = F.when(F.col("outcome").isin("applied", "remote"), F.col("__remote")).otherwise(F.col("__local"))
    return both.withColumn("__c", chosen).select(id_, "__c.*", "outcome")


def live_delta(before: DataFrame, after: DataFrame, id_: str = "_id", touched: DataFrame | None = None, order: list[Column] | None = None, fields: list[str] | None = None) -> DataFrame:
    """(_id, change, changed_fields) between two results of one query: added, removed, changed, moved.

    ``changed`` are survivors that ``touched`` names (by default those that differ). ``moved`` are survivors whose rank among
    survivors differs. With ``fields``, changes that touch none of them are left out.
    """
    values = [c for c in before.columns if c != id_]

    def side(df: DataFrame, name: str, other: DataFrame) -> DataFrame:
        rows = df.select(id_, F.struct(*values).alias(name))
        if not order:
            return rows
        survivors = df.join(other.select(id_), id_, "left_semi")
        return rows.join(ranks(survivors, [*order, F.col(id_)], f"{name}_rank").select(id_, f"{name}_rank"), id_, "left")

    both = side(before, "__b", after).join(side(after, "__a", before), id_, "full")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"__b.{c}").eqNullSafe(F.col(f"__a.{c}")), F.lit(c)) for c in values]))
    both = both.withColumn("changed_fields", F.when(F.col("__b").isNotNull() & F.col("__a").isNotNull(), differ).otherwise(F.array().cast("array<string>")))
    if touched is not None:
        both = both.join(touched.select(F.col(id_), F.lit(True).alias("__touched")).distinct(), id_, "left")
        hit = F.col("__touched").isNotNull()
    else:
        hit = F.size("changed_fields") > 0
    survived = F.col("__b").isNotNull() & F.col("__a").isNotNull()
    changed = survived & hit
    if fields is not None:
        changed = changed & F.arrays_overlap("changed_fields", F.array(*map(F.lit, fields)))
    kinds = [F.when(F.col("__b").isNull(), "added"), F.when(F.col("__a").isNull(), "removed"), F.when(changed, "changed")]
    if order:
        kinds.append(F.when(survived & (F.col("__b_rank") != F.col("__a_rank")), "moved"))
    return both.withColumn("change", F.explode(F.array_compact(F.array(*kinds)))).select(id_, "change", "changed_fields")


def ranks(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``, its place from 0 in ``order``: rows are sorted over all tasks, and each task counts on from those before it."""
    numbered = checkpoint(df.orderBy(*order).withColumn("__i", F.monotonically_increasing_id()), free=False)
    task = F.shiftright("__i", 33).cast("int")
    held = {r.p: r.n for r in numbered.groupBy(task.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row a task
    before = [0]
    for p in range(max(held, default=0)):
        before.append(before[-1] + held.get(p, 0))
    place = F.get(F.array(*map(F.lit, before)), task) + F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn(name, place.cast("long")).drop("__i")


def changes(spark: SparkSession, path: str, since: int = 0) -> DataFrame:
    """The feed under ``path`` as a stream of entries after ``since``; a checkpoint makes it resumable.

    Only whole commits are ever moved there.
    """
    return spark.readStream.schema(T.StructType.fromDDL(FEED)).option("recursiveFileLookup", "true").parquet(path).where(F.col("seq") > since)


def relevant(before: DataFrame, touched: DataFrame, result: DataFrame, id_: str = "_id", most: int = 500) -> bool:
    """Whether changed documents can change a live result: one is a member, or matches now. More than ``most`` always may."""
    if len(touched.limit(most + 1).collect()) > most:
        return True
    few = F.broadcast(touched)  # ``most`` rows
    return not before.join(few, id_, "left_semi").isEmpty() or not result.join(few, id_, "left_semi").isEmpty()


def watch(
    spark: SparkSession,
    path: str,
    result: Callable[[], DataFrame],
    callback: Callable[[str, DataFrame], None],
    checkpoint_dir: str,
    id_: str = "_id",
    trigger: dict | None = None,
    coll: str | None = None,
    seq: int = 0,
    **options,
):
    """Calls back with ("init", rows), then ("delta", changes) for each batch of the feed that changes the result.

    ``result`` runs the query anew, once for all entries that a batch holds (``trigger`` says how long they are gathered:
    ``{"processingTime": "1 second"}``; what there is, then an end, by default) and only if they can matter. The state between batches is a written table, so that a
    watch started again with the same ``checkpoint_dir`` goes on with the changes since; a batch that is run again calls back again.
    ``seq`` is the feed's last number when the watch began: what came before is in the first result.
    """
    state = f"{checkpoint_dir}/state"
    os.makedirs(state, exist_ok=True)

    def held(n: int) -> tuple[str, int]:
        with open(f"{state}/{n}.json") as f:
            x = json.load(f)
        return x["dir"], x["seq"]

    def hold(n: int, at: str, seq: int) -> None:
        with open(f"{state}/{n}.new", "w") as f:
            json.dump({"dir": at, "seq": seq}, f)
        os.replace(f"{state}/{n}.new", f"{state}/{n}.json")

    last = max((int(f[:-5]) for f in os.listdir(state) if f.endswith(".json")), default=None)
    if last is None:
        result().write.mode("overwrite").parquet(f"{state}/0")
        hold(0, f"{state}/0", seq)
        last = 0
    callback("init", spark.read.parquet(held(last)[0]))

    def batch(entries: DataFrame, n: int) -> None:
        at, since = held(n)
        before = spark.read.parquet(at)
        fresh = checkpoint(entries.where(F.col("seq") > since).groupBy(F.col("doc_id").alias(id_)).agg(F.max("seq").alias("seq")), free=False)
        since = fresh.agg(F.max("seq")).first()[0] or since
        touched = fresh.select(id_)
        if not relevant(before, touched, result(), id_):
            hold(n + 1, at, since)
            return
        to = f"{state}/{n + 1}"
        result().write.mode("overwrite").parquet(to)
        delta = live_delta(before, spark.read.parquet(to), id_, touched, **options)
        if not delta.isEmpty():
            callback("delta", delta)
        hold(n + 1, to, since)

    os.makedirs(path, exist_ok=True)
    entries = changes(spark, path)
    entries = entries.where(F.col("coll") == coll) if coll else entries
    return entries.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint_dir}/stream").trigger(**(trigger or {"availableNow": True})).start()


def watch_doc(spark: SparkSession, path: str, find: Callable[[], dict | None], id_value: str, callback: Callable[[dict | None], None], checkpoint_dir: str, trigger: dict | None = None, coll: str | None = None, seq: int = 0):
    """Calls back with the document now and after every change of it since ``seq``; with None when it is absent."""
    callback(find())

    def batch(entries: DataFrame, n: int) -> None:
        if not entries.where(F.col("doc_id") == id_value).isEmpty():
            callback(find())

    os.makedirs(path, exist_ok=True)
    entries = changes(spark, path, seq)
    entries = entries.where(F.col("coll") == coll) if coll else entries
    return entries.where(F.col("doc_id") == id_value).writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint_dir}/stream").trigger(**(trigger or {"availableNow": True})).start()
