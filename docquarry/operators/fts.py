"""A full-text index: postings written once, so that a search reads its own words only.

Postings (term, ids, where the positions in each end, all positions) lie in folders by a digest of the term, sorted by term, so that a
query's terms prune folders and row groups. Changes are written as further segments, and
what they replace is named in a table of dead documents; ``reindex`` writes all anew. Every step
is a folder that ``index.json`` names once it is whole, so a lost job leaves no half index.
"""

from __future__ import annotations

import json
import os
import shutil
import time
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.operators import search as S
from docquarry.operators.where import where

FOLDERS = 64
#: Bytes of text that a Python worker takes apart at once; one text at least.
AT_ONCE = 16_000_000


class Index:
    """The index of the texts of ``fields`` of the rows known by ``id_``."""

    def __init__(self, spark: SparkSession, path: str, fields: list[str], id_: str = "_id"):
        self.spark, self.path, self.fields, self.id = spark, path, fields, id_
        os.makedirs(path, exist_ok=True)

    def state(self) -> dict:
        at = f"{self.path}/index.json"
        return json.load(open(at)) if os.path.exists(at) else {"segments": [], "dead": [], "seq": 0, "docs": 0, "mean": 0.0}

    def _publish(self, state: dict) -> None:
        with open(f"{self.path}/index.json.new", "w") as f:
            json.dump(state, f)
        os.replace(f"{self.path}/index.json.new", f"{self.path}/index.json")

    def _segment(self, df: DataFrame, name: str) -> None:
        text = F.concat_ws(" ", *[S.text_of(df, p) for p in self.fields])
        texts = df.select(F.col(f"`{self.id}`").alias("id"), S.joined(text).alias("w"))
        schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("ids", T.ArrayType(texts.schema["id"].dataType)), T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("positions", T.ArrayType(T.IntegerType()))])
        each = texts.mapInArrow(_posted, schema)
        # The folder is the digest's, rows within are spread by it and their first identifier: a hot term is in many files. The last folder has the lengths.
        each = each.withColumn("b", F.when(F.col("term").isNull(), FOLDERS).otherwise(F.pmod(F.xxhash64("term"), F.lit(FOLDERS))).cast("int"))
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        spread = max(1, parts // (FOLDERS + 1))
        place = F.pmod(F.col("b") * spread + F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(spread)), F.lit(parts)).cast("int")
        each = each.withColumn("p", place).repartitionById(parts, "p").drop("p").sortWithinPartitions("b", "term")
        each.write.mode("overwrite").partitionBy("b").parquet(f"{self.path}/{name}/postings")
        if os.path.isdir(f"{self.path}/{name}/postings/b={FOLDERS}"):
            os.rename(f"{self.path}/{name}/postings/b={FOLDERS}", f"{self.path}/{name}/length")

    def _stats(self, state: dict) -> dict:
        r = self._lengths(state).agg(F.count("*").alias("docs"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean")).first()
        return {**state, "docs": r.docs, "mean": r.mean}

    def reindex(self, df: DataFrame, seq: int = 0) -> int:
        """Builds the index anew from ``df``; ``seq`` is how much of the change feed that holds. The number of documents."""
        old, name = self.state(), f"s-{time.time_ns()}"
        self._segment(df, name)
        state = self._stats({"segments": [name], "dead": [], "seq": seq})
        self._publish(state)
        for gone in [*old["segments"], *(d["at"] for d in old["dead"])]:
            shutil.rmtree(f"{self.path}/{gone}", ignore_errors=True)
        return state["docs"]

    def catch_up(self, df: DataFrame, feed: DataFrame) -> int:
        """Brings the index to the state ``df``, from the entries of ``feed`` after the last one seen. The number of documents looked at."""
        state = self.state()
        fresh = feed.where(F.col("seq") > state["seq"])
        last = fresh.agg(F.max("seq")).first()[0]
        if last is None:
            return 0
        stamp = time.time_ns()
        at = f"d-{stamp}"
        fresh.select(F.col("doc_id").alias("id")).distinct().write.parquet(f"{self.path}/{at}")
        touched = self.spark.read.parquet(f"{self.path}/{at}")
        name = f"s-{stamp}"
        self._segment(df.join(touched, F.col(f"`{self.id}`").cast("string") == F.col("id"), "left_semi"), name)
        # The dead of a step are those of all segments before it.
        self._publish(self._stats({**state, "segments": [*state["segments"], name], "dead": [*state["dead"], {"at": at, "before": len(state["segments"])}], "seq": last}))
        return touched.count()

    def _live(self, state: dict, part: str) -> DataFrame | None:
        parts = []
        for i, name in enumerate(state["segments"]):
            at = f"{self.path}/{name}/{part}"
            if not any(f.endswith(".parquet") for _, _, fs in os.walk(at) for f in fs):
                continue
            rows = self.spark.read.parquet(at)
            if "ids" in rows.columns:  # segments of older versions have a row for each identifier
                each = F.inline(F.transform("ids", _own)).alias("id", "positions")
                rows = rows.select(each).select("id", F.get("positions", F.lit(0)).alias("n")) if part == "length" else rows.select("term", each, "b")
            for d in state["dead"]:
                if d["before"] > i:
                    gone = self.spark.read.parquet(f"{self.path}/{d['at']}").withColumnRenamed("id", "__gone")
                    rows = rows.join(gone, rows["id"].cast("string") == F.col("__gone"), "left_anti")
            parts.append(rows)
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _lengths(self, state: dict) -> DataFrame:
        held = self._live(state, "length")
        return self.spark.createDataFrame([], "id string, n int") if held is None else held

    def _leaf(self, postings: DataFrame, leaf: tuple, i: int) -> DataFrame:
        def of(word: str) -> DataFrame:
            folder = F.pmod(F.xxhash64(F.lit(word)), F.lit(FOLDERS)).cast("int")
            return postings.where((F.col("b") == folder) & (F.col("term") == word))

        def placed(word: str) -> DataFrame:
            """One row an identifier; rows of one identifier count as one document."""
            return of(word).groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))

        if leaf[0] == "term":
            rows = of(leaf[1]).groupBy("id").agg(F.sum(F.size("positions")).cast("int").alias("f"))
        elif leaf[0] == "prefix":
            rows = postings.where(F.col("term").startswith(leaf[1])).groupBy("id").agg(F.sum(F.size("positions")).cast("int").alias("f"))
        else:
            rows = placed(leaf[1][0]).select("id", F.col("positions").alias("p"))
            for k, word in enumerate(leaf[1][1:], 1):
                after = placed(word).select("id", F.expr(f"transform(positions, x -> x - {k})").alias("q"))
                rows = rows.join(after, "id").select("id", F.array_intersect("p", "q").alias("p"))
            rows = rows.select("id", F.size("p").alias("f"))
        return rows.where("f > 0").select("id", F.lit(i).alias("leaf"), "f")

    def search(self, df: DataFrame, query: str, take: int | None = 50, where_: dict | None = None) -> DataFrame:
        """As :func:`docquarry.operators.search.search`: the same rows, order and scores."""
        tree, state = S.parse(query), self.state()
        leaves = list(dict.fromkeys(S._leaves(tree)))
        postings = self._live(state, "postings")
        if postings is None or not leaves:
            return df.limit(0).withColumn("_score", F.lit(0.0))
        met = reduce(DataFrame.unionByName, [self._leaf(postings, leaf, i) for i, leaf in enumerate(leaves)])
        each = met.groupBy("id").agg(*[F.coalesce(F.max(F.when(F.col("leaf") == i, F.col("f"))), F.lit(0)).alias(f"__f{i}") for i in range(len(leaves))])
        found = {r.leaf: r.n for r in met.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row a leaf of the query
        counted = each.join(self._lengths(state).withColumnRenamed("n", "__n"), "id")
        out = S.ranked(counted, tree, state["docs"], state["mean"], [found.get(i, 0) for i in range(len(leaves))]).select(F.col("id").alias("__id"), "_score")
        rows = df.where(where(df, where_)) if where_ else df
        if take is not None and not where_:
            out = F.broadcast(out.orderBy(F.desc("_score"), "__id").limit(take))  # ``take`` rows
        out = rows.join(out, F.col(f"`{self.id}`") == F.col("__id")).drop("__id").orderBy(F.desc("_score"), F.col(f"`{self.id}`"))
        return out.limit(take) if take is not None else out


def _own(x: Column, i: Column) -> Column:
    """An identifier of a row of postings, and its own positions."""
    begin = F.coalesce(F.get("ends", i - 1), F.lit(0))
    return F.struct(x.alias("id"), F.slice("positions", begin + 1, F.get("ends", i) - begin).alias("positions"))


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, words with a blank between two) as a row for each word of some texts, and one without a word for the texts' numbers of words."""
    for b in batches:
        size = np.cumsum(pc.binary_length(b.column("w")).to_numpy(zero_copy_only=False))
        first = 0
        while first < b.num_rows:
            done = size[first - 1] if first else 0
            after = max(first + 1, int(np.searchsorted(size, done + AT_ONCE, "right")))
            yield _post(b.column("id").slice(first, after - first), b.column("w").slice(first, after - first))
            first = after


def _post(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    split = pc.split_pattern(texts, " ")
    offsets = split.offsets.to_numpy()
    count = np.diff(offsets)
    row = np.repeat(np.arange(len(count), dtype=np.int32), count)
    at = np.arange(len(row), dtype=np.int32) - np.repeat(offsets[:-1] - offsets[0], count)
    coded = split.flatten().dictionary_encode()
    key = coded.indices.to_numpy().astype(np.int64) * len(count) + row
    blank = pc.index(coded.dictionary, "").as_py()  # what a text without words is split into
    if blank >= 0:
        stay = key // len(count) != blank
        row, at, key = row[stay], at[stay], key[stay]
    n = np.bincount(row, minlength=len(count)).astype(np.int32)
    order = np.argsort(key, kind="stable")
    key = key[order]
    pair = np.flatnonzero(np.diff(key, prepend=-1))
    code, row = np.divmod(key[pair], len(count))
    term = np.flatnonzero(np.diff(code, prepend=-1))
    # The texts' lengths come after the postings, as a row with one number for each.
    first = np.r_[pair[term], len(key)]
    end = np.r_[pair[1:], len(key)][: len(pair)] - np.repeat(first[:-1], np.diff(np.r_[term, len(pair)]))
    outer = pa.array(np.r_[term, len(pair), len(pair) + len(n)].astype(np.int32))
    held = pa.ListArray.from_arrays(outer, ids.take(pa.array(np.r_[row, np.arange(len(n))])))
    ends = pa.ListArray.from_arrays(outer, pa.array(np.r_[end, np.arange(1, len(n) + 1)].astype(np.int32)))
    positions = pa.ListArray.from_arrays(pa.array(np.r_[first, len(key) + len(n)].astype(np.int32)), pa.array(np.r_[at[order], n].astype(np.int32)))
    words = pa.concat_arrays([coded.dictionary.take(pa.array(code[term])), pa.nulls(1, coded.dictionary.type)])
    return pa.RecordBatch.from_arrays([words, held, ends, positions], ["term", "ids", "ends", "positions"])
