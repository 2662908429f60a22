"""The index's segments against a plain reading of the texts, how they are built, and segments of older versions."""

import os

import pytest
from pyspark.sql import functions as F

from docquarry.operators import fts
from docquarry.operators import search as S
from docquarry.operators.fts import Index

TEXTS = [
    (1, "One, two; ONE three one"), (2, ""), (3, None), (4, "  ... --- "), (5, "été ÉTÉ x2 2x œuvre"), (6, "two"), (7, "two one two one"),
    (8, "日本語 テキスト 🙂 emoji"), (9, "a_b a-b a'b"), (10, "word " * 3000 + "end"), (11, "İstanbul \U00010400 tab\tnew\nline"), (None, "one without an identifier"),
]


@pytest.mark.parametrize("at_once", [1, 40, 8_000_000])
def test_segments_hold_every_word_and_length(spark, tmp_path, monkeypatch, at_once):
    monkeypatch.setattr(fts, "AT_ONCE", at_once)
    docs = spark.createDataFrame(TEXTS, "id long, text string").coalesce(1)
    index = Index(spark, str(tmp_path / "i"), ["text"], "id")
    assert index.reindex(docs) == len(TEXTS)
    words = {r.id: r.w for r in docs.select("id", S.tokens(F.coalesce("text", F.lit(""))).alias("w")).collect()}
    want = sorted((t, str(i), [k for k, x in enumerate(w) if x == t]) for i, w in words.items() for t in set(w))
    held = index._live(index.state(), "postings")
    assert sorted((r.term, str(r.id), list(r.positions)) for r in held.collect()) == want
    assert {r.id: r.n for r in index._lengths(index.state()).collect()} == {i: len(w) for i, w in words.items()}
    for q in ("one", "two one", '"one two"', "wo*", '"word word"', "one NOT three", "x2 OR emoji"):
        scored = lambda df: [(r.id, round(r._score, 6)) for r in df.collect()]
        assert scored(index.search(docs, q)) == scored(S.search(docs, ["text"], q, "id")), q


def test_texts_without_words(spark, tmp_path):
    docs = spark.createDataFrame([("a", "..."), ("b", "")], "id string, text string")
    index = Index(spark, str(tmp_path / "i"), ["text"], "id")
    assert index.reindex(docs) == 2 and index.search(docs, "a").collect() == []
    assert index.reindex(docs.limit(0)) == 0 and index.search(docs, "a").collect() == []


def test_rows_of_one_identifier_count_as_one_document(spark, tmp_path):
    docs = spark.createDataFrame([("a", "one two"), ("a", "one"), ("b", "one two")], "id string, text string")
    index = Index(spark, str(tmp_path / "i"), ["text"], "id")
    index.reindex(docs)
    rows = index._leaf(index._live(index.state(), "postings"), ("term", "one"), 0).collect()
    assert sorted((r.id, r.f) for r in rows) == [("a", 2), ("b", 1)]


def test_a_build_shuffles_once_and_reads_the_texts_once(spark, tmp_path):
    store = spark._jsparkSession.sharedState().statusStore()
    runs = lambda: [store.executionsList().apply(i) for i in range(store.executionsList().size())]
    begun = {x.executionId() for x in runs()}
    docs = str(tmp_path / "docs")
    spark.createDataFrame(TEXTS, "id long, text string").write.parquet(docs)
    Index(spark, str(tmp_path / "i"), ["text"], "id").reindex(spark.read.parquet(docs))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = [x.physicalPlanDescription() for x in runs() if x.executionId() not in begun]
    built = [p.partition("== Initial Plan ==")[0] for p in plans if "struct<id:bigint,text:string>" in p]
    assert len(built) == 1
    assert built[0].count("- Exchange (") == 1 and "Aggregate" not in built[0]


def test_segments_of_older_versions_are_read(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"), ["text"])
    spark.createDataFrame([("a", 2), ("b", 1)], "id string, n int").write.parquet(f"{index.path}/s-1/length")
    old = spark.createDataFrame([("one", "a", [0]), ("two", "a", [1]), ("one", "b", [0])], "term string, id string, positions array<int>")
    old.withColumn("b", F.pmod(F.xxhash64("term"), F.lit(fts.FOLDERS)).cast("int")).write.partitionBy("b").parquet(f"{index.path}/s-1/postings")
    index._publish(index._stats({"segments": ["s-1"], "dead": [], "seq": 0}))
    docs = spark.createDataFrame([("a", "one two"), ("b", "two two")], "_id string, text string")
    assert sorted(r._id for r in index.search(docs, "one").collect()) == ["a", "b"]
    index.catch_up(docs, spark.createDataFrame([("b", 1)], "doc_id string, seq long"))
    assert [r._id for r in index.search(docs, "one").collect()] == ["a"] and len(index.search(docs, "two").collect()) == 2
    assert index.search(docs, '"one two"').count() == 1 and os.path.isdir(f"{index.path}/s-1")


def test_phrases_of_texts_that_are_taken_apart_together(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a public license" if i % 3 else "license public, public a license") for i in range(30)], "id long, text string").coalesce(1)
    index = Index(spark, str(tmp_path / "i"), ["text"], "id")
    index.reindex(docs)
    held = spark.read.parquet(f"{index.path}/{index.state()['segments'][0]}/postings")
    assert held.count() == 3  # a row a word, not one for each word of each text
    assert sorted(r.id for r in index.search(docs, '"public license"', None).collect()) == [i for i in range(30) if i % 3]
