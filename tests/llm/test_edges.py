"""Clashing column names, extreme identifiers, repeated rows: what comes back is what went in."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docquarry.llm import exact, mixing, neardup, packing, passages, secrets, toxicity, langid

TOP, LOW, MID = 2**63 - 1, -(2**63), -(2**62)
EXTRA = ["__d", "__v", "__i", "__key", "__own", "__times", "__copies", "__copy", "__drawn", "__rows", "__words", "__doc", "__row", "__gone", "__spans", "n", "h", "key", "c0", "c2", "row", "node", "source", "lang", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    words = " ".join(f"word{i}" for i in range(70))
    rows = [(TOP, "the last identifier " + words), (LOW, "the first identifier"), (MID, "one between"), (None, "no identifier"), (None, "no identifier"), (5, "the first identifier"), (7, words + " changed"), (7, "another text of seven"), (8, None), (9, ""), (9, "")]
    return spark.createDataFrame([(*r, *[f"{c}{i}" for c in EXTRA]) for i, r in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in EXTRA)).repartition(2).cache()


def whole(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_exact_keeps_all_columns_and_identifiers(docs):
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns
    got, had = whole(kept), whole(docs)
    assert set(got) <= set(had) and len(got) == docs.select("text").distinct().count()
    assert {(r.doc_id, r.n_copies) for r in exact.exact_dedup(docs).collect()} == {(TOP, 1), (LOW, 2), (MID, 1), (None, 2), (7, 1), (8, 1), (9, 2)} | {(7, 1)}


@pytest.mark.parametrize("fan_in", [2, 4, 8])
def test_exact_in_any_rounds(docs, fan_in):
    want = docs.groupBy("text").agg(F.min("doc_id").alias("d"), F.count("*").alias("n")).select("d", "n")
    assert whole(exact.exact_dedup(docs, fan_in)) == whole(want)


def test_near_keeps_all_columns(docs):
    kept = neardup.drop_near(docs)
    assert kept.columns == docs.columns and set(whole(kept)) <= set(whole(docs))
    ids = [r.doc_id for r in kept.collect()]
    # Document 7 has the less identifier of two near texts; its other text is no copy of anything.
    assert TOP not in ids and ids.count(7) == 2 and ids.count(None) == 2 and ids.count(9) == 2 and 8 in ids


def test_mixing_loses_no_row(docs):
    out = mixing.resample(docs)
    assert out.columns == docs.columns and set(whole(out)) == set(whole(docs))
    assert {r.doc_id for r in mixing.mix(docs).select("doc_id").collect()} == {TOP, LOW, MID, None, 5, 7}


def test_packing_keeps_identifiers(docs):
    assert sorted(map(str, [r.doc_id for r in packing.pack(docs).collect()])) == sorted(map(str, [r.doc_id for r in docs.collect()]))


def test_passages_keep_all_columns(docs):
    cut = passages.drop_passages(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()


def test_toxicity_keeps_all_columns(docs, spark):
    y = spark.createDataFrame([(TOP, 1, 0), (LOW, 0, 1), (7, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.drop_toxic(docs, y).columns == docs.columns


def test_repeated_rows_reach_the_driver_once(docs, spark, monkeypatch):
    many = docs
    for _ in range(3):
        many = many.unionByName(many)
    seen = {}
    monkeypatch.setattr(langid, "fit", lambda texts, *a, **k: seen.setdefault("langid", texts))
    monkeypatch.setattr(secrets, "train", lambda texts, *a, **k: seen.setdefault("secrets", texts))
    monkeypatch.setattr(toxicity, "fit", lambda texts, *a, **k: seen.setdefault("toxicity", texts))
    langid.train(many.withColumn("lang", F.lit("en")))
    secrets.field_of(many)
    toxicity.train(many, spark.createDataFrame([(7, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int"))
    ids = docs.where("doc_id is not null").select("doc_id").distinct().count()
    assert len(seen["langid"]) == len(seen["secrets"]) == ids and len(seen["toxicity"]) == 2


def test_pipeline_on_hostile_rows(spark, docs, tmp_path):
    y = spark.createDataFrame([(TOP, 1, 0), (7, 1, 0), (None, 1, 1), (9, None, 1)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    y.write.parquet(f"{tmp_path}/labels.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
    # Exact copies leave 8 rows, near ones 7; each lies in a window or is wordless.
    assert sorted(map(str, {r.doc_id for r in at.select("doc_id").collect()})) == sorted(map(str, {LOW, MID, None, 7, 8, 9}))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == at.count()


def test_pipeline_on_empty_tables(spark, docs, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
