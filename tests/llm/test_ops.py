"""The ten operators on hostile rows and empty tables, and against brute force."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docquarry.llm import exact, knn, langid, mixing, neardup, packing, passages, queries, secrets, tokens, toxicity
from tests.compare import difference

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, h string, key long"
LABELS = "doc_id long, quality int, toxic int"


def rows():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    passage = " ".join(word() for _ in range(60))
    out = [(i, " ".join(word() for _ in range(120)), "en" if i % 2 else "fr", f"s{i % 3}", 1, 1, "x", 2) for i in range(24)]
    out[3] = (3, out[3][1][:200] + " " + passage + " " + out[3][1][200:], *out[3][2:])
    out[7] = (7, out[7][1][:330] + " " + passage + " " + out[7][1][330:], *out[7][2:])
    near = out[5][1].split()
    near[50] = "changed"
    out += [(100, " ".join(near), "fr", "s0", None, None, None, None), (101, out[5][1], None, None, 1, 1, "x", 1), (101, out[5][1], None, None, 1, 1, "x", 1)]
    out += [(None, "no identifier here", None, None, 0, 0, "", 0), (None, None, None, None, None, None, None, None), (200, None, "en", "s1", 0, 0, "", 0), (201, "", "en", "s1", 0, 0, "", 0), (202, " \n\t ", "fr", "s1", 0, 0, "", 0)]
    out += [(203, "long " * 30000, "en", "s2", 0, 0, "", 0), (204, "x" * 50000, "fr", "s2", 0, 0, "", 0), (205, '... !!! | token = "abe29cfcdae4f03e1e339fcaa4c5bb6c83baff71" end', "en", "s2", 0, 0, "", 0), (206, "a b　 c", None, "s2", 0, 0, "", 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(20)] + [(None, 1, 1), (3, None, 0), (200, 1, 1), (4, 1, 1)], LABELS)


@pytest.mark.parametrize("name", ["toxicity", "packing", "exact", "langid", "mixing", "knn", "neardup", "passages", "tokens", "secrets"])
def test_empty_tables(spark, name):
    d, y = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    run = {
        "toxicity": lambda: toxicity.classify(d, y), "packing": lambda: packing.pack(d), "exact": lambda: exact.exact_dedup(d), "langid": lambda: langid.identify(d),
        "mixing": lambda: mixing.mix(d), "knn": lambda: knn.neighbors(spark.createDataFrame([], "vec_id long, embedding array<float>")), "neardup": lambda: neardup.near_classes(d),
        "passages": lambda: passages.repeated_passages(d), "tokens": lambda: tokens.count_tokens(d), "secrets": lambda: secrets.scan(d, 4),
    }
    assert run[name]().count() == 0


def test_toxicity(docs, labels):
    out = toxicity.classify(docs, labels)
    assert out.count() == docs.count() and out.where("p_toxic is null or p_toxic < 0 or p_toxic > 1").count() == 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == out.where("not is_toxic").count()


def test_toxicity_held_out(spark):
    d, y = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.classify(d, y.where("doc_id % 2 = 0")).join(y.where("doc_id % 2 = 1"), "doc_id").toPandas()
    t = got.toxic == 1
    assert (got.is_toxic & ~t).sum() <= 0.1 * (~t).sum() and got.p_toxic[t].mean() > 3 * got.p_toxic[~t].mean()


def test_packing(docs):
    out = packing.pack(docs).toPandas()
    n = docs.select("doc_id", mixing.word_count().alias("n")).toPandas()
    assert (out.tok_to - out.tok_from).sum() == n.n.sum() and out.tier.isna().sum() == (n.n == 0).sum()
    full = out[out.tier.notna()]
    for (_, tier, _), w in full.groupby(["shard", "tier", "window_no"]):
        w = w.sort_values("place")
        size = (w.tok_to - w.tok_from).to_numpy()
        assert size.sum() <= tier and (w.place.to_numpy() == np.r_[0, np.cumsum(size)[:-1]]).all() and w.step.nunique() == 1


def test_exact(docs):
    want = docs.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select("doc_id", "n").collect()
    assert sorted(map(str, exact.exact_dedup(docs, 2).select("doc_id", F.col("n_copies").alias("n")).collect())) == sorted(map(str, want))
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(want)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF) == ""


def test_language(docs):
    out = langid.identify(docs, rows=50).toPandas()
    assert len(out) == docs.count() and out.language.isna().sum() == 4


def test_neighbors_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5)).round(1)
    x[50] = x[51]
    x[200:240] = x[51]  # a hot vector
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (None, x[0].tolist()), (900, None), (901, []), (902, [1.0, float("nan"), 0.0, 0.0, 0.0]), (903, [1.0, 2.0])]
    got = knn.neighbors(spark.createDataFrame(data, "vec_id long, embedding array<double>"), k=4, shard_rows=40, chunk_rows=50, max_shards=4, part_rows=20).toPandas()
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    want = np.lexsort((np.broadcast_to(np.arange(300), d.shape), d), axis=1)[:, :4]
    assert (got.sort_values(["vec_id", "rank"]).neighbor_id.to_numpy().reshape(300, 4) == want).all()


def test_near_classes(docs):
    got = {(r.doc_id, r.class_id, r.n_links) for r in neardup.near_classes(docs).collect()}
    assert {(5, 5, 2), (100, 5, 2), (101, 5, 2), (202, 202, 0)} <= got
    kept = neardup.drop_near(docs)
    assert kept.columns == docs.columns and {100, 101}.isdisjoint({r.doc_id for r in kept.select("doc_id").collect()})


def test_passages(docs):
    got = passages.repeated_passages(docs).toPandas()
    assert set(got[got.removed].doc_id) == {7, 100, 101} and set(got.doc_id) == {3, 5, 7, 100, 101}
    cut = {r.doc_id: r.text for r in passages.drop_passages(docs.where("doc_id in (3, 7)")).collect()}
    assert len(cut[7].split()) < 170 and len(cut[3].split()) >= 180


def test_token_counts(docs):
    enc = tokens.encoding()
    got = sorted((str(r.doc_id), r.n_tokens) for r in tokens.count_tokens(docs, most=50).collect() if r.n_tokens is not None)
    assert got == sorted((str(x[0]), len(enc.encode_ordinary(x[1]))) for x in rows() if x[1] is not None)


def test_secrets(docs):
    tagger = secrets.Tagger(secrets.train([x[1] for x in rows()[:24]], n=800))
    s, e = tagger.scores(pa.array([x[1] for x in rows()[:24]] + ['a token = "abe29cfcdae4f03e1e339fcaa4c5bb6c83baff71" end', "export API_KEY=sk-" + "aB3xY9" * 8], pa.large_string()))
    fast = tagger.tags(s, e)
    tagger.lead = np.inf
    assert (fast == tagger.tags(s, e)).all()
    found = {int(d) for d in s.doc[fast > 0]}
    assert 24 in found and 25 in found
    assert {r.doc_id for r in secrets.scan(docs).select("doc_id").collect()} >= {205}


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "source_mixing", "packing"]
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = corpus_pipeline.run(spark, SF)
    toxic = toxicity.classify(docs, labels).where("is_toxic").select("doc_id")
    assert out.join(toxic, "doc_id").count() == 0 and out.where("doc_id is null").count() == 0
    texts = docs.join(out.select("doc_id").distinct(), "doc_id")
    assert texts.count() == texts.select("text").distinct().count()
