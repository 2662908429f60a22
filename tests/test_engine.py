"""Semantics on small documents: filters, updates, store, stores, cron, feed."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docquarry.functions.values import QueryError
from docquarry.operators import cron, query, search, update
from docquarry.operators.aggregate import aggregate, distinct, group_by
from docquarry.operators.stores import KV, Cron, Queue
from docquarry.operators.where import where
from docquarry.sources.store import NotNullError, StoreError, UniqueError, create_db, is_object_id, object_id
from docquarry.streaming import feed


def docs(spark, *bodies):
    import json

    return spark.createDataFrame([(k, json.dumps(b)) for k, b in bodies], "_id string, data string").withColumn("data", F.parse_json("data"))


def ids(df, spec):
    return sorted(r._id for r in df.where(where(df, spec)).collect())


def test_where_on_documents(spark):
    d = docs(
        spark,
        ("Ali", {"age": 28, "role": "admin", "tags": ["a", "b"], "address": {"city": "Riyadh"}}),
        ("Sara", {"age": 24, "role": "editor", "tags": ["b", "c"], "address": {"city": "Jeddah"}}),
        ("Omar", {"age": 31, "role": "admin", "tags": ["c"], "address": {"city": "Riyadh"}}),
        ("Lina", {"age": 19, "role": "guest", "address": {"city": "Mecca"}}),
    )
    for spec, want in [
        ({"age": {"gt": 24, "lte": 31}}, ["Ali", "Omar"]),
        ({"role": {"not": "admin"}}, ["Lina", "Sara"]),
        ({"tags": {"has": "c"}}, ["Omar", "Sara"]),
        ({"tags": {"contains": "B", "mode": "insensitive"}}, ["Ali", "Sara"]),
        ({"tags": {"exists": False}}, ["Lina"]),
        ({"address.city": "Riyadh"}, ["Ali", "Omar"]),
        ({"tags.0": "b"}, ["Sara"]),
        ({"OR": [{}]}, ["Ali", "Lina", "Omar", "Sara"]),
        ({"OR": []}, []),
        ({"AND": []}, ["Ali", "Lina", "Omar", "Sara"]),
        ({"role": {"endsWith": ""}}, ["Ali", "Lina", "Omar", "Sara"]),
        ({"role": {"regex": "^AD", "mode": "insensitive"}}, ["Ali", "Omar"]),
    ]:
        assert ids(d, spec) == want, spec
    with pytest.raises(QueryError):
        where(d, {"age": {"near": 3}})


def test_null_missing_and_mixed(spark):
    d = docs(spark, ("has5", {"n": 5}), ("missing", {}), ("nul", {"n": None}), ("other", {"n": 3}), ("text", {"n": "7"}), ("yes", {"n": True}))
    assert ids(d, {"NOT": {"n": 5}}) == ["missing", "nul", "other", "text", "yes"]
    assert ids(d, {"n": {"not": 5}}) == ["missing", "nul", "other", "text", "yes"]
    assert ids(d, {"n": None}) == ["missing", "nul"]
    assert ids(d, {"n": {"exists": True}}) == ["has5", "nul", "other", "text", "yes"]
    assert ids(d, {"n": {"gt": 4}}) == ["has5", "text"]
    assert ids(d, {"n": {"lt": "a"}}) == ["has5", "other", "text", "yes"]
    assert ids(d, {"n": 1}) == ["yes"]
    assert ids(d, {"n": {"in": [5, None]}}) == ["has5", "missing", "nul"]
    assert ids(d, {"n": {"notIn": [5, None]}}) == ["missing", "nul", "other", "text", "yes"]
    order = query.find_many(d, order_by=[{"n": "asc"}, {"_id": "asc"}]).select("_id").collect()
    assert [r._id for r in order] == ["missing", "nul", "yes", "other", "has5", "text"]


def test_elem_match(spark):
    d = docs(spark, ("o1", {"items": [{"sku": "A", "qty": 2}, {"sku": "B", "qty": 5}]}), ("o2", {"items": [{"sku": "A", "qty": 1}]}), ("o3", {"items": [{"sku": "C", "qty": 9}], "scores": [70, 95]}))
    assert ids(d, {"items": {"elemMatch": {"sku": "A", "qty": {"gte": 2}}}}) == ["o1"]
    assert ids(d, {"scores": {"elemMatch": {"gte": 90}}}) == ["o3"]


def test_aggregates(spark):
    d = docs(spark, ("Ali", {"age": 28, "role": "admin"}), ("Sara", {"age": 24, "role": "editor"}), ("Omar", {"age": 32, "role": "admin"}), ("No", {"tags": ["x", "y"]}), ("Empty", {"tags": []}))
    r = aggregate(d, {"age": {"gt": 0}}, _count=True, _sum={"age": True}, _avg={"age": True}).first()
    assert (r._count, r._sum_age, r._avg_age) == (3, 84, 28)
    g = group_by(d, ["role"], having={"_sum": {"age": {"gt": 50}}}, _count=True).collect()
    assert [(str(x.role.toPython()), x._count) for x in g] == [("admin", 2)]
    assert [x.value.toPython() for x in distinct(d, "tags").collect()] == ["x", "y"]
    with pytest.raises(QueryError):
        group_by(d, [])


def test_documents_change():
    ap = update.apply_document
    assert ap({"a": {"c": 1}}, {"$set": {"a.c": 2, "v": True}}) == {"a": {"c": 2}, "v": True}
    assert ap({"s": 5}, {"$inc": {"s": 3, "fresh": 1}}) == {"s": 8, "fresh": 1}
    assert ap({"t": ["a"]}, {"$push": {"t": {"$each": ["c", "d"]}}})["t"] == ["a", "c", "d"]
    assert ap({"t": ["a", "b", "a"]}, {"$pull": {"t": "a"}})["t"] == ["b"]
    assert ap({"t": ["x"]}, {"$addToSet": {"t": {"$each": ["x", "y", "y"]}}})["t"] == ["x", "y"]
    assert ap({"n": 1, "t": 2}, {"$unset": {"t": 1}}) == {"n": 1}
    assert ap({"_id": "1"}, {"_id": "2", "x": 1}) == {"_id": "1", "x": 1}
    for bad in ({"$set": {"a": 1}, "b": 2}, {"$what": {}}, {"$inc": {"a": "x"}}, {"$set": {"_id": 1}}):
        with pytest.raises(QueryError):
            ap({}, bad)


def test_store(spark, tmp_path):
    db = create_db(spark, str(tmp_path / "db"))
    users = db.collection("users", unique=[["email"]])
    users.create_many([{"_id": i, "name": n, "email": f"{n}@x"} for i, n in enumerate(["Ali", "Sara"])])
    assert users.find_by_id(0)["name"] == "Ali" and users.count() == 2
    with pytest.raises(UniqueError):
        users.create({"name": "Eve", "email": "Ali@x"})
    assert users.count() == 2
    assert users.update({"name": "Ali"}, {"$set": {"a.b": 1}})["a"] == {"b": 1}
    assert users.upsert({"name": "Zed"}, {"n": 1}, {"n": 2})["name"] == "Zed"
    assert users.find_one_and_update({"name": "Zed"}, {"$inc": {"n": 1}}, "before")["n"] == 1
    with pytest.raises(UniqueError):
        users.bulk_write([{"insertOne": {"email": "q"}}, {"insertOne": {"email": "q"}}])
    assert users.count() == 3
    assert users.delete_many({"name": "Sara"}) == {"count": 1}
    assert [r.op for r in db.feed().orderBy("seq").collect()] == ["insert", "insert", "update", "insert", "update", "delete"]
    assert db.query_raw("SELECT count(*) AS n FROM users WHERE _id <> ?", ["zz"]).first().n == 2
    typed = db.collection("typed", {"n": {"type": "INTEGER", "notNull": True}, "meta": {"type": "JSON"}})
    typed.create({"n": 1, "meta": {"a": [1, 2]}, "note": "extra"})
    (doc,) = typed.documents(typed.find_many({"note": "extra", "meta.a.1": 2}))
    assert (doc["n"], doc["meta"], doc["note"]) == (1, {"a": [1, 2]}, "extra")
    with pytest.raises(NotNullError):
        typed.create({"meta": 1})
    with pytest.raises(StoreError):
        typed.migrate({"meta": {"type": "JSON"}})
    typed.migrate({"m": {"type": "TEXT"}, "meta": {"type": "JSON"}}, rename={"n": "m"})
    assert typed.documents(typed.read())[0]["m"] == "1"
    db.backup(str(tmp_path / "copy"))
    with pytest.raises(StoreError):
        db.backup(str(tmp_path / "copy"))
    db.vacuum()
    assert set(db.collections()) == {"users", "typed"} and db.stats()["collections"]["users"] == 2
    assert is_object_id(object_id()) and object_id() != object_id()


def test_kv_queue_cron(spark, tmp_path):
    db = create_db(spark, str(tmp_path / "db"), changes=False)
    kv = KV(db)
    kv.set("a", {"x": 1})
    assert kv.get("a") == {"x": 1} and kv.ttl("a") == -1 and kv.ttl("b") == -2 and not kv.set_nx("a", 2)
    assert kv.incr("n", 2) == 2 and kv.keys() == ["a", "n"]
    kv.zadd("z", {"dave": 5, "bob": 60, "alice": 100})
    assert kv.zrange("z", 0, -1) == ["dave", "bob", "alice"] and kv.zrank("z", "alice", rev=True) == 0
    q = Queue(db)
    q.add("low", priority=1, max_attempts=1), q.add("high", priority=10, job_id="j"), q.add("again", job_id="j")
    job = q.claim()
    assert job["payload"] == "high" and q.complete(job, 1) and not q.complete(job)
    low = q.claim()
    assert q.fail(low, "no") == "failed" and q.counts() == {"pending": 0, "active": 0, "completed": 1, "failed": 1}
    c = Cron(db)
    c.schedule("x", "*/15 * * * *", now=0)
    assert c.tick(now=15 * 60_000) == ["x"] and c.tick(now=15 * 60_000) == []


def test_cron():
    at = dt.datetime(2026, 1, 1, 10, 0, 30, tzinfo=dt.UTC)
    run = lambda e, t=at, tz="UTC": cron.next_run(e, t, tz).strftime("%Y-%m-%d %H:%M")
    assert run("* * * * *") == "2026-01-01 10:01"
    assert run("0 0 * * *") == "2026-01-02 00:00"
    assert run("0 9 * * 1") == "2026-01-05 09:00"
    assert run("0 0 29 2 *") == "2028-02-29 00:00"
    assert run("30 14 * * *", at, "Asia/Tokyo") == "2026-01-02 05:30"
    assert run("0 9 * * *", at, "America/New_York") == "2026-01-01 14:00"
    assert run("5/20 * * * *") == "2026-01-01 10:05"
    for bad in ("* * * *", "61 * * * *", "* * * * 7", "a * * * *", "0 0 31 2 *"):
        with pytest.raises(cron.CronError):
            run(bad)


def test_search_language(spark):
    d = spark.createDataFrame([("1", "Hello world", "the quick brown fox"), ("2", "Goodbye", "lazy dog sleeps"), ("3", None, "Café quickly")], "_id string, title string, body string")
    found = lambda q: sorted(r._id for r in search.search(d, ["title", "body"], q).collect())
    assert found("quick") == ["1"] and found("quick*") == ["1", "3"] and found("cafe") == ["3"]
    assert found('"brown fox"') == ["1"] and found('"fox brown"') == [] and found("quick OR lazy") == ["1", "2"]
    assert found("quick NOT fox") == [] and found("(unbalanced") == [] and found("") == []


def test_stream_of_changes(spark, tmp_path):
    db = create_db(spark, str(tmp_path / "db"))
    people = db.collection("people")
    people.create({"_id": "a", "role": "admin"})
    seen = []
    q = feed.watch(spark, f"{db.path}/_feed", lambda: people.find_many({"role": "admin"}).select("_id", F.to_json("data").alias("data")), lambda kind, df: seen.append((kind, sorted((r._id, r.change) for r in df.collect()) if kind == "delta" else df.count())), str(tmp_path / "cp"))
    people.create({"_id": "b", "role": "admin"})
    q.awaitTermination(60)
    assert seen[0] == ("init", 1)


def test_imports_without_llm():
    import pathlib
    import re

    root = pathlib.Path(__file__).parents[1] / "docquarry"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"docquarry\.llm|corpus_pipeline", p.read_text()), p
