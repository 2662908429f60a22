"""Commits: atomic, recoverable, and with nothing lost between writers."""

import json
import os
import socket
import threading

import pytest
from pyspark.sql import functions as F

from docquarry.functions.values import QueryError
from docquarry.operators.query import NotFound, TooManyRows
from docquarry.sources.store import Database, ForeignKeyError, NotNullError, StoreError, UniqueError, create_db


@pytest.fixture
def db(spark, tmp_path):
    return create_db(spark, str(tmp_path / "db"))


def ops(db):
    return [(r.coll, r.doc_id, r.op) for r in db.feed().orderBy("seq").collect()]


def test_a_failed_bulk_write_leaves_the_other_writers_commit(spark, db):
    a = db.collection("a", unique=[["k"]])
    a.create({"_id": "1", "k": 1})
    other = Database(spark, db.path)
    started, go = threading.Event(), threading.Event()

    def write():
        started.wait(60)
        other.collection("b").create({"_id": "theirs"})
        go.set()

    t = threading.Thread(target=write)
    t.start()
    with pytest.raises(UniqueError):
        started.set()
        a.bulk_write([{"insertOne": {"_id": "2", "k": 2}}, {"deleteOne": {"where": {"_id": "1"}}}, {"insertOne": {"k": 2}}])
    t.join(90)
    assert go.is_set() and db.collection("b").count() == 1 and [d["_id"] for d in a.documents(a.read())] == ["1"]
    assert ops(db) == [("a", "1", "insert"), ("b", "theirs", "insert")] and db.integrity_check() == []


def test_transactions(db):
    a, b = db.collection("a"), db.collection("b", {"n": {"type": "INTEGER", "notNull": True}})
    with db.transaction():
        a.create({"_id": "1"})
        b.create({"_id": "1", "n": 5})
        try:
            with db.transaction():
                a.create({"_id": "inner"})
                raise ValueError
        except ValueError:
            pass
        assert a.count() == 1
        a.update({"_id": "1"}, {"x": 1})
    assert ops(db) == [("a", "1", "insert"), ("b", "1", "insert"), ("a", "1", "update")]
    with pytest.raises(NotNullError):
        db.transact(lambda d: (a.create({"_id": "2"}), b.create({"n": None})))
    assert a.count() == 1 and len(ops(db)) == 3
    with pytest.raises(ZeroDivisionError):
        db.transact(lambda d: (a.drop if False else d.drop("a"), 1 / 0))
    assert db.collection("a").count() == 1
    db.drop("b")
    assert db.collections() == ["a"] and ops(db)[-1] == ("b", "1", "delete")


def test_a_lost_writer(spark, db):
    a = db.collection("a")
    a.create({"_id": "1"})
    # Its lock stays behind, with a version and entries that no manifest names.
    with open(f"{db.path}/.lock", "w") as f:
        f.write(f"{socket.gethostname()}:999999999")
    os.makedirs(f"{db.path}/a/v=2")
    db.feed().write.parquet(f"{db.path}/_stage/000000000002/p-0")
    assert a.count() == 1 and len(ops(db)) == 1
    a.create({"_id": "2"})
    assert a.count() == 2 and ops(db) == [("a", "1", "insert"), ("a", "2", "insert")]
    # Lost after the manifest, before the entries were moved: readers see them, the next writer moves them.
    state = json.load(open(f"{db.path}/_manifest.json"))
    os.rename(f"{db.path}/_feed/c-{state['staged']}", f"{db.path}/_stage/{state['staged']}")
    assert len(ops(db)) == 2
    a.create({"_id": "3"})
    assert len(ops(db)) == 3 and not os.path.isdir(f"{db.path}/_stage/{state['staged']}")
    db.vacuum()
    assert sorted(os.listdir(a.path)) == ["v=3"] and a.count() == 3


def test_counters_of_many_writers(spark, db):
    from docquarry.operators.stores import KV

    KV(db).set("n", 0)
    threads = [threading.Thread(target=lambda: KV(Database(spark, db.path)).incr("n")) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert KV(db).get("n") == 3


def test_update_many_stays_out_of_the_driver(db, monkeypatch):
    a = db.collection("a", {"n": {"type": "INTEGER"}, "meta": {"type": "JSON"}})
    a.create_many([{"_id": i, "n": i, "meta": {"k": [i]}, "tags": ["x"]} for i in range(6)])
    monkeypatch.setattr(type(a), "documents", lambda *x: pytest.fail("documents were brought to the driver"))
    assert a.update_many({"n": {"gte": 3}}, {"$inc": {"n": 10}, "$push": {"tags": "y"}, "$set": {"meta.z": True}}) == {"count": 3}
    assert a.delete_many({"n": {"lt": 2}}) == {"count": 2} and a.update_many({"n": 99}, {"x": 1}) == {"count": 0}
    monkeypatch.undo()
    got = {d["_id"]: d for d in a.documents(a.read())}
    assert sorted(got) == ["2", "3", "4", "5"] and got["4"]["n"] == 14 and got["4"]["tags"] == ["x", "y"] and got["4"]["meta"] == {"k": [4], "z": True} and got["2"]["tags"] == ["x"]
    assert [op for *_, op in ops(db)] == ["insert"] * 6 + ["update"] * 3 + ["delete"] * 2
    with pytest.raises(QueryError):
        a.update_many({"_id": "3"}, {"$inc": {"tags": 1}})


def test_constraints(db):
    db.collection("parents").create({"_id": "p"})
    kids = db.collection("kids", {"parent": {"type": "TEXT", "references": {"collection": "parents"}}, "code": {"type": "TEXT", "unique": True}})
    kids.create({"_id": "1", "parent": "p", "code": "a"})
    for doc, error in [({"parent": "q"}, ForeignKeyError), ({"parent": "p", "code": "a"}, UniqueError), ({"_id": "1"}, UniqueError)]:
        with pytest.raises(error):
            kids.create(doc)
    kids.create({"_id": "2", "parent": None, "code": None})
    kids.create({"_id": "3", "code": None})
    with pytest.raises(UniqueError):
        kids.update({"_id": "2"}, {"code": "a"})
    assert kids.count() == 3 and kids.find_unique({"code": "a"})["_id"] == "1" and kids.find_unique({"_id": "9"}) is None
    with pytest.raises(QueryError):
        kids.find_unique({"parent": "p"})
    with pytest.raises(NotFound):
        kids.find_first_or_throw({"code": "zz"})


def test_limits_and_declarations(spark, tmp_path):
    small = create_db(spark, str(tmp_path / "db"), max_document_bytes=40, max_rows=2)
    c = small.collection("c", {"n": {"type": "INTEGER"}})
    with pytest.raises(StoreError):
        c.create({"text": "x" * 50})
    c.create_many([{"n": i} for i in range(3)])
    with pytest.raises(TooManyRows):
        c.find_many({"n": {"gte": 0}})
    assert c.find_many({"n": {"gte": 0}}, take=3).count() == 3 and c.find_many({"n": 1}, select={"n": True}, keep_id=True).columns == ["n", "_id"]
    again = Database(spark, small.path)
    with pytest.raises(StoreError):
        again.collection("c", {"n": {"type": "TEXT"}})
    assert again.collection("c").declared == {"n": {"type": "INTEGER"}} and again.collection("c").count() == 3
    again.disconnect()
    assert again.analyze()["c"]["rows"] == 3


def test_execute_raw(db):
    c = db.collection("c", {"n": {"type": "INTEGER"}, "t": {"type": "TEXT", "unique": True}})
    assert db.execute_raw("INSERT INTO c (_id, n, t) VALUES ('a', 1, 'x,y'), ('b', 2, 'z')") == 2
    assert db.execute_raw("UPDATE c SET n = n + greatest(1, 2), t = concat(t, ',', '!') WHERE n > ?", [1]) == 1
    assert {d["_id"]: (d["n"], d["t"]) for d in c.documents(c.read())} == {"a": (1, "x,y"), "b": (4, "z,!")}
    with pytest.raises(UniqueError):
        db.execute_raw("UPDATE c SET t = 'same'")
    for bad in ("DROP TABLE c", "UPDATE c SET _id = 'q'", "UPDATE c SET missing = 1"):
        with pytest.raises(QueryError):
            db.execute_raw(bad)
    assert db.execute_raw("DELETE FROM c WHERE n = 1") == 1 and c.count() == 1


def test_compaction_and_marks(db):
    c = db.collection("c")
    for i in range(4):
        c.create({"_id": str(i)})
    db.mark_pushed(db.feed().where("seq <= 2"))
    assert [r.pushed for r in db.feed().orderBy("seq").collect()] == [True, True, False, False]
    db.compact(1, syncing=True)
    assert [r.seq for r in db.feed().orderBy("seq").collect()] == [3, 4]
    db.compact(1)
    c.create({"_id": "9"})
    assert [r.seq for r in db.feed().orderBy("seq").collect()] == [4, 5]


def test_whole_numbers_stay_whole(db):
    c = db.collection("c")
    c.create_many([{"a": {"b": 3}, "a_b": 7}, {"a": {"b": 2.5}, "a_b": 7}, {"a": {"b": "t"}}, {"a": {"b": [1, 2]}}])
    got = c.aggregate(None, _min={"a.b": True, "a_b": True}, _max={"a_b": True})
    assert got.columns[::2] == ["_min_a_b", "_max_a_b"] and len(set(got.columns)) == 3
    row = got.first()
    assert (row[0].toPython(), row[1].toPython(), row[2].toPython()) == (2.5, 7, 7)
    assert sorted(str(x.value.toPython()) for x in c.distinct("a.b").collect()) == ["1", "2", "2.5", "3", "t"]
