"""A database folder: collections as versioned Parquet, a change feed, and atomic commits.

A collection is a folder of versions. One manifest names the current version of every collection,
its declared schema, and the last number of the feed. A transaction holds the lock, writes new versions and a
staged folder of feed entries, and then replaces the manifest in one step: readers see all of it
or nothing, and what a failed or lost writer left behind is named nowhere. The staged entries then
move into the feed's folder; if the writer is lost before that, the next one moves them. Reads are lazy
DataFrames over the current version; documents have their body in a VARIANT column.
"""

from __future__ import annotations

import copy
import itertools
import json
import os
import re
import secrets as randomness
import shutil
import socket
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docquarry.functions.values import BODY, QueryError
from docquarry.operators import aggregate as agg
from docquarry.operators import query, update
from docquarry.operators.where import where
from docquarry.runtime import checkpoint, large
from docquarry.streaming import feed as live
from docquarry.streaming.feed import FEED, make_version
from docquarry.streaming.feed import mark_pushed as mark_feed

SYSTEM = ("_id", "created_at", "updated_at")
TYPES = {"TEXT": "string", "INTEGER": "long", "REAL": "double", "BLOB": "binary", "JSON": "variant", "VECTOR": "array<double>"}


class StoreError(RuntimeError):
    pass


class ConstraintError(StoreError):
    pass


class UniqueError(ConstraintError):
    pass


class NotNullError(ConstraintError):
    pass


class ForeignKeyError(ConstraintError):
    pass


_counter = itertools.count(randomness.randbelow(1 << 24))
_node = randomness.token_hex(5)


def object_id() -> str:
    """24 hex digits: seconds, process, counter."""
    return f"{int(time.time()):08x}{_node}{next(_counter) & 0xFFFFFF:06x}"


def is_object_id(x: Any) -> bool:
    return isinstance(x, str) and len(x) == 24 and all(c in "0123456789abcdef" for c in x)


def now_ms() -> int:
    return int(time.time() * 1000)


class Database:
    def __init__(self, spark: SparkSession, path: str, changes: bool = True, max_document_bytes: int | None = None, max_rows: int | None = None, plugins: tuple = (), on_query: Callable[[str, float], None] | None = None):
        self.spark, self.path = spark, path
        self.feed_on, self.max_document_bytes, self.max_rows = changes, max_document_bytes, max_rows
        self.on_query, self.plugins = on_query, plugins
        self._open: dict[str, Collection] = {}
        self._mine = threading.local()
        os.makedirs(path, exist_ok=True)
        for p in plugins:
            p.init(self)

    @contextmanager
    def lock(self, wait_s: float = 30.0) -> Iterator[None]:
        """One writer at a time, across processes; the lock of a process that is gone is taken over."""
        at, until = os.path.join(self.path, ".lock"), time.time() + wait_s
        me = f"{socket.gethostname()}:{os.getpid()}"
        while True:
            try:
                fd = os.open(at, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
                break
            except FileExistsError:
                if _abandoned(at):
                    # Only one of those that wait gets to move it away.
                    try:
                        os.rename(at, f"{at}.{randomness.token_hex(4)}")
                    except FileNotFoundError:
                        pass
                    continue
                if time.time() > until:
                    raise StoreError("another writer holds the lock") from None
                time.sleep(0.02)
        try:
            os.write(fd, me.encode())
            yield
        finally:
            os.close(fd)
            os.unlink(at)

    # Manifest and transactions.
    def _load(self) -> dict:
        at = f"{self.path}/_manifest.json"
        return json.load(open(at)) if os.path.exists(at) else {"commit": 0, "seq": 0, "floor": 0, "keep_unpushed": False, "marks": None, "collections": {}, "staged": None}

    def view(self) -> dict:
        """The manifest as this thread sees it: that of its transaction, if it is in one."""
        tx = getattr(self._mine, "tx", None)
        return tx["manifest"] if tx else self._load()

    @contextmanager
    def transaction(self) -> Iterator[Database]:
        """All writes inside are one commit; an error undoes them all. A transaction within one undoes its own part only."""
        outer = getattr(self._mine, "tx", None)
        if outer:
            before = copy.deepcopy(outer["manifest"]), len(outer["made"]), dict(outer["written"])
            try:
                yield self
            except BaseException:
                for d in outer["made"][before[1] :]:
                    shutil.rmtree(d, ignore_errors=True)
                outer["manifest"], outer["written"] = before[0], before[2]
                del outer["made"][before[1] :]
                raise
            return
        with self.lock():
            base = self._load()
            self._settle(base)
            tx = self._mine.tx = {"manifest": copy.deepcopy(base), "made": [], "written": {}, "stage": f"{self.path}/_stage/{base['commit'] + 1:012d}"}
            shutil.rmtree(tx["stage"], ignore_errors=True)
            try:
                yield self
                new = tx["manifest"]
                if new != base:
                    new["commit"] = base["commit"] + 1
                    new["staged"] = f"{new['commit']:012d}" if os.path.isdir(tx["stage"]) else None
                    _replace(f"{self.path}/_manifest.json", new)
                    self._settle(new)
            except BaseException:
                for d in [*tx["made"], tx["stage"]]:
                    shutil.rmtree(d, ignore_errors=True)
                raise
            finally:
                self._mine.tx = None
        for name, ids in tx["written"].items():
            for p in self.plugins:
                p.after_write(self.collection(name), ids)

    def transact(self, fn: Callable[[Database], Any]) -> Any:
        """``fn(db)`` as one transaction; what it returns."""
        with self.transaction():
            return fn(self)

    async def transact_async(self, fn: Callable[[Database], Any]) -> Any:
        """As :meth:`transact`, for a coroutine function that does not leave its thread."""
        with self.transaction():
            return await fn(self)

    def _settle(self, manifest: dict) -> None:
        """Moves the entries of the last commit into the feed, if they are not there yet."""
        if manifest["staged"]:
            at, to = f"{self.path}/_stage/{manifest['staged']}", f"{self.path}/_feed/c-{manifest['staged']}"
            if os.path.isdir(at):
                os.makedirs(f"{self.path}/_feed", exist_ok=True)
                os.rename(at, to)

    def collection(self, name: str, schema: dict[str, dict] | None = None, unique: list[list[str]] | None = None, ttl: dict | None = None) -> Collection:
        """The collection of that name; a schema that is not the one it was declared with is an error."""
        if not name.isidentifier():
            raise StoreError(f"bad name {name!r}")
        held = self.view()["collections"].get(name)
        if held and schema is not None and held["declared"] != schema:
            raise StoreError(f"{name} was declared with another schema")
        if name in self._open:
            if schema is not None and schema != self._open[name].declared:
                raise StoreError(f"{name} is open with another schema")
            return self._open[name]
        if held:
            schema = held["declared"]
            unique, ttl = unique if unique is not None else held["unique"], ttl or held["ttl"]
        self._open[name] = Collection(self, name, schema, unique or [], ttl)
        return self._open[name]

    def collections(self) -> list[str]:
        return sorted(self.view()["collections"])

    def disconnect(self) -> None:
        """Forgets the open collections; the folder stays usable."""
        self._open.clear()

    def schema(self, name: str) -> T.StructType:
        return self.collection(name).read().schema

    def drop(self, name: str) -> None:
        with self.transaction():
            self._open.pop(name, None)
            if name in self.view()["collections"]:
                ids = Collection(self, name, self.view()["collections"][name]["declared"], [], None).read().select("_id")
                self._record(name, ids.select(F.col("_id").alias("doc_id"), F.lit("delete").alias("op")))
                del self.view()["collections"][name]

    def drop_all(self) -> None:
        for n in self.collections():
            self.drop(n)

    def backup(self, to: str) -> None:
        """A copy of every collection's current state; ``to`` must not exist."""
        if os.path.exists(to):
            raise StoreError(f"{to} exists")
        for n in self.collections():
            self.collection(n).read().write.parquet(f"{to}/{n}.parquet")

    def stats(self) -> dict[str, Any]:
        files = [os.path.join(d, f) for d, _, fs in os.walk(self.path) for f in fs if f.endswith(".parquet")]
        return {"files": len(files), "bytes": sum(map(os.path.getsize, files)), "collections": {n: self.collection(n).count() for n in self.collections()}}

    def vacuum(self) -> None:
        """Deletes what no manifest names: old versions, dropped collections, stages of lost writers."""
        with self.lock():
            now = self._load()
            self._settle(now)
            shutil.rmtree(f"{self.path}/_stage", ignore_errors=True)
            if os.path.isdir(f"{self.path}/_marks"):
                for d in os.listdir(f"{self.path}/_marks"):
                    if f"_marks/{d}" != now["marks"]:
                        shutil.rmtree(f"{self.path}/_marks/{d}")
            for name in os.listdir(self.path):
                at = f"{self.path}/{name}"
                if name.startswith(("_", ".")) or not os.path.isdir(at):
                    continue
                keep = f"v={now['collections'][name]['version']}" if name in now["collections"] else None
                for d in os.listdir(at):
                    if d.startswith("v=") and d != keep:
                        shutil.rmtree(f"{at}/{d}")
                if keep is None:
                    shutil.rmtree(at)

    def integrity_check(self) -> list[str]:
        """What is wrong: versions that are named but not there, identifiers that repeat, numbers of the feed that do."""
        out = []
        for n, held in self.view()["collections"].items():
            if not os.path.isdir(f"{self.path}/{n}/v={held['version']}"):
                out.append(f"{n}: version {held['version']} is missing")
            elif not update.violations(self.collection(n).read(), ["_id"]).isEmpty():
                out.append(f"{n}: identifiers repeat")
        if not update.violations(self.feed(), ["seq"]).isEmpty():
            out.append("feed: numbers repeat")
        return out

    def analyze(self) -> dict[str, dict[str, int]]:
        """Rows and bytes of every collection's current version, for planning."""
        out = {}
        for n, held in self.view()["collections"].items():
            at = f"{self.path}/{n}/v={held['version']}"
            out[n] = {"rows": self.collection(n).read().count(), "bytes": sum(os.path.getsize(f"{at}/{f}") for f in os.listdir(at))}
        return out

    def feed(self) -> DataFrame:
        """Entries of all commits that the manifest has published, in this thread's transaction its own ones too.

        What has been pushed, and below which number entries are dropped, stands in the manifest; the entries stay as they were written.
        """
        now, parts = self.view(), []
        tx = getattr(self._mine, "tx", None)
        stage = tx["stage"] if tx else f"{self.path}/_stage/{now['staged']}"
        for at in (f"{self.path}/_feed", stage):
            if os.path.isdir(at):
                parts.append(self.spark.read.schema(FEED).option("recursiveFileLookup", "true").parquet(at).where(F.col("seq") <= now["seq"]))
        if not parts:
            return self.spark.createDataFrame([], FEED)
        out = reduce(DataFrame.unionByName, parts)
        if now["marks"]:
            out = mark_feed(out, self.spark.read.parquet(f"{self.path}/{now['marks']}"))
        stay = F.col("seq") > now["floor"]
        return out.where(stay | ((F.col("source") == "local") & ~F.col("pushed")) if now["keep_unpushed"] else stay)

    def current_seq(self) -> int:
        return self.view()["seq"]

    def _record(self, coll: str, changed: list[tuple[str, str]] | DataFrame, source: str = "local", versions: DataFrame | None = None) -> None:
        """Adds entries (doc_id, op) to the transaction's part of the feed; a DataFrame never reaches the driver."""
        tx = self._mine.tx
        if not self.feed_on:
            return
        seq, ts = tx["manifest"]["seq"], now_ms()
        if isinstance(changed, list):
            if not changed:
                return
            rows = [(seq + i + 1, coll, d, op, f"{ts:015d}:{_node}:{seq + i + 1:012d}", ts, source, source != "local") for i, (d, op) in enumerate(changed)]
            entries, n = self.spark.createDataFrame(rows, FEED).coalesce(1), len(rows)
        else:
            extra = ["version"] if "version" in changed.columns else []
            numbered = checkpoint(changed.select("doc_id", "op", *extra).withColumn("__i", F.monotonically_increasing_id()), free=False)
            per = {r.p: r.n for r in numbered.groupBy(F.shiftright("__i", 33).cast("int").alias("p")).agg(F.count("*").alias("n")).collect()}  # a row a partition
            n = sum(per.values())
            if not n:
                return
            before = list(itertools.accumulate([0, *(per.get(p, 0) for p in range(max(per)))]))
            place = F.get(F.array(*map(F.lit, before)), F.shiftright("__i", 33).cast("int")) + F.col("__i").bitwiseAND(F.lit((1 << 33) - 1)) + 1 + seq
            entries = numbered.withColumn("seq", place.cast("long"))
            version = F.col("version") if extra else make_version(F.lit(ts), F.lit(_node), F.col("seq"))
            entries = entries.select("seq", F.lit(coll).alias("coll"), "doc_id", "op", version.alias("version"), F.lit(ts).cast("long").alias("ts"), F.lit(source).alias("source"), F.lit(source != "local").alias("pushed"))
        part = f"{tx['stage']}/p-{len(tx['made'])}"
        tx["made"].append(part)
        entries.write.parquet(part)
        tx["manifest"]["seq"] = seq + n

    def compact(self, keep_last: int = 1000, syncing: bool = False) -> None:
        """Drops entries more than ``keep_last`` numbers back, but while syncing no local one that isn't pushed."""
        with self.transaction():
            now = self.view()
            now["floor"], now["keep_unpushed"] = max(now["floor"], now["seq"] - keep_last), syncing

    def mark_pushed(self, done: DataFrame) -> None:
        """``done`` (coll, doc_id, seq): local entries of those documents up to that number count as pushed."""
        with self.transaction():
            now = self.view()
            marks = done.select("coll", "doc_id", "seq")
            if now["marks"]:
                marks = marks.unionByName(self.spark.read.parquet(f"{self.path}/{now['marks']}"))
            to = f"_marks/m-{time.time_ns()}"
            self._mine.tx["made"].append(f"{self.path}/{to}")
            marks.groupBy("coll", "doc_id").agg(F.max("seq").alias("seq")).write.parquet(f"{self.path}/{to}")
            now["marks"] = to

    def execute_raw(self, sql: str, args: list | dict | None = None) -> int:
        """INSERT INTO, UPDATE or DELETE FROM one collection, as one commit; the number of rows it changed.

        ``UPDATE t SET column = expression, ... [WHERE condition]``, ``DELETE FROM t [WHERE condition]``
        and ``INSERT INTO t (columns) SELECT ... | VALUES ...`` over typed columns; constraints hold and the feed is told.
        """
        m = re.fullmatch(r"(?is)\s*(?:UPDATE\s+(?P<u>\w+)\s+SET\s+(?P<set>.*?)(?:\s+WHERE\s+(?P<uw>.*))?|DELETE\s+FROM\s+(?P<d>\w+)(?:\s+WHERE\s+(?P<dw>.*))?|INSERT\s+INTO\s+(?P<i>\w+)\s*\((?P<cols>[^)]*)\)\s*(?P<src>.*))\s*;?\s*", sql)
        if not m:
            raise QueryError("execute_raw takes INSERT INTO, UPDATE or DELETE FROM")
        c = self.collection(m["u"] or m["d"] or m["i"])
        began = time.time()
        with self.transaction():
            for n in self.collections():
                self.collection(n).read().createOrReplaceTempView(n)
            ask = (lambda text: self.spark.sql(text, args=args)) if args is not None else self.spark.sql
            if m["i"]:
                cols = [x.strip().strip("`") for x in m["cols"].split(",")]
                rows = ask(m["src"]).toDF(*cols)
                fill = {"_id": F.uuid(), "created_at": F.lit(now_ms()), "updated_at": F.lit(now_ms()), BODY: F.parse_json(F.lit("{}"))}
                n = c.append(rows.withColumns({k: v for k, v in fill.items() if k not in cols}))
            else:
                cond = m["uw"] or m["dw"] or "true"
                hit = checkpoint(ask(f"SELECT _id FROM {c.name} WHERE {cond}").withColumnRenamed("_id", "__hit"), free=False)
                n = hit.count()
                base = c.read()
                rest = base.join(hit, base["_id"] == hit["__hit"], "left_anti")
                op = F.lit("delete" if m["d"] else "update").alias("op")
                new = rest
                if m["u"]:
                    kept = [x for x in base.columns if x not in ("updated_at",)]
                    own = dict(_assignments(m["set"]))
                    if unknown := set(own) - set(base.columns) or set(own) & set(SYSTEM):
                        raise QueryError(f"cannot set {', '.join(sorted(unknown))}")
                    columns = ", ".join([*(f"CAST({own[x]} AS {base.schema[x].dataType.simpleString()}) AS `{x}`" if x in own else f"`{x}`" for x in kept), f"{now_ms()} AS updated_at"])
                    changed = ask(f"SELECT {columns} FROM {c.name} WHERE {cond}")
                    new = rest.unionByName(changed)
                if n:
                    c._commit(new, hit.select(F.col("__hit").alias("doc_id"), op), hit.withColumnRenamed("__hit", "_id"))
        if self.on_query:
            self.on_query(sql, (time.time() - began) * 1000)
        return n

    def query_raw(self, sql: str, args: list | dict | None = None) -> DataFrame:
        """Any SELECT over the collections as views; ``?`` and ``:name`` take ``args``."""
        for n in self.collections():
            self.collection(n).read().createOrReplaceTempView(n)
        began = time.time()
        out = self.spark.sql(sql, args=args) if args is not None else self.spark.sql(sql)
        if self.on_query:
            self.on_query(sql, (time.time() - began) * 1000)
        return out


def _abandoned(lock: str) -> bool:
    """Whether a lock's writer, on this machine, is gone."""
    try:
        host, _, pid = open(lock).read().rpartition(":")
        if host != socket.gethostname():
            return False
        os.kill(int(pid), 0)
    except ProcessLookupError:
        return True
    except (FileNotFoundError, PermissionError, ValueError):
        return False
    return False


def _assignments(text: str) -> Iterator[tuple[str, str]]:
    """(column, expression) of a SET list; commas inside brackets or quotes do not part it."""
    depth, quote, start = 0, "", 0
    parts = []
    for i, ch in enumerate(text):
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"`":
            quote = ch
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        elif ch == "," and not depth:
            parts.append(text[start:i])
            start = i + 1
    for part in [*parts, text[start:]]:
        name, _, value = part.partition("=")
        yield name.strip().strip("`"), value.strip()


def _replace(path: str, value: dict) -> None:
    with open(path + ".new", "w") as f:
        json.dump(value, f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(path + ".new", path)


class Collection:
    """Documents (``schema`` None) or typed rows with the fields ``schema`` declares and all others in the body."""

    def __init__(self, db: Database, name: str, schema: dict[str, dict] | None, unique: list[list[str]], ttl: dict | None):
        self.db, self.name, self.declared, self.unique, self.ttl = db, name, schema, unique, ttl
        self.path = f"{db.path}/{name}"
        for field, d in (schema or {}).items():
            if not field.isidentifier() or field in (*SYSTEM, BODY) or d["type"] not in TYPES:
                raise StoreError(f"bad column {field!r}")
            if d.get("unique"):
                self.unique = [*self.unique, [field]]

    def struct(self) -> T.StructType:
        typed = "".join(f", `{n}` {TYPES[d['type']]}" for n, d in (self.declared or {}).items())
        return T.StructType.fromDDL(f"_id string, {BODY} variant{typed}, created_at long, updated_at long")

    def manifest(self) -> dict:
        return self.db.view()["collections"].get(self.name, {"version": 0})

    def read(self) -> DataFrame:
        v = self.manifest()["version"]
        if not v:
            return self.db.spark.createDataFrame([], self.struct())
        df = large(self.db.spark.read.parquet(f"{self.path}/v={v}"))
        for n, d in (self.declared or {}).items():  # columns declared since
            if n not in df.columns:
                df = df.withColumn(n, F.lit(d.get("default")).cast(TYPES[d["type"]]))
        return df

    def _plain(self) -> str:
        """The schema of encoded rows: as :meth:`struct`, with JSON as text."""
        typed = "".join(f", `{n}` {'string' if d['type'] == 'JSON' else TYPES[d['type']]}" for n, d in (self.declared or {}).items())
        return f"_id string, {BODY} string{typed}, created_at long, updated_at long"

    def _rows(self, docs: list[dict]) -> DataFrame:
        now = now_ms()
        rows = [encode({**doc, "_id": object_id() if doc.get("_id") is None else str(doc["_id"])}, self.declared, self.db.max_document_bytes, now) for doc in docs]
        return self._parsed(self.db.spark.createDataFrame(rows, self._plain()))

    def _parsed(self, df: DataFrame) -> DataFrame:
        for n in [BODY, *(n for n, d in (self.declared or {}).items() if d["type"] == "JSON")]:
            df = df.withColumn(n, F.parse_json(n))
        return df.select(*self.struct().names)

    def _texts(self, df: DataFrame) -> DataFrame:
        """Rows with JSON as text."""
        for n in [BODY, *(n for n, d in (self.declared or {}).items() if d["type"] == "JSON")]:
            df = df.withColumn(n, F.to_json(n))
        return df

    def _commit(self, new: DataFrame, changed: list[tuple[str, str]] | DataFrame, touched: DataFrame | None = None, source: str = "local") -> None:
        """Writes ``new`` as the next version within the thread's transaction.

        ``changed`` are the feed's entries. Constraints are held against the rows whose ``_id`` is in ``touched``; all by default.
        """
        tx = self.db._mine.tx
        v = self.manifest()["version"] + 1
        to = f"{self.path}/v={v}"
        tx["made"].append(to)
        shutil.rmtree(to, ignore_errors=True)
        new.write.parquet(to)
        held = large(self.db.spark.read.parquet(to))
        fresh = held if touched is None else held.join(touched.select("_id"), "_id", "left_semi")
        for keys in [["_id"], *self.unique]:
            cols = [query.key(query.resolve(held.schema, k)).alias(f"k{i}") for i, k in enumerate(keys)]
            names = [f"k{i}" for i in range(len(keys))]
            among = held.select(*cols)
            if touched is not None:  # a repeat has a changed row's values
                among = among.join(fresh.select(*cols).distinct(), names, "left_semi")
            if not update.violations(among, names).isEmpty():
                raise UniqueError(", ".join(keys))
        for n, d in (self.declared or {}).items():
            if d.get("notNull") and not fresh.where(F.col(n).isNull()).isEmpty():
                raise NotNullError(n)
            if ref := d.get("references"):
                other = self.db.collection(ref["collection"]).read().select(F.col(ref.get("field", "_id")).alias(n))
                if not fresh.where(F.col(n).isNotNull()).join(other, n, "left_anti").isEmpty():
                    raise ForeignKeyError(n)
        tx["manifest"]["collections"][self.name] = {"version": v, "declared": self.declared, "unique": self.unique, "ttl": self.ttl}
        self.db._record(self.name, changed, source)
        if isinstance(changed, list):
            tx["written"].setdefault(self.name, [])
            tx["written"][self.name] = [*tx["written"][self.name], *(i for i, _ in changed)]
        else:
            tx["written"].setdefault(self.name, [])

    # Reads.
    def find_many(self, where_: dict | None = None, **args) -> DataFrame:
        return query.find_many(self.read(), where_, max_rows=args.pop("max_rows", self.db.max_rows), **args)

    def find_first(self, where_: dict | None = None, **args) -> DataFrame:
        return query.find_first(self.read(), where_, **args)

    def find_first_or_throw(self, where_: dict | None = None, **args) -> dict:
        got = self.documents(query.find_first(self.read(), where_, **args))
        if not got:
            raise query.NotFound("no document passes the filter")
        return got[0]

    def find_unique(self, where_: dict) -> dict | None:
        """The one document of an identifier or of a unique key."""
        if set(where_) != {"_id"} and sorted(where_) not in [sorted(k) for k in self.unique]:
            raise QueryError("find_unique takes _id or the fields of a unique key")
        got = self.documents(query.find_first(self.read(), where_))
        return got[0] if got else None

    def find_by_id(self, id_: Any) -> dict | None:
        got = self.documents(query.find_by_id(self.read(), id_))
        return got[0] if got else None

    def count(self, where_: dict | None = None) -> int:
        return query.count(self.read(), where_)

    def exists(self, where_: dict | None = None) -> bool:
        return query.exists(self.read(), where_)

    def aggregate(self, where_: dict | None = None, **args) -> DataFrame:
        return agg.aggregate(self.read(), where_, **args)

    def group_by(self, by: list[str], **args) -> DataFrame:
        return agg.group_by(self.read(), by, **args)

    def distinct(self, path: str, where_: dict | None = None) -> DataFrame:
        return agg.distinct(self.read(), path, where_)

    def documents(self, df: DataFrame) -> list[dict]:
        """Rows as documents: columns, body and system fields in one."""
        return [decode(r.asDict(recursive=True), self.declared) for r in self._texts(df).collect()]

    # Live queries.
    def watch(self, where_: dict | None, callback: Callable[[str, DataFrame], None], checkpoint_dir: str, order_by: dict | list | None = None, **options):
        """See :func:`docquarry.streaming.feed.watch`; rows have the body as JSON text."""
        def result() -> DataFrame:
            return self._texts(self.find_many(where_)).drop("updated_at")

        if order_by is not None:
            options["order"] = query.order_columns(result(), order_by)
        return live.watch(self.db.spark, f"{self.db.path}/_feed", result, callback, checkpoint_dir, coll=self.name, seq=self.db.current_seq(), **options)

    def watch_doc(self, id_: Any, callback: Callable[[dict | None], None], checkpoint_dir: str, trigger: dict | None = None):
        return live.watch_doc(self.db.spark, f"{self.db.path}/_feed", lambda: self.find_by_id(id_), str(id_), callback, checkpoint_dir, trigger, self.name, self.db.current_seq())

    # Writes.
    def create(self, doc: dict) -> dict:
        return self._insert([doc])[0]

    def create_many(self, docs: list[dict]) -> dict[str, int]:
        return {"count": len(self._insert(docs))}

    def _insert(self, docs: list[dict]) -> list[dict]:
        docs = [{**d, "_id": object_id() if d.get("_id") is None else str(d["_id"])} for d in docs]
        if docs:
            with self.db.transaction():
                rows = self._rows(docs)
                self._commit(self.read().unionByName(rows), [(d["_id"], "insert") for d in docs], rows.select("_id"))
        return docs

    def append(self, df: DataFrame) -> int:
        """Adds a DataFrame of this collection's columns, for loads that are too large for the driver; the number of its rows."""
        with self.db.transaction():
            rows = checkpoint(df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.struct()]), free=False)
            self._commit(self.read().unionByName(rows), rows.select(F.col("_id").alias("doc_id"), F.lit("insert").alias("op")), rows.select("_id"))
            return rows.count()

    def _change_first(self, where_: dict | None, change: Callable[[dict], dict | None]) -> tuple[dict, dict | None] | None:
        """Changes the oldest match (None deletes it): (before, after)."""
        with self.db.transaction():
            base = self.read()
            old = self.documents(base.where(where(base, where_)).orderBy("created_at", "_id").limit(1))
            if not old:
                return None
            old, new = old[0], change(old[0])
            rest = base.where(F.col("_id") != old["_id"])
            if new is None:
                self._commit(rest, [(old["_id"], "delete")], rest.select("_id").limit(0))
                return old, None
            new = {**new, "_id": old["_id"], "created_at": old["created_at"], "updated_at": now_ms()}
            row = self._rows([new])
            self._commit(rest.unionByName(row), [(old["_id"], "update")], row.select("_id"))
            return old, new

    def update(self, where_: dict, data: dict) -> dict | None:
        got = self._change_first(where_, lambda d: update.apply_document(d, data))
        return got[1] if got else None

    def update_many(self, where_: dict | None, data: dict) -> dict[str, int]:
        """Changes all matches; they are rewritten where they lie and never brought together."""
        update.check(data)
        declared, most, now = self.declared, self.db.max_document_bytes, now_ms()
        schema = self._plain()
        with self.db.transaction():
            base = self.read()
            hit = F.coalesce(where(base, where_), F.lit(False))
            texts = self._texts(base.where(hit)).select("_id", BODY, *(declared or {}), "created_at", "updated_at")
            arrow = to_arrow_schema(T.StructType.fromDDL(schema))

            def run(batches):
                for b in batches:
                    out = []
                    for r in b.to_pylist():
                        new = update.apply_document(decode(r, declared), data)
                        out.append(encode({**new, "_id": r["_id"], "created_at": r["created_at"], "updated_at": now}, declared, most, now))
                    yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, x)) for x in out], schema=arrow)

            try:
                changed = checkpoint(texts.mapInArrow(run, schema), free=False)
            except Exception as e:
                raise _told(e) from e
            n = changed.count()
            if n:
                ids = changed.select("_id")
                self._commit(base.where(~hit).unionByName(self._parsed(changed)), ids.select(F.col("_id").alias("doc_id"), F.lit("update").alias("op")), ids)
        return {"count": n}

    def upsert(self, where_: dict, create: dict, data: dict) -> dict:
        """Changes the first match, or creates; equalities of ``where_`` seed the new document."""
        with self.db.transaction():
            got = self.update(where_, data)
            if got is not None:
                return got
            seed = {k: (v["equals"] if isinstance(v, dict) else v) for k, v in where_.items() if k not in ("AND", "OR", "NOT") and "." not in k and (not isinstance(v, dict) or set(v) == {"equals"})}
            return self.create({**seed, **create})

    def put_many(self, docs: list[dict], keys: list[str]) -> None:
        """Documents replace those of the same ``keys`` and are added otherwise, in one commit."""
        docs = list({tuple(d[k] for k in keys): d for d in docs}.values())
        if not docs:
            return
        with self.db.transaction():
            rows = self._rows(docs)
            held = self.read().select(*[F.col(k) for k in keys], F.col("_id").alias("__id"), F.col("created_at").alias("__at"))
            rows = rows.join(held, keys, "left")
            rows = checkpoint(rows.withColumns({"op": F.when(F.col("__id").isNull(), "insert").otherwise("update"), "_id": F.coalesce("__id", "_id"), "created_at": F.coalesce("__at", "created_at")}), free=False)
            stay = self.read().join(rows.select("_id"), "_id", "left_anti")
            self._commit(stay.unionByName(rows.select(*self.struct().names)), rows.select(F.col("_id").alias("doc_id"), "op"), rows.select("_id"))

    def find_one_and_update(self, where_: dict, data: dict, return_document: str = "after") -> dict | None:
        got = self._change_first(where_, lambda d: update.apply_document(d, data))
        return (got[0] if return_document == "before" else got[1]) if got else None

    def delete(self, where_: dict) -> dict | None:
        got = self._change_first(where_, lambda d: None)
        return got[0] if got else None

    def delete_many(self, where_: dict | None = None) -> dict[str, int]:
        with self.db.transaction():
            base = self.read()
            hit = F.coalesce(where(base, where_), F.lit(False))
            ids = checkpoint(base.where(hit).select("_id"), free=False)
            n = ids.count()
            if n:
                self._commit(base.where(~hit), ids.select(F.col("_id").alias("doc_id"), F.lit("delete").alias("op")), ids.limit(0))
        return {"count": n}

    def purge_expired(self) -> dict[str, int]:
        if not self.ttl:
            return {"count": 0}
        return self.delete_many({self.ttl["field"]: {"lt": now_ms() - int(self.ttl["seconds"] * 1000)}})

    def bulk_write(self, ops: list[dict]) -> dict[str, int]:
        """Insert, update and delete in order; one commit, all or nothing."""
        done = {"inserted": 0, "updated": 0, "deleted": 0}
        with self.db.transaction():
            for op in ops:
                (kind, x), = op.items()
                if kind == "insertOne":
                    self.create(x)
                    done["inserted"] += 1
                elif kind in ("updateOne", "updateMany"):
                    done["updated"] += int(self.update(x["where"], x["data"]) is not None) if kind == "updateOne" else self.update_many(x["where"], x["data"])["count"]
                elif kind in ("deleteOne", "deleteMany"):
                    done["deleted"] += int(self.delete(x["where"]) is not None) if kind == "deleteOne" else self.delete_many(x["where"])["count"]
                else:
                    raise QueryError(f"unknown operation {kind}")
        return done

    def apply_remote(self, incoming: DataFrame, resolver: Callable[[Column, Column], Column] | None = None) -> DataFrame:
        """Last-write-wins of ``incoming`` (doc_id, op, version, and the collection's columns) into the collection.

        The later version wins, or what ``resolver(local version, remote version)`` says is true; an entry of
        the feed with the remote's version records each change, so nothing is sent back. The result is
        (doc_id, op, version, local, outcome): applied, remote (it won over a local change), local_won, echo.
        """
        rest = [c for c in incoming.columns if c != "doc_id"]
        with self.db.transaction():
            new = incoming.groupBy("doc_id").agg(F.max_by(F.struct(*rest), "version").alias("r")).select("doc_id", "r.*")
            have = self.db.feed().where(F.col("coll") == self.name).groupBy("doc_id").agg(F.max("version").alias("local"))
            met = new.join(large(have), "doc_id", "left")
            wins = resolver(F.col("local"), F.col("version")) if resolver else F.col("version") > F.col("local")
            outcome = F.when(F.col("local").isNull(), "applied").when(F.col("local") == F.col("version"), "echo").when(wins, "remote").otherwise("local_won")
            met = checkpoint(met.withColumn("outcome", outcome), free=False)
            put = met.where(F.col("outcome").isin("applied", "remote"))
            if not put.isEmpty():
                base = self.read()
                ids = put.select(F.col("doc_id").alias("_id"))
                fields = [F.col("doc_id").alias("_id"), *[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in put.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.struct() if f.name != "_id"]]
                rows = put.where("op <> 'delete'").select(*fields)
                self._commit(base.join(ids, "_id", "left_anti").unionByName(rows), put.select("doc_id", "op", "version"), ids, "remote")
        return met.select("doc_id", "op", "version", "local", "outcome")

    def migrate(self, schema: dict[str, dict], rename: dict[str, str] | None = None, drop: list[str] | None = None) -> None:
        """Rebuilds typed columns: renamed, dropped, cast to new types, added with their defaults."""
        rename, drop = rename or {}, drop or []
        lost = set(self.declared or {}) - set(schema) - set(rename) - set(drop)
        if lost:
            raise StoreError(f"columns would be lost: {', '.join(sorted(lost))}")
        before = self.declared
        try:
            with self.db.transaction():
                df = self.read().withColumnsRenamed(rename).drop(*drop)
                for n, d in schema.items():
                    kind = TYPES[d["type"]]
                    df = df.withColumn(n, (F.parse_json(F.to_json(F.struct(n))) if kind == "variant" and n in df.columns and df.schema[n].dataType != T.VariantType() else F.expr(f"try_cast(`{n}` AS {kind})")) if n in df.columns else F.lit(d.get("default")).cast(kind))
                self.declared = schema
                self._commit(df.select(*self.struct().names), [])
        except BaseException:
            self.declared = before
            raise


def encode(doc: dict, declared: dict[str, dict] | None, most: int | None, now: int) -> tuple:
    """A document with its ``_id`` as a row of plain values."""
    declared = declared or {}
    body = {k: v for k, v in doc.items() if k not in SYSTEM and k not in declared}
    text = json.dumps(body, ensure_ascii=False)
    if most and len(text.encode()) > most:
        raise StoreError("the document is too large")
    typed = {n: doc.get(n, d.get("default")) for n, d in declared.items()}
    for n, d in declared.items():
        if typed[n] is None and d.get("notNull"):
            raise NotNullError(n)
        if d["type"] == "JSON":
            typed[n] = None if typed[n] is None else json.dumps(typed[n])
        elif d["type"] == "VECTOR":
            typed[n] = None if typed[n] is None else [float(x) for x in typed[n]]
        elif isinstance(typed[n], (dict, list)):
            raise StoreError(f"{n} takes no object")
    return (doc["_id"], text, *typed.values(), doc.get("created_at") or now, doc.get("updated_at") or now)


def decode(row: dict, declared: dict[str, dict] | None) -> dict:
    """The document of a row whose JSON is text."""
    doc = dict(row)
    body = json.loads(doc.pop(BODY, None) or "{}")
    for n, d in (declared or {}).items():
        if d["type"] == "JSON" and doc.get(n) is not None:
            doc[n] = json.loads(doc[n])
    return {"_id": doc.pop("_id"), **body, **doc}


def _told(e: Exception) -> Exception:
    """The store's own error that a worker raised, as itself."""
    for kind in (QueryError, NotNullError, StoreError):
        if m := re.search(rf"{kind.__name__}: (.*)", str(e)):
            return kind(m[1])
    return e


def create_db(spark: SparkSession, path: str, **options) -> Database:
    return Database(spark, path, **options)


