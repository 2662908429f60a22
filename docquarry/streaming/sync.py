"""Two-way replication between databases: pull, push, last write wins, with cursors and a log of conflicts.

A round pulls what is new on the other side, then pushes what is pending here. All of it is joins
between feeds and collections; only counts reach the driver. An adapter is anything with ``name``,
``pull(coll, since)`` and ``push(coll, changes)``; :class:`FolderAdapter` is the one for another database folder.
"""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.values import BODY, QueryError
from docquarry.runtime import checkpoint, large
from docquarry.sources.store import Database, now_ms
from docquarry.streaming import feed as FD

MODES = ("pull", "push", "two-way")


def read_cursors(held: Any) -> tuple[dict[str, int], int]:
    """(number a collection, floor for those without one): a map, or the one number of an older state; anything else starts anew."""
    if isinstance(held, bool) or held is None:
        return {}, 0
    if isinstance(held, int):
        return {}, held
    if isinstance(held, dict) and all(isinstance(v, int) and not isinstance(v, bool) for v in held.values()):
        return dict(held), 0
    return {}, 0


def with_rows(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """The latest entry of each document with its row; an entry whose row is gone is a delete."""
    last = entries.groupBy("doc_id").agg(F.max_by(F.struct("op", "version", "seq"), "seq").alias("e")).select("doc_id", "e.*")
    rest = [c for c in rows.columns if c != "_id"]
    held = rows.select(F.col("_id").alias("__id"), *rest)
    out = last.join(held, last["doc_id"] == F.col("__id"), "left")
    return out.withColumn("op", F.when(F.col("__id").isNull(), "delete").otherwise("upsert")).drop("__id")


class FolderAdapter:
    """Another database folder."""

    def __init__(self, db: Database, name: str | None = None):
        self.db, self.name = db, name or db.path

    def pull(self, coll: str, since: int) -> tuple[DataFrame | None, int]:
        """(what changed after ``since``, the last number looked at)."""
        last = self.db.current_seq()
        entries = self.db.feed().where((F.col("coll") == coll) & (F.col("seq") > since) & (F.col("seq") <= last))
        if last <= since or entries.isEmpty():
            return None, last
        return with_rows(entries, self.db.collection(coll).read()).drop("seq"), last

    def push(self, coll: str, changes: DataFrame, declared: dict | None, resolver: Callable[[Column, Column], Column] | None) -> DataFrame:
        target = self.db.collection(coll, declared) if coll not in self.db.collections() else self.db.collection(coll)
        return target.apply_remote(changes, resolver)


class SyncEngine:
    """Keeps ``collections`` (all by default) in step with the other side of ``adapter``."""

    def __init__(
        self, db: Database, adapter: Any, collections: list[str] | None = None, mode: str = "two-way", retries: int = 4, resolver: Callable[[Column, Column], Column] | None = None, interval_s: float = 5.0, base_s: float = 0.2
    ):
        if mode not in MODES:
            raise QueryError(f"mode is one of {', '.join(MODES)}")
        self.db, self.adapter, self.mode, self.retries, self.resolver = db, adapter, mode, retries, resolver
        self.interval_s, self.base_s, self._chosen = min(interval_s, 60.0), base_s, collections
        self.state = db.collection("sync_state", {"remote": {"type": "TEXT", "unique": True}, "cursors": {"type": "JSON"}, "at": {"type": "INTEGER"}})
        self.conflicts = db.collection("sync_conflicts", {"remote": {"type": "TEXT"}, "coll": {"type": "TEXT"}, "doc_id": {"type": "TEXT"}, "local": {"type": "TEXT"}, "version": {"type": "TEXT"}, "outcome": {"type": "TEXT"}, "at": {"type": "INTEGER"}})
        self._status: dict[str, Any] = {"running": False, "rounds": 0, "error": None, "last": None}
        self._stop, self._thread = threading.Event(), None

    def collections(self) -> list[str]:
        own = {"sync_state", "sync_conflicts"}
        there = self.adapter.db.collections() if hasattr(self.adapter, "db") else []
        return self._chosen if self._chosen is not None else sorted({*self.db.collections(), *there} - own)

    def _cursors(self) -> tuple[dict[str, int], int]:
        held = self.state.documents(self.state.find_many({"remote": self.adapter.name}))
        return read_cursors(held[0]["cursors"] if held else None)

    def _move(self, coll: str, to: int) -> None:
        with self.db.transaction():
            cursors, floor = self._cursors()
            if floor:
                cursors = {c: floor for c in self.collections()} | cursors
            self.state.put_many([{"remote": self.adapter.name, "cursors": {**cursors, coll: to}, "at": now_ms()}], ["remote"])

    def _log(self, coll: str, outcomes: DataFrame) -> int:
        rows = checkpoint(outcomes.where(F.col("outcome").isin("remote", "local_won")), free=False)
        n = rows.count()
        if n:
            rows = rows.select(F.uuid().alias("_id"), F.parse_json(F.lit("{}")).alias(BODY), F.lit(self.adapter.name).alias("remote"), F.lit(coll).alias("coll"), "doc_id", "local", "version", "outcome", F.lit(now_ms()).alias("at"), F.lit(now_ms()).alias("created_at"), F.lit(now_ms()).alias("updated_at"))
            self.conflicts.append(rows)
        return n

    def seed(self, collections: list[str] | None = None) -> int:
        """Enters every document that the feed has never named, so that it will be pushed; how many."""
        n = 0
        for name in collections or self.collections():
            if name not in self.db.collections():
                continue
            with self.db.transaction():
                known = self.db.feed().where(F.col("coll") == name).select("doc_id").distinct()
                fresh = checkpoint(self.db.collection(name).read().select(F.col("_id").alias("doc_id")).join(known, "doc_id", "left_anti").withColumn("op", F.lit("insert")), free=False)
                n += fresh.count()
                self.db._record(name, fresh)
        return n

    def _tried(self, step: Callable[[], Any]) -> Any:
        """``step()``, tried again after growing waits."""
        for attempt in range(self.retries + 1):
            try:
                return step()
            except (OSError, ConnectionError):
                if attempt == self.retries:
                    raise
                time.sleep(self.base_s * 2**attempt * (0.5 + random.random()))

    def pull(self) -> dict[str, int]:
        done = {"pulled": 0, "conflicts": 0}
        for coll in self.collections():
            cursors, floor = self._cursors()
            since = cursors.get(coll, floor)
            changes, last = self._tried(lambda coll=coll, since=since: self.adapter.pull(coll, since))
            if changes is not None:
                declared = self.adapter.db.collection(coll).declared if hasattr(self.adapter, "db") else None
                target = self.db.collection(coll, declared) if coll not in self.db.collections() else self.db.collection(coll)
                waiting = FD.pending(self.db.feed()).where(F.col("coll") == coll).select("doc_id")
                with self.db.transaction():
                    outcomes = target.apply_remote(changes, self.resolver)
                    done["pulled"] += outcomes.where(F.col("outcome").isin("applied", "remote")).count()
                    done["conflicts"] += self._log(coll, outcomes.join(large(waiting), "doc_id", "left_semi"))
                    self._move(coll, last)
            elif last > since:
                self._move(coll, last)
        return done

    def push(self) -> dict[str, int]:
        done = {"pushed": 0, "refused": 0}
        for coll in self.collections():
            if coll not in self.db.collections():
                continue
            held = self.db.collection(coll)
            waiting = checkpoint(FD.pending(self.db.feed()).where(F.col("coll") == coll), free=False)
            if waiting.isEmpty():
                continue
            changes = with_rows(waiting, held.read())
            outcomes = self._tried(lambda coll=coll, changes=changes, held=held: self.adapter.push(coll, changes.drop("seq"), held.declared, self.resolver))
            done["pushed"] += outcomes.where("outcome <> 'local_won'").count()
            done["refused"] += outcomes.where("outcome = 'local_won'").count()
            self.db.mark_pushed(waiting.select("coll", "doc_id", "seq"))
        return done

    def sync(self) -> dict[str, int]:
        """One round."""
        out: dict[str, int] = {}
        if self.mode != "push":
            out |= self.pull()
        if self.mode != "pull":
            out |= self.push()
        self._status |= {"rounds": self._status["rounds"] + 1, "last": out, "error": None}
        return out

    def start(self) -> None:
        """Rounds in a thread of their own, until :meth:`stop`; after an error the wait doubles, up to a minute."""

        def loop() -> None:
            wait = self.interval_s
            while not self._stop.is_set():
                try:
                    self.sync()
                    wait = self.interval_s
                except Exception as e:  # noqa: BLE001 - the status carries it, the next round tries again
                    self._status["error"] = str(e)
                    wait = min(2 * wait, 60.0)
                self._stop.wait(wait)
            self._status["running"] = False

        self._stop.clear()
        self._status["running"] = True
        self._thread = threading.Thread(target=loop, daemon=True)
        self._thread.start()

    def stop(self) -> None:
        self._stop.set()
        if self._thread:
            self._thread.join()

    def status(self) -> dict[str, Any]:
        return {**self._status, "cursors": self._cursors()[0], "pending": FD.pending(self.db.feed()).where(F.col("coll").isin(self.collections())).count()}
