"""Search indexes and vector stores that are made at run time, and indexes of a collection's fields.

They are collections like any other, so transactions, the feed, backup and sync hold for them.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.values import QueryError
from docquarry.operators import search as S
from docquarry.operators.fts import Index
from docquarry.sources.store import Collection, Database


class TextIndex:
    """The full-text index of some fields of a collection, kept up from the feed when it is asked."""

    def __init__(self, collection: Collection, fields: list[str]):
        self.collection = collection
        self.index = Index(collection.db.spark, f"{collection.db.path}/_index/{collection.name}", fields)

    def reindex(self) -> dict[str, int]:
        return {"indexed": self.index.reindex(self.collection.read(), self.collection.db.current_seq())}

    def catch_up(self) -> dict[str, int]:
        """Entries of the feed since the last time; everything, if there is no index yet."""
        if not self.index.state()["segments"]:
            return self.reindex()
        feed = self.collection.db.feed().where(F.col("coll") == self.collection.name)
        return {"indexed": self.index.catch_up(self.collection.read(), feed)}

    def search(self, query: str, take: int | None = 50, where: dict | None = None) -> DataFrame:
        self.catch_up()
        return self.index.search(self.collection.read(), query, take, where)


class SearchIndexes:
    """Named indexes of documents {"id", fields...}."""

    def __init__(self, db: Database):
        self.db, self._held = db, {}

    def ensure_collection(self, name: str, fields: list[str], filter_fields: list[str] = ()) -> TextIndex:
        if name not in self._held:
            declared = {f: {"type": "TEXT"} for f in [*fields, *filter_fields]}
            self._held[name] = TextIndex(self.db.collection(f"fts_{name}", declared), fields)
        return self._held[name]

    def _get(self, name: str) -> TextIndex:
        if name not in self._held:
            raise QueryError(f"no search index {name}")
        return self._held[name]

    def upsert(self, name: str, docs: list[dict[str, Any]]) -> int:
        held = self._get(name).collection
        held.put_many([{**{k: v for k, v in d.items() if k != "id"}, "_id": str(d["id"])} for d in docs], ["_id"])
        return len(docs)

    def search(self, name: str, query: str, take: int = 10, where: dict | None = None) -> DataFrame:
        """The best documents with ``_score``; the filter comes before the ranking's cut."""
        return self._get(name).search(query, take, where)

    def delete(self, name: str, ids: list[Any]) -> int:
        return self._get(name).collection.delete_many({"_id": {"in": [str(i) for i in ids]}})["count"]


class VectorStore:
    """Named sets of vectors with metadata; searches filter first and are exact."""

    def __init__(self, db: Database):
        self.db, self._held = db, {}

    def ensure_collection(self, name: str, dimensions: int, metric: str = "cosine") -> Collection:
        if metric not in ("cosine", "l2"):
            raise QueryError(f"no metric {metric}")
        if name not in self._held:
            self._held[name] = self.db.collection(f"vec_{name}", {"vector": {"type": "VECTOR"}, "metadata": {"type": "JSON"}}), dimensions, metric
        return self._held[name][0]

    def _get(self, name: str) -> tuple[Collection, int, str]:
        if name not in self._held:
            raise QueryError(f"no vector collection {name}")
        return self._held[name]

    def upsert(self, name: str, rows: list[dict[str, Any]]) -> int:
        held, dimensions, _ = self._get(name)
        if any(len(r["vector"]) != dimensions for r in rows):
            raise QueryError(f"vectors of {name} have {dimensions} components")
        held.put_many([{"_id": str(r["id"]), "vector": [float(x) for x in r["vector"]], "metadata": r.get("metadata")} for r in rows], ["_id"])
        return len(rows)

    def search(self, name: str, vector: list[float], top_k: int = 10, where: dict | None = None) -> DataFrame:
        """(_id, metadata, _distance); ``where`` is over the metadata's fields."""
        held, dimensions, metric = self._get(name)
        if metric == "cosine" and not any(vector):
            raise QueryError("a vector of zeros has no direction")
        return S.find_similar(held.read(), vector, "vector", top_k, _under("metadata", where), metric, dimensions=dimensions).select("_id", "metadata", "_distance")

    def delete(self, name: str, ids: list[Any]) -> int:
        return self._get(name)[0].delete_many({"_id": {"in": [str(i) for i in ids]}})["count"]


def _under(root: str, where: dict | None) -> dict | None:
    """The filter with every path below ``root``."""
    if where is None:
        return None
    out: dict[str, Any] = {}
    for k, v in where.items():
        if k in ("AND", "OR"):
            out[k] = [_under(root, x) for x in v]
        elif k == "NOT":
            out[k] = [_under(root, x) for x in v] if isinstance(v, list) else _under(root, v)
        else:
            out[f"{root}.{k}"] = v
    return out
