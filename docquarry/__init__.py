"""Documents, typed tables, search and streams on Spark: one dictionary-shaped API over DataFrames.

Names are imported when they are first asked for.
"""

from importlib import import_module

__version__ = "0.2.0"

_HELD = {
    "create_db": "sources.store", "Database": "sources.store", "Collection": "sources.store", "StoreError": "sources.store", "UniqueError": "sources.store", "NotNullError": "sources.store", "ForeignKeyError": "sources.store", "object_id": "sources.store", "is_object_id": "sources.store",
    "SearchIndexes": "sources.indexes", "TextIndex": "sources.indexes", "VectorStore": "sources.indexes", "SyncEngine": "streaming.sync", "FolderAdapter": "streaming.sync",
    "KV": "operators.stores", "Queue": "operators.stores", "Cron": "operators.stores", "find_many": "operators.query", "find_first": "operators.query", "lookup": "operators.query", "NotFound": "operators.query", "TooManyRows": "operators.query",
    "where": "operators.where", "aggregate": "operators.aggregate", "group_by": "operators.aggregate", "distinct": "operators.aggregate", "update_many": "operators.update", "delete_many": "operators.update",
    "search": "operators.search", "find_similar": "operators.search", "hybrid_search": "operators.search", "QueryError": "functions.values", "watch": "streaming.feed", "live_delta": "streaming.feed", "merge_lww": "streaming.feed",
}
__all__ = sorted(_HELD)


def __getattr__(name: str):
    if name not in _HELD:
        raise AttributeError(f"docquarry has no {name}")
    return getattr(import_module(f"docquarry.{_HELD[name]}"), name)
