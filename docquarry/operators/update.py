"""Update operators as Column rewrites of typed rows, and as functions of JSON bodies for documents."""

from __future__ import annotations

import copy
import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions.values import QueryError, resolve
from docquarry.operators.where import where

ORDER = ("$set", "$inc", "$push", "$addToSet", "$pull", "$unset")


def check(spec: dict[str, Any]) -> bool:
    """Whether ``spec`` uses operators; plain fields and operators don't mix."""
    marked = [k for k in spec if k.startswith("$")]
    if not marked:
        return False
    if len(marked) != len(spec):
        raise QueryError("plain fields and operators don't mix")
    if unknown := set(marked) - set(ORDER):
        raise QueryError(f"unknown operator: {', '.join(sorted(unknown))}")
    for op in ORDER:
        for path, value in spec.get(op, {}).items():
            if path == "_id" or path.startswith("_id."):
                raise QueryError("_id cannot be changed")
            if op == "$inc" and (isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value)):
                raise QueryError("$inc takes a finite number")
    return True


def _each(value: Any) -> list:
    return list(value["$each"]) if isinstance(value, dict) and set(value) == {"$each"} else [value]


def _literal(value: Any, kind: T.DataType) -> Column:
    if isinstance(value, dict) and isinstance(kind, T.StructType):
        return F.struct(*[_literal(value.get(f.name), f.dataType).alias(f.name) for f in kind])
    if isinstance(value, list):
        return F.array(*[_literal(v, kind.elementType) for v in value]).cast(kind)
    return F.lit(value).cast(kind)


def _at(df: DataFrame, path: str, new) -> tuple[str, Column]:
    """(root column, its value with ``new(old, type)`` at ``path``)."""
    head, *rest = path.split(".")
    f = resolve(df.schema, path)
    if f.kind == "null" and path not in df.columns:
        raise QueryError(f"no column {path}")
    value = new(f.col, f.type)
    if not rest:
        return head, value
    if value is None:
        return head, F.col(head).dropFields(".".join(rest))
    return head, F.col(head).withField(".".join(rest), value)


def update_many(df: DataFrame, where_: dict | None, spec: dict[str, Any]) -> DataFrame:
    """``df`` with the matching rows changed. Operators go in the order $set, $inc, $push, $addToSet, $pull, $unset."""
    marked = check(spec)
    hit = F.coalesce(where(df, where_), F.lit(True) if not where_ else F.lit(False))
    out = df.withColumn("__hit", hit)
    changes = spec if marked else {"$set": {k: v for k, v in spec.items() if k != "_id"}}

    def put(path: str, new) -> None:
        nonlocal out
        head, value = _at(out, path, new)
        old = F.col(f"`{head}`")
        out = out.withColumn(head, F.when(F.col("__hit"), value).otherwise(old))

    for op in ORDER:
        for path, value in changes.get(op, {}).items():
            if op == "$set":
                put(path, lambda c, t, v=value: _literal(v, t))
            elif op == "$unset":
                put(path, lambda c, t: F.lit(None).cast(t))
            elif op == "$inc":
                if not isinstance(resolve(out.schema, path).type, T.NumericType):
                    raise QueryError(f"{path} is no number")
                put(path, lambda c, t, v=value: (F.coalesce(c, F.lit(0).cast(t)) + F.lit(v)).cast(t))
            else:
                kind = resolve(out.schema, path).type
                if not isinstance(kind, T.ArrayType):
                    if op == "$pull":
                        continue
                    raise QueryError(f"{path} is no array")
                if op == "$pull":
                    put(path, lambda c, t, v=value: F.filter(c, lambda e: ~e.eqNullSafe(_literal(v, t.elementType))))
                    continue
                more = F.array(*[_literal(v, kind.elementType) for v in _each(value)]).cast(kind)
                empty = F.array().cast(kind)
                if op == "$push":
                    put(path, lambda c, t: F.concat(F.coalesce(c, empty), more))
                else:
                    put(path, lambda c, t: F.concat(F.coalesce(c, empty), F.array_except(more, F.coalesce(c, empty))))
    return out.drop("__hit")


def delete_many(df: DataFrame, where_: dict | None = None) -> DataFrame:
    """The rows that stay; without a filter none does."""
    return df.where(~F.coalesce(where(df, where_), F.lit(False)))


def purge_expired(df: DataFrame, field: str, seconds: float, now_ms: int) -> DataFrame:
    """Drops rows whose ``field`` (epoch milliseconds) is older than ``seconds``; rows without it stay."""
    return delete_many(df, {field: {"lt": now_ms - int(seconds * 1000)}})


def upsert(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` replace those of the same keys and are added otherwise."""
    return df.join(rows, keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Values of ``keys`` that more than one row has; nulls don't count."""
    filled = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    return filled.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def apply_document(doc: dict[str, Any], spec: dict[str, Any]) -> dict[str, Any]:
    """A changed copy of one JSON document."""
    out = copy.deepcopy(doc)
    if not check(spec):
        return {**out, **{k: v for k, v in spec.items() if k != "_id"}}

    def hold(path: str, make: bool):
        at, *rest = out, *path.split(".")
        for s in rest[:-1]:
            if not isinstance(at.get(s), dict):
                if not make:
                    return None, rest[-1]
                at[s] = {}
            at = at[s]
        return at, rest[-1]

    for op in ORDER:
        for path, value in spec.get(op, {}).items():
            at, name = hold(path, op not in ("$unset", "$pull"))
            if at is None:
                continue
            old = at.get(name)
            if op == "$set":
                at[name] = value
            elif op == "$unset":
                at.pop(name, None)
            elif op == "$inc":
                if old is not None and (isinstance(old, bool) or not isinstance(old, (int, float))):
                    raise QueryError(f"{path} is no number")
                at[name] = (old or 0) + value
            elif op == "$pull":
                if isinstance(old, list):
                    at[name] = [x for x in old if not _same(x, value)]
            else:
                if old is not None and not isinstance(old, list):
                    raise QueryError(f"{path} is no array")
                got = list(old or [])
                for v in _each(value):
                    if op == "$push" or not any(_same(v, x) for x in got):
                        got.append(v)
                at[name] = got
    return out


def _same(a: Any, b: Any) -> bool:
    return isinstance(a, bool) == isinstance(b, bool) and a == b
