"""Reads: filter, order, page, look up, project. All lazy but ``count``, ``exists`` and ``find_by_id``."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.values import QueryError, key, resolve
from docquarry.operators.where import where


class NotFound(LookupError):
    """No row where one was asked for."""


class TooManyRows(RuntimeError):
    """An unbounded read found more rows than allowed."""


def order_columns(df: DataFrame, order: dict | list | None) -> list[Column]:
    """Sort columns: nulls first when ascending, last when descending."""
    out = []
    for part in [order] if isinstance(order, dict) else order or []:
        for path, way in part.items():
            k = key(resolve(df.schema, path))
            out.append(k.desc_nulls_last() if way == "desc" else k.asc_nulls_first())
    return out


def _page(df: DataFrame, skip: int | None, take: int | None) -> DataFrame:
    df = df.offset(int(skip)) if skip else df
    return df.limit(int(take)) if take is not None else df


def lookup(df: DataFrame, foreign: DataFrame, local_field: str, foreign_field: str, as_: str, unwind: bool | str = False) -> DataFrame:
    """Left equi-join. By default the matches become an array, empty where there are none; with ``unwind``
    a row for each match, rows without one dropped, or kept with null for ``"preserve"``."""
    f = foreign.select(key(resolve(foreign.schema, foreign_field)).alias("__k"), F.struct(*[F.col(f"`{c}`") for c in foreign.columns]).alias("__m")).where("__k is not null")
    left = df.withColumn("__l", key(resolve(df.schema, local_field)))
    if left.schema["__l"].dataType != f.schema["__k"].dataType and {left.schema["__l"].dataType.typeName(), f.schema["__k"].dataType.typeName()} & {"string"}:
        raise QueryError(f"{local_field} and {foreign_field} are of different kinds")
    if not unwind:
        # Only what this side's keys ask for is grouped.
        own = left.select("__l").where("__l is not null").distinct()
        f = f.join(own, F.col("__k") == F.col("__l"), "left_semi").groupBy("__k").agg(F.collect_list("__m").alias("__m"))
    how = "inner" if unwind is True else "left"
    joined = left.join(f, F.col("__l") == F.col("__k"), how).drop("__l", "__k")
    value = F.col("__m") if unwind else F.coalesce("__m", F.array().cast(f.schema["__m"].dataType))
    kept = [c for c in df.columns if c != as_]
    return joined.select(*[F.col(f"`{c}`") for c in kept], value.alias(as_))


def having_related(df: DataFrame, foreign: DataFrame, local_field: str, foreign_field: str, where_: dict | None = None, related: bool = True) -> DataFrame:
    """The rows that have a match among the foreign rows that pass ``where_``; with ``related`` false, those that have none."""
    f = foreign.where(where(foreign, where_)) if where_ else foreign
    keys = f.select(key(resolve(f.schema, foreign_field)).alias("__k"))
    left = df.withColumn("__l", key(resolve(df.schema, local_field)))
    return left.join(keys, F.col("__l") == F.col("__k"), "left_semi" if related else "left_anti").drop("__l")


def project(df: DataFrame, select: dict[str, bool] | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Keeps the paths that are true; dotted ones rebuild their objects. All false: the whole rows."""
    paths = [p for p, on in (select or {}).items() if on]
    if not paths:
        return df

    def build(tree: dict, prefix: str) -> list[Column]:
        out = []
        for name, below in tree.items():
            path = f"{prefix}{name}"
            out.append((F.struct(*build(below, path + ".")) if below else resolve(df.schema, path).col).alias(name))
        return out

    tree: dict[str, Any] = {}
    for path in paths:
        at = tree
        for s in path.split("."):
            at = at.setdefault(s, {})
    return df.select(*build(tree, ""), *[F.col(f"`{k}`") for k in keep if k not in tree])


def find_many(
    df: DataFrame,
    where_: dict | None = None,
    order_by: dict | list | None = None,
    skip: int | None = None,
    take: int | None = None,
    lookups: list[dict] | None = None,
    select: dict[str, bool] | None = None,
    max_rows: int | None = None,
    keep_id: bool = False,
) -> DataFrame:
    """where, then order, then page, then lookups, then select, with ``_id`` if it is to be kept. ``max_rows`` bounds reads that have no ``take``."""
    out = df.where(where(df, where_)) if where_ else df
    if max_rows is not None and take is None and len(out.limit(max_rows + 1).select(F.lit(1)).collect()) > max_rows:
        raise TooManyRows(f"more than {max_rows} rows; give take or raise max_rows")
    order = order_columns(out, order_by)
    out = _page(out.orderBy(*order) if order else out, skip, take)
    for one in lookups or []:
        out = lookup(out, one["from"], one["localField"], one["foreignField"], one["as"], one.get("unwind", False))
    return project(out, select, (*(["_id"] if keep_id else []), *(x["as"] for x in lookups or [])))


def find_first(df: DataFrame, where_: dict | None = None, order_by: dict | list | None = None, **more) -> DataFrame:
    return find_many(df, where_, order_by, take=1, **more)


def find_first_or_throw(df: DataFrame, where_: dict | None = None, order_by: dict | list | None = None, **more):
    row = find_first(df, where_, order_by, **more).first()
    if row is None:
        raise NotFound("no row passes the filter")
    return row


def find_by_id(df: DataFrame, id_: Any, column: str = "_id") -> DataFrame:
    return df.where(where(df, {column: id_})).limit(1)


def count(df: DataFrame, where_: dict | None = None) -> int:
    return df.where(where(df, where_)).count()


def exists(df: DataFrame, where_: dict | None = None) -> bool:
    return not df.where(where(df, where_)).isEmpty()


def explain(df: DataFrame) -> dict[str, Any]:
    """The physical plan as text, and whether a filter reaches the scan."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = [line.strip() for line in plan.splitlines() if line.startswith("PushedFilters") and line.strip() != "PushedFilters: []"]
    return {"plan": plan, "pushed": pushed, "uses_pushdown": bool(pushed)}
