"""Aggregation: whole-table, grouped with having and paging, distinct with unwinding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions.values import Field, QueryError, key, resolve, value_of, variant_number
from docquarry.operators.where import leaf, where

BUCKETS = ("_sum", "_avg", "_min", "_max")


def _number(f: Field) -> Column:
    if f.kind == "variant":
        return variant_number(f.col)
    if f.kind == "text":
        return f.col.try_cast("double")
    return f.col.cast("int") if f.kind == "bool" else f.col


def _accumulate(schema: T.StructType, bucket: str, path: str) -> Column:
    f = resolve(schema, path)
    if bucket == "_sum":
        return F.sum(_number(f))
    if bucket == "_avg":
        return F.avg(_number(f))
    return (F.min if bucket == "_min" else F.max)(key(f))


class Names:
    """Column names of paths: dots as underscores, with a further one where another path has that name."""

    def __init__(self):
        self.held: dict[str, str] = {}

    def __call__(self, bucket: str, path: str) -> str:
        name = f"{bucket}_{path.replace('.', '_')}" if bucket else path.replace(".", "_")
        while self.held.setdefault(name, path) != path:
            name += "_"
        return name


def _columns(schema: T.StructType, args: dict, flat: Names) -> dict[str, Column]:
    out = {"_count": F.count("*")} if args.get("_count") else {}
    for bucket in BUCKETS:
        for path, on in (args.get(bucket) or {}).items():
            if on:
                out[flat(bucket, path)] = _accumulate(schema, bucket, path)
    return out


def _shown(schema: T.StructType, args: dict, flat: Names) -> list[Column]:
    """The columns of :func:`_columns` after aggregation, least and greatest values as what they were."""
    out = [F.col("_count")] if args.get("_count") else []
    for bucket in BUCKETS:
        for path, on in (args.get(bucket) or {}).items():
            if on:
                c = F.col(f"`{flat(bucket, path)}`")
                out.append((value_of(resolve(schema, path), c) if bucket in ("_min", "_max") else c).alias(flat(bucket, path)))
    return out


def aggregate(df: DataFrame, where_: dict | None = None, **args) -> DataFrame:
    """One row with the asked ``_count``, ``_sum``, ``_avg``, ``_min``, ``_max``, named like ``_sum_age``.

    With no rows the count is 0 and all else null.
    """
    flat = Names()
    columns = _columns(df.schema, args, flat)
    if not columns:
        raise QueryError("nothing to aggregate")
    return df.where(where(df, where_)).agg(*[c.alias(n) for n, c in columns.items()]).select(*_shown(df.schema, args, flat))


def group_by(df: DataFrame, by: list[str], where_: dict | None = None, having: dict | None = None, order_by: list | dict | None = None, skip: int | None = None, take: int | None = None, **args) -> DataFrame:
    """Groups by the paths ``by`` (null and missing are one group). ``having`` and ``order_by`` may name accumulators that aren't selected."""
    if not by:
        raise QueryError("group_by needs a field")
    flat = Names()
    names = {p: flat("", p) for p in by}
    shown = _columns(df.schema, args, flat)
    hidden: dict[str, Column] = {}

    def need(bucket: str, path: str | None) -> str:
        name = "_count" if path is None else flat(bucket, path)
        if name not in shown:
            hidden[name] = F.count("*") if path is None else _accumulate(df.schema, bucket, path)
        return name

    tests: list[tuple[str, dict]] = []
    for bucket, cond in (having or {}).items():
        if bucket == "_count":
            tests.append((need("_count", None), cond))
        elif bucket in BUCKETS:
            tests += [(need(bucket, path), c) for path, c in cond.items()]
        else:
            raise QueryError(f"having knows no {bucket}")
    order: list[tuple[str, str]] = []
    for part in [order_by] if isinstance(order_by, dict) else order_by or []:
        for name, way in part.items():
            if name == "_count":
                order.append((need("_count", None), way))
            elif name in BUCKETS:
                order += [(need(name, path), w) for path, w in way.items()]
            elif name in names:
                order.append((names[name], way))
            else:
                raise QueryError(f"{name} is neither grouped by nor an accumulator")
    columns = [c.alias(n) for n, c in {**shown, **hidden}.items()] or [F.count("*").alias("__n")]
    out = df.where(where(df, where_)).groupBy(*[key(resolve(df.schema, p)).alias(n) for p, n in names.items()]).agg(*columns)
    for name, cond in tests:
        allowed = {"equals", "not", "gt", "gte", "lt", "lte"}
        if isinstance(cond, dict) and set(cond) - allowed:
            raise QueryError("having takes equals, not, gt, gte, lt, lte")
        out = out.where(leaf(resolve(out.schema, name), cond))
    if order:
        out = out.orderBy(*[F.col(f"`{n}`").desc_nulls_last() if w == "desc" else F.col(f"`{n}`").asc_nulls_first() for n, w in order])
    out = out.offset(int(skip)) if skip else out
    out = out.limit(int(take)) if take is not None else out
    return out.select(*[value_of(resolve(df.schema, p), F.col(f"`{n}`")).alias(n) for p, n in names.items()], *_shown(df.schema, args, flat))


def distinct(df: DataFrame, path: str, where_: dict | None = None) -> DataFrame:
    """Sorted distinct values in column ``value``; arrays are unwound, an empty one adds nothing, nor does a missing field."""
    f = resolve(df.schema, path)
    rows = df.where(where(df, where_))
    if f.kind == "array":
        rows = rows.select(F.explode(f.col).alias("value"))
    elif f.kind == "variant":
        held = F.try_variant_get(f.col, "$", "array<variant>")
        inside = F.schema_of_variant(f.col).startswith("ARRAY")
        rows = rows.where(f.col.isNotNull()).select(F.explode(F.when(inside, held).otherwise(F.array(f.col))).alias("v"))
        held = Field(F.col("v"), None)
        rows = rows.select(key(held).alias("value")).distinct().orderBy(F.col("value").asc_nulls_first())
        return rows.select(value_of(held, F.col("value")).alias("value"))
    else:
        rows = rows.select(f.col.alias("value"))
    return rows.distinct().orderBy(F.col("value").asc_nulls_first())
