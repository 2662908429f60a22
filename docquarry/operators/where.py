"""Compiles a filter in dictionary form to one Column.

``{"age": {"gte": 18}, "OR": [{"role": "admin"}, {"tags": {"has": "vip"}}]}``: fields are joined by
AND, and so are the operators of one field. Null and missing fields are alike but for
``exists``. Operands that are ``UNSET`` are skipped.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions.values import Field, QueryError, compare, is_null, resolve, schema_of, variant_text, variant_path

UNSET = object()
OPERATORS = {"equals", "not", "gt", "gte", "lt", "lte", "in", "notIn", "contains", "startsWith", "endsWith", "regex", "has", "elemMatch", "exists", "mode", "flags"}
_SIGNS = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<="}
_SCALAR = {"equals", "not", "gt", "gte", "lt", "lte", "in", "notIn", "mode"}


def _all(parts: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, parts) if parts else None


def _surely(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def where(source: DataFrame | T.StructType, spec: dict | None, root=None) -> Column:
    """The condition ``spec`` over the columns of ``source``; true for an empty one."""
    got = _object(schema_of(source), spec or {}, root)
    return F.lit(True) if got is None else got


def _object(schema: T.StructType, spec: dict, root) -> Column | None:
    parts: list[Column] = []
    for name, cond in spec.items():
        if cond is UNSET:
            continue
        if name in ("AND", "OR", "NOT"):
            subs = cond if isinstance(cond, list) else [cond]
            inner = [_object(schema, s, root) for s in subs]
            some = [c for c in inner if c is not None]
            if name == "AND":
                parts += some
            elif name == "OR":
                if not subs:
                    parts.append(F.lit(False))
                elif len(some) == len(inner):  # one empty part lets everything through
                    parts.append(reduce(lambda a, b: a | b, some))
            elif some:
                parts.append(~_surely(_all(some)))
            continue
        parts.append(leaf(resolve(schema, name, root), cond, stringify=name == "_id"))
    return _all(parts)


def _text(x: Any) -> Any:
    if isinstance(x, list):
        return [_text(v) for v in x]
    return str(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def leaf(f: Field, cond: Any, stringify: bool = False) -> Column:
    """All operators of one field."""
    if not isinstance(cond, dict):
        cond = {"equals": cond}
    unknown = set(cond) - OPERATORS
    if unknown:
        raise QueryError(f"unknown operator: {', '.join(sorted(unknown))}")
    low = cond.get("mode") == "insensitive"
    parts = []
    for op, value in cond.items():
        if value is UNSET or op in ("mode", "flags"):
            continue
        value = _text(value) if stringify else value
        parts.append(_operator(f, op, value, low, cond))
    return _all(parts) if parts else F.lit(True)


def _operator(f: Field, op: str, value: Any, low: bool, cond: dict) -> Column:
    if op == "equals":
        return is_null(f) if value is None else compare(f, "=", value)
    if op == "not":
        return ~is_null(f) if value is None else is_null(f) | ~compare(f, "=", value)
    if op in _SIGNS:
        return F.lit(None).cast("boolean") if value is None else compare(f, _SIGNS[op], value)
    if op in ("in", "notIn"):
        if not isinstance(value, (list, tuple)):
            raise QueryError(f"{op} takes a list")
        some, nulls = [v for v in value if v is not None], any(v is None for v in value)
        plain = f.kind in ("number", "text") and all(isinstance(v, str if f.kind == "text" else (int, float)) and not isinstance(v, bool) for v in some)
        hit = f.col.isin(some) if plain and some else reduce(lambda a, b: a | b, [compare(f, "=", v) for v in some]) if some else F.lit(False)
        if op == "in":
            return hit | is_null(f) if nulls else hit
        if not value:
            return F.lit(True)
        return is_null(f) | ~hit if some else ~is_null(f)
    if op in ("contains", "startsWith", "endsWith"):
        return _string(f, op, value, low)
    if op == "regex":
        flags = "".join(x for x in cond.get("flags", "") if x in "ims") + ("i" if low and "i" not in cond.get("flags", "") else "")
        return _as_text(f).rlike((f"(?{flags})" if flags else "") + value)
    if op == "has":
        return _surely(_members(f, lambda e: compare(e, "=", value) if value is not None else is_null(e), scalar=True))
    if op == "elemMatch":
        return _surely(_members(f, lambda e: _element(e, value), scalar=False))
    present = f.col.isNotNull()  # exists: a JSON null is there, a missing key isn't
    return present if value else ~present


def _as_text(f: Field) -> Column:
    return variant_text(f.col) if f.kind == "variant" else f.col.cast("string")


def _string(f: Field, op: str, value: Any, low: bool) -> Column:
    fold = F.lower if low else (lambda c: c)
    want = value.lower() if low and isinstance(value, str) else value

    def test(c: Column) -> Column:
        c = fold(c)
        return {"contains": c.contains, "startsWith": c.startswith, "endsWith": c.endswith}[op](F.lit(str(want)))

    if op == "contains" and f.kind in ("array", "variant"):

        def member(e: Field) -> Column:
            if low and isinstance(want, str):
                return fold(_as_text(e)) == want
            return compare(e, "=", want)

        inside = _surely(_members(f, member, scalar=False))
        return inside if f.kind == "array" else F.when(_is_array(f), inside).otherwise(test(_as_text(f)))
    return test(_as_text(f))


def _is_array(f: Field) -> Column:
    return F.coalesce(F.schema_of_variant(f.col).startswith("ARRAY"), F.lit(False))


def _members(f: Field, test, scalar: bool) -> Column:
    """Whether some element passes; with ``scalar``, a value that is no array is its own element."""
    if f.kind == "variant":
        held = F.try_variant_get(f.col, "$", "array<variant>")
        inside = F.exists(held, lambda e: _surely(test(Field(e, None))))
        return F.when(_is_array(f), inside).otherwise(test(f) if scalar else F.lit(False))
    if f.kind == "array":
        inner = f.type.elementType
        return F.exists(f.col, lambda e: _surely(test(Field(e, None if isinstance(inner, T.VariantType) else inner))))
    return test(f) if scalar else F.lit(False)


def _element(e: Field, spec: dict) -> Column:
    if not spec:
        return F.lit(True)
    if set(spec) <= _SCALAR:
        return leaf(e, spec)
    if e.kind == "variant":
        return _all([leaf(Field(F.try_variant_get(e.col, variant_path(p.split(".")), "variant"), None), c) for p, c in spec.items()])
    if not isinstance(e.type, T.StructType):
        return F.lit(False)
    return where(e.type, spec, root=lambda name: e.col.getField(name))
