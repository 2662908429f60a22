"""Typed access to fields by dotted path, over plain columns and VARIANT bodies alike.

Comparison follows storage classes: null, then numbers (booleans count as 0 and 1), then text. A plain
column keeps its own expression, so filters on it reach the Parquet scan; only a VARIANT
path needs the class of each value at run time.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BODY = "data"
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


class QueryError(ValueError):
    """A query that has no meaning."""


@dataclass
class Field:
    col: Column
    type: T.DataType | None  # None: a VARIANT value, whose type is known by row only

    @property
    def kind(self) -> str:
        if self.type is None:
            return "variant"
        if isinstance(self.type, T.NumericType):
            return "number"
        if isinstance(self.type, T.StringType):
            return "text"
        if isinstance(self.type, T.BooleanType):
            return "bool"
        if isinstance(self.type, T.ArrayType):
            return "array"
        return "null" if isinstance(self.type, T.NullType) else "other"


def variant_path(segments: list[str]) -> str:
    out = "$"
    for s in segments:
        out += f"[{s}]" if s.isdigit() else f".{s}" if _NAME.fullmatch(s) else "[" + json.dumps(s) + "]"
    return out


def _inside(col: Column, kind: T.DataType, segments: list[str]) -> Field:
    while segments:
        if isinstance(kind, T.VariantType):
            return Field(F.try_variant_get(col, variant_path(segments), "variant"), None)
        head, segments = segments[0], segments[1:]
        if isinstance(kind, T.StructType) and head in kind.names:
            col, kind = col.getField(head), kind[head].dataType
        elif isinstance(kind, T.MapType):
            col, kind = F.try_element_at(col, F.lit(head)), kind.valueType
        elif isinstance(kind, T.ArrayType) and head.isdigit():
            col, kind = F.get(col, int(head)), kind.elementType
        else:
            return Field(F.lit(None), T.NullType())
    return Field(col, None if isinstance(kind, T.VariantType) else kind)


def resolve(schema: T.StructType, path: str, root=None) -> Field:
    """The field at ``path``: a column of ``schema``, a place in one, or in the body of a document."""
    if not path or any(not s for s in path.split(".")):
        raise QueryError(f"no such path: {path!r}")
    column = root or (lambda name: F.col(f"`{name}`"))
    if path in schema.names:
        return _inside(column(path), schema[path].dataType, [])
    head, *rest = path.split(".")
    if head in schema.names:
        return _inside(column(head), schema[head].dataType, rest)
    if BODY in schema.names and isinstance(schema[BODY].dataType, T.VariantType):
        return Field(F.try_variant_get(column(BODY), variant_path([head, *rest]), "variant"), None)
    return Field(F.lit(None), T.NullType())


def _class(v: Column) -> Column:
    return F.schema_of_variant(v)


def variant_text(v: Column) -> Column:
    """The value as text if it is a string, else null."""
    return F.when(_class(v) == "STRING", F.try_variant_get(v, "$", "string"))


def variant_number(v: Column) -> Column:
    """The value as a number if it is one or a boolean, else null."""
    t = _class(v)
    number = t.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT", "BOOLEAN") | t.startswith("DECIMAL")
    return F.when(number, F.try_variant_get(v, "$", "double"))


def is_null(f: Field) -> Column:
    """Missing or null."""
    return f.col.isNull() | F.coalesce(F.is_variant_null(f.col), F.lit(False)) if f.kind == "variant" else f.col.isNull()


def key(f: Field) -> Column:
    """What to sort, group and join by: for a VARIANT value (class, number, text, whether the text is JSON), null for null."""
    if f.kind == "variant":
        number, text = variant_number(f.col), variant_text(f.col)
        nothing = F.lit(None).cast("double"), F.lit(None).cast("string")
        return (
            F.when(is_null(f), F.lit(None))
            .when(number.isNotNull(), F.struct(F.lit(1).alias("class"), number.alias("number"), nothing[1].alias("text"), F.lit(False).alias("json")))
            .otherwise(F.struct(F.lit(2).alias("class"), nothing[0].alias("number"), F.coalesce(text, F.to_json(f.col)).alias("text"), text.isNull().alias("json")))
        )
    return f.col


def value_of(f: Field, k: Column) -> Column:
    """The value that a :func:`key` of ``f`` stands for: VARIANT again, booleans as numbers."""
    if f.kind != "variant":
        return k
    number, text = k.getField("number"), k.getField("text")
    whole = (number == F.floor(number)) & (F.abs(number) < 2**53)
    return F.when(k.getField("class") == 1, F.when(whole, number.cast("long").cast("variant")).otherwise(number.cast("variant"))).when(k.getField("json"), F.try_parse_json(text)).otherwise(text.cast("variant"))


def operand(value: Any) -> Any:
    """A query's operand as what it is compared as: booleans as 1 and 0, times as ISO text, lists and objects as JSON text."""
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, dt.datetime):
        moment = value.astimezone(dt.UTC) if value.tzinfo else value
        return moment.strftime("%Y-%m-%dT%H:%M:%S.") + f"{moment.microsecond // 1000:03d}Z"
    if isinstance(value, (list, dict)):
        return json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    return value


def compare(f: Field, op: str, value: Any) -> Column:
    """``f op value`` for one of = < <= > >=; null when the field is."""
    raw, value = value, operand(value)
    number = isinstance(value, (int, float))

    def apply(left: Column, right: Any) -> Column:
        right = F.lit(right)
        return {"=": left == right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]

    if f.kind == "variant":
        own, other = (variant_number(f.col), F.coalesce(variant_text(f.col), F.to_json(f.col))) if number else (F.coalesce(variant_text(f.col), F.to_json(f.col)), variant_number(f.col))
        # Of the other class: text is above all numbers.
        across = F.lit(op in (">", ">=") if number else op in ("<", "<="))
        if number:
            return F.when(is_null(f), F.lit(None)).when(own.isNotNull(), apply(own, float(value))).otherwise(across)
        return F.when(is_null(f), F.lit(None)).when(other.isNotNull(), across).otherwise(apply(own, value))
    if f.kind == "null":
        return F.lit(None).cast("boolean")
    if f.kind == "bool":
        if isinstance(raw, bool) and op == "=":
            return f.col == F.lit(raw)
        f = Field(f.col.cast("int"), T.IntegerType())
    if isinstance(f.type, (T.TimestampType, T.TimestampNTZType, T.DateType)) and not number:
        return apply(f.col, raw if isinstance(raw, (dt.datetime, dt.date)) else F.lit(value).cast(f.type))
    if f.kind == "number" and not number:
        return F.when(f.col.isNotNull(), F.lit(op in ("<", "<=")))
    if f.kind == "text" and number:
        return F.when(f.col.isNotNull(), F.lit(op in (">", ">=")))
    if f.kind in ("array", "other") and not isinstance(f.type, (T.BinaryType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        return apply(F.to_json(f.col), str(value))
    return apply(f.col, value)


def schema_of(source: DataFrame | T.StructType) -> T.StructType:
    return source.schema if isinstance(source, DataFrame) else source
