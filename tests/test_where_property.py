"""Random filters over random documents against a plain evaluation in Python."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.operators.where import where


def documents(rng):
    out = []
    for i in range(60):
        d = {}
        if rng.random() < 0.85:
            d["a"] = int(rng.integers(10))
        if rng.random() < 0.7:
            d["b"] = ["x", "y", "z"][rng.integers(3)]
        if rng.random() < 0.1:
            d["b"] = None
        if rng.random() < 0.6:
            d["flag"] = bool(rng.integers(2))
        if rng.random() < 0.5:
            d["tags"] = [["p", "q", "r"][k] for k in rng.integers(0, 3, rng.integers(0, 4))]
        out.append((f"{i:02d}", d))
    return out


def condition(rng):
    k = rng.integers(9)
    n, s = int(rng.integers(10)), ["x", "y", "z"][rng.integers(3)]
    return [
        {"a": n}, {"a": {["gt", "gte", "lt", "lte"][rng.integers(4)]: n}}, {"b": {"not": s}}, {"b": {"in": [s, None] if rng.random() < 0.3 else [s, "y"]}}, {"a": {"notIn": [n, int(rng.integers(10))]}},
        {"b": None}, {"flag": bool(rng.integers(2))}, {"tags": {"has": ["p", "q"][rng.integers(2)]}}, {"b": {"exists": bool(rng.integers(2))}},
    ][k]


def spec(rng, depth=2):
    if depth == 0 or rng.random() < 0.4:
        return {k: v for _ in range(1 + int(rng.random() < 0.3)) for k, v in condition(rng).items()}
    k = rng.integers(3)
    if k == 2:
        return {"NOT": spec(rng, depth - 1)}
    return {["AND", "OR"][k]: [spec(rng, depth - 1) for _ in range(rng.integers(0, 3))]}


def bare(x):
    """Whether a filter says nothing, so that its negation does not either."""
    says = {"AND": lambda v: all(map(bare, v)), "OR": lambda v: any(map(bare, v)), "NOT": bare}
    return all(k in says and says[k](v) for k, v in x.items())


def passes(d, x):
    """Whether a document passes; NOT takes whatever its inner filter does not."""
    got = []
    for k, v in x.items():
        if k == "AND":
            got.append(all(passes(d, y) for y in v))
        elif k == "OR":
            got.append(any(passes(d, y) for y in v))
        elif k == "NOT":
            got.append(bare(v) or not passes(d, v))
        else:
            got += [leaf(d.get(k), op, y, k in d) for op, y in (v.items() if isinstance(v, dict) else [("equals", v)])]
    return all(got)


def leaf(own, op, y, there):
    number = lambda z: int(z) if isinstance(z, bool) else z
    if op == "exists":
        return there == y
    if op == "equals":
        return own is None if y is None else own is not None and number(own) == number(y)
    if op == "not":
        return own is None or own != y
    if op == "in":
        return own in y
    if op == "notIn":
        return own is None or own not in y
    if op == "has":
        return isinstance(own, list) and y in own
    return own is not None and {"gt": own > y, "gte": own >= y, "lt": own < y, "lte": own <= y}[op]


@pytest.mark.parametrize("seed", [1000, 1001, 1002])
def test_filters_are_those_of_a_plain_evaluation(spark, seed):
    rng = np.random.default_rng(seed)
    docs = documents(rng)
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in docs], "_id string, data string").withColumn("data", F.parse_json("data")).coalesce(1)
    specs = [spec(rng) for _ in range(12)]
    got = df.select("_id", *[F.coalesce(where(df, x), F.lit(False)).alias(f"f{i}") for i, x in enumerate(specs)]).collect()
    for i, x in enumerate(specs):
        assert [r._id for r in got if r[f"f{i}"]] == [k for k, d in docs if passes(d, x)], x
