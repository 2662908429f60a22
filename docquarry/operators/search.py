"""Full-text (BM25), vector and hybrid ranking.

A search first filters, then ranks: exact, where an index that over-fetches and filters may fall short.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docquarry.functions.values import QueryError, resolve, variant_number, variant_text
from docquarry.operators.where import where
from docquarry.runtime import checkpoint

K1, B = 1.2, 0.75
_ACCENTS = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīłńňőŕřśšťūůűźżž", "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeegilnnorrsstuuuzzz"


def text_of(df: DataFrame, path: str) -> Column:
    """The searchable text of a field: strings as they are, arrays joined by blanks, numbers and booleans as text, else empty."""
    f = resolve(df.schema, path)
    if f.kind == "array":
        return F.array_join(f.col.cast("array<string>"), " ")
    if f.kind == "variant":
        held = F.try_variant_get(f.col, "$", "array<variant>")
        one = F.coalesce(variant_text(f.col), F.when(variant_number(f.col).isNotNull(), F.try_variant_get(f.col, "$", "string")), F.lit(""))
        each = F.transform(held, lambda v: F.coalesce(variant_text(v), F.when(variant_number(v).isNotNull(), F.try_variant_get(v, "$", "string"))))
        return F.when(F.schema_of_variant(f.col).startswith("ARRAY"), F.array_join(each, " ")).otherwise(one)
    return F.coalesce(f.col.cast("string"), F.lit("")) if f.kind in ("text", "number", "bool") else F.lit("")


def folded(c: Column) -> Column:
    """Lower case, without accents."""
    return F.translate(F.lower(c), *_ACCENTS)


def tokens(c: Column) -> Column:
    """Runs of letters and digits, lower case, without accents."""
    return F.regexp_extract_all(folded(c), F.lit(r"[\p{L}\p{N}]+"), 0)


def joined(c: Column) -> Column:
    """The :func:`tokens` with one blank between two."""
    return F.trim(F.regexp_replace(folded(c), r"[^\p{L}\p{N}]+", " "))


def spaced(c: Column) -> Column:
    """The tokens with a blank on either side of each, so that counting one is counting a piece of text."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(folded(c), r"[^\p{L}\p{N}]+", "  ")), F.lit(" "))


def _fold(s: str) -> list[str]:
    return re.findall(r"[^\W_]+", s.lower().translate(str.maketrans(*_ACCENTS)))


def parse(query: str) -> tuple:
    """The query's tree: ("term", word), ("prefix", word), ("phrase", words), ("and"|"or", left, right), ("not", left, right).

    Terms side by side are joined by AND; NOT binds tightest, then AND, then OR. A query that is not
    well formed is taken as all of its words.
    """
    marks = re.findall(r'"[^"]*"|\(|\)|[^\s()"]+', query)
    at = 0

    def peek():
        return marks[at] if at < len(marks) else None

    def primary():
        nonlocal at
        m = peek()
        if m is None or m in (")", "AND", "OR", "NOT"):
            raise QueryError(f"unexpected {m}")
        at += 1
        if m == "(":
            inner = either()
            if peek() != ")":
                raise QueryError("missing )")
            at += 1
            return inner
        words = _fold(m)
        if m.endswith("*") and len(words) == 1:
            return "prefix", words[0]
        if not m.startswith('"') and re.search(r"[^\w*]", m) or not words:
            raise QueryError(f"cannot read {m}")
        return ("term", words[0]) if len(words) == 1 else ("phrase", tuple(words))

    def without():
        nonlocal at
        left = primary()
        while peek() == "NOT":
            at += 1
            left = ("not", left, primary())
        return left

    def both():
        nonlocal at
        left = without()
        while (m := peek()) is not None and m not in (")", "OR"):
            if m == "AND":
                at += 1
            left = ("and", left, without())
        return left

    def either():
        nonlocal at
        left = both()
        while peek() == "OR":
            at += 1
            left = ("or", left, both())
        return left

    try:
        tree = either()
        if at < len(marks):
            raise QueryError("left over")
        return tree
    except QueryError:
        words = [("term", w) for w in _fold(query)]
        return reduce(lambda a, b: ("and", a, b), words) if words else ("none",)


def _matches(tree: tuple, has: dict[tuple, Column]) -> Column:
    """Whether a row matches, from which leaves it has."""
    kind = tree[0]
    if kind == "none":
        return F.lit(False)
    if kind in ("term", "prefix", "phrase"):
        return has[tree]
    left, right = _matches(tree[1], has), _matches(tree[2], has)
    return left & right if kind == "and" else left | right if kind == "or" else left & ~right


def _pieces(s: Column, piece: str) -> Column:
    return ((F.length(s) - F.length(F.replace(s, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def _times(leaf: tuple, s: Column) -> Column:
    """How often a leaf stands in spaced tokens; phrases may overlap themselves."""
    if leaf[0] == "term":
        return _pieces(s, f" {leaf[1]} ")
    if leaf[0] == "prefix":
        return _pieces(s, f" {leaf[1]}")
    piece = " " + "  ".join(leaf[1]) + " "
    alone = all(leaf[1][:i] != leaf[1][-i:] for i in range(1, len(leaf[1])))
    return _pieces(s, piece) if alone else F.regexp_count(s, F.lit(f"(?={piece})"))


def _leaves(tree: tuple, all_: bool = True) -> list[tuple]:
    """The tree's leaves; without ``all_`` only those that add to the score."""
    if tree[0] in ("term", "prefix", "phrase"):
        return [tree]
    if tree[0] == "none":
        return []
    return _leaves(tree[1], all_) + (_leaves(tree[2], all_) if all_ or tree[0] != "not" else [])


def ranked(counted: DataFrame, tree: tuple, docs: int, mean: float, found: list[int]) -> DataFrame:
    """The matching rows of ``counted`` (``__n`` tokens, ``__f0``, ``__f1``, ... times of each leaf) with their BM25 ``_score``.

    ``found`` is the number of documents that hold each leaf.
    """
    leaves = list(dict.fromkeys(_leaves(tree)))
    score = F.lit(0.0)
    for leaf in dict.fromkeys(_leaves(tree, False)):
        i = leaves.index(leaf)
        idf = math.log((docs - found[i] + 0.5) / (found[i] + 0.5)) if docs else 0.0
        idf = idf if idf > 0 else 1e-6
        f = F.col(f"__f{i}")
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("__n") / (mean or 1.0)))
    hit = _matches(tree, {leaf: F.col(f"__f{i}") > 0 for i, leaf in enumerate(leaves)})
    return counted.where(hit).withColumn("_score", score)


def search(df: DataFrame, fields: list[str], query: str, id_: str = "_id", take: int | None = 50, where_: dict | None = None) -> DataFrame:
    """The rows that match, best first, with ``_score``: BM25 over all of ``fields``.

    One pass over the texts leaves a row of counts for each document; statistics and ranks come
    from those, and the documents are read again for the hits only. :class:`docquarry.operators.fts.Index` needs no pass over the texts.
    """
    tree = parse(query)
    leaves = list(dict.fromkeys(_leaves(tree)))
    s = spaced(F.concat_ws(" ", *[text_of(df, p) for p in fields]))
    allowed = F.coalesce(where(df, where_), F.lit(False)) if where_ else F.lit(True)
    seen = df.select(F.col(id_).alias("__id"), allowed.alias("__ok"), s.alias("__s"))
    n = F.when(F.trim("__s") == "", 0).otherwise((F.length("__s") - F.length(F.replace("__s", F.lit(" "), F.lit("")))) / 2).cast("int")
    counted = checkpoint(seen.select("__id", "__ok", n.alias("__n"), *[_times(leaf, F.col("__s")).alias(f"__f{i}") for i, leaf in enumerate(leaves)]), free=False)
    stats = counted.agg(F.count("*").alias("docs"), F.coalesce(F.avg("__n"), F.lit(0.0)).alias("mean"), *[F.count_if(F.col(f"__f{i}") > 0).alias(f"d{i}") for i in range(len(leaves))]).first()
    out = ranked(counted.where("__ok"), tree, stats.docs, stats.mean, [stats[f"d{i}"] for i in range(len(leaves))]).select("__id", "_score")
    if take is not None:
        out = F.broadcast(out.orderBy(F.desc("_score"), "__id").limit(take))  # ``take`` rows
    return df.join(out, F.col(f"`{id_}`") == F.col("__id")).drop("__id").orderBy(F.desc("_score"), F.col(f"`{id_}`"))


def distance(v: Column, query: list[float], metric: str = "l2") -> Column:
    """Euclidean or cosine distance of a vector column to ``query``, in double precision; cosine is 1 where a norm is 0."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = v.cast("array<double>")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    if metric == "l2":
        return F.sqrt(total(F.zip_with(v, q, lambda a, b: (a - b) * (a - b))))
    if metric != "cosine":
        raise QueryError(f"no metric {metric}")
    norm = math.sqrt(sum(float(x) ** 2 for x in query))
    bottom = F.sqrt(total(F.transform(v, lambda a: a * a))) * norm
    return F.when(bottom == 0, 1.0).otherwise(1 - total(F.zip_with(v, q, lambda a, b: a * b)) / bottom)


def find_similar(df: DataFrame, vector: list[float], field: str = "embedding", top_k: int = 10, where_: dict | None = None, metric: str = "l2", id_: str = "_id", dimensions: int | None = None) -> DataFrame:
    """The ``top_k`` nearest rows with ``_distance``; rows whose vector has another length don't take part."""
    if dimensions is not None and len(vector) != dimensions:
        raise QueryError(f"the vector has {len(vector)} components, not {dimensions}")
    rows = df.where(where(df, where_)) if where_ else df
    rows = rows.where(F.size(F.col(field)) == len(vector)).withColumn("_distance", distance(F.col(field), vector, metric))
    return rows.orderBy("_distance", id_).limit(top_k)


def hybrid_search(df: DataFrame, text: str, vector: list[float], fields: list[str], field: str = "embedding", top_k: int = 10, where_: dict | None = None, candidates: int | None = None, k: int = 60, metric: str = "l2", id_: str = "_id", mode: str = "rrf") -> DataFrame:
    """Reciprocal-rank fusion of both rankings as ``_rrf``; ``mode="rerank"`` orders the text's hits by distance instead."""
    most = candidates or top_k * 4
    if mode == "rerank":
        return find_similar(search(df, fields, text, id_, None, where_).drop("_score"), vector, field, top_k, None, metric, id_)
    words = search(df, fields, text, id_, most, where_).select(id_, F.row_number().over(W.orderBy(F.desc("_score"), id_)).alias("rank"))
    near = find_similar(df, vector, field, most, where_, metric, id_).select(id_, F.row_number().over(W.orderBy("_distance", id_)).alias("rank"))
    fused = words.unionByName(near).groupBy(id_).agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("_rrf"))
    top = fused.orderBy(F.desc("_rrf"), id_).limit(top_k)
    return df.join(F.broadcast(top), id_).orderBy(F.desc("_rrf"), id_)  # top_k rows
