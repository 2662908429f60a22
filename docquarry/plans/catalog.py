"""Registered queries and their SQL counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import aggregate as A
from docquarry.operators import cron, query as Q, ranking as R, search as S, update as U
from docquarry.operators.fts import Index
from docquarry.operators.stores import claim_order, live
from docquarry.operators.where import where
from docquarry.runtime import shared_dir, table
from docquarry.sources.indexes import VectorStore
from docquarry.sources.store import Database, UniqueError
from docquarry.streaming import feed as FD
from docquarry.streaming.sync import FolderAdapter, SyncEngine

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Registers ``fn(spark, sf_dir)`` under ``name``, with the SQL that gives the same rows."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# Filters over orders, with a status that is null in part.
_NULLABLE = "(SELECT *, nullif(o_orderstatus, 'P') AS st FROM orders)"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("st", F.nullif("o_orderstatus", F.lit("P")))


def _filter(name: str, spec: dict, sql: str, source: str = "orders", key: str = "o_orderkey", relation: str = _NULLABLE) -> None:
    def run(spark, d):
        df = _orders(spark, d) if source == "orders" else table(spark, d, source)
        return df.where(where(df, spec)).select(key)

    query(name, f"SELECT {key} FROM {relation if source == 'orders' else source} AS t WHERE {sql}")(run)


_filter("where_equals", {"o_orderpriority": "1-URGENT"}, "o_orderpriority = '1-URGENT'")
_filter("where_null", {"st": None}, "st IS NULL")
_filter("where_not", {"st": {"not": "O"}}, "st IS NULL OR st <> 'O'")
_filter("where_range", {"o_totalprice": {"gte": 1000, "lt": 50000.5}}, "o_totalprice >= 1000 AND o_totalprice < 50000.5")
_filter("where_gt_lte", {"o_custkey": {"gt": 5, "lte": 90}}, "o_custkey > 5 AND o_custkey <= 90")
_filter("where_in", {"o_orderpriority": {"in": ["1-URGENT", "2-HIGH"]}}, "o_orderpriority IN ('1-URGENT', '2-HIGH')")
_filter("where_in_null", {"st": {"in": ["O", None]}}, "st = 'O' OR st IS NULL")
_filter("where_in_empty", {"st": {"in": []}}, "false")
_filter("where_not_in", {"st": {"notIn": ["O"]}}, "st IS NULL OR st NOT IN ('O')")
_filter("where_not_in_null", {"st": {"notIn": [None]}}, "st IS NOT NULL")
_filter("where_and_or_not", {"OR": [{"st": "F"}, {"o_totalprice": {"gt": 400000}}], "NOT": {"o_orderpriority": {"startsWith": "5"}}}, "(st = 'F' OR o_totalprice > 400000) AND NOT coalesce(starts_with(o_orderpriority, '5'), false)")
_filter("where_empty_or", {"OR": []}, "false")
_filter("where_not_missing", {"NOT": {"st": {"gt": "G"}}}, "NOT coalesce(st > 'G', false)")
_filter("where_mixed_types", {"o_totalprice": {"lt": "a"}, "o_orderpriority": {"gt": 3}}, "o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL")
_filter("where_contains", {"p_name": {"contains": "anvil"}}, "contains(p_name, 'anvil')", "part", "p_partkey")
_filter("where_starts_with", {"p_brand": {"startsWith": "Brand#1"}}, "starts_with(p_brand, 'Brand#1')", "part", "p_partkey")
_filter("where_ends_with", {"p_type": {"endsWith": "L"}}, "ends_with(p_type, 'L')", "part", "p_partkey")
_filter("where_insensitive", {"p_type": {"contains": "eCONo", "mode": "insensitive"}}, "contains(lower(p_type), 'econo')", "part", "p_partkey")
_filter("where_regex", {"p_name": {"regex": "^[bg][a-z]+ .*[aeiou][lrn]$"}}, "regexp_matches(p_name, '^[bg][a-z]+ .*[aeiou][lrn]$')", "part", "p_partkey")
_filter("where_text_contains", {"text": {"contains": "licensed under", "mode": "insensitive"}}, "contains(lower(text), 'licensed under')", "documents", "doc_id")


# Predicates on arrays and on JSON bodies.
def _baskets(spark, d):
    line = table(spark, d, "lineitem")
    return line.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"))).alias("items"), F.collect_list("l_partkey").alias("parts"))


def _basket(name: str, spec: dict, sql: str) -> None:
    query(name, f"SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING {sql}")(lambda s, d: (lambda b: b.where(where(b, spec)).select("l_orderkey"))(_baskets(s, d)))


_basket("where_has", {"parts": {"has": 7}}, "count(*) FILTER (l_partkey = 7) > 0")
_basket("where_array_contains", {"parts": {"contains": 11}}, "count(*) FILTER (l_partkey = 11) > 0")
_basket("where_elem_match_scalar", {"parts": {"elemMatch": {"gte": 10, "lt": 14}}}, "count(*) FILTER (l_partkey >= 10 AND l_partkey < 14) > 0")
_basket("where_elem_match_object", {"items": {"elemMatch": {"part": {"lt": 50}, "qty": {"gte": 45}}}}, "count(*) FILTER (l_partkey < 50 AND l_quantity >= 45) > 0")


def _documents(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").cast("string").alias("_id"), F.parse_json("props").alias("data"), "user_id", "event_type")


_K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"


def _body(name: str, spec: dict, sql: str) -> None:
    query(name, f"SELECT CAST(event_id AS VARCHAR) AS _id FROM events WHERE {sql}")(lambda s, d: (lambda e: e.where(where(e, spec)).select("_id"))(_documents(s, d)))


_body("where_doc_path", {"k": {"gte": 50, "lt": 60}}, f"{_K} >= 50 AND {_K} < 60")
_body("where_doc_text_order", {"k": {"lt": "a"}}, f"{_K} IS NOT NULL")
_body("where_exists", {"k": {"exists": True}, "absent": {"exists": False}}, "json_exists(props, '$.k')")
_body("where_doc_not", {"NOT": {"k": 7}}, f"coalesce({_K} <> 7, true)")


# Projection, order, pages.
@query("select_nested", "SELECT o_orderkey, {'price': o_totalprice, 'status': o_orderstatus}::VARCHAR IS NOT NULL AS has_inner, o_totalprice AS price FROM orders")
def select_nested(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status")).alias("inner"))
    out = Q.project(df, {"o_orderkey": True, "inner.price": True})
    return out.select("o_orderkey", F.col("inner").isNotNull().alias("has_inner"), "inner.price")


@query("order_skip_take", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def order_skip_take(spark, d):
    return Q.find_many(table(spark, d, "orders"), order_by=[{"o_totalprice": "desc"}, {"o_orderkey": "asc"}], skip=10, take=20, select={"o_orderkey": True, "o_totalprice": True})


@query("order_nulls_first", f"SELECT o_orderkey, st FROM {_NULLABLE} AS t ORDER BY st ASC NULLS FIRST, o_orderkey LIMIT 50")
def order_nulls_first(spark, d):
    return Q.find_many(_orders(spark, d), order_by=[{"st": "asc"}, {"o_orderkey": "asc"}], take=50, select={"o_orderkey": True, "st": True})


@query("find_by_id", "SELECT * FROM customer WHERE c_custkey = 42")
def find_by_id(spark, d):
    return Q.find_by_id(table(spark, d, "customer"), 42, "c_custkey")


@query("count_where", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def count_where(spark, d):
    o = table(spark, d, "orders")
    return o.where(where(o, {"o_orderstatus": "F"})).agg(F.count("*").alias("n"))


# Lookups.
@query("lookup_array", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT coalesce(round(sum(o_totalprice), 2), 0) FROM orders WHERE o_custkey = c_custkey) AS total FROM customer")
def lookup_array(spark, d):
    out = Q.lookup(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey", "orders")
    total = F.aggregate("orders", F.lit(0.0), lambda s, o: s + o["o_totalprice"])
    return out.select("c_custkey", F.size("orders").cast("long").alias("n"), F.round(total, 2).alias("total"))


@query("lookup_unwind", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def lookup_unwind(spark, d):
    out = Q.find_many(table(spark, d, "customer"), {"c_mktsegment": "BUILDING"}, lookups=[{"from": table(spark, d, "orders"), "localField": "c_custkey", "foreignField": "o_custkey", "as": "o", "unwind": True}])
    return out.select("c_custkey", "o.o_orderkey")


@query("lookup_preserve", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON o_custkey = c_custkey")
def lookup_preserve(spark, d):
    o = table(spark, d, "orders")
    out = Q.lookup(table(spark, d, "customer"), o.where(where(o, {"o_totalprice": {"gt": 300000}})), "c_custkey", "o_custkey", "o", "preserve")
    return out.select("c_custkey", "o.o_orderkey")


@query("lookup_multi", "SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity > 45")
def lookup_multi(spark, d):
    steps = [{"from": table(spark, d, t), "localField": a, "foreignField": b, "as": t, "unwind": True} for t, a, b in (("part", "l_partkey", "p_partkey"), ("supplier", "l_suppkey", "s_suppkey"))]
    out = Q.find_many(table(spark, d, "lineitem"), {"l_quantity": {"gt": 45}}, lookups=steps)
    return out.select("l_orderkey", "l_linenumber", "part.p_name", "supplier.s_name")


@query("lookup_select", "SELECT c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
def lookup_select(spark, d):
    out = Q.find_many(table(spark, d, "customer").withColumn("id", F.col("c_custkey")), lookups=[{"from": table(spark, d, "orders"), "localField": "c_custkey", "foreignField": "o_custkey", "as": "o"}], select={"c_name": True})
    return out.select("c_name", F.size("o").cast("long").alias("n"))


@query("semi_filter", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def semi_filter(spark, d):
    return Q.having_related(table(spark, d, "orders"), table(spark, d, "customer"), "o_custkey", "c_custkey", {"c_acctbal": {"gt": 5000}}).select("o_orderkey")


@query("anti_orphans", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000)")
def anti_orphans(spark, d):
    return Q.having_related(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey", {"o_totalprice": {"gt": 350000}}, related=False).select("c_custkey")


@query("latest_per_key", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_per_key(spark, d):
    return R.latest_per_key(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


# Aggregation.
@query("aggregate_all", 'SELECT count(*) AS _count, round(sum(o_totalprice), 2) AS _sum_o_totalprice, round(avg(o_totalprice), 4) AS _avg_o_totalprice, min(o_orderpriority) AS _min_o_orderpriority, max(o_custkey) AS _max_o_custkey FROM orders WHERE o_orderstatus = \'O\'')
def aggregate_all(spark, d):
    out = A.aggregate(table(spark, d, "orders"), {"o_orderstatus": "O"}, _count=True, _sum={"o_totalprice": True}, _avg={"o_totalprice": True}, _min={"o_orderpriority": True}, _max={"o_custkey": True})
    return out.withColumns({"_sum_o_totalprice": F.round("_sum_o_totalprice", 2), "_avg_o_totalprice": F.round("_avg_o_totalprice", 4)})


@query("aggregate_empty", "SELECT count(*) AS _count, sum(o_totalprice) AS _sum_o_totalprice FROM orders WHERE o_totalprice < 0")
def aggregate_empty(spark, d):
    return A.aggregate(table(spark, d, "orders"), {"o_totalprice": {"lt": 0}}, _count=True, _sum={"o_totalprice": True})


@query("group_by", f"SELECT st, count(*) AS _count, round(sum(o_totalprice), 2) AS _sum_o_totalprice FROM {_NULLABLE} AS t GROUP BY st")
def group_by(spark, d):
    return A.group_by(_orders(spark, d), ["st"], _count=True, _sum={"o_totalprice": True}).withColumn("_sum_o_totalprice", F.round("_sum_o_totalprice", 2))


@query("group_having", "SELECT o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderpriority HAVING count(*) > 10 AND avg(o_totalprice) > 1000")
def group_having(spark, d):
    out = A.group_by(table(spark, d, "orders"), ["o_orderpriority"], having={"_count": {"gt": 10}, "_avg": {"o_totalprice": {"gt": 1000}}}, _count=True, _sum={"o_totalprice": True})
    return out.select(F.col("o_orderpriority").alias("priority"), F.col("_count").alias("n"), F.round("_sum_o_totalprice", 2).alias("total"))


@query("group_order_by_sum", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 25 OFFSET 5")
def group_order_by_sum(spark, d):
    out = A.group_by(table(spark, d, "orders"), ["o_custkey"], order_by=[{"_sum": {"o_totalprice": "desc"}}, {"o_custkey": "asc"}], skip=5, take=25, _sum={"o_totalprice": True})
    return out.select("o_custkey", F.round("_sum_o_totalprice", 2).alias("total"))


@query("group_by_doc_path", f"SELECT {_K} AS k, count(*) AS n FROM events GROUP BY 1")
def group_by_doc_path(spark, d):
    out = A.group_by(_documents(spark, d), ["k"], _count=True)
    return out.select(F.col("k").cast("double").alias("k"), F.col("_count").alias("n"))


@query("distinct_scalar", "SELECT DISTINCT p_brand AS value FROM part")
def distinct_scalar(spark, d):
    return A.distinct(table(spark, d, "part"), "p_brand")


@query("distinct_unwind", "SELECT DISTINCT l_partkey AS value FROM lineitem")
def distinct_unwind(spark, d):
    return A.distinct(_baskets(spark, d), "parts")


@query("counts_by_status", "SELECT s.status, CAST(count(o_orderkey) AS BIGINT) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) s(status) LEFT JOIN orders ON o_orderstatus = s.status GROUP BY s.status")
def counts_by_status(spark, d):
    return R.counts_by_status(table(spark, d, "orders"), "o_orderstatus", ["F", "O", "P", "X"])


# Ranking.
@query("zrank", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_name) - 1 AS rank FROM customer")
def zrank(spark, d):
    return R.zrank(table(spark, d, "customer"), ["c_nationkey"], "c_name", "c_acctbal").select("c_custkey", F.col("rank").cast("long").alias("rank"))


@query("zrange", "SELECT c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_name) BETWEEN 2 AND 5")
def zrange(spark, d):
    return R.zrange(table(spark, d, "customer"), ["c_nationkey"], "c_name", "c_acctbal", 1, 4).select("c_custkey")


@query("zrange_rev", "SELECT c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_name) <= 3")
def zrange_rev(spark, d):
    return R.zrange(table(spark, d, "customer"), ["c_nationkey"], "c_name", "c_acctbal", -3, -1, rev=True).select("c_custkey")


@query("zrange_by_score", "SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 1000 AND 2000")
def zrange_by_score(spark, d):
    return R.zrange_by_score(table(spark, d, "customer"), "c_acctbal", "c_name", 1000, 2000).select("c_custkey")


@query("rate_window", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY (epoch_us(ts) // 1000) RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def rate_window(spark, d):
    e = table(spark, d, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return R.rate_window(e, ["event_type"], "ms", 3_600_000).select("event_id", "in_window")


# Updates, as the state they leave.
@query("update_set", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_set(spark, d):
    return U.update_many(table(spark, d, "orders"), {"o_totalprice": {"gt": 200000}}, {"$set": {"o_orderstatus": "X"}}).select("o_orderkey", "o_orderstatus")


@query("update_inc", "SELECT p_partkey, CAST(CASE WHEN p_size < 10 THEN p_size + 100 ELSE p_size END AS INTEGER) AS p_size FROM part")
def update_inc(spark, d):
    return U.update_many(table(spark, d, "part"), {"p_size": {"lt": 10}}, {"$inc": {"p_size": 100}}).select("p_partkey", "p_size")


@query("update_unset", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS o_orderpriority FROM orders")
def update_unset(spark, d):
    return U.update_many(table(spark, d, "orders"), {"o_orderstatus": "F"}, {"$unset": {"o_orderpriority": True}}).select("o_orderkey", "o_orderpriority")


def _array_update(name: str, change: dict, sql: str) -> None:
    def run(spark, d):
        out = U.update_many(_baskets(spark, d).select("l_orderkey", F.array_sort(F.array_distinct("parts")).alias("parts")), None, change)
        return out.select("l_orderkey", F.array_join("parts", ",").alias("parts"))

    query(name, f"SELECT l_orderkey, array_to_string({sql}, ',') AS parts FROM (SELECT l_orderkey, list_sort(list(DISTINCT l_partkey)) AS p FROM lineitem GROUP BY l_orderkey)")(run)


_array_update("push", {"$push": {"parts": {"$each": [1, 1]}}}, "list_concat(p, [1, 1])")
_array_update("add_to_set", {"$addToSet": {"parts": {"$each": [7, 8, 8]}}}, "list_concat(p, [x for x in [7, 8] if NOT list_contains(p, x)])")
_array_update("pull", {"$pull": {"parts": 7}}, "[x for x in p if x <> 7]")


_CHANGES = "(SELECT c_custkey, 'new' AS c_name FROM customer WHERE c_acctbal < 3000 UNION ALL SELECT -c_custkey, 'new' FROM customer WHERE c_acctbal > 7000)"


@query("upsert", f"SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM {_CHANGES}) UNION ALL SELECT c_custkey, c_name FROM {_CHANGES}")
def upsert(spark, d):
    c = table(spark, d, "customer")
    old, added = c.where("c_acctbal < 3000").select("c_custkey", F.lit("new").alias("c_name")), c.where("c_acctbal > 7000").select((-F.col("c_custkey")).alias("c_custkey"), F.lit("new").alias("c_name"))
    return U.upsert(c.select("c_custkey", "c_name"), old.unionByName(added), ["c_custkey"])


@query("delete_many", f"SELECT o_orderkey FROM {_NULLABLE} AS t WHERE NOT coalesce(st = 'O', false)")
def delete_many(spark, d):
    return U.delete_many(_orders(spark, d), {"st": "O"}).select("o_orderkey")


@query("purge_expired", "SELECT event_id FROM events WHERE NOT (epoch_us(ts) // 1000) < 1705276800000")
def purge_expired(spark, d):
    e = table(spark, d, "events").withColumn("at", F.unix_millis(F.col("ts").cast("timestamp")))
    return U.purge_expired(e, "at", 86400, 1705276800000 + 86400_000).select("event_id")


@query("unique_violations", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def unique_violations(spark, d):
    return U.violations(table(spark, d, "orders"), ["o_custkey"])


# Search.
_Q = [0.1 * ((i % 7) - 3) for i in range(64)]
_QS = "[" + ", ".join(map(repr, _Q)) + "]::DOUBLE[]"


def _knn(name: str, metric: str, spec: dict | None, sql_distance: str, sql_where: str) -> None:
    def run(spark, d):
        out = S.find_similar(table(spark, d, "embeddings"), _Q, top_k=20, where_=spec, metric=metric, id_="vec_id")
        return out.select("vec_id", F.round("_distance", 4).alias("distance"))

    query(name, f"SELECT vec_id, round({sql_distance}(embedding::DOUBLE[], {_QS}), 4) AS distance FROM embeddings WHERE {sql_where} ORDER BY {sql_distance}(embedding::DOUBLE[], {_QS}), vec_id LIMIT 20")(run)


_knn("knn_l2", "l2", None, "list_distance", "true")
_knn("knn_cosine", "cosine", None, "list_cosine_distance", "true")
_knn("knn_filtered", "l2", {"label": {"in": [1, 2]}}, "list_distance", "label IN (1, 2)")

_FTS = """WITH t AS (SELECT *, regexp_extract_all(translate(lower(text), '{a}', '{b}'), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
 f AS (SELECT *, len(w) AS n, len([x for x in w if x = '{x}']) AS f1, len([x for x in w if x = '{y}']) AS f2 FROM t),
 s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (f1 > 0) AS d1, count(*) FILTER (f2 > 0) AS d2 FROM f),
 r AS (SELECT doc_id, source, lang, greatest(ln((docs - d1 + 0.5) / (d1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * n / mean))
                    + greatest(ln((docs - d2 + 0.5) / (d2 + 0.5)), 1e-6) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * n / mean)) AS score FROM f, s WHERE {w})
SELECT doc_id, round(score, 4) AS score FROM r ORDER BY score DESC, doc_id {limit}"""


def _fts_sql(x: str, y: str, w: str, limit: str = "") -> str:
    return _FTS.format(a=S._ACCENTS[0], b=S._ACCENTS[1], x=x, y=y, w=w, limit=limit)


@query("fts_search", _fts_sql("license", "public", "f1 > 0 AND f2 > 0"))
def fts_search(spark, d):
    return S.search(table(spark, d, "documents"), ["text"], "license public", "doc_id", None).select("doc_id", F.round("_score", 4).alias("score"))


@query("fts_boolean", _fts_sql("rights", "copyright", "f1 > 0 OR f2 > 0"))
def fts_boolean(spark, d):
    return S.search(table(spark, d, "documents"), ["text"], "rights OR copyright", "doc_id", None).select("doc_id", F.round("_score", 4).alias("score"))


@query("fts_filtered", _fts_sql("license", "public", "f1 > 0 AND f2 > 0 AND lang = 'en'"))
def fts_filtered(spark, d):
    return S.search(table(spark, d, "documents"), ["text"], "license AND public", "doc_id", None, {"lang": "en"}).select("doc_id", F.round("_score", 4).alias("score"))


@query("fts_phrase", f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string(regexp_extract_all(translate(lower(text), '{S._ACCENTS[0]}', '{S._ACCENTS[1]}'), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ', ' public license ')")
def fts_phrase(spark, d):
    return S.search(table(spark, d, "documents"), ["text"], '"public license"', "doc_id", None).select("doc_id")


@query(
    "hybrid_rrf",
    f"""WITH v AS (SELECT vec_id, row_number() OVER (ORDER BY list_distance(embedding::DOUBLE[], {_QS}), vec_id) AS rank FROM embeddings QUALIFY rank <= 40),
 w AS (SELECT vec_id, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM (
   SELECT vec_id, greatest(ln(((SELECT count(*) FROM embeddings) - d + 0.5) / (d + 0.5)), 1e-6) AS s FROM embeddings, (SELECT count(*) AS d FROM embeddings WHERE label = 3) WHERE label = 3) QUALIFY rank <= 40)
 SELECT vec_id, round(sum(1.0 / (60 + rank)), 6) AS rrf FROM (SELECT * FROM v UNION ALL SELECT * FROM w) GROUP BY vec_id ORDER BY sum(1.0 / (60 + rank)) DESC, vec_id LIMIT 10""",
)
def hybrid_rrf(spark, d):
    e = table(spark, d, "embeddings").withColumn("title", F.concat(F.lit("label "), F.col("label").cast("string")))
    return S.hybrid_search(e, "3", _Q, ["title"], id_="vec_id").select("vec_id", F.round("_rrf", 6).alias("rrf"))


# Change feed, live queries, replication.
def _feed(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("coll"), F.col("user_id").cast("string").alias("doc_id"),
        F.when(F.col("value") < 5, "delete").otherwise("upsert").alias("op"),
        FD.make_version(F.unix_millis(F.col("ts").cast("timestamp")), F.lit("n1"), F.col("event_id")).alias("version"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
        F.when(F.col("event_id") % 3 == 0, "remote").otherwise("local").alias("source"), (F.col("event_id") % 5 == 0).alias("pushed"),
    )


_FEED = "(SELECT event_id AS seq, event_type AS coll, CAST(user_id AS VARCHAR) AS doc_id, CASE WHEN event_id % 3 = 0 THEN 'remote' ELSE 'local' END AS source, event_id % 5 = 0 AS pushed, lpad(CAST((epoch_us(ts) // 1000) AS VARCHAR), 15, '0') || ':n1:' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS version FROM events)"


@query("feed_since", f"SELECT seq, version FROM {_FEED} WHERE seq > 100 AND coll = 'click' ORDER BY seq LIMIT 50")
def feed_since(spark, d):
    return FD.feed_since(_feed(spark, d), 100, "click", 50).select("seq", "version")


@query("feed_current", f"SELECT max(seq) AS seq FROM {_FEED}")
def feed_current(spark, d):
    return FD.current_seq(_feed(spark, d))


@query("feed_compact", f"SELECT seq FROM {_FEED} WHERE seq > (SELECT max(seq) FROM {_FEED}) - 500 OR (source = 'local' AND NOT pushed)")
def feed_compact(spark, d):
    return FD.compact(_feed(spark, d), 500, syncing=True).select("seq")


@query("pending_push", f"SELECT coll, doc_id, max(seq) AS seq FROM {_FEED} WHERE source = 'local' AND NOT pushed GROUP BY coll, doc_id")
def pending_push(spark, d):
    return FD.pending(_feed(spark, d)).select("coll", "doc_id", "seq")


@query("feed_mark_pushed", f"SELECT f.seq, f.pushed OR coalesce(f.seq <= m.u, false) AS pushed FROM {_FEED} f LEFT JOIN (SELECT event_type AS coll, CAST(user_id AS VARCHAR) AS doc_id, max(event_id) AS u FROM events WHERE (epoch_us(ts) // 3600000000) % 2 = 0 GROUP BY ALL) m USING (coll, doc_id)")
def feed_mark_pushed(spark, d):
    f = _feed(spark, d)
    return FD.mark_pushed(f, f.where("(ts div 3600000) % 2 = 0").select("coll", "doc_id", "seq")).select("seq", "pushed")


@query("lww_merge", """WITH l AS (SELECT o_orderkey AS id, o_totalprice AS v, lpad(CAST(o_orderkey * 7 % 1000 AS VARCHAR), 6, '0') AS ver FROM orders WHERE o_orderkey % 3 <> 0),
 r AS (SELECT o_orderkey AS id, o_totalprice + 1 AS v, lpad(CAST(o_orderkey * 13 % 1000 AS VARCHAR), 6, '0') AS ver FROM orders WHERE o_orderkey % 4 <> 0)
 SELECT coalesce(l.id, r.id) AS id, CASE WHEN l.id IS NULL OR r.ver > l.ver THEN r.v ELSE l.v END AS value,
  CASE WHEN r.id IS NULL THEN 'local' WHEN l.id IS NULL THEN 'applied' WHEN l.ver = r.ver THEN 'echo' WHEN r.ver > l.ver THEN 'remote' ELSE 'local_won' END AS outcome FROM l FULL JOIN r ON l.id = r.id""")  # fmt: skip
def lww_merge(spark, d):
    o = table(spark, d, "orders")

    def side(keep: str, by: int, more: int):
        return o.where(keep).select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") + more).alias("value"), F.lpad((F.col("o_orderkey") * by % 1000).cast("string"), 6, "0").alias("version"))

    return FD.merge_lww(side("o_orderkey % 3 <> 0", 7, 0), side("o_orderkey % 4 <> 0", 13, 1), "id").select("id", "value", "outcome")


def _states(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("_id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    before = o.where("_id % 5 <> 0")
    after = o.where("_id % 7 <> 0").withColumn("status", F.when(F.col("_id") % 11 == 0, "Z").otherwise(F.col("status")))
    return before, after


_STATES = "(SELECT o_orderkey AS _id, o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_orderkey % 5 <> 0) b FULL JOIN (SELECT o_orderkey AS _id, CASE WHEN o_orderkey % 11 = 0 THEN 'Z' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 7 <> 0) a ON a._id = b._id"


@query("live_delta", f"SELECT coalesce(a._id, b._id) AS _id, CASE WHEN b._id IS NULL THEN 'added' WHEN a._id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM {_STATES} WHERE a._id IS NULL OR b._id IS NULL OR a.s <> b.s")
def live_delta(spark, d):
    return FD.live_delta(*_states(spark, d)).select("_id", "change")


@query("live_fields", f"SELECT coalesce(a._id, b._id) AS _id, CASE WHEN b._id IS NULL THEN 'added' ELSE 'removed' END AS change FROM {_STATES} WHERE a._id IS NULL OR b._id IS NULL")
def live_fields(spark, d):
    return FD.live_delta(*_states(spark, d), fields=["price"]).select("_id", "change")


@query(
    "live_moved",
    """WITH b AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS r FROM customer),
 a AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY CASE WHEN c_custkey % 50 = 0 THEN -1e6 ELSE c_acctbal END, c_custkey) AS r FROM customer)
 SELECT b.id AS _id FROM a JOIN b ON a.id = b.id WHERE a.r <> b.r""",
)
def live_moved(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("_id"), F.col("c_acctbal").alias("rank"))
    after = c.withColumn("rank", F.when(F.col("_id") % 50 == 0, -1e6).otherwise(F.col("rank")))
    return FD.live_delta(c, after, order=[F.col("rank")]).where("change = 'moved'").select("_id")


# Operational stores.
@query("queue_claim_order", "SELECT o_orderkey AS seq, row_number() OVER (ORDER BY o_custkey % 5 DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'P' AND (epoch_us(o_orderdate) // 1000) <= 852076800000 ORDER BY 2 LIMIT 100")
def queue_claim_order(spark, d):
    o = table(spark, d, "orders")
    jobs = o.select(F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("completed").alias("status"), (F.col("o_custkey") % 5).alias("priority"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("run_at"))
    top = claim_order(jobs, 852076800000).limit(100)
    return R.zrank(top.withColumn("all", F.lit(1)), ["all"], "seq", "priority").withColumn("p", -F.col("priority")).select("seq", F.expr("row_number() OVER (ORDER BY priority DESC, seq)").cast("long").alias("place"))


@query("kv_live_keys", "SELECT event_id FROM events WHERE event_id % 4 = 0 OR (epoch_us(ts) // 1000) + 86400000 > 1705276800000")
def kv_live_keys(spark, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = table(spark, d, "events").withColumn("expires_at", F.when(F.col("event_id") % 4 != 0, ms + 86400000))
    return live(rows, 1705276800000).select("event_id")


@query("cron_next", "SELECT event_id, date_trunc('hour', ts) + INTERVAL 1 MINUTE * (CAST(floor(minute(ts) / 15) AS INTEGER) + 1) * 15 AS due FROM events")
def cron_next(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", cron.next_run_column(F.lit("*/15 * * * *"), F.col("ts")).alias("due"))


@query("raw_sql", "WITH t AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT c_mktsegment, CAST(rank() OVER (ORDER BY round(sum(s), 2) DESC) AS INTEGER) AS place, round(sum(s), 2) AS total FROM t JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment")
def raw_sql(spark, d):
    for t in ("orders", "customer"):
        table(spark, d, t).createOrReplaceTempView(t)
    return spark.sql(
        "WITH t AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) "
        "SELECT c_mktsegment, CAST(rank() OVER (ORDER BY round(sum(s), 2) DESC) AS INT) AS place, round(sum(s), 2) AS total FROM t JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment"
    )


# Single answers, as one row.
@query("exists_where", "SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 400000) AS there, EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0) AS absent")
def exists_where(spark, d):
    o = table(spark, d, "orders")
    return spark.createDataFrame([(Q.exists(o, {"o_totalprice": {"gt": 400000}}), Q.exists(o, {"o_totalprice": {"lt": 0}}))], "there boolean, absent boolean")


@query("count_of", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def count_of(spark, d):
    return spark.createDataFrame([(Q.count(table(spark, d, "orders"), {"o_orderstatus": "F"}),)], "n long")


@query("find_by_text_id", "SELECT c_custkey, c_name FROM customer WHERE CAST(c_custkey AS VARCHAR) = '42'")
def find_by_text_id(spark, d):
    c = table(spark, d, "customer").withColumn("_id", F.col("c_custkey").cast("string"))
    return Q.find_by_id(c, 42).select("c_custkey", "c_name")


@query("find_first", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def find_first(spark, d):
    return Q.find_first(table(spark, d, "orders"), {"o_orderstatus": "F"}, [{"o_totalprice": "desc"}, {"o_orderkey": "asc"}]).select("o_orderkey")


@query("distinct_doc_values", f"SELECT DISTINCT {_K} AS value FROM events WHERE {_K} IS NOT NULL")
def distinct_doc_values(spark, d):
    return A.distinct(_documents(spark, d), "k").select(F.col("value").cast("double").alias("value"))


@query("group_min_max_doc", f"SELECT event_type AS kind, min({_K}) AS low, max({_K}) AS high FROM events GROUP BY event_type")
def group_min_max_doc(spark, d):
    out = A.group_by(_documents(spark, d), ["event_type"], _min={"k": True}, _max={"k": True})
    return out.select(F.col("event_type").alias("kind"), F.col("_min_k").cast("double").alias("low"), F.col("_max_k").cast("double").alias("high"))


# Through a database folder: what its files hold after the operations.
def _database(spark) -> Database:
    return Database(spark, f"{shared_dir(spark).removeprefix('file:').replace('///', '/')}/db-{uuid.uuid4().hex}")


_ORDER = {"custkey": {"type": "INTEGER"}, "status": {"type": "TEXT"}, "price": {"type": "REAL"}}


def _stored(spark, d, db: Database | None = None):
    db = db or _database(spark)
    held = db.collection("orders", _ORDER, unique=[["_id"]])
    o = table(spark, d, "orders")
    held.append(o.select(F.col("o_orderkey").cast("string").alias("_id"), F.parse_json(F.to_json(F.struct(F.col("o_orderpriority").alias("priority")))).alias("data"), F.col("o_custkey").cast("long").alias("custkey"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.lit(1).cast("long").alias("created_at"), F.lit(1).cast("long").alias("updated_at")))
    return db, held


@query("store_update_many", "SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS n FROM orders WHERE NOT (o_orderstatus = 'P' AND o_totalprice <= 200000)")
def store_update_many(spark, d):
    db, held = _stored(spark, d)
    held.update_many({"price": {"gt": 200000}}, {"$set": {"status": "X"}, "$inc": {"seen": 1}})
    held.delete_many({"status": "P"})
    return held.read().select(F.col("_id").alias("id"), "status", F.coalesce(F.try_variant_get("data", "$.seen", "int"), F.lit(0)).alias("n"))


@query("store_feed", "SELECT 'insert' AS op, count(*) AS n, count(*) AS seqs FROM orders UNION ALL SELECT 'update', count(*), count(*) FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT 'delete', count(*), count(*) FROM orders WHERE o_orderstatus = 'P' AND o_totalprice <= 200000")
def store_feed(spark, d):
    db, held = _stored(spark, d)
    with db.transaction():
        held.update_many({"price": {"gt": 200000}}, {"$set": {"status": "X"}})
        held.delete_many({"status": "P"})
    return db.feed().groupBy("op").agg(F.count("*").alias("n"), F.count_distinct("seq").alias("seqs"))


@query("store_query_raw", "SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def store_query_raw(spark, d):
    db, _ = _stored(spark, d)
    return db.query_raw("SELECT status, count(*) AS n, round(sum(price), 2) AS total FROM orders WHERE price > :least GROUP BY status", {"least": 100000})


@query("store_execute_raw", "SELECT CAST(o_orderkey AS VARCHAR) AS id, round(CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END, 2) AS price FROM orders WHERE o_totalprice >= 50000 UNION ALL SELECT 'new', 1.0")
def store_execute_raw(spark, d):
    db, held = _stored(spark, d)
    db.execute_raw("DELETE FROM orders WHERE price < ?", [50000])
    db.execute_raw("UPDATE orders SET price = price * 2 WHERE status = 'F'")
    db.execute_raw("INSERT INTO orders (_id, price) VALUES ('new', 1.0)")
    return held.read().select(F.col("_id").alias("id"), F.round("price", 2).alias("price"))


@query("store_rollback", "SELECT count(*) AS n, count(*) AS entries FROM orders")
def store_rollback(spark, d):
    db, held = _stored(spark, d)
    try:
        with db.transaction():
            held.delete_many({"status": "F"})
            held.create({"_id": "new"})
            held.create({"_id": "new", "status": "a copy of an identifier"})
    except UniqueError:
        pass
    return spark.createDataFrame([(held.count(), db.feed().count())], "n long, entries long")


@query("sync_folders", "SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_totalprice > 300000 THEN 'R' WHEN o_totalprice > 200000 THEN 'L' ELSE o_orderstatus END AS status FROM orders WHERE o_orderstatus <> 'P' OR o_totalprice > 200000")
def sync_folders(spark, d):
    """Both sides change the same documents; the later change wins on both."""
    db, held = _stored(spark, d)
    other = _database(spark)
    engine = SyncEngine(db, FolderAdapter(other, "other"), ["orders"])
    engine.sync()
    there = other.collection("orders")
    held.update_many({"price": {"gt": 200000}}, {"$set": {"status": "L"}})
    there.update_many({"price": {"gt": 300000}}, {"$set": {"status": "R"}})
    held.delete_many({"status": "P"})
    engine.sync()
    both = held.read().select("_id", "status").unionByName(there.read().select("_id", "status"))
    return both.distinct().select(F.col("_id").alias("id"), "status")


@query("fts_index", _fts_sql("license", "public", "f1 > 0 AND f2 > 0"))
def fts_index(spark, d):
    docs = table(spark, d, "documents")
    index = Index(spark, f"{shared_dir(spark).removeprefix('file:').replace('///', '/')}/fts-{uuid.uuid4().hex}", ["text"], "doc_id")
    index.reindex(docs)
    return index.search(docs, "license public", None).select("doc_id", F.round("_score", 4).alias("score"))


@query("fts_index_phrase", ORACLES["fts_phrase"])
def fts_index_phrase(spark, d):
    docs = table(spark, d, "documents")
    index = Index(spark, f"{shared_dir(spark).removeprefix('file:').replace('///', '/')}/fts-{uuid.uuid4().hex}", ["text"], "doc_id")
    index.reindex(docs)
    return index.search(docs, '"public license"', None).select("doc_id")


@query("vector_store", f"SELECT CAST(vec_id AS VARCHAR) AS id, round(list_cosine_distance(embedding::DOUBLE[], {_QS}), 4) AS distance FROM embeddings WHERE label = 3 ORDER BY list_cosine_distance(embedding::DOUBLE[], {_QS}), CAST(vec_id AS VARCHAR) LIMIT 10")
def vector_store(spark, d):
    store = VectorStore(_database(spark))
    held = store.ensure_collection("e", 64)
    e = table(spark, d, "embeddings")
    held.append(e.select(F.col("vec_id").cast("string").alias("_id"), F.parse_json(F.lit("{}")).alias("data"), F.col("embedding").cast("array<double>").alias("vector"), F.parse_json(F.to_json(F.struct("label"))).alias("metadata"), F.lit(1).cast("long").alias("created_at"), F.lit(1).cast("long").alias("updated_at")))
    return store.search("e", _Q, 10, {"label": 3}).select(F.col("_id").alias("id"), F.round("_distance", 4).alias("distance"))
