"""Queries that earlier saw a range of identifiers only reach the whole table; none is empty on both sides."""

from pyspark.sql import functions as F

from docquarry.plans import catalog
from tests.compare import oracle_rows

SF = "/root/testdata/sf0.01"
EMPTY = {"where_in_empty", "where_empty_or"}


def test_distinct_over_all_baskets(spark):
    line = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert catalog.QUERIES["distinct_unwind"](spark, SF).count() == line.select("l_partkey").distinct().count()


def test_changes_from_the_whole_table(spark):
    c = spark.read.parquet(f"{SF}/customer.parquet")
    new = catalog.QUERIES["upsert"](spark, SF).where("c_name = 'new'")
    assert new.where("c_custkey > 0").agg(F.max("c_custkey")).first()[0] > 0.9 * c.count() and new.where("c_custkey < 0").count() > 0.1 * c.count()
    assert catalog.QUERIES["feed_mark_pushed"](spark, SF).where("pushed and seq > 4000 and seq % 5 <> 0").count() > 0


def test_no_query_is_empty():
    assert {name for name, sql in catalog.ORACLES.items() if not oracle_rows(sql, SF)[1]} == EMPTY
