"""The registered queries: a Spark callable each, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Declared schemas of the shared tables; nothing is inferred on read.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


class Tables:
    """Attribute access to the tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.dir}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(self.path(name))

    def stream(self, name: str) -> DataFrame:
        # a glob path is taken whether the table is one file or a folder of files
        return self.spark.readStream.schema(SCHEMAS[name]).parquet(self.path(name) + "*")

    # A second version of `orders`, used wherever an operator compares two states of a table: a
    # seventh of the keys is gone, a seventh has a changed price, a seventh as many keys are new.
    @property
    def orders_v2(self) -> DataFrame:
        o, k = self.orders, F.col("o_orderkey")
        kept = o.where(k % 7 != 0).withColumn(
            "o_totalprice", F.when(k % 7 == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
        )
        return kept.unionAll(o.where(k % 7 == 2).withColumn("o_orderkey", k + NEW_KEY))

    # The log that leads from `orders` to `orders_v2`: an update is a delete and then an insert.
    @property
    def orders_log(self) -> DataFrame:
        o, k = self.orders, F.col("o_orderkey")
        gone = o.where((k % 7 == 0) | (k % 7 == 1)).withColumn("op", F.lit("D"))
        new = self.orders_v2.where((k % 7 == 1) & (k < NEW_KEY) | (k >= NEW_KEY)).withColumn("op", F.lit("I"))
        both = gone.unionByName(new)
        return both.withColumn("seq", k * 2 + F.when(F.col("op") == "I", 1).otherwise(0))


NEW_KEY = 1_000_000_000_000

ORDERS_V2 = f"""orders_v2 AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_orderkey % 7 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
         o_orderdate, o_orderpriority
  FROM orders WHERE o_orderkey % 7 <> 0
  UNION ALL
  SELECT o_orderkey + {NEW_KEY}, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderkey % 7 = 2)"""

ORDERS_LOG = f"""{ORDERS_V2},
orders_log AS (
  SELECT *, 'D' AS op, o_orderkey * 2 AS seq FROM orders WHERE o_orderkey % 7 IN (0, 1)
  UNION ALL
  SELECT *, 'I' AS op, o_orderkey * 2 + 1 AS seq FROM orders_v2
  WHERE (o_orderkey < {NEW_KEY} AND o_orderkey % 7 = 1) OR o_orderkey >= {NEW_KEY})"""


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def refused(check: Callable, *args, **named) -> Column:
    """Whether a check turns its input down, as a column beside the rows it is about."""
    try:
        check(*args, **named)
    except (TypeError, ValueError):
        return F.lit(True)
    return F.lit(False)


def query(name: str, sql: str | None = None):
    """Register `fn(tables)` under `name`, with the SQL that gives the same rows when there is one."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(fn, sql)
        return fn

    return add
