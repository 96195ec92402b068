"""Registered queries: keyed writes and publication."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtide.catalog.registry import NEW_KEY, ORDERS_V2, Tables, query, refused
from rowtide.operators import publish as p, writes as w
from rowtide.session import fresh_path, stored

KEY = ["o_orderkey"]


def fresh_orders(t: Tables):
    return t.orders_v2.where(F.col("o_orderkey") >= NEW_KEY)


@query("sink_insert", f"WITH {ORDERS_V2} SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders UNION ALL SELECT o_orderkey, o_totalprice, NULL FROM orders_v2 WHERE o_orderkey >= {NEW_KEY}")
def insert(t):
    return w.insert(t.orders, fresh_orders(t).drop("o_orderpriority"), KEY).select("o_orderkey", "o_totalprice", "o_orderpriority")


@query("sink_ignore_duplicates", f"WITH {ORDERS_V2} SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT o_orderkey, min(o_totalprice) FROM orders_v2 WHERE o_orderkey >= {NEW_KEY} GROUP BY 1")
def ignore_duplicates(t):
    twice = t.orders_v2.unionByName(t.orders_v2.withColumn("o_totalprice", F.col("o_totalprice") + 5))
    return w.ignore_duplicates(t.orders, twice, KEY, "o_totalprice").select("o_orderkey", "o_totalprice")


@query("sink_merge_duplicates", f"""WITH {ORDERS_V2}, n AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS o_orderstatus FROM orders_v2)
    SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NULL THEN o.o_totalprice ELSE n.o_totalprice END AS o_totalprice,
      CASE WHEN n.o_orderkey IS NULL THEN o.o_orderstatus ELSE n.o_orderstatus END AS o_orderstatus, o.o_custkey
    FROM orders o FULL JOIN n ON o.o_orderkey = n.o_orderkey""")
def merge_duplicates(t):
    rows = t.orders_v2.select("o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"))
    return w.merge_duplicates(t.orders, rows, KEY).select("o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey")


@query("sink_update_where", """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer""")
def update_where(t):
    return w.update_where(t.customer, F.col("c_acctbal") < 0, {"c_mktsegment": F.lit("DEBT")}).select("c_custkey", "c_mktsegment", "c_acctbal")


@query("sink_delete_where", "SELECT * FROM customer WHERE NOT (c_acctbal < 0) OR c_acctbal IS NULL")
def delete_where(t):
    return w.delete_where(t.customer, F.col("c_acctbal") < 0)


@query("sink_returning", "SELECT c_custkey, CAST(0 AS DOUBLE) AS c_acctbal, c_name FROM customer WHERE c_acctbal < 0")
def returning(t):
    return w.returning(t.customer, F.col("c_acctbal") < 0, {"c_acctbal": F.lit(0.0)}).select("c_custkey", "c_acctbal", "c_name")


@query("sink_json_columns", """SELECT event_id, CAST(to_json(props) AS VARCHAR) AS props, CAST(to_json(value) AS VARCHAR) AS value FROM events""")
def json_columns(t):
    return w.json_columns(t.events.select("event_id", "props", "value"), ["props", "value"])


@query("pub_validate", """SELECT CAST(o_custkey AS VARCHAR) AS id, 'repeated id' AS rule, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1
    UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'not finite', count(*) FROM orders WHERE o_totalprice > 490000 GROUP BY 1""")
def validate(t):
    out = t.orders.select(F.col("o_custkey").cast("string").alias("id"),
                          F.when(F.col("o_totalprice") > 490000, F.lit(float("inf"))).otherwise(F.col("o_totalprice")).alias("total"))
    p.check_sinks(["totals"], {"totals": out})
    return p.violations(out)


@query("pub_validate_delta", f"""WITH {ORDERS_V2} SELECT CAST(o_orderkey AS VARCHAR) AS id, 2 AS n FROM orders_v2 WHERE o_orderkey < {NEW_KEY} AND o_orderstatus = 'F'""")
def validate_delta(t):
    ups = t.orders_v2.select(F.col("o_orderkey").cast("string").alias("id"))
    return p.delta_violations(ups, t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("id")))


@query("pub_check_columns", """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name, false AS sound, true AS no_id, true AS unknown, true AS read_only, true AS short FROM customer""")
def check_columns(t):
    sink = t.customer.select(F.col("c_custkey").cast("string").alias("id"), "c_name", "c_acctbal")
    out = sink.select("id", "c_name")
    cases = {"sound": out, "no_id": out.drop("id"), "unknown": out.withColumn("c_other", F.lit(1)), "read_only": sink, "short": out.select("id")}
    no = {n: refused(p.check_columns, sink.schema, df.schema, read_only=["c_acctbal"], required=["c_name"]) for n, df in cases.items()}
    return out.withColumns(no)


DIFF = f"""{ORDERS_V2}, a AS (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey,
    CASE WHEN n.o_orderkey IS NULL THEN o.o_totalprice ELSE n.o_totalprice END AS o_totalprice,
    CASE WHEN o.o_orderkey IS NULL THEN 'insert' WHEN n.o_orderkey IS NULL THEN 'delete'
         WHEN o.o_totalprice IS DISTINCT FROM n.o_totalprice THEN 'update' ELSE 'keep' END AS action
    FROM orders o FULL JOIN orders_v2 n ON o.o_orderkey = n.o_orderkey)"""


@query("pub_replace", f"WITH {DIFF} SELECT * FROM a")
def replace(t):
    return p.actions(t.orders, t.orders_v2, "o_orderkey").select("o_orderkey", "o_totalprice", "action")


@query("pub_upsert", f"WITH {DIFF} SELECT o_orderkey, o_totalprice FROM a")
def upsert(t):
    acted = p.actions(t.orders, t.orders_v2, "o_orderkey", keep_omitted=True)
    return p.next_state(acted).select("o_orderkey", "o_totalprice")


@query("pub_delta", f"WITH {DIFF} SELECT o_orderkey, o_totalprice FROM a WHERE NOT (action IN ('delete', 'keep') AND o_orderkey % 3 = 0)")
def delta(t):
    cols = ["o_orderkey", "o_totalprice"]
    ups = p.written(p.actions(t.orders.select(cols), t.orders_v2.select(cols), "o_orderkey", keep_omitted=True)).select(cols)
    deletes = t.orders.select("o_orderkey").where(F.col("o_orderkey") % 3 == 0).join(ups, "o_orderkey", "left_anti")
    return p.next_state(p.delta_actions(t.orders.select(cols), ups, deletes, "o_orderkey"))


@query("pub_skip_equal", f"WITH {DIFF} SELECT CAST(count(*) FILTER (action IN ('insert', 'update')) AS BIGINT) AS upserted, CAST(count(*) FILTER (action = 'delete') AS BIGINT) AS deleted FROM a")
def skip_equal(t):
    return p.summary(p.written(p.actions(t.orders, t.orders_v2, "o_orderkey")))


def owned(df):
    return df.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("partition"))


@query("pub_partition_ownership", f"""WITH {ORDERS_V2}, r AS (SELECT unnest(['1-URGENT', '5-LOW']) AS p)
    SELECT o_orderkey AS id, o_totalprice AS total, o_orderpriority AS "partition" FROM orders_v2 WHERE o_orderpriority IN (SELECT p FROM r)
    UNION ALL SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderpriority NOT IN (SELECT p FROM r)""")
def partition_ownership(t):
    before, after = owned(t.orders), owned(t.orders_v2)
    again = before.select("partition").distinct().where(F.col("partition").isin("1-URGENT", "5-LOW"))
    outputs = after.join(again, "partition", "left_semi").select("id", "total", "partition")
    if p.ownership_conflicts(before.select("id", "partition"), again, outputs).take(1):
        raise ValueError("a row is owned by two partitions")
    sink = p.next_state(p.partition_actions(before.select("id", "total"), before.select("id", "partition"), again, outputs))
    return sink.join(p.next_owners(before.select("id", "partition"), again, outputs), "id")


@query("pub_repair_drift", f"""WITH {ORDERS_V2} SELECT o_orderpriority AS "partition", count(*) AS "rows" FROM orders o
    WHERE o_orderkey % 7 IN (0, 1) GROUP BY 1""")
def repair_drift(t):
    desired = owned(t.orders)
    edited = owned(t.orders_v2).where(F.col("id") < NEW_KEY)
    return p.drifted_partitions(edited.select("id", "total"), desired.select("id", "partition"), desired.select("id", "total"))


@query("sink_topic_routing", """SELECT 'flat-' || event_type AS topic, CAST(event_id AS VARCHAR) AS "key",
    CAST(to_json({event_id: event_id, value: value, operation: 'create', collection: event_type, traceparent: ''}) AS VARCHAR) AS value FROM events""")
def topic_routing(t):
    rows = t.events.select("event_id", "value", F.col("event_type").alias("collection"))
    routed = w.route(rows, "collection", F.lit("create"), F.lit(""), "event_id")
    path = fresh_path(t.spark, "topics")
    w.to_folders(routed, path)
    return t.spark.read.schema("key string, value string, topic string").parquet(path)


def answer(key: str, body: str) -> int:
    """A receiver that refuses some bodies for good and is unreachable for others."""
    if '"k": 1' in body:
        raise OSError("unreachable")
    return 500 if '"k": 2' in body else 201


@query("sink_http_retry", """SELECT event_id, CASE WHEN contains(props, '"k": 1') THEN 4 WHEN contains(props, '"k": 2') THEN 4 ELSE 1 END AS attempts,
    CASE WHEN contains(props, '"k": 1') THEN -1 WHEN contains(props, '"k": 2') THEN 500 ELSE 201 END AS status,
    NOT (contains(props, '"k": 1') OR contains(props, '"k": 2')) AS delivered FROM events""")
def http_retry(t):
    return stored(w.deliver(t.events, "event_id", "props", answer, first_wait=0.0))
