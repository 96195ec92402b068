"""Registered queries: aggregates and ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtide.catalog.registry import Tables, query
from rowtide.operators import aggregates as a, read as r, windows as w


@query("agg_read", """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty, min(l_shipdate) AS first_ship,
      max(l_extendedprice) AS top, count(l_tax) AS taxed, count(*) AS n,
      round(avg(CAST(l_discount AS DECIMAL(18,2))), 6) AS avg_disc FROM lineitem GROUP BY ALL""")
def agg_read(t: Tables):
    df = t.lineitem.withColumns({"l_quantity": F.col("l_quantity").cast("decimal(18,2)"), "l_discount": F.col("l_discount").cast("decimal(18,2)")})
    out = r.aggregate(df, ["l_returnflag", "l_linestatus"],
                      {"qty": ("sum", "l_quantity"), "first_ship": ("min", "l_shipdate"), "top": ("max", "l_extendedprice"),
                       "taxed": ("count", "l_tax"), "n": ("count", "*"), "avg_disc": ("avg", "l_discount")},
                      order=["l_returnflag", "l_linestatus"])
    return out.withColumns({"qty": F.col("qty").cast("double"), "avg_disc": F.round(F.col("avg_disc"), 6).cast("double")})


@query("agg_count_exact", "SELECT 20 AS first, 29 AS last, count(*) AS total FROM orders WHERE o_orderstatus = 'O'")
def count_exact(t):
    return a.count_exact(t.orders.where("o_orderstatus = 'O'"), 10, 20)


@query("agg_json_array", """WITH p AS (SELECT *, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 25 AS part FROM customer)
    SELECT c_nationkey, part, CAST(to_json(list({c_custkey: c_custkey, c_acctbal: c_acctbal} ORDER BY c_custkey)) AS VARCHAR) AS "rows" FROM p GROUP BY ALL""")
def json_array(t):
    return a.json_arrays(t.customer, ["c_nationkey"], ["c_custkey"], ["c_custkey", "c_acctbal"], 25)


@query("agg_string", """WITH p AS (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 1000 AS part FROM events)
    SELECT event_type, part, string_agg(props, ', ' ORDER BY ts, event_id) AS joined FROM p GROUP BY ALL""")
def agg_string(t):
    return a.strings(t.events, ["event_type"], ["ts", "event_id"], "props", size=1000)


@query("agg_conditional", """SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS filled,
    CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS open FROM orders GROUP BY 1""")
def conditional(t):
    return a.pivot_counts(t.orders, ["o_custkey"], "o_orderstatus", {"filled": "F", "open": "O"})


@query("agg_filter_clause", """SELECT o_orderpriority, count(*) FILTER (WHERE o_totalprice > 250000) AS big, count(*) FILTER (WHERE o_orderstatus = 'P') AS part FROM orders GROUP BY 1""")
def filter_clause(t):
    return a.filtered_counts(t.orders, ["o_orderpriority"], {"big": F.col("o_totalprice") > 250000, "part": F.col("o_orderstatus") == "P"})


@query("agg_distinct", "SELECT event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def distinct(t):
    return t.events.select("user_id", "event_type").dropDuplicates().groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("agg_having", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 12")
def having(t):
    return r.aggregate(t.events, ["user_id", "event_type"], {"n": ("count", "*")}).where("n >= 12")


@query("agg_regex_max", r"""SELECT s_nationkey, max(CAST(NULLIF(regexp_extract(s_name, '#0*([0-9]+)', 1), '') AS BIGINT)) AS highest FROM supplier GROUP BY 1""")
def regex_max(t):
    return a.regex_max(t.supplier, ["s_nationkey"], "s_name", r"#0*([0-9]+)")


@query("agg_object", """WITH p AS (SELECT *, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) - 1) // 30 AS part FROM customer)
    SELECT c_nationkey, part, '{' || string_agg('"' || c_name || '":' || c_custkey, ',' ORDER BY c_name) || '}' AS object FROM p GROUP BY ALL""")
def agg_object(t):
    return a.objects(t.customer, ["c_nationkey"], "c_name", "c_custkey", 30).withColumn("object", F.to_json("object"))


@query("agg_array", """WITH p AS (SELECT *, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1) // 4 AS part FROM lineitem)
    SELECT l_orderkey, part, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS items FROM p GROUP BY ALL""")
def agg_array(t):
    return a.arrays(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], F.col("l_partkey"), 4)


@query("agg_multiplicity", "SELECT c_nationkey, c_mktsegment, count(*) AS copies FROM customer GROUP BY ALL")
def multiplicity(t):
    return a.multiplicity(t.customer.select("c_nationkey", "c_mktsegment"))


@query("win_latest_per_key", """SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1""")
def latest(t):
    return w.latest_per_key(t.events, ["user_id"], "ts").select("user_id", "event_id", "event_type", "value")


@query("win_row_number", "SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rn FROM orders")
def row_number(t):
    from rowtide.plans.groups import number_rows
    return number_rows(t.orders.select("o_orderstatus", "o_orderkey"), ["o_orderstatus"], ["o_orderkey"])


@query("win_running_sum", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) OVER
    (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM lineitem""")
def running_sum(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("q"))
    return w.running_sum(df, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "q").drop("q")


@query("win_forward_fill", """SELECT event_id, user_id, trace FROM (SELECT *, coalesce(last_value(CASE WHEN event_type = 'signup' THEN props END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), '') AS trace FROM events) WHERE event_type <> 'signup'""")
def forward_fill(t):
    out = w.forward_fill(t.events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("props"))
    return out.select("event_id", "user_id", "trace")


@query("win_first_trace", """SELECT user_id, coalesce(arg_min(props, event_id) FILTER (WHERE event_type IN ('click', 'error')), '') AS trace FROM events GROUP BY 1""")
def first_trace(t):
    df = t.events.withColumn("props", F.when(F.col("event_type").isin("click", "error"), F.col("props")).otherwise(""))
    return w.first_trace(df, ["user_id"], "event_id", "props")
