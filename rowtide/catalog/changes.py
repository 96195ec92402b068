"""Registered queries: change logs, weighted rows and incremental maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtide.catalog.registry import ORDERS_LOG, ORDERS_V2, Tables, query, refused
from rowtide.operators import changes as c, deltas as d, publish
from rowtide.session import fresh_path

COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
PICK = ", ".join(COLS)


def log_of(t: Tables, cols=COLS):
    return t.orders_log.select("seq", "op", *cols)


@query("log_compact", f"WITH {ORDERS_V2} SELECT {PICK} FROM orders_v2")
def log_compact(t):
    return c.compact(t.orders.select(COLS), log_of(t), ["o_orderkey"])


@query("log_compact_truncated", f"""WITH {ORDERS_LOG}, t AS (SELECT max(o_orderkey) // 2 * 2 AS t FROM orders), k AS (SELECT * FROM orders_log WHERE seq > (SELECT t FROM t)),
    e AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC) = 1) SELECT {PICK} FROM e WHERE op = 'I'""")
def log_compact_truncated(t):
    cut = t.orders.agg((F.floor(F.max("o_orderkey") / 2) * 2).cast("bigint").alias("seq"), F.lit("T").alias("op"))
    log = log_of(t).unionByName(cut, allowMissingColumns=True)
    return c.compact(t.orders.select(COLS), log, ["o_orderkey"])


@query("log_apply_no_key", f"WITH {ORDERS_V2} SELECT o_custkey, o_orderpriority FROM orders_v2")
def log_apply_no_key(t):
    cols = ["o_custkey", "o_orderpriority"]
    return c.apply_no_key(t.orders.select(cols), log_of(t, cols))


@query("log_retain", f"""WITH {ORDERS_V2}, u AS (SELECT o.o_orderstatus AS "table", o.o_orderkey, o.o_totalprice AS old, n.o_totalprice AS new FROM orders o JOIN orders_v2 n USING (o_orderkey)),
    l AS (SELECT "table", 'D' AS op, o_orderkey * 2 AS seq, o_orderkey, old AS price FROM u UNION ALL SELECT "table", 'I', o_orderkey * 2 + 1, o_orderkey, new FROM u)
    SELECT "table", op, seq, o_orderkey, price FROM l QUALIFY row_number() OVER (PARTITION BY "table" ORDER BY seq DESC) <= 300""")
def log_retain(t):
    new = t.orders_v2.select("o_orderkey", F.struct("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("table")).alias("new"))
    old = t.orders.select("o_orderkey", F.struct("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("table")).alias("old"))
    log = c.update_entries(old.join(new, "o_orderkey"), "old", "new", "o_orderkey")
    return c.newest_entries(log, keep=300)


@query("log_fence", f"""WITH {ORDERS_LOG}, p AS (SELECT o_custkey, max(seq) AS target, min(seq) AS lo, count(*) AS n FROM orders_log GROUP BY 1)
    SELECT o_custkey, CASE WHEN o_custkey % 3 = 0 THEN 'log' WHEN n % 2 = 0 THEN 'noop' ELSE 'seed' END AS mode, target AS next_seq FROM p""")
def log_fence(t):
    # every customer's entries are one replica table: some are at the log's start, some hold equal rows
    seen = t.orders_log.groupBy("o_custkey").agg(F.max("seq").alias("log_target"), F.min("seq").alias("log_from"), F.count(F.lit(1)).alias("n"))
    at_start = F.col("o_custkey") % 3 == 0
    tables = seen.withColumns({
        "signature": F.lit("v1"), "seen_signature": F.lit("v1"), "seen_seq": F.when(at_start, F.col("log_from")).otherwise(F.lit(-1)),
        "rows_digest": F.lit(0), "seen_digest": (F.col("n") % 2).cast("int"),
    })
    return c.refresh_plan(tables).select("o_custkey", "mode", "next_seq")


@query("ivm_carrier", f"""WITH {ORDERS_V2} SELECT coalesce(CAST(o.o_orderkey AS VARCHAR), CAST(n.o_orderkey AS VARCHAR)) AS __key, coalesce(n.o_orderstatus, o.o_orderstatus) AS status,
    CASE WHEN o.o_orderkey IS NULL THEN 'insert' WHEN n.o_orderkey IS NULL THEN 'delete' ELSE 'keep' END AS action FROM orders o FULL JOIN orders_v2 n ON o.o_orderkey = n.o_orderkey""")
def ivm_carrier(t):
    held = t.orders.select(F.col("o_orderkey").cast("string").alias("__key"), F.col("o_orderstatus").alias("status"))
    return d.carry(held, log_of(t), "o_orderkey", {"status": F.col("o_orderstatus")})


def by_customer(orders, t: Tables):
    joined = orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))


@query("ivm_join_agg", f"""WITH {ORDERS_V2} SELECT c_custkey, c_nationkey, count(*) AS total, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS filled,
    CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, max(o_totalprice) AS top FROM orders_v2 JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def ivm_join_agg(t):
    key = ["c_custkey", "c_nationkey"]
    sums = {"filled": F.when(F.col("o_orderstatus") == "F", 1).otherwise(0), "cents": F.col("cents")}
    view = by_customer(t.orders, t).groupBy(*key).agg(
        F.count(F.lit(1)).alias("total"), *[F.sum(x).alias(n) for n, x in sums.items()], F.max("o_totalprice").alias("top"))
    delta = by_customer(t.orders_log.withColumn("weight", F.when(F.col("op") == "I", 1).otherwise(-1)), t)
    return d.maintain(view, delta, key, {"filled": sums["filled"], "cents": F.col("cents")}, "top", "o_totalprice", by_customer(t.orders_v2, t))


@query("ivm_refresh_groups", f"""WITH {ORDERS_V2} SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders_v2 GROUP BY 1""")
def ivm_refresh_groups(t):
    view = lambda df: df.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))
    touched = t.orders_log.select("o_custkey")
    again = view(t.orders_v2.join(touched.distinct(), "o_custkey", "left_semi"))
    return d.refresh_groups(view(t.orders), touched, ["o_custkey"], again)


PENDING = f"""{ORDERS_V2}, w AS (SELECT {PICK}, 1 AS w FROM orders_v2 UNION ALL SELECT {PICK}, -1 FROM orders),
    p AS (SELECT {PICK}, CAST(sum(w) AS BIGINT) AS weight FROM w GROUP BY ALL HAVING sum(w) <> 0)"""


def pending(t: Tables):
    return d.pending(d.weigh(t.orders_v2.select(COLS)), d.weigh(t.orders.select(COLS)))


@query("ivm_pending", f"WITH {PENDING} SELECT * FROM p")
def ivm_pending(t):
    return pending(t)


@query("ivm_pending_count", f"WITH {PENDING} SELECT CAST(count(*) + 25 AS BIGINT) AS n FROM p")
def ivm_pending_count(t):
    return d.pending_count(pending(t), d.weigh(t.nation))


@query("ivm_capture", f"""WITH {PENDING} SELECT 'orders' AS relation, CAST(to_json({{o_custkey: o_custkey, o_orderkey: o_orderkey, o_orderpriority: o_orderpriority,
    o_orderstatus: o_orderstatus, o_totalprice: o_totalprice}}) AS VARCHAR) AS "row", weight FROM p""")
def ivm_capture(t):
    return d.capture({"orders": pending(t)}, {"no_price": t.orders_v2.where("o_totalprice IS NULL"), "no_key": t.orders_v2.where("o_orderkey IS NULL")})


@query("ivm_checks", """SELECT o_orderstatus, count(*) AS n, (SELECT min(o_totalprice) < 0 OR count(*) > count(o_custkey) FROM orders) AS sound,
    (SELECT max(o_totalprice) > 490000 FROM orders) AS dear FROM orders GROUP BY 1""")
def ivm_checks(t):
    checks = {"sound": {"price": t.orders.where("o_totalprice < 0"), "customer": t.orders.where("o_custkey IS NULL")},
              "dear": {"price": t.orders.where("o_totalprice < 0"), "dear": t.orders.where("o_totalprice > 490000")}}
    counted = t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumns({n: refused(d.require_empty, c) for n, c in checks.items()})


@query("ivm_ack", f"WITH {ORDERS_V2} SELECT {PICK}, CAST(1 AS BIGINT) AS weight FROM orders_v2")
def ivm_ack(t):
    base = fresh_path(t.spark, "baseline")
    d.acknowledge(base, 1, d.weigh(t.orders.select(COLS)))
    for _ in range(2):  # acknowledged twice, counted once
        d.acknowledge(base, 2, pending(t))
    return d.baseline(t.spark, base, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string, weight bigint")


STEP = ["o_custkey", "o_orderpriority"]


def step(t: Tables):
    state = t.orders.select(STEP).groupBy(*STEP).agg(F.count(F.lit(1)).alias("copies"))
    moves = log_of(t, STEP).select(*STEP, F.when(F.col("op") == "I", 1).otherwise(-1).alias("weight"))
    return d.apply_step(state, moves, "o_orderpriority")


@query("ivm_delta_apply", f"WITH {ORDERS_V2} SELECT o_custkey, o_orderpriority, count(*) AS copies FROM orders_v2 GROUP BY ALL")
def ivm_delta_apply(t):
    return step(t)[0]


@query("ivm_partition_capture", f"""WITH {ORDERS_V2} SELECT o_orderpriority AS "partition", CAST(to_json({{o_custkey: o_custkey, o_orderpriority: o_orderpriority}}) AS VARCHAR) AS "row" FROM orders_v2""")
def ivm_partition_capture(t):
    state, affected = step(t)
    return d.partition_rows(state, affected, "o_orderpriority")
