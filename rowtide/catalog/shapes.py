"""Registered queries: shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtide.catalog.registry import NEW_KEY, ORDERS_LOG, ORDERS_V2, Tables, query
from rowtide.operators import shapes as s
from rowtide.operators.read import Param

# Log positions double as offsets; a hundred positions make a transaction, every fifth still open.
TX = "seq // 100 AS txid, (seq // 100) % 5 = 0 AS open"


def feed(t: Tables):
    log = t.orders_log.withColumns({"offset": F.col("seq"), "txid": F.expr("seq div 100"), "scope_id": F.concat(F.lit("p:"), "o_orderpriority")})
    return log.withColumn("open", F.col("txid") % 5 == 0)


@query("shape_snapshot", f"WITH {ORDERS_LOG} SELECT o_orderkey, (SELECT max(seq) FROM orders_log) AS position FROM orders WHERE o_orderstatus = 'F'")
def snapshot(t):
    return s.snapshot(t.orders, F.col("o_orderstatus") == "F", feed(t)).select("o_orderkey", "position")


@query("shape_visibility", f"""WITH {ORDERS_LOG}, x AS (SELECT {TX} FROM orders_log) SELECT DISTINCT (SELECT min(txid) FROM x WHERE open) AS xmin,
    (SELECT max(txid) + 1 FROM x) AS xmax, txid FROM x WHERE open""")
def visibility(t):
    bounds, unfinished = s.visibility(feed(t).select("txid", "open"))
    return unfinished.withColumns({n: bounds.select(n).scalar() for n in ("xmin", "xmax")})


@query("shape_changes", f"""WITH {ORDERS_LOG} SELECT seq AS "offset", op, o_orderkey FROM orders_log WHERE seq > 500 AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def shape_changes(t):
    return s.feed(feed(t), 500, ["p:1-URGENT", "p:2-HIGH"]).select("offset", "op", "o_orderkey")


@query("shape_subset", "SELECT o_orderkey, o_totalprice, 7 AS snapshot_mark FROM orders WHERE o_orderstatus = 'O' AND o_totalprice < 300000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def subset(t):
    where = [("and", [("o_orderstatus", "eq", Param(1)), ("o_totalprice", "lt", Param(2))])]
    return s.subset(t.orders, where, ["O", 300000], ["o_totalprice.desc", "o_orderkey"], 25, 7).select("o_orderkey", "o_totalprice", "snapshot_mark")


@query("shape_merge", f"""WITH {ORDERS_LOG}, l AS (SELECT *, seq // 100 AS txid FROM orders_log),
    m AS (SELECT max(txid) // 2 AS xmax FROM l WHERE o_orderkey < {NEW_KEY}), k AS (SELECT * FROM l, m WHERE txid >= xmax OR txid IN (3, 5)),
    e AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC) = 1)
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM e) UNION ALL SELECT o_orderkey, o_totalprice FROM e WHERE op = 'I'""")
def merge(t):
    log = feed(t)
    xmax = log.where(F.col("o_orderkey") < NEW_KEY).agg(F.floor(F.max("txid") / 2).alias("x")).first()[0]
    unfinished = log.where("txid IN (3, 5)").select("txid")
    return s.merge(t.orders.select("o_orderkey", "o_totalprice"), log, ["o_orderkey"], xmax, unfinished)


@query("shape_expired", f"""WITH {ORDERS_LOG}, o AS (SELECT min(seq) AS oldest FROM (SELECT seq FROM orders_log ORDER BY seq DESC LIMIT 200))
    SELECT user_id AS reader, max(event_id) * 2 AS "offset", max(event_id) * 2 < any_value(oldest) - 1 AS expired FROM events, o GROUP BY 1""")
def expired(t):
    readers = t.events.groupBy(F.col("user_id").alias("reader")).agg((F.max("event_id") * 2).alias("offset"))
    return s.expired(readers, feed(t).select("offset", "op"), keep=200)


OPS = """ops AS (SELECT user_id AS shape, event_id AS seq, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN CASE WHEN event_id % 10 = 0 THEN 'truncate' ELSE 'upsert' END ELSE 'upsert' END AS op,
    props AS key, value FROM events)"""


def ops(t: Tables, write: str = "upsert"):
    kind = F.col("event_type")
    op = F.when(kind == "error", "delete").when((kind == "signup") & (F.col("event_id") % 10 == 0), "truncate").otherwise(write)
    return t.events.select(F.col("user_id").alias("shape"), F.col("event_id").alias("seq"), op.alias("op"), F.col("props").alias("key"), "value")


@query("shape_compact_store", f"""WITH {OPS}, live AS (SELECT * FROM ops o WHERE op <> 'truncate' AND seq > coalesce((SELECT max(seq) FROM ops t WHERE t.shape = o.shape AND t.op = 'truncate'), -1)),
    e AS (SELECT shape, key, arg_max(op, seq) AS op, arg_max(value, seq) AS value, coalesce(max(seq) FILTER (op = 'delete'), -1) AS gone FROM live GROUP BY ALL)
    SELECT e.shape, e.key, e.value, min(l.seq) AS place FROM e JOIN live l ON l.shape = e.shape AND l.key = e.key AND l.op = 'upsert' AND l.seq > gone WHERE e.op = 'upsert' GROUP BY ALL""")
def compact_store(t):
    return s.compact_store(ops(t), ["shape"], "key", "value")


@query("shape_idempotent_ops", f"""WITH {OPS}, x AS (SELECT *, sum(CASE WHEN op = 'truncate' THEN 1 ELSE 0 END) OVER (PARTITION BY shape ORDER BY seq) AS epoch FROM ops)
    SELECT shape, seq, CASE WHEN op = 'upsert' THEN CASE WHEN seq > min(seq) FILTER (op = 'upsert') OVER (PARTITION BY shape, epoch, key) THEN 'update' ELSE 'insert' END ELSE op END AS op, key, value FROM x""")
def idempotent_ops(t):
    return s.idempotent_ops(ops(t, "insert"), ["shape"], "key")


@query("shape_live_changes", f"""WITH {ORDERS_V2}, a AS (SELECT * FROM orders WHERE o_totalprice > 200000), b AS (SELECT * FROM orders_v2 WHERE o_totalprice > 200000)
    SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN a.o_totalprice ELSE b.o_totalprice END AS o_totalprice,
      CASE WHEN a.o_orderkey IS NULL THEN 'insert' WHEN b.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS op
    FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_totalprice <> b.o_totalprice
    UNION ALL SELECT o_orderkey, o_totalprice, 'insert' FROM a""")
def live_changes(t):
    keep = F.col("o_totalprice") > 200000
    moved = s.live_changes(t.orders, t.orders_v2, "o_orderkey", keep)
    return s.initial_rows(t.orders, keep).unionByName(moved).select("o_orderkey", "o_totalprice", "op")


@query("shape_write_confirm", f"""WITH {ORDERS_LOG}, w AS (SELECT o_orderkey AS key, o_orderkey * 2 // 100 AS txid, o_orderkey % 3 AS changed FROM orders)
    SELECT key, CASE WHEN changed = 0 AND key IN (SELECT o_orderkey FROM orders_v2) THEN 'refused' WHEN changed = 0 THEN 'confirmed'
      WHEN txid IN (SELECT seq // 100 FROM orders_log WHERE seq % 1000 < 500) THEN 'confirmed' ELSE 'waiting' END AS status FROM w""")
def write_confirm(t):
    k = F.col("o_orderkey")
    writes = t.orders.select(k.alias("key"), F.expr("(o_orderkey * 2) div 100").alias("txid"), (k % 3).alias("changed"))
    log = feed(t).where(F.col("seq") % 1000 < 500)
    return s.confirm_writes(writes, log, t.orders_v2.select(k.alias("key"))).select("key", "status")
