"""Registered queries: joins, sets and bags."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtide.catalog.registry import ORDERS_V2, Tables, query
from rowtide.catalog.reads import lookup
from rowtide.operators import joins as j, read as r, sets as s
from rowtide.operators.read import Embed
from rowtide.plans.groups import number_rows


@query("join_embed_one", """SELECT o_orderkey, CAST(to_json({c_custkey: c_custkey, c_name: c_name, c_nationkey: c_nationkey}) AS VARCHAR) AS customer
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def embed_one(t: Tables):
    spec = Embed("customer", "customer", [("o_custkey", "c_custkey")], select=("c_custkey", "c_name", "c_nationkey"))
    return r.read(lookup(t), "orders", ["o_orderkey"], embeds=[spec]).withColumn("customer", F.to_json("customer"))


@query("join_embed_many", """WITH n AS (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 12 AS part FROM orders),
    g AS (SELECT o_custkey, part, list({o_orderkey: o_orderkey, o_orderstatus: o_orderstatus} ORDER BY o_orderkey) AS items FROM n GROUP BY ALL)
    SELECT c_custkey, coalesce(part, 0) AS orders_part, coalesce(CAST(to_json(items) AS VARCHAR), '[]') AS orders
    FROM customer LEFT JOIN g ON c_custkey = o_custkey""")
def embed_many(t):
    spec = Embed("orders", "orders", [("c_custkey", "o_custkey")], many=True, select=("o_orderkey", "o_orderstatus"),
                 order=("o_orderkey",), size=12)
    return r.read(lookup(t), "customer", ["c_custkey"], embeds=[spec]).withColumn("orders", F.to_json("orders"))


@query("join_embed_inner", """SELECT c_custkey, c_name FROM customer WHERE EXISTS
    (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def embed_inner(t):
    return j.has_child(t.customer, r.where(t.orders, [("o_totalprice", "gt", 400000)]), [("c_custkey", "o_custkey")]).select("c_custkey", "c_name")


@query("join_embed_hint", """SELECT c_custkey, CAST(to_json(CASE WHEN n_nationkey IS NOT NULL THEN {n_name: n_name} END) AS VARCHAR) AS away
    FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN nation ON s_nationkey = n_nationkey""")
def embed_hint(t):
    relations = {"home": Embed("home", "nation", [("c_nationkey", "n_nationkey")], select=("n_name",)),
                 "away": Embed("away", "nation", [("s_nationkey", "n_nationkey")], select=("n_name",))}
    base = t.customer.join(t.supplier, F.col("s_suppkey") == F.col("c_custkey"), "left")
    out = r.embed(base, r.pick_relation(relations, "nation", "s_nationkey"), lookup(t))
    return out.select("c_custkey", F.to_json("away").alias("away"))


@query("join_embed_nested", """WITH c AS (SELECT c_nationkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 40 AS part, c_custkey FROM customer),
    g AS (SELECT c_nationkey, part, list({c_custkey: c_custkey} ORDER BY c_custkey) AS items FROM c GROUP BY ALL),
    n AS (SELECT n_regionkey, n_nationkey, n_name, coalesce(items, []) AS customers, coalesce(part, 0) AS customers_part
          FROM nation LEFT JOIN g ON n_nationkey = c_nationkey),
    p AS (SELECT *, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, customers_part) - 1) // 10000 AS part FROM n)
    SELECT r_name, coalesce(part, 0) AS nations_part, coalesce(CAST(to_json(list({n_name: n_name, customers: customers, customers_part: customers_part}
           ORDER BY n_nationkey, customers_part)) AS VARCHAR), '[]') AS nations
    FROM region LEFT JOIN p ON r_regionkey = n_regionkey GROUP BY ALL""")
def embed_nested(t):
    customers = Embed("customers", "customer", [("n_nationkey", "c_nationkey")], many=True, select=("c_custkey",), order=("c_custkey",), size=40)
    nations = Embed("nations", "nation", [("r_regionkey", "n_regionkey")], many=True, select=("n_name",),
                    order=("n_nationkey", "customers_part"), size=1000, embeds=(customers,))
    return r.read(lookup(t), "region", ["r_name"], embeds=[nations]).withColumn("nations", F.to_json("nations"))


@query("join_computed", """SELECT o_orderkey, CAST(to_json(CASE WHEN o_totalprice > 200000 THEN {band: floor(o_totalprice / 100000), urgent: o_orderpriority = '1-URGENT'} END) AS VARCHAR) AS grade FROM orders""")
def computed(t):
    fields = {"band": F.floor(F.col("o_totalprice") / 100000).cast("double"), "urgent": F.col("o_orderpriority") == "1-URGENT"}
    out = j.computed(t.orders, "grade", fields, F.col("o_totalprice") > 200000)
    return out.select("o_orderkey", F.to_json("grade").alias("grade"))


@query("join_asof_left", """WITH e AS (SELECT * FROM events WHERE event_type = 'error'), c AS (SELECT * FROM events WHERE event_type = 'click')
    SELECT e.event_id, e.user_id, c.event_id AS click_id, c.value AS click_value
    FROM e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.ts""")
def asof(t):
    e, c = t.events.where("event_type = 'error'"), t.events.where("event_type = 'click'")
    out = j.asof_left(e.select("event_id", "user_id", "ts"), c.select("event_id", "user_id", "ts", "value"), ["user_id"],
                      "ts", "ts", "event_id", "event_id")
    return out.select("event_id", "user_id", F.col("match.event_id").alias("click_id"), F.col("match.value").alias("click_value"))


@query("join_disjunctive_equi", """WITH p AS (SELECT c_custkey, c_nationkey, s_nationkey FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey)
    SELECT c_custkey, n_name FROM nation JOIN p ON n_nationkey = s_nationkey OR n_nationkey = c_nationkey""")
def disjunctive(t):
    pairs = t.customer.join(t.supplier, F.col("s_suppkey") == F.col("c_custkey"), "left").select("c_custkey", "c_nationkey", "s_nationkey")
    return j.either_key(t.nation, pairs, "n_nationkey", "s_nationkey", "c_nationkey").select("c_custkey", "n_name")


@query("join_range", """WITH g AS (SELECT DISTINCT date_trunc('day', ts) AS starts FROM events)
    SELECT event_id, CAST(starts AS VARCHAR) AS starts FROM events JOIN g ON ts >= starts AND ts < starts + INTERVAL 36 HOUR""")
def in_range(t):
    grid = t.events.select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("starts")).distinct()
    grid = grid.withColumn("ends", F.expr("starts + INTERVAL 36 HOUR"))
    out = j.in_interval(t.events.select("event_id", "ts"), "ts", grid, "starts", "ends")
    return out.select("event_id", F.date_format("starts", "yyyy-MM-dd HH:mm:ss").alias("starts"))


@query("join_range_long", """WITH s AS (SELECT o_orderkey, o_orderdate AS starts, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate + to_days(CAST(o_orderkey % 900 AS INTEGER)) END AS ends
      FROM orders WHERE o_orderkey % 400 < 3),
    d AS (SELECT DISTINCT o_orderdate AS day FROM orders)
    SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n, sum(o_orderkey) AS keys FROM d JOIN s ON day >= starts AND (day < ends OR ends IS NULL) GROUP BY day""")
def in_long_range(t):
    o, k = t.orders.where("o_orderkey % 400 < 3"), F.col("o_orderkey")
    ends = F.when(k % 3 > 0, F.col("o_orderdate") + F.make_dt_interval((k % 900).cast("int")))  # from no time at all to no end
    spans = o.select(k, F.col("o_orderdate").alias("starts"), ends.alias("ends"))
    days = t.orders.select(F.col("o_orderdate").alias("day")).distinct()
    held = j.in_interval(days, "day", spans, "starts", "ends", open_ended=True)
    return held.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("join_overlap", """WITH s AS (SELECT l_orderkey, l_linenumber, l_shipdate AS a, l_shipdate + to_days(CAST(l_quantity AS INTEGER)) AS b FROM lineitem WHERE l_orderkey % 50 = 0),
    p AS (SELECT DISTINCT date_trunc('quarter', o_orderdate) AS q, date_trunc('quarter', o_orderdate) + INTERVAL 100 DAY AS z FROM orders)
    SELECT l_orderkey, l_linenumber, strftime(q, '%Y-%m-%d') AS quarter FROM s JOIN p ON a < z AND q < b AND a < b""")
def overlap(t):
    line = t.lineitem.where("l_orderkey % 50 = 0").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("a"),
                                                           (F.col("l_shipdate") + F.make_dt_interval(F.col("l_quantity").cast("int"))).alias("b"))
    q = F.date_trunc("quarter", "o_orderdate").cast("timestamp_ntz")
    quarters = t.orders.select(q.alias("q"), (q + F.make_dt_interval(F.lit(100))).alias("z")).distinct()
    return j.overlapping(line, "a", "b", quarters, "q", "z").select("l_orderkey", "l_linenumber", F.date_format("q", "yyyy-MM-dd").alias("quarter"))


@query("join_cross_scalar", "SELECT o_orderkey FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 1456 DAY")
def cross_scalar(t):
    return j.newer_than_latest(t.orders, "o_orderdate", 1456).select("o_orderkey")


EVENT_TYPES = ("view", "click", "purchase", "signup", "error")


@query("join_cross_panel", """WITH f AS (SELECT n_regionkey, event_type, count(*) AS n FROM events JOIN customer ON user_id = c_custkey
      JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
    SELECT r_name, panel, coalesce(n, 0) AS n FROM region, (SELECT unnest(['view', 'click', 'purchase', 'signup', 'error']) AS panel)
    LEFT JOIN f ON n_regionkey = r_regionkey AND event_type = panel""")
def cross_panel(t):
    grid = j.each_panel(t.region, EVENT_TYPES)
    # events shrink to one row per (user, type) before they meet the customer table
    per_user = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    facts = (per_user.join(t.customer, F.col("user_id") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
             .groupBy("n_regionkey", "event_type").agg(F.sum("n").alias("n")))
    out = grid.join(facts, (F.col("n_regionkey") == F.col("r_regionkey")) & (F.col("event_type") == F.col("panel")), "left")
    return out.select("r_name", "panel", F.coalesce("n", F.lit(0)).alias("n"))


@query("join_lateral_unnest", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)
    SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line, unnest(list_transform(lines, lambda x: length(x))) AS n FROM l""")
def lateral_unnest(t):
    lines = F.split("text", "\n")
    out = j.unnest_aligned(t.documents.select("doc_id", "text"), {"line": lines, "n": F.transform(lines, F.length)})
    return out.select("doc_id", F.col("pos").cast("bigint"), "line", F.col("n").cast("bigint"))


@query("join_left_optional_fact", """SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 60""")
def optional_fact(t):
    out = j.optional_fact(t.customer, t.orders, [("c_custkey", "o_custkey")], F.col("o_totalprice") > F.col("c_acctbal") * 60)
    return out.select("c_custkey", "o_orderkey")


@query("join_anti_missing", f"WITH {ORDERS_V2} SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders_v2 WHERE o_orderkey = l_orderkey)")
def anti_missing(t):
    return j.missing(t.lineitem, t.orders_v2, [("l_orderkey", "o_orderkey")]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("join_scope_from_parent", f"""WITH {ORDERS_V2}, o AS (SELECT o_orderkey, 'nation:' || c_nationkey AS scope_id FROM orders_v2 JOIN customer ON o_custkey = c_custkey)
    SELECT l_orderkey, l_linenumber, l_partkey, scope_id, o_orderkey IS NULL AS violation FROM lineitem LEFT JOIN o ON l_orderkey = o_orderkey""")
def scope_from_parent(t):
    c = t.customer.select("c_custkey", F.concat(F.lit("nation:"), "c_nationkey").alias("scope_id"))
    o = j.scope_from_parent(t.orders_v2, c, [("o_custkey", "c_custkey")], derived=True)
    out = j.scope_from_parent(t.lineitem, o, [("l_orderkey", "o_orderkey")])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "scope_id", "violation")


@query("join_null_safe", """WITH a AS (SELECT doc_id, NULLIF(quality, 0) AS q FROM labels),
    b AS (SELECT NULLIF(quality, 0) AS q, count(*) AS n FROM labels GROUP BY 1)
    SELECT doc_id, a.q, n FROM a JOIN b ON a.q IS NOT DISTINCT FROM b.q""")
def null_safe(t):
    a = t.labels.select("doc_id", F.nullif("quality", F.lit(0)).alias("q"))
    b = a.groupBy(F.col("q").alias("q2")).agg(F.count(F.lit(1)).alias("n"))
    return j.null_safe(a, b, [("q", "q2")]).select("doc_id", "q", "n")


@query("set_union_all", """SELECT user_id, event_type FROM events WHERE event_type = 'error' UNION ALL SELECT user_id, event_type FROM events WHERE value > 100""")
def union_all(t):
    e = t.events.select("user_id", "event_type", "value")
    return s.union_all(e.where("event_type = 'error'"), e.where("value > 100")).select("user_id", "event_type")


@query("set_union", """SELECT user_id, event_type FROM events WHERE event_type = 'error' UNION SELECT user_id, event_type FROM events WHERE value > 100""")
def union(t):
    e = t.events
    return s.union(e.where("event_type = 'error'").select("user_id", "event_type"), e.where("value > 100").select("user_id", "event_type"))


@query("set_batch_reads", """WITH n AS (SELECT 0 AS "read", 0 AS part, CAST(to_json(list({n_nationkey: n_nationkey, n_name: n_name} ORDER BY n_nationkey)) AS VARCHAR) AS "rows" FROM nation),
    o AS (SELECT 1 AS "read", part, CAST(to_json(list({o_orderkey: o_orderkey} ORDER BY o_orderkey)) AS VARCHAR) AS "rows"
          FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS part FROM orders) GROUP BY part)
    SELECT * FROM n UNION ALL SELECT * FROM o UNION ALL SELECT 2, 0, '[]'""")
def batch_reads(t):
    reads = [t.nation.select("n_nationkey", "n_name"), t.orders.select("o_orderkey"), t.region.where("r_name = 'NOWHERE'")]
    keys = [["n_nationkey"], ["o_orderkey"], ["r_regionkey"]]
    return s.batch_reads(reads, keys, size=500)


@query("set_except_symmetric", f"""WITH {ORDERS_V2} SELECT *, 'left' AS side, 1 AS copies FROM (SELECT * FROM orders EXCEPT SELECT * FROM orders_v2)
    UNION ALL SELECT *, 'right', 1 FROM (SELECT * FROM orders_v2 EXCEPT SELECT * FROM orders)""")
def except_symmetric(t):
    return s.symmetric_difference(t.orders, t.orders_v2)


@query("set_bag_difference", f"""WITH {ORDERS_V2} SELECT o_custkey, o_orderstatus, CAST(sum(w) AS BIGINT) AS weight FROM
    (SELECT o_custkey, o_orderstatus, 1 AS w FROM orders_v2 UNION ALL SELECT o_custkey, o_orderstatus, -1 FROM orders) GROUP BY ALL HAVING sum(w) <> 0""")
def bag_difference(t):
    cols = ["o_custkey", "o_orderstatus"]
    return s.bag_difference(t.orders.select(cols), t.orders_v2.select(cols))


@query("set_union_refcount", f"""WITH {ORDERS_V2}, a AS (SELECT 'old' AS s, 1 AS seq, * FROM orders WHERE o_orderstatus = 'F'
      UNION ALL SELECT 'new', 2, * FROM orders_v2 WHERE o_totalprice > 200000 UNION ALL SELECT 'low', 3, * FROM orders WHERE o_orderpriority = '5-LOW')
    SELECT o_orderkey, arg_max(o_totalprice, seq) AS o_totalprice, max(seq) AS seq, count(DISTINCT s) AS sources FROM a GROUP BY 1""")
def union_refcount(t):
    cols = ["o_orderkey", "o_totalprice"]
    sources = {"old": t.orders.where("o_orderstatus = 'F'").select(*cols, F.lit(1).alias("seq")),
               "new": t.orders_v2.where("o_totalprice > 200000").select(*cols, F.lit(2).alias("seq")),
               "low": t.orders.where("o_orderpriority = '5-LOW'").select(*cols, F.lit(3).alias("seq"))}
    return s.union_refcount(sources, ["o_orderkey"], "seq")


@query("set_recursive_closure", """WITH RECURSIVE e AS (SELECT o_orderkey AS src, o_orderkey // 4 AS dst FROM orders UNION ALL SELECT o_orderkey, o_custkey FROM orders),
    r(node) AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 480000 UNION SELECT dst FROM r JOIN e ON node = src) SELECT node FROM r""")
def recursive_closure(t):
    o = t.orders
    edges = o.select(F.col("o_orderkey").alias("src"), F.floor(F.col("o_orderkey") / 4).alias("dst")).unionByName(
        o.select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst")))
    return s.closure(edges, o.where("o_totalprice > 480000").select(F.col("o_orderkey").alias("node")))


@query("set_closure_open_orders", """WITH RECURSIVE e AS (SELECT o_orderkey AS src, o_orderkey // 4 AS dst FROM orders UNION ALL SELECT o_orderkey, o_custkey FROM orders),
    r(node) AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' UNION SELECT dst FROM r JOIN e ON node = src) SELECT node FROM r""")
def closure_open_orders(t):
    o = t.orders
    edges = o.select(F.col("o_orderkey").alias("src"), F.floor(F.col("o_orderkey") / 4).alias("dst")).unionByName(
        o.select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst")))
    return s.closure(edges, o.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("node")))


@query("set_closure_chain", """SELECT event_id AS node FROM events WHERE event_id >= (SELECT min(event_id) FROM events WHERE event_type = 'signup')""")
def closure_chain(t):
    """One chain through all events, followed from the first sign-up: as long as the table."""
    ids = t.events.select(F.col("event_id").alias("src"))
    numbered = number_rows(ids, [], ["src"], "rn")
    edges = numbered.join(numbered.select(F.col("src").alias("dst"), (F.col("rn") - 1).alias("rn")), "rn").select("src", "dst")
    return s.closure(edges, t.events.where("event_type = 'signup'").agg(F.min("event_id").alias("node")))
