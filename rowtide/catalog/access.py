"""Registered queries: row access."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtide.catalog.registry import Tables, query
from rowtide.operators import access as a, read as r
from rowtide.operators.read import Embed

SCOPED = "s AS (SELECT *, CASE WHEN c_acctbal < 0 THEN 'public:' ELSE 'nation:' || c_nationkey END AS scope_id FROM customer)"
REACH = ["public:", "user:7", "nation:3", "nation:5"]


def scoped(t: Tables):
    scope = F.when(F.col("c_acctbal") < 0, a.PUBLIC).otherwise(F.concat(F.lit("nation:"), "c_nationkey"))
    return t.customer.withColumn("scope_id", scope)


@query("acc_scopes", """SELECT c_custkey AS reader, array_to_string(['public:', 'user:' || c_custkey] || CASE WHEN c_custkey % 2 = 0 THEN ['nation:' || c_nationkey] ELSE [] END, '|') AS scopes FROM customer""")
def scopes(t):
    granted = F.array(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("nation:"), "c_nationkey")).otherwise(""), F.lit(a.PUBLIC))
    return a.reader_scopes(t.customer.withColumn("granted", granted), "c_custkey", "granted").withColumn("scopes", F.array_join("scopes", "|"))


@query("acc_filter", f"""WITH {SCOPED}, v AS (SELECT * FROM s WHERE scope_id IN ('public:', 'user:7', 'nation:3', 'nation:5'))
    SELECT o_orderkey, CAST(to_json(CASE WHEN c_custkey IS NOT NULL THEN {{c_name: c_name}} END) AS VARCHAR) AS customer FROM orders LEFT JOIN v ON o_custkey = c_custkey""")
def acc_filter(t):
    see = a.scoped_lookup(lambda n: scoped(t) if n == "customer" else getattr(t, n), REACH)
    spec = Embed("customer", "customer", [("o_custkey", "c_custkey")], select=("c_name",))
    return r.read(see, "orders", ["o_orderkey"], embeds=[spec]).withColumn("customer", F.to_json("customer"))


@query("acc_write_check", f"WITH {SCOPED} SELECT c_custkey, coalesce(NULLIF(scope_id, 'nation:9') IN ('public:', 'user:7', 'nation:3', 'nation:5'), false) AS accepted FROM s")
def write_check(t):
    rows = scoped(t).withColumn("scope_id", F.nullif("scope_id", F.lit("nation:9")))
    return a.check_write(rows, REACH).select("c_custkey", "accepted")


@query("acc_public", f"WITH {SCOPED} SELECT c_custkey FROM s WHERE scope_id = 'public:'")
def public(t):
    return a.public_rows(scoped(t)).select("c_custkey")


@query("acc_key_reach", f"""WITH {SCOPED} SELECT o_orderkey FROM orders WHERE o_custkey = 7
    OR o_custkey IN (SELECT c_custkey FROM s WHERE scope_id IN ('public:', 'user:7', 'nation:3', 'nation:5'))""")
def key_reach(t):
    return a.keyed_reach(t.orders, "o_custkey", a.visible(scoped(t), REACH), "c_custkey", F.col("o_custkey") == 7).select("o_orderkey")


@query("acc_grants", """WITH g AS (SELECT DISTINCT l_orderkey AS key, 'user' AS way FROM lineitem WHERE l_suppkey = 3
      UNION SELECT l_orderkey, 'group' FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 4)),
    w AS (SELECT o_orderkey, 'owner' AS way FROM orders WHERE o_custkey = 3 UNION SELECT o_orderkey, way FROM orders JOIN g ON o_orderkey = key
      UNION SELECT o_orderkey, 'folder' FROM orders JOIN g ON o_orderkey // 10 = key)
    SELECT o_orderkey, o_custkey, count(*) AS ways FROM orders JOIN w USING (o_orderkey) GROUP BY ALL""")
def grants(t):
    # suppliers are users and groups: a line grants its order to its supplier; user 3 is in the groups of nation 4
    lines = t.lineitem.select(F.col("l_suppkey").alias("user"), F.col("l_orderkey").alias("key"))
    members = t.supplier.where("s_nationkey = 4").select(F.lit(3).alias("user"), F.col("s_suppkey").alias("grp"))
    out = a.granted(t.orders, "o_orderkey", F.col("o_custkey") == 3, 3, lines, lines.withColumnRenamed("user", "grp"), members, F.expr("o_orderkey div 10"))
    return out.select("o_orderkey", "o_custkey", "ways")
