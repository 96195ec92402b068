"""Registered queries: schema evolution."""

from __future__ import annotations

from rowtide.catalog.registry import Tables, query
from rowtide.operators import evolve as e


@query("evo_add_column", "SELECT c_custkey, 'basic' AS tier, coalesce(NULLIF(upper(c_mktsegment), 'BUILDING'), 'OTHER') AS seg, CAST(NULL AS INT) AS note FROM customer")
def add_column(t: Tables):
    changes = [e.AddColumn("tier", "string", default="'basic'"), e.AddColumn("note", "int"),
               e.AddColumn("seg", "string", default="'OTHER'", fill="nullif(upper(c_mktsegment), 'BUILDING')")]
    return e.migrate(t.customer, changes).select("c_custkey", "tier", "seg", "note")


CENTS = e.AlterColumn("c_acctbal", "round(c_acctbal * 100)", "c_acctbal / 100", "bigint", "double")


@query("evo_alter_column", """SELECT c_custkey, 'up' AS way, CAST(round(c_acctbal * 100) AS DOUBLE) AS c_acctbal FROM customer
    UNION ALL SELECT c_custkey, 'back', c_acctbal FROM customer""")
def alter_column(t):
    up = CENTS.up(t.customer)
    both = up.selectExpr("c_custkey", "'up' AS way", "cast(c_acctbal AS double) AS c_acctbal")
    return both.unionByName(CENTS.down(up).selectExpr("c_custkey", "'back' AS way", "c_acctbal"))


@query("evo_rename", "SELECT c_custkey AS id, c_name AS name, c_acctbal FROM customer")
def rename(t):
    change = e.RenameColumns({"c_custkey": "id", "c_name": "name"})
    tables = e.rename_table({"customer": change.up(t.customer)}, "customer", "client")
    return tables["client"].select("id", "name", "c_acctbal")


@query("evo_drop", "SELECT c_custkey, 'gone' AS c_mktsegment FROM customer")
def drop(t):
    change = e.DropColumn("c_mktsegment", "'gone'")
    tables = e.drop_table({"customer": change.up(t.customer), "old": t.nation}, "old")
    return e.revert(tables["customer"], [change]).select("c_custkey", "c_mktsegment")


@query("evo_constraint", """SELECT c_custkey, 'segment set' AS "constraint" FROM customer WHERE c_nationkey % 5 <> 0 AND c_mktsegment = 'BUILDING'
    UNION ALL SELECT c_custkey, 'one per nation' FROM customer WHERE (c_nationkey, c_mktsegment) IN (SELECT (c_nationkey, c_mktsegment) FROM customer GROUP BY ALL HAVING count(*) > 1)
    UNION ALL SELECT c_custkey, 'not in debt' FROM customer WHERE c_acctbal + 500 < 0""")
def constraint(t):
    rules = [e.Constraint("one per nation", "unique", ["c_nationkey", "c_mktsegment"]),
             e.Constraint("segment set", "not null", ["seg"], repair={"seg": "if(c_nationkey % 5 = 0, 'X', nullif(c_mktsegment, 'BUILDING'))"}),
             e.Constraint("not in debt", "check", check="c_acctbal >= 0", repair={"c_acctbal": "c_acctbal + 500"})]
    return e.constrain(t.customer, "c_custkey", rules)[1]


@query("evo_sql", "SELECT c_custkey, c_acctbal * 2 AS twice, c_acctbal AS c_acctbal FROM customer WHERE c_acctbal > 0")
def raw_sql(t):
    change = e.RawSql("SELECT *, c_acctbal * 2 AS twice FROM {t} WHERE c_acctbal > 0", "SELECT * EXCEPT (twice) FROM {t}")
    up = change.up(t.customer)
    assert change.down(up).columns == t.customer.columns
    return up.select("c_custkey", "twice", "c_acctbal")
