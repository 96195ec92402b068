"""Registered queries: the declarative read."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtide.catalog.registry import Tables, query
from rowtide.operators import access, read as r
from rowtide.operators.read import Embed, Param


def lookup(t: Tables):
    return lambda name: getattr(t, name)


@query("read_top_customers", """
    WITH mine AS (SELECT * FROM customer WHERE c_nationkey IN (1, 2, 3, 7, 11)),
    spent AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total, count(*) AS n
              FROM orders GROUP BY 1)
    SELECT c_custkey, c_name, CAST(total AS DOUBLE) AS total, n, to_json({n_nationkey: n_nationkey, n_name: n_name}) AS nation
    FROM mine JOIN spent ON c_custkey = o_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
    ORDER BY total DESC, c_custkey LIMIT 10""")
def top_customers(t: Tables):
    scoped = t.customer.withColumn("scope_id", F.concat(F.lit("nation:"), "c_nationkey"))
    mine = access.visible(scoped, [f"nation:{n}" for n in (1, 2, 3, 7, 11)])
    spent = t.orders.groupBy("o_custkey").agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"), F.count(F.lit(1)).alias("n"))
    top = r.page(mine.join(spent, mine.c_custkey == spent.o_custkey), ["total.desc", "c_custkey"], 10)
    top = r.embed(top, Embed("nation", "nation", [("c_nationkey", "n_nationkey")], select=("n_nationkey", "n_name")), lookup(t))
    return top.select("c_custkey", "c_name", F.col("total").cast("double").alias("total"), "n", F.to_json("nation").alias("nation"))


@query("sel_columns", "SELECT c_custkey AS id, c_name AS name, c_acctbal FROM customer")
def sel_columns(t):
    return r.select(t.customer, ["id:c_custkey", "name:c_name", "c_acctbal"])


@query("sel_json_row", """SELECT CAST(to_json({n_nationkey: n_nationkey, n_name: n_name, n_regionkey: NULLIF(n_regionkey, 0)}) AS VARCHAR) AS "row" FROM nation""")
def sel_json_row(t):
    return r.json_rows(t.nation.withColumn("n_regionkey", F.nullif("n_regionkey", F.lit(0))))


@query("flt_compare", """SELECT * FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 300000 AND o_orderstatus <> 'P'
    AND o_orderkey >= 10 AND o_custkey < 1000000 AND o_orderpriority = '5-LOW'""")
def flt_compare(t):
    return r.where(t.orders, [("o_totalprice", "gt", 100000), ("o_totalprice", "lte", 300000), ("o_orderstatus", "neq", "P"),
                              ("o_orderkey", "gte", 10), ("o_custkey", "lt", 1000000), ("o_orderpriority", "eq", "5-LOW")])


@query("flt_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring' AND p_type IS NOT NULL")
def flt_like(t):
    return r.where(t.part, [("p_name", "like", "*ring"), ("p_type", "like", "**")]).select("p_partkey", "p_name")


@query("flt_ilike", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%' AND p_name NOT ILIKE '%WIDGET'")
def flt_ilike(t):
    return r.where(t.part, [("p_name", "ilike", "*RED*"), ("p_name", "not.ilike", "*WIDGET")]).select("p_partkey", "p_name")


@query("flt_is", """SELECT doc_id, (toxic = 1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)
    WHERE (toxic = 1) IS NULL OR (toxic = 1) IS TRUE""")
def flt_is(t):
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", (F.col("toxic") == 1).alias("toxic"))
    return r.where(joined, [("or", [("toxic", "is", "unknown"), ("toxic", "is", "true")])])


@query("flt_in", "SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def flt_in(t):
    empty = r.where(t.orders, [("o_orderstatus", "in", [])])
    return r.where(t.orders, [("o_orderpriority", "in", ["1-URGENT", "2-HIGH"])]).unionAll(empty)


@query("flt_not", "SELECT doc_id, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT (toxic = 1)")
def flt_not(t):
    joined = t.documents.select("doc_id").join(t.labels.select("doc_id", "toxic"), "doc_id", "left")
    return r.where(joined, [("toxic", "not.eq", 1)])


@query("flt_and_or", """SELECT * FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 400000)
    AND (o_orderpriority <> '5-LOW' AND o_custkey > 5)""")
def flt_and_or(t):
    return r.where(t.orders, [("or", [("o_orderstatus", "eq", "F"), ("o_totalprice", "gt", 400000)]),
                              ("and", [("o_orderpriority", "neq", "5-LOW"), ("o_custkey", "gt", 5)])])


@query("flt_fts", r"""SELECT doc_id FROM documents WHERE
    list_has_all(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), ['que', 'elle'])""")
def flt_fts(t):
    return r.where(t.documents, [("text", "plfts", "Que ELLE")]).select("doc_id")


@query("flt_related", """SELECT o_orderkey, CAST(to_json(CASE WHEN c_custkey IS NOT NULL THEN {c_name: c_name, c_mktsegment: c_mktsegment} END) AS VARCHAR) AS customer
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey""")
def flt_related(t):
    spec = Embed("customer", "customer", [("o_custkey", "c_custkey")], select=("c_name", "c_mktsegment"),
                 where=[("c_mktsegment", "eq", "BUILDING")])
    return r.read(lookup(t), "orders", ["o_orderkey"], embeds=[spec]).withColumn("customer", F.to_json("customer"))


@query("flt_key_param", "SELECT * FROM orders WHERE o_custkey = 7")
def flt_key_param(t):
    return r.where(t.orders, [("o_custkey", "eq", Param(1))], [7])


@query("flt_subset_where", """SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O') AND NOT (o_totalprice < 250000)
    AND (o_custkey IS NOT NULL OR o_totalprice = NULL)""")
def flt_subset_where(t):
    pred = ("and", [("o_orderstatus", "any", Param(1)), ("not", ("o_totalprice", "lt", Param(2))),
                    ("or", [("o_custkey", "not.is", "null"), ("o_totalprice", "eq", Param(9))])])
    return r.where(t.orders, [pred], [["F", "O"], 250000])


@query("flt_subset_coalesce", """SELECT 'high' AS request, o_orderkey FROM orders WHERE o_totalprice > 300000
    UNION ALL SELECT 'urgent', o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'
    UNION ALL SELECT 'early', o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'""")
def flt_subset_coalesce(t):
    reads = {"high": [("o_totalprice", "gt", 300000)],
             "urgent": [("o_orderpriority", "eq", "1-URGENT"), ("o_orderstatus", "eq", "F")],
             "early": [("o_orderdate", "lt", "1996-01-01")]}
    return r.tagged_reads(t.orders, reads).select("request", "o_orderkey")


@query("prj_defaults", """SELECT c_custkey, c_acctbal, 'none' AS c_note, 3 AS c_level FROM customer""")
def prj_defaults(t):
    rows = t.customer.select("c_custkey", "c_acctbal")
    return r.with_defaults(rows, {"c_acctbal": ("double", 0), "c_note": ("string", "none"), "c_level": ("int", 3)})


@query("prj_query_page", """WITH nxt AS (SELECT * FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 500),
    sized AS (SELECT *, 1 + sum(octet_length(encode(CAST(to_json({o_orderkey: o_orderkey, o_custkey: o_custkey, o_orderstatus: o_orderstatus,
        o_orderpriority: o_orderpriority}) AS VARCHAR))) + 1) OVER (ORDER BY o_orderkey) AS b FROM nxt)
    SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM sized WHERE b <= 20000""")
def prj_query_page(t):
    return r.key_page(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "o_orderkey", 100, 500, 20000)


@query("prj_capture_text", """SELECT CAST(to_json({c_acctbal: c_acctbal, c_custkey: CAST(c_custkey AS VARCHAR), c_mktsegment: c_mktsegment,
    c_name: c_name, c_nationkey: c_nationkey}) AS VARCHAR) AS text FROM customer""")
def prj_capture_text(t):
    return r.capture_text(t.customer)


@query("prj_digest", """WITH h AS (SELECT sha256(CAST(to_json({o_custkey: o_custkey, o_orderkey: o_orderkey, o_orderpriority: o_orderpriority,
        o_orderstatus: o_orderstatus, o_totalprice: o_totalprice}) AS VARCHAR)) AS h FROM orders),
    s AS (SELECT sum(CAST(('0x' || h[1:15]) AS BIGINT)::HUGEINT) AS a, sum(CAST(('0x' || h[16:30]) AS BIGINT)::HUGEINT) AS b,
        sum(CAST(('0x' || h[31:45]) AS BIGINT)::HUGEINT) AS c, sum(CAST(('0x' || h[46:60]) AS BIGINT)::HUGEINT) AS d, count(*) AS n FROM h)
    SELECT sha256(concat_ws(':', a, b, c, d, n)) AS digest, n AS "rows" FROM s""")
def prj_digest(t):
    return r.digest(t.orders.drop("o_orderdate"))


@query("srt_order", """SELECT c_custkey, bal FROM (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS bal FROM customer)
    ORDER BY bal DESC NULLS FIRST, c_custkey""")
def srt_order(t):
    return r.order_by(t.customer.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("bal")),
                      "bal.desc", "c_custkey.asc")


@query("srt_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 25")
def srt_limit_offset(t):
    return r.read(lookup(t), "orders", ["o_orderkey", "o_totalprice"], order=["o_totalprice.desc", "o_orderkey"], limit=50, offset=25)


@query("srt_subset_topk", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def srt_subset_topk(t):
    return r.read(lookup(t), "orders", ["o_orderkey", "o_orderdate"], [("o_orderstatus", "eq", "F")],
                  order=["o_orderdate.desc", "o_orderkey"], limit=20)
