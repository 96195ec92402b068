"""Registered queries: portable types and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtide.catalog.registry import Tables, query, refused
from rowtide.operators import types as ty, validate as v
from rowtide.operators.types import Field


def spelled(t: Tables):
    """Orders as loosely spelled text, some of it wrong."""
    k = F.col("o_orderkey")
    return t.orders.select(
        "o_orderkey",
        F.concat(F.when(k % 11 == 0, "x").otherwise(""), F.lit("000"), k.cast("string")).alias("n"),
        F.concat(F.lit("+0"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("00")).alias("price"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 23:30:00.5"), F.when(k % 13 == 0, "").otherwise("-0130")).alias("at"),
        F.concat(F.lit("PT"), (k % 50).cast("string"), F.lit("H"), (k % 60).cast("string"), F.lit("M1.50S")).alias("wait"),
        F.upper(F.concat(F.lit("41d7be09-25fa-4c83-b16e-"), F.lpad(F.hex(k), 12, "0"))).alias("id"),
        F.when(F.col("o_orderstatus") == "F", "t").when(F.col("o_orderstatus") == "O", "f").otherwise("maybe").alias("done"),
    )


FIELDS = {"n": Field("int64"), "price": Field("decimal", 12, 2), "at": Field("timestamp"), "wait": Field("duration"),
          "id": Field("uuid"), "done": Field("bool")}


@query("typ_normalize", """SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS n,
    regexp_replace(regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '0+$', ''), '[.]$', '') AS price,
    CASE WHEN o_orderkey % 13 <> 0 THEN strftime(o_orderdate + INTERVAL 25 HOUR, '%Y-%m-%dT%H:%M:%S') || '.500000Z' END AS at,
    'PT' || ((o_orderkey % 50) * 3600 + (o_orderkey % 60) * 60 + 1) || '.5S' AS wait,
    '41d7be09-25fa-4c83-b16e-' || lpad(lower(to_hex(o_orderkey)), 12, '0') AS id,
    CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS done,
    array_to_string(list_filter([CASE WHEN o_orderkey % 11 = 0 THEN 'n' END, CASE WHEN o_orderkey % 13 = 0 THEN 'at' END,
        CASE WHEN o_orderstatus = 'P' THEN 'done' END], lambda x: x IS NOT NULL), ',') AS _errors FROM orders""")
def normalize(t):
    return ty.normalize(spelled(t), FIELDS, "postgres").withColumn("_errors", F.array_join("_errors", ","))


@query("typ_check", """SELECT o_orderkey, o_totalprice < 100000 AS fits, o_orderkey % 31 <= 27 AS a_date,
    o_custkey % 400 <= 180 AS closed FROM orders""")
def check(t):
    k = F.col("o_orderkey")
    price = ty.canonical(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), Field("decimal", 7, 2))
    day = ty.canonical(F.concat(F.lit("2023-02-"), F.lpad(((k % 31) + 1).cast("string"), 2, "0")), Field("date"))
    x = (F.col("o_custkey") % 400).cast("string")
    ring = F.concat(F.lit('{"type":"Polygon","coordinates":[[[0,0],['), x, F.lit(",0],["), x, F.lit(",1],[0,0]]]}"))
    shape = ty.canonical(ring, Field("geojson"))
    return t.orders.select("o_orderkey", price.isNotNull().alias("fits"), day.isNotNull().alias("a_date"), shape.isNotNull().alias("closed"))


@query("typ_project_lossless", """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') AS o_orderdate,
    CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS o_totalprice, 'PT' || (o_custkey * 60) || '.25S' AS wait, base64(encode(o_orderpriority)) AS raw FROM orders""")
def project_lossless(t):
    df = t.orders.select("o_orderkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"),
                         F.make_dt_interval(F.lit(0), F.lit(0), F.col("o_custkey").cast("int"), F.lit(0.25).cast("decimal(18,6)")).alias("wait"),
                         F.col("o_orderpriority").cast("binary").alias("raw"))
    fields = {"o_orderkey": "int64", "o_orderdate": "timestamp", "o_totalprice": "decimal", "wait": "duration", "raw": "bytes"}
    ty.admit_physical(df.schema, fields)
    return ty.project_lossless(df, fields)


ADMITTED = {"o_orderkey": "int64", "o_totalprice": "double", "o_orderdate": "timestamp", "o_orderstatus": "string"}


@query("typ_physical_admission", """SELECT o_orderkey, o_totalprice, o_orderdate, o_orderstatus, false AS as_declared, true AS whole_from_double, true AS date_from_timestamp,
    true AS number_from_text, false AS decimal_from_text, false AS from_nothing FROM orders""")
def physical_admission(t):
    df = t.orders.select(*ADMITTED)
    cases = {"as_declared": ADMITTED, "whole_from_double": {"o_totalprice": "int64"}, "date_from_timestamp": {"o_orderdate": "date"},
             "number_from_text": {"o_orderstatus": "double"}, "decimal_from_text": {"o_orderstatus": "decimal"}}
    no = {n: refused(ty.admit_physical, df.schema, fields) for n, fields in cases.items()}
    empty = df.where("false").withColumn("o_totalprice", F.lit(None))  # no type yet, so any type
    return df.withColumns(no | {"from_nothing": refused(ty.admit_physical, empty.schema, ADMITTED)})


@query("typ_boundary", "SELECT c_custkey, c_name, false AS exact, true AS missing, true AS extra, true AS twice, false AS no_rows FROM customer")
def boundary(t):
    df, fields = t.customer.select("c_custkey", "c_name"), ["c_custkey", "c_name"]
    cases = {"exact": df, "missing": df.select("c_name"), "extra": t.customer, "twice": df.select("*", "c_name"), "no_rows": df.where("false")}
    return df.withColumns({n: refused(ty.check_boundary, case.schema, fields) for n, case in cases.items()})


@query("typ_compare", """SELECT o_orderkey, sign(o_totalprice - 99999.5)::INT AS price, sign(o_orderkey - 900)::INT AS k, sign(o_custkey * 60 - 5400)::INT AS wait FROM orders""")
def compare(t):
    price = ty.compare(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("9.99995e4"), "decimal")
    wait = ty.compare(F.concat(F.lit("PT"), F.col("o_custkey").cast("string"), F.lit("M")), F.lit("01:30:00"), "duration")
    return t.orders.select("o_orderkey", price.alias("price"), ty.compare(F.col("o_orderkey").cast("string"), F.lit("900"), "int64").alias("k"), wait.alias("wait"))


@query("typ_protojson", "SELECT o_orderkey, o_custkey || '.5s' AS proto, 'PT' || o_custkey || '.5S' AS back FROM orders")
def protojson(t):
    proto = ty.to_protojson(ty.canonical(F.concat(F.lit("PT"), F.col("o_custkey").cast("string"), F.lit(".500S")), Field("duration")), "duration")
    return t.orders.select("o_orderkey", proto.alias("proto")).withColumn("back", ty.from_protojson(F.col("proto"), Field("duration")))


@query("val_constraints", r"""SELECT doc_id, 'text.max_length' AS rule FROM documents WHERE length(text) > 500
    UNION ALL SELECT doc_id, 'text.min_length' FROM documents WHERE length(text) < 1
    UNION ALL SELECT doc_id, 'text.pattern' FROM documents WHERE NOT regexp_full_match(text, '[\p{L}\p{N}\p{P}\p{S}\s]+')""")
def constraints(t):
    return v.violations(t.documents, "doc_id", [v.Rule("text", required=True, min_length=1, max_length=500, pattern=v.PLAIN_TEXT)])


@query("val_cross_row", """WITH f AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY 1)
    SELECT c_custkey, CASE WHEN top > 60 * c_acctbal THEN 'own-limit' ELSE '' END AS refused, CASE WHEN o_custkey IS NULL THEN 'own-limit' ELSE '' END AS error,
    o_custkey IS NOT NULL AND NOT top > 60 * c_acctbal AS ok FROM customer LEFT JOIN f ON c_custkey = o_custkey""")
def cross_row(t):
    facts = v.grouped_facts(t.orders, "o_custkey", top=F.max("o_totalprice"))
    out = v.cross_row(t.customer, {"orders": (facts, "c_custkey", "o_custkey")}, {"own-limit": F.col("orders.top") <= 60 * F.col("c_acctbal")})
    return out.select("c_custkey", F.array_join("refused", ",").alias("refused"), F.array_join("error", ",").alias("error"), "ok")


@query("val_unique_key", "SELECT lower(p_brand) AS key, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def unique_key(t):
    return v.repeated_keys(t.part.withColumn("p_brand", F.upper("p_brand")), F.lower("p_brand"))
