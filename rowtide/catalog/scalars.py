"""Registered queries: scalar functions and the function kinds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from rowtide.catalog.registry import Tables, query
from rowtide.functions import ids, text
from rowtide.session import stored


@query("fn_string", r"""SELECT p_partkey, substring(p_name FROM 3) AS tail, strpos(p_name, 'r') AS at, length(p_name) AS n, rtrim(p_name, 'gt') AS trimmed,
    lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, concat(p_brand, '/', p_type) AS joined, replace(p_name, ' ', '_') AS snake,
    lower(p_type) AS low, starts_with(p_name, 'red') AS red, octet_length(encode(p_name)) AS bytes, regexp_extract(p_brand, '([0-9]+)', 1) AS digits,
    regexp_matches(p_name, '^[a-m]') AS early FROM part""")
def fn_string(t: Tables):
    c = F.col
    return t.part.select(
        "p_partkey", F.substring("p_name", 3, 1000).alias("tail"), F.locate("r", c("p_name")).alias("at"), F.char_length("p_name").alias("n"),
        F.rtrim(c("p_name"), F.lit("gt")).alias("trimmed"), F.lpad(c("p_size").cast("string"), 4, "0").alias("padded"),
        F.concat("p_brand", F.lit("/"), "p_type").alias("joined"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("snake"),
        F.lower("p_type").alias("low"), c("p_name").startswith("red").alias("red"), F.octet_length("p_name").alias("bytes"),
        F.regexp_extract("p_brand", "([0-9]+)", 1).alias("digits"), c("p_name").rlike("^[a-m]").alias("early"))


@query("fn_unaccent", """WITH p AS (SELECT doc_id, text, replace(replace(replace(strip_accents(text), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae') AS plain FROM documents)
    SELECT doc_id, sha256(plain) AS plain, plain = text AS same FROM p""")
def fn_unaccent(t):
    plain = text.unaccent(F.col("text"))
    return t.documents.select("doc_id", F.sha2(plain, 256).alias("plain"), (plain == F.col("text")).alias("same"))


@query("fn_cast_exact", """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k, CAST(o_totalprice AS DECIMAL(12,2))::VARCHAR AS price, o_orderkey AS back FROM orders""")
def fn_cast_exact(t):
    k = F.col("o_orderkey").cast("string")
    price = text.cast_exact(F.col("o_totalprice").cast("string"), "decimal(12,2)").cast("string")
    return t.orders.select("o_orderkey", k.alias("k"), price.alias("price"), text.cast_exact(k, "bigint").alias("back"))


@query("fn_date", """SELECT event_id, strftime(date_trunc('month', ts), '%Y-%m-%d') AS month, epoch_us(ts) AS micros,
    CAST(trunc(epoch_us(TIMESTAMP '2024-01-15 12:00:00' - ts) / 60000000.0) AS BIGINT) AS minutes, strftime(ts + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS later,
    strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%d %H:%M') AS ny FROM events""")
def fn_date(t):
    ts = F.col("ts")
    utc = F.to_timestamp_ltz(F.concat(ts.cast("string"), F.lit("+00:00")))
    return t.events.select(
        "event_id", F.date_format(F.date_trunc("month", ts), "yyyy-MM-dd").alias("month"), F.unix_micros(utc).alias("micros"),
        F.expr("timestampdiff(MINUTE, ts, TIMESTAMP_NTZ'2024-01-15 12:00:00')").alias("minutes"),
        F.date_format(ts + F.make_dt_interval(F.lit(0), F.lit(1), F.lit(30)), "yyyy-MM-dd HH:mm:ss").alias("later"),
        F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), ts), "yyyy-MM-dd HH:mm").alias("ny"))


@query("fn_math", """SELECT l_orderkey, l_linenumber, l_partkey, greatest(l_quantity, l_tax * 100) AS top, trunc(l_extendedprice) AS whole,
    isfinite(l_discount) AS finite, l_partkey // 7 AS q, l_partkey % 7 AS r FROM lineitem""")
def fn_math(t):
    c = F.col
    whole = F.when(c("l_extendedprice") < 0, F.ceil("l_extendedprice")).otherwise(F.floor("l_extendedprice"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.greatest("l_quantity", c("l_tax") * 100).alias("top"),
                             whole.cast("double").alias("whole"), (~F.isnan("l_discount") & (F.abs("l_discount") < float("inf"))).alias("finite"),
                             F.expr("l_partkey div 7").alias("q"), (c("l_partkey") % 7).alias("r"))


@query("fn_conditional", """SELECT c_custkey, coalesce(NULLIF(c_mktsegment, 'BUILDING'), 'other') AS seg, CASE WHEN c_acctbal < 0 THEN 'low' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END AS band FROM customer""")
def fn_conditional(t):
    bal = F.col("c_acctbal")
    checked = F.when(F.isnan(bal), F.raise_error(F.lit("balance is not a number"))).when(bal < 0, "low").when(bal < 5000, "mid").otherwise("high")
    return t.customer.select("c_custkey", F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("other")).alias("seg"), checked.alias("band"))


@query("fn_json", """SELECT event_id, CAST(props ->> '$.k' AS INT) AS k, CAST(to_json({id: event_id, kind: event_type}) AS VARCHAR) AS obj,
    'k' AS name, CAST(props -> '$.k' AS VARCHAR) AS member, '{"k":' || (props ->> '$.k') || ',"t":"' || event_type || '"}' AS merged FROM events""")
def fn_json(t):
    e = t.events.withColumn("m", F.from_json("props", "map<string,int>"))
    each = e.select("*", F.explode(F.from_json("props", "map<string,string>")).alias("name", "member"))
    merged = F.concat(F.regexp_replace(F.to_json("m"), "}$", ","), F.lit('"t":"'), "event_type", F.lit('"}'))
    return each.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"),
                       F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("obj"), "name", "member", merged.alias("merged"))


@query("fn_array", """WITH w AS (SELECT doc_id, list_distinct(string_split(lower(source || ' ' || lang), ' ')) AS ws FROM documents)
    SELECT doc_id, unnest(ws) AS w, len(ws) AS n, list_contains(ws, 'fr') AS fr, list_has_any(ws, ['en', 'de']) AS overlap FROM w""")
def fn_array(t):
    ws = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "source", "lang")), " "))
    df = t.documents.select("doc_id", ws.alias("ws"))
    return df.select("doc_id", F.explode("ws").alias("w"), F.size("ws").alias("n"), F.array_contains("ws", "fr").alias("fr"),
                     F.arrays_overlap("ws", F.array(F.lit("en"), F.lit("de"))).alias("overlap"))


NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


@query("fn_hash_id", f"""WITH h AS (SELECT doc_id, sha256(text) AS sha, base64(encode(lang)) AS b64,
      sha1(from_hex('{NAMESPACE.replace("-", "")}') || encode(source || doc_id)) AS d FROM documents)
    SELECT doc_id, sha, b64, d[1:8] || '-' || d[9:12] || '-5' || d[14:16] || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', d[17:17]), 1)
      || d[18:20] || '-' || d[21:32] AS id FROM h""")
def fn_hash_id(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha"), F.base64(F.col("lang").cast("binary")).alias("b64"),
                              ids.uuid5(NAMESPACE, F.concat("source", F.col("doc_id").cast("string"))).alias("id"))


@query("fn_mapping", """SELECT event_id, CAST(props ->> '$.k' AS INT) AS k, CASE WHEN event_type = 'error' THEN 'none' ELSE event_type END AS kind,
    [user_id * 2, user_id] AS doubled, CASE WHEN user_id > 3 THEN user_id * 2 END AS first_big, 2 AS n, json_exists(props, '$.k') AS has_k, 'BIGINT' AS type FROM events""")
def fn_mapping(t):
    e = t.events.withColumns({"v": F.try_parse_json("props"), "pair": F.array("user_id", "user_id")})
    doubled = F.transform(F.array(F.col("user_id") * 2, F.col("user_id")), lambda x: x)
    big = F.get(F.filter(doubled, lambda x: x > 6), F.lit(0))
    return e.select("event_id", F.coalesce(F.try_variant_get("v", "$.k", "int"), F.lit(0)).alias("k"),
                    F.coalesce(F.nullif("event_type", F.lit("error")), F.lit("none")).alias("kind"), doubled.alias("doubled"),
                    F.when(F.col("user_id") > 3, big).alias("first_big"), F.size(F.flatten(F.array(F.array_distinct("pair"), F.array_distinct("pair")))).alias("n"),
                    F.variant_get("v", "$.k", "string").isNotNull().alias("has_k"), F.schema_of_variant(F.variant_get("v", "$.k", "variant")).alias("type"))


@query("fn_interpolate", """SELECT event_id, 'http://host/' || event_type || '?id=eq.' || user_id || '&x=' AS url FROM events""")
def fn_interpolate(t):
    meta = F.create_map(F.lit("collection"), "event_type", F.lit("record_id"), F.col("user_id").cast("string"))
    url = text.interpolate('http://${HOST}/${! meta("collection") }?id=eq.${_meta.record_id}&x=${NOPE}', env={"HOST": "host"})
    return t.events.withColumn("meta", meta).select("event_id", url.alias("url"))


@query("fn_traceparent", """SELECT event_id, CASE WHEN event_type <> 'error' THEN '00-' || md5(props) || '-' || left(md5(event_type), 16) || '-01' ELSE '' END AS trace FROM events""")
def fn_traceparent(t):
    made = F.concat(F.lit("00-"), F.md5("props"), F.when(F.col("event_type") == "error", "").otherwise("-"), F.substring(F.md5("event_type"), 1, 16), F.lit("-01"))
    return t.events.select("event_id", text.traceparent(made).alias("trace"))


@query("udf_scalar", "SELECT event_id, value * 2 + length(event_type) AS score FROM events")
def udf_scalar(t):
    @F.pandas_udf("double")
    def score(value: pd.Series, kind: pd.Series) -> pd.Series:
        return value * 2 + kind.str.len()

    return t.events.select("event_id", score("value", "event_type").alias("score"))


@query("udf_table", """SELECT doc_id, unnest(range(len(string_split(text, ' ')))) AS pos, unnest(string_split(text, ' ')) AS token FROM documents""")
def udf_table(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "token")).withColumn("pos", F.col("pos").cast("bigint"))


@query("udf_seeded", "SELECT o_orderkey, CAST(('0x' || sha256(o_orderpriority || o_orderkey)[1:8]) AS BIGINT) AS seed FROM orders")
def udf_seeded(t):
    return t.orders.select("o_orderkey", ids.seed(F.concat("o_orderpriority", F.col("o_orderkey").cast("string"))).alias("seed"))
