"""Registered queries: scans and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtide.catalog.registry import ORDERS_LOG, SCHEMAS, Tables, query
from rowtide.operators import types as ty, writes
from rowtide.session import fresh_path
from rowtide.sources import feeds, lake, versions
from rowtide.streaming.runs import drain


@query("src_snapshot", """SELECT o_orderkey, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey""")
def snapshot(t: Tables):
    base = fresh_path(t.spark, "tables")
    versions.commit({"orders": t.orders, "customer": t.customer}, base)
    seen = versions.capture(t.spark, base, {n: SCHEMAS[n] for n in ("orders", "customer")})
    versions.commit({"orders": t.orders_v2, "customer": t.customer.where("c_custkey % 2 = 0")}, base)  # the capture must not show it
    joined = seen["orders"].join(seen["customer"], F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("o_orderkey", "o_totalprice", "c_name")


@query("src_lake_manifest", "SELECT o_orderkey, o_totalprice, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def lake_manifest(t):
    base = fresh_path(t.spark, "lake")
    lake.publish({"orders": t.orders, "customer": t.customer, "nation": t.nation}, base)
    t.nation.write.mode("append").parquet(f"{base}/data/nation")  # files the manifest does not list
    got = lake.attach(t.spark, base)
    out = got["orders"].join(got["customer"], F.col("o_custkey") == F.col("c_custkey")).join(got["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    return out.select("o_orderkey", "o_totalprice", "n_name")


@query("src_lake_typed", """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS o_totalprice,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') AS o_orderdate, o_orderstatus FROM orders""")
def lake_typed(t):
    base = fresh_path(t.spark, "lake")
    lake.publish({"orders": t.orders.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))}, base)
    fields = {"o_orderkey": "int64", "o_totalprice": "decimal", "o_orderdate": "timestamp", "o_orderstatus": "string"}
    return ty.project_lossless(lake.attach(t.spark, base)["orders"].select(*fields), fields)


@query("src_kafka_json", "SELECT event_id, user_id, event_type, value FROM events")
def kafka_json(t):
    topic = fresh_path(t.spark, "topic")
    t.events.select(F.to_json(F.struct("event_id", "user_id", "event_type", "value")).alias("value")).write.text(topic)
    raw = t.spark.readStream.schema("value string").text(topic)
    return drain(feeds.json_records(raw, "event_id bigint, user_id bigint, event_type string, value double"))


@query("src_cdc_envelope", """SELECT event_id AS id, event_type, value, 'trace-' || user_id AS traceparent FROM events WHERE event_type NOT IN ('error', 'signup')""")
def cdc_envelope(t):
    body = F.to_json(F.struct(F.when(F.col("event_type") != "signup", F.col("event_id")).alias("id"), "event_type", "value"))
    data = F.when(F.col("event_type") == "error", F.substring(body, 1, 9)).otherwise(body)  # cut off: not JSON
    bus = t.events.select(data.alias("data"), F.concat(F.lit("trace-"), "user_id").alias("traceparent"))
    return feeds.unwrap_envelope(bus, "id bigint, event_type string, value double")


@query("src_change_log", f"WITH {ORDERS_LOG} SELECT seq, op, o_orderkey, o_totalprice FROM orders_log WHERE seq > 14 AND seq <= (SELECT max(seq) FROM orders_log)")
def change_log(t):
    log = t.orders_log
    target = log.agg(F.max("seq")).first()[0]
    assert feeds.change_log(log, 14, target, pruned=14) is None and feeds.change_log(log, 15, target) is None
    return feeds.change_log(log, 14, target).select("seq", "op", "o_orderkey", "o_totalprice")


@query("src_heartbeat", """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, count(*) AS n FROM events GROUP BY 1""")
def heartbeat(t):
    # one beat after the last event closes every window; without it the last hours stay open
    beats = fresh_path(t.spark, "beats")
    t.events.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("timestamp")).write.parquet(beats)
    stream = feeds.with_heartbeat(t.stream("events").select("ts", "event_type"), t.spark.readStream.schema("timestamp timestamp_ntz").parquet(beats),
                                  "ts", event_type=F.lit("heartbeat"))
    hours = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    real = F.count_if(F.col("event_type") != "heartbeat")
    hours = hours.groupBy(F.window("ts", "1 hour")).agg(real.alias("n")).where("n > 0")
    return drain(hours.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "n"))


@query("src_start_sweep", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def start_sweep(t):
    base, mark = fresh_path(t.spark, "swept"), fresh_path(t.spark, "mark")
    cols = ["o_orderkey", "o_custkey", "o_totalprice"]
    run = feeds.start_sweep(t.orders.select(*cols), t.stream("orders").select(*cols),
                            lambda rows, batch: versions.write_batch(rows, base, batch), mark)
    run.awaitTermination()
    return versions.merged(versions.read_batches(t.spark, base, "o_orderkey bigint, o_custkey bigint, o_totalprice double"), ["o_orderkey"])


@query("src_objects", "SELECT page_id % 20 AS shelf, CAST(sum(octet_length(encode(coalesce(html, ''))) + 1) AS BIGINT) AS length FROM pages GROUP BY 1")
def objects(t):
    base, shelf = fresh_path(t.spark, "objects"), (F.col("page_id") % 20).alias("shelf")
    t.pages.select(shelf, F.coalesce("html", F.lit("")).alias("value")).repartition("shelf").write.partitionBy("shelf").text(base)
    found = feeds.objects(t.spark, base, "*.txt")
    return found.groupBy(F.regexp_extract("path", "shelf=([0-9]+)/", 1).cast("bigint").alias("shelf")).agg(F.sum("length").alias("length"))


@query("src_content_check", """SELECT page_id, (CASE WHEN page_id % 5 = 0 THEN sha256(url) ELSE sha256(html) END) = sha256(html) AS matches FROM pages""")
def content_check(t):
    named = F.when(F.col("page_id") % 5 == 0, F.sha2("url", 256)).otherwise(F.sha2("html", 256))
    found = t.pages.select("page_id", F.concat(F.lit("site/"), named, F.lit("-page.html")).alias("path"), F.col("html").cast("binary").alias("content"))
    return feeds.check_content(found).select("page_id", "matches")


@query("sink_lake_publish", """SELECT 'customer' AS name, count(*) AS "rows" FROM customer UNION ALL SELECT 'orders', count(*) FROM orders""")
def lake_publish(t):
    base = fresh_path(t.spark, "lake")
    lake.publish({"orders": t.orders, "customer": t.customer}, base)
    got = lake.attach(t.spark, base)
    counts = [df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows")) for n, df in got.items()]
    return counts[0].unionByName(counts[1])


@query("sink_drop", "SELECT count(*) AS dropped FROM events")
def sink_drop(t):
    return t.spark.range(writes.drop_all(t.events), numPartitions=1).agg(F.count(F.lit(1)).alias("dropped"))
