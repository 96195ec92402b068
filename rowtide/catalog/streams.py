"""Registered queries: streams, each run over all input its source holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtide.catalog.registry import Tables, query
from rowtide.session import fresh_path
from rowtide.sources import files, versions
from rowtide.streaming import stateful, windows as w
from rowtide.streaming.runs import drain

# Windows close once the watermark, an hour behind the newest event, has passed their end.
CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


def feed(t: Tables):
    """Events as a stream with a message that is sometimes null; every record arrives twice."""
    e = t.stream("events").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withColumn("message", F.when(F.col("event_type") != "view", F.concat_ws(":", "event_type", "props")))
    return e.unionByName(e)


def shard(key: str, shards: int):
    return (F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint") % shards).cast("int")


MESSAGES = """m AS (SELECT *, CASE WHEN event_type <> 'view' THEN event_type || ':' || props END AS message,
    CAST(('0x' || md5(CAST(event_id AS VARCHAR))[1:8]) AS BIGINT) % 4 AS part FROM events)"""


@query("str_tumble_agg", f"""WITH {MESSAGES}, g AS (SELECT date_trunc('hour', ts) AS w, part, count(*) AS n, coalesce(string_agg(message, ', ' ORDER BY message), '') AS messages FROM m GROUP BY ALL)
    SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, part, n, messages FROM g
    WHERE w + INTERVAL 1 HOUR <= {CLOSED} AND w IN (SELECT w FROM g GROUP BY w HAVING sum(n) >= 2)""")
def tumble(t):
    base, mark = fresh_path(t.spark, "windows"), fresh_path(t.spark, "mark")
    texts = w.window_texts(feed(t), "ts", "1 hour", "1 hour", "event_id", "message", part=shard("event_id", 4))
    w.emit(texts, base, mark).awaitTermination()
    out = versions.read_batches(t.spark, base, "id string, window_start timestamp, part int, n bigint, messages string")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "part", "n", "messages")


@query("str_hop_agg", f"""WITH h AS (SELECT event_type, value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events)
    SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n, max(value) AS top FROM h WHERE w + INTERVAL 2 HOUR <= {CLOSED} GROUP BY ALL""")
def hop(t):
    e = t.stream("events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    out = e.groupBy(F.window("ts", "2 hours", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    return drain(out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", "top"))


@query("str_dedup", "SELECT event_id, user_id, value FROM events")
def dedup(t):
    return drain(w.dedup(feed(t), "ts", "1 hour", ["event_id"]).select("event_id", "user_id", "value"))


@query("str_late_replay", f"""WITH {MESSAGES} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, part, count(*) AS n FROM m
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {CLOSED} GROUP BY ALL""")
def late_replay(t):
    base = fresh_path(t.spark, "windows")
    for again in range(2):  # a restart that lost its checkpoint replays everything
        texts = w.window_texts(feed(t), "ts", "1 day", "1 hour", "event_id", "message", part=shard("event_id", 4))
        w.emit(texts, base, fresh_path(t.spark, "mark"), first_batch=again * 1000).awaitTermination()
    every = versions.read_batches(t.spark, base, "id string, window_start timestamp, part int, n bigint, messages string")
    return versions.merged(every, ["id"]).select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "part", "n")


@query("str_trace_state", """SELECT event_id, user_id, trace FROM (SELECT *, coalesce(last_value(CASE WHEN event_type = 'signup' THEN props END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), '') AS trace FROM events) WHERE event_type <> 'signup'""")
def trace_state(t):
    # files of consecutive times, so that markers have to carry over from batch to batch
    src = fresh_path(t.spark, "feed")
    t.events.repartitionByRange(4, "ts").sortWithinPartitions("ts", "event_id").write.parquet(src)
    files.in_order(t.spark, src)
    stream = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 2).parquet(src).select("event_id", "user_id", "ts", "event_type", "props")
    traced = stateful.carry_trace(stream, "user_id", ["ts", "event_id"], F.col("event_type") == "signup", F.col("props"))
    return drain(traced.select("event_id", "user_id", "trace"), start=stateful.started)


@query("str_write_back_stream", """SELECT o_orderkey, 'rowtide' AS source, '2024-02-01' AS processed_at FROM orders WHERE o_orderstatus <> 'F'""")
def write_back_stream(t):
    done = F.col("o_orderstatus") == "F"
    rows = t.stream("orders").select("o_orderkey", F.when(done, "2024-01-01").alias("processed_at"), F.when(done, "before").alias("source"))
    echo = rows.withColumns({"processed_at": F.coalesce("processed_at", F.lit("2024-02-01")), "source": F.coalesce("source", F.lit("rowtide"))})
    base = fresh_path(t.spark, "written")
    apply = stateful.write_back_batches(base, "o_orderkey", F.lit("2024-02-01"), "rowtide")
    both = rows.unionByName(rows).unionByName(echo)  # delivered twice, and its own updates come back
    both.writeStream.foreachBatch(apply).option("checkpointLocation", fresh_path(t.spark, "mark")).trigger(availableNow=True).start().awaitTermination()
    return versions.merged(versions.read_batches(t.spark, base, "o_orderkey bigint, processed_at string, source string"), ["o_orderkey"])


@query("str_tumble_parts", f"""WITH {MESSAGES}, n AS (SELECT date_trunc('hour', ts) AS w, message, (row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY message IS NULL, message, event_id) - 1) // 25 AS part,
      count(*) OVER (PARTITION BY date_trunc('hour', ts)) AS total FROM m)
    SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, part, count(*) AS n, coalesce(string_agg(message, ', ' ORDER BY message), '') AS messages FROM n
    WHERE w + INTERVAL 1 HOUR <= {CLOSED} AND total >= 2 GROUP BY ALL""")
def tumble_parts(t):
    base, mark = fresh_path(t.spark, "windows"), fresh_path(t.spark, "mark")
    rows = w.window_rows(feed(t), "ts", "1 hour", "1 hour", "event_id", "message")
    w.emit_parts(rows, "event_id", "message", base, mark, 25).awaitTermination()
    out = versions.read_batches(t.spark, base, "id string, window_start timestamp, part int, n bigint, messages string")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "part", "n", "messages")


@query("str_archive", """WITH n AS (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 150 AS part FROM events)
    SELECT event_type, part, CAST(to_json(list({event_id: event_id, value: value} ORDER BY ts, event_id)) AS VARCHAR) AS content FROM n GROUP BY ALL""")
def archive(t):
    src = fresh_path(t.spark, "feed")
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp")).select("event_type", "ts", "event_id", F.to_json(F.struct("event_id", "value")).alias("content"))
    rows.repartitionByRange(4, "ts").sortWithinPartitions("ts", "event_id").write.parquet(src)
    files.in_order(t.spark, src)
    # a heartbeat a day after the last event comes last and moves the clock on, so every key falls quiet
    beat = rows.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    beat = beat.select(F.lit(None).cast("string").alias("event_type"), "ts", F.lit(-1).cast("bigint").alias("event_id"), F.lit("0").alias("content"))
    beat.coalesce(1).write.mode("append").parquet(src)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(src)
    out = stateful.archived(stream, ["event_type"], "ts", ["ts", "event_id"], "content", 150, "1 hour", 3_600_000)
    return drain(out, start=stateful.started).where("event_type IS NOT NULL")
