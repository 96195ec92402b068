"""Registered queries: message steps and delivery."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtide.catalog.registry import Tables, query
from rowtide.operators import delivery as d, messages as m, writes
from rowtide.session import stored


def msgs(t: Tables):
    return m.messages(t.events, ["event_id", "event_type", "value", "props"], {"user": F.col("user_id"), "kind": F.col("event_type")})


@query("pipe_map", "SELECT event_id AS id, value * 2 AS twice, event_type AS kind, CAST(event_id AS VARCHAR) AS record, CAST(user_id AS VARCHAR) AS user FROM events")
def pipe_map(t):
    out = m.mapping(msgs(t), {"id": F.col("content.event_id"), "twice": F.col("content.value") * 2}, {"record": F.col("content.event_id"), "kind": m.meta("kind")})
    return out.select("content.*", m.meta("kind").alias("kind"), m.meta("record").alias("record"), m.meta("user").alias("user"))


@query("pipe_filter_deleted", "SELECT event_id FROM events WHERE event_type <> 'error'")
def pipe_filter_deleted(t):
    return m.drop_deleted(msgs(t), F.col("content.event_type") == "error").select("content.event_id")


@query("pipe_jq", "SELECT props ->> '$.k' AS k, event_type AS kind, event_id FROM events")
def pipe_jq(t):
    df = t.events.select("event_id", F.col("props").alias("content"), F.create_map(F.lit("kind"), "event_type").alias("meta"))
    return m.json_paths(df, {"k": "$.k", "kind": "$._meta.kind"}).select("content.*", "event_id")


@query("pipe_branch", "SELECT event_id, value + 1 AS value, 'branched' AS how FROM events UNION ALL SELECT event_id, value, 'kept' FROM events")
def pipe_branch(t):
    request = lambda df: m.mapping(df, {"event_id": F.col("content.event_id"), "value": F.col("content.value")})
    plus = lambda df: m.mapping(df, {"event_id": F.col("content.event_id"), "value": F.col("content.value") + 1})
    taken = m.branch(msgs(t), request, [plus]).select("content.event_id", "content.value", F.lit("branched").alias("how"))
    kept = m.branch(msgs(t), request, [plus], keep_original=True).select("content.event_id", "content.value", F.lit("kept").alias("how"))
    return taken.unionByName(kept)


@query("pipe_switch", """SELECT event_id, CASE WHEN event_type = 'click' THEN 'a' WHEN value > 200 THEN 'b' ELSE event_type END AS arm FROM events
    UNION ALL SELECT event_id, 'a' FROM events WHERE event_type = 'click'""")
def pipe_switch(t):
    base = m.mapping(msgs(t), {"event_id": F.col("content.event_id"), "arm": F.col("content.event_type"), "value": F.col("content.value")})
    to = lambda name: lambda df: m.mapping(df, {"event_id": F.col("content.event_id"), "arm": F.lit(name), "value": F.col("content.value")})
    twice = lambda df: df.unionByName(df)
    out = m.switch(base, [(m.meta("kind") == "click", [to("a"), twice]), (F.col("content.value") > 200, [to("b")])])
    return out.select("content.event_id", "content.arm")


@query("pipe_try_catch", """SELECT event_id, CASE WHEN CAST(props ->> '$.k' AS INT) % 10 = 0 THEN -1 ELSE 100 // (CAST(props ->> '$.k' AS INT) % 10) END AS share FROM events""")
def pipe_try_catch(t):
    k = F.get_json_object("content.props", "$.k").try_cast("int")
    base = m.mapping(msgs(t), {"event_id": F.col("content.event_id"), "props": F.col("content.props"), "share": F.lit(None).cast("bigint")})
    tried = m.attempt(base, [(F.when(k.isNull(), F.lit("not json")), {}), (F.when(k % 10 == 0, F.lit("division by zero")), {"share": F.floor(F.try_divide(F.lit(100), k % 10))})])
    return m.must_succeed(m.catch(tried, {"share": F.lit(-1).cast("bigint")})).select("content.event_id", "content.share")


@query("pipe_unarchive", """SELECT doc_id, unnest(string_split(text, chr(10))) AS content FROM documents WHERE lang <> 'de'""")
def pipe_unarchive(t):
    packed = F.when(F.col("lang") == "de", F.lit("{}")).otherwise(F.to_json(F.split("text", "\n")))
    df = t.documents.select("doc_id", packed.alias("content"), F.create_map(F.lit("lang"), "lang").alias("meta"))
    return m.unarchive(df).select("doc_id", "content")


@query("pipe_archive", """WITH n AS (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 500 AS part FROM events)
    SELECT event_type, part, CAST(to_json(list({event_id: event_id, value: value} ORDER BY ts, event_id)) AS VARCHAR) AS content FROM n GROUP BY ALL""")
def pipe_archive(t):
    df = t.events.select("event_type", "ts", "event_id", F.struct("event_id", "value").alias("content"))
    return m.archive(df, ["event_type"], ["ts", "event_id"], 500)


@query("pipe_http_enrich", "SELECT event_id, 'seen:' || event_type AS response FROM events")
def pipe_http_enrich(t):
    return m.enrich(t.events.select("event_id", "event_type"), "event_type", lambda x: f"seen:{x}").select("event_id", "response")


@query("pipe_log", "SELECT count(*) AS n, max(event_id) AS last, count(DISTINCT event_id) AS passed FROM events")
def pipe_log(t):
    passed, seen = m.log(t.events.select("event_id"), "events", n=F.count(F.lit(1)), last=F.max("event_id"))
    through = stored(passed)
    metrics = seen.get
    return through.agg(F.lit(metrics["n"]).cast("bigint").alias("n"), F.lit(metrics["last"]).cast("bigint").alias("last"), F.count_distinct("event_id").alias("passed"))


@query("pipe_retry", "SELECT event_id, value FROM events")
def pipe_retry(t):
    """The client fails inside the tasks of the first two attempts; an accumulator counts what it was asked."""
    asked, attempts, out = t.spark.sparkContext.accumulator(0), [], []

    def send(rows, batch):
        attempts.append(batch)
        down = len(attempts) < 3

        def client(batches):
            for pdf in batches:
                asked.add(len(pdf))
                if down:
                    raise OSError("unreachable")
                yield pdf

        out.append(stored(rows.mapInPandas(client, rows.schema)))

    m.retried(send, wait=0.0)(t.events.select("event_id", "value"), 0)
    sent = out[0].count()
    if len(attempts) != 3 or asked.value < sent:
        raise AssertionError(f"{len(attempts)} attempts, {asked.value} of {sent} rows")
    return out[0]


@query("cdc_writeback", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-02-01' END AS processed_at,
    CASE WHEN o_orderstatus = 'F' THEN 'before' ELSE 'rowtide' END AS source FROM orders""")
def cdc_writeback(t):
    done = F.col("o_orderstatus") == "F"
    rows = t.orders.select("o_orderkey", F.when(done, F.lit("2024-01-01").cast("timestamp_ntz")).alias("processed_at"), F.when(done, "before").alias("source"))
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    merged = writes.merge_duplicates(rows, d.enriched(rows, now, "rowtide", "o_orderkey"), ["o_orderkey"])
    if d.enriched(merged, now, "rowtide", "o_orderkey").take(1):  # the write's own echo must not be written again
        raise AssertionError("write-back loops")
    return merged


@query("cdc_route_by_table", "SELECT 'click' AS route, event_id FROM events WHERE event_type = 'click' UNION ALL SELECT 'error', event_id FROM events WHERE event_type = 'error'")
def cdc_route_by_table(t):
    routes = {n: (lambda df, n=n: df.select(F.lit(n).alias("route"), "event_id")) for n in ("click", "error")}
    out = d.route_by_table(t.events, routes, "event_type")
    return out["click"].unionByName(out["error"])


@query("cdc_dead_letter", """SELECT event_id, event_type || CASE WHEN event_id % 9 > 5 OR value > 450 THEN '-dead' ELSE '-retry' END AS stream FROM events""")
def cdc_dead_letter(t):
    return d.dead_letters(t.events, F.col("event_type"), F.col("event_id") % 9, F.col("value") > 450).select("event_id", "stream")


@query("cdc_redrive", """SELECT event_type AS grp, count(*) FILTER (event_id % 9 > 5) AS redriven, count(*) FILTER (event_id % 9 <= 5) AS pending, max(event_id) AS lag FROM events GROUP BY 1""")
def cdc_redrive(t):
    streams = d.dead_letters(t.events, F.col("event_type"), F.col("event_id") % 9, F.lit(False))
    groups = t.events.groupBy(F.col("event_type").alias("grp")).agg(F.count_if(F.col("event_id") % 9 <= 5).alias("pending"), F.max("event_id").alias("lag"))
    return d.redrive(streams, groups)[1]


READERS = [("index", 100, 5, False), ("mirror", 0, 0, False), ("audit", 50, 0, True)]


@query("cdc_consumer_lag", """WITH g(grp, pos, pending, was) AS (VALUES ('index', 100, 5, false), ('mirror', 0, 0, false), ('audit', 50, 0, true)),
    l AS (SELECT grp, pending, was, count(*) FILTER (event_id > pos) AS lag FROM events, g GROUP BY ALL),
    s AS (SELECT *, CASE WHEN lag + pending > 940 AND was THEN 'to-tail' WHEN lag + pending > 940 THEN 'retired' ELSE 'reading' END AS state FROM l)
    SELECT grp, CASE WHEN state = 'to-tail' THEN 0 ELSE lag END AS lag, CASE WHEN state = 'to-tail' THEN 0 ELSE pending END AS pending, state FROM s""")
def cdc_consumer_lag(t):
    return d.consumer_lag(t.events, "event_id", READERS, budget=940)


@query("cdc_consumer_lag_many", """WITH g AS (SELECT c_custkey, c_custkey * 7919 % 9973 AS pos, c_custkey % 5 AS pending, c_custkey % 2 = 0 AS was FROM customer),
    l AS (SELECT g.*, (SELECT count(*) FROM orders) - coalesce(n, 0) AS lag FROM g ASOF LEFT JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) o ON pos >= o_orderkey),
    s AS (SELECT *, CASE WHEN lag + pending > 900 AND was THEN 'to-tail' WHEN lag + pending > 900 THEN 'retired' ELSE 'reading' END AS state FROM l)
    SELECT 'c' || c_custkey AS grp, CASE WHEN state = 'to-tail' THEN 0 ELSE lag END AS lag, CASE WHEN state = 'to-tail' THEN 0 ELSE pending END AS pending, state FROM s""")
def cdc_consumer_lag_many(t):
    """Every customer reads the log of orders and stands somewhere in it."""
    k = F.col("c_custkey")
    readers = t.customer.select(F.concat(F.lit("c"), k).alias("grp"), (k * 7919 % 9973).alias("position"), (k % 5).alias("pending"), (k % 2 == 0).alias("retired"))
    return d.consumer_lag(t.orders, "o_orderkey", readers, budget=900)


@query("cdc_retention_trim", """WITH a AS (SELECT event_type, max(event_id) // 2 AS p FROM events GROUP BY 1)
    SELECT event_id FROM events WHERE event_id > (SELECT min(p) FROM a) OR event_id IN (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 700)""")
def cdc_retention_trim(t):
    acked = t.events.groupBy(F.col("event_type").alias("grp")).agg(F.floor(F.max("event_id") / 2).alias("position"))
    return d.retained(t.events, "event_id", acked, ["view", "click", "purchase", "signup", "error"], keep=700).select("event_id")


@query("cdc_invalidation_batch", """WITH n AS (SELECT *, date_trunc('day', ts) AS period, (row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) - 1) // 20 AS part FROM events)
    SELECT strftime(period, '%Y-%m-%d') AS period, part, CASE WHEN bool_or(value > 480) THEN NULL ELSE array_to_string(list_sort(list_distinct(list(event_type))), ',') END AS tables,
      coalesce(arg_min(props, event_id) FILTER (event_type <> 'view'), '') AS trace FROM n GROUP BY ALL""")
def cdc_invalidation_batch(t):
    changes = t.events.withColumns({"tbl": F.when(F.col("value") <= 480, F.col("event_type")), "trace": F.when(F.col("event_type") != "view", F.col("props")).otherwise("")})
    out = d.invalidations(changes, "ts", ["ts", "event_id"], "tbl", "trace", "1 day", 20)
    return out.select(F.date_format("period", "yyyy-MM-dd").alias("period"), "part", F.array_join("tables", ",").alias("tables"), "trace")
