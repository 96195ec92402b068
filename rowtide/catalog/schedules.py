"""Registered queries: schedules. Every customer owns a cron schedule and every order a one-shot one."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtide.catalog.registry import Tables, query
from rowtide.operators import schedule as s, writes
from rowtide.session import stored

CRONS = ("*/10 * * * *", "30 2 * * *", "0,30 1-23/2 * * 1-5", "15 */6 1,10,20 * *", "0 0 13 * FRI", "45 5 * FEB,MAR *")
ZONES = ("UTC", "America/New_York", "America/Sao_Paulo", "Asia/Kolkata")
NOW = "2026-02-11 12:00:00"


def pick(values, key):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def crons(t: Tables, lateness=(300, 3600, 86400), now: str = NOW):
    """The watermark of customer k is k hours back, at most 29 days; every ninth customer has none."""
    k = F.col("c_custkey")
    mark = F.when(k % 9 != 0, F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), (k % 700).cast("int")))
    return t.customer.select(F.col("c_name").alias("name"), pick(CRONS, k).alias("cron"), F.lit(None).cast("timestamp_ntz").alias("due_at"),
                             pick(ZONES, F.floor(k / 6)).alias("time_zone"), pick(lateness, k).alias("max_lateness_seconds"), mark.alias("last_tick_at"),
                             F.when(k % 2 == 0, "Forbid").otherwise("Allow").alias("concurrency_policy"), k.alias("k"))


def one_shots(t: Tables):
    k = F.col("o_orderkey")
    return t.orders.select(k.cast("string").alias("name"), F.lit(None).cast("string").alias("cron"), F.col("o_orderdate").alias("due_at"), F.lit("UTC").alias("time_zone"),
                           F.lit(300).alias("max_lateness_seconds"), F.when(k % 3 == 0, F.expr("o_orderdate + INTERVAL 1 DAY")).when(k % 3 == 1, F.expr("o_orderdate - INTERVAL 1 DAY")).alias("last_tick_at"))


MATCH = """CASE p WHEN 0 THEN minute(l) % 10 = 0 WHEN 1 THEN minute(l) = 30 AND hour(l) = 2
      WHEN 2 THEN minute(l) IN (0, 30) AND hour(l) % 2 = 1 AND dayofweek(l) BETWEEN 1 AND 5
      WHEN 3 THEN minute(l) = 15 AND hour(l) % 6 = 0 AND day(l) IN (1, 10, 20)
      WHEN 4 THEN minute(l) = 0 AND hour(l) = 0 AND (day(l) = 13 OR dayofweek(l) = 5)
      ELSE minute(l) = 45 AND hour(l) = 5 AND month(l) IN (2, 3) END"""


def sweep_sql(now: str, days: int, lateness: str) -> str:
    """All matching minutes of `days` before `now`, per pattern and zone, joined with the schedules."""
    return f"""z AS (SELECT unnest(['UTC', 'America/New_York', 'America/Sao_Paulo', 'Asia/Kolkata']) AS zone, unnest([0, 1, 2, 3]) AS zi),
    g AS (SELECT unnest(generate_series(TIMESTAMP '{now}' - INTERVAL {days} DAY, TIMESTAMP '{now}', INTERVAL 1 MINUTE)) AS inst),
    w AS (SELECT zi, inst, (inst AT TIME ZONE 'UTC') AT TIME ZONE zone AS l FROM g, z),
    m AS (SELECT p, zi, inst FROM (SELECT w.*, p FROM w, (SELECT unnest(range(6)) AS p)) WHERE {MATCH}),
    s AS (SELECT c_name AS name, c_custkey AS k, c_custkey % 6 AS p, (c_custkey // 6) % 4 AS zi, list_extract({lateness}, (c_custkey % 3 + 1)::INT) AS lateness,
      CASE WHEN c_custkey % 9 <> 0 THEN TIMESTAMP '{now}' - to_hours((c_custkey % 700)::INT) END AS mark FROM customer),
    h AS (SELECT *, TIMESTAMP '{now}' - to_seconds(lateness) AS horizon FROM s),
    t AS (SELECT name, k, p, zi, mark, horizon, inst AS tick_at, false AS late FROM h JOIN m USING (p, zi) WHERE inst > greatest(horizon, coalesce(mark, horizon))
      UNION ALL SELECT name, k, p, zi, mark, horizon, min(inst), true FROM h JOIN m USING (p, zi) WHERE inst > mark AND inst < horizon AND mark < horizon GROUP BY ALL),
    d AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tick_at) AS n FROM t)"""


DUE = sweep_sql(NOW, 40, "[300, 3600, 86400]")


def text(df, *cols):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in cols})


@query("sch_due", f"WITH {DUE} SELECT name, strftime(tick_at, '%Y-%m-%d %H:%M:%S') AS tick_at, late, n FROM d")
def due(t: Tables):
    return text(s.due(crons(t), NOW, cap=500), "tick_at")


@query("sch_cron_match", f"SELECT event_id, {MATCH} AS matches FROM (SELECT event_id, event_id % 6 AS p, ts AS l FROM events)")
def cron_match(t):
    df = s.compiled(t.events.withColumn("cron", pick(CRONS, F.col("event_id"))))
    return df.select("event_id", s.cron_matches(F.col("ts"), s.fields()).alias("matches"))


DST = "2026-03-08 12:00:00"


@query("sch_dst", f"""WITH {sweep_sql(DST, 3, "[172800, 172800, 172800]")} SELECT name, strftime(tick_at, '%Y-%m-%d %H:%M:%S') AS tick_at FROM d WHERE NOT late""")
def dst(t):
    return text(s.due(crons(t, (172800, 172800, 172800), DST), DST, cap=1000).where("NOT late").select("name", "tick_at"), "tick_at")


@query("sch_one_shot", """SELECT CAST(o_orderkey AS VARCHAR) AS name, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS tick_at FROM orders WHERE o_orderdate <= TIMESTAMP '1999-01-01' AND o_orderkey % 3 <> 0""")
def one_shot(t):
    return text(s.due(one_shots(t), "1999-01-01 00:00:00", s.TICKS_PER_SWEEP).select("name", "tick_at"), "tick_at")


@query("sch_next_owed", f"""WITH {sweep_sql("2026-05-01 00:00:00", 130, "[300, 3600, 86400]")},
    f AS (SELECT name, p, zi, greatest(TIMESTAMP '{NOW}' - to_seconds(lateness), coalesce(CASE WHEN k % 9 <> 0 THEN TIMESTAMP '{NOW}' - to_hours((k % 700)::INT) END, TIMESTAMP '{NOW}' - to_seconds(lateness))) AS lo FROM s)
    SELECT name, strftime(min(inst), '%Y-%m-%d %H:%M:%S') AS next_at FROM f LEFT JOIN m ON m.p = f.p AND m.zi = f.zi AND inst > lo GROUP BY name""")
def next_owed(t):
    return text(s.next_owed(crons(t), NOW), "next_at")


@query("sch_watermark", f"WITH {DUE} SELECT s.name, strftime(greatest(max(s.mark), max(d.tick_at)), '%Y-%m-%d %H:%M:%S') AS last_tick_at FROM s LEFT JOIN d ON d.name = s.name AND d.n <= 64 GROUP BY 1")
def watermark(t):
    ticks = s.due(crons(t), NOW, s.TICKS_PER_SWEEP).where(F.col("n") <= s.TICKS_PER_SWEEP)
    return text(s.advance(crons(t), ticks).select("name", "last_tick_at"), "last_tick_at")


NS = s.TICK_NAMESPACE.replace("-", "")
TICK_ID = f"""sha1(from_hex('{NS}') || encode(name || chr(10) || strftime(%s, '%%Y-%%m-%%dT%%H:%%M:%%S') || '.000Z'))"""
AS_ID = "d[1:8] || '-' || d[9:12] || '-5' || d[14:16] || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', d[17:17]), 1) || d[18:20] || '-' || d[21:32]"


@query("sch_tick_rows", f"WITH {DUE}, i AS (SELECT name AS schedule, late, n, {TICK_ID % 'tick_at'} AS d FROM d) SELECT schedule, late, {AS_ID} AS id FROM i")
def tick_rows(t):
    rows = stored(s.tick_rows(s.due(crons(t), NOW, cap=500)), "ticks")
    half = rows.where("late")  # written by an earlier sweep; inserting again must add nothing
    return writes.ignore_duplicates(half, rows, ["id"]).select("schedule", "late", "id")


# Before this sweep every third schedule's last tick was written, on time; every fifth of all has an outcome.
HELD = f"""{DUE}, q AS (SELECT *, lag(tick_at) OVER (PARTITION BY name ORDER BY n) AS pt, lag(late) OVER (PARTITION BY name ORDER BY n) AS pl FROM d WHERE n <= 64),
    x AS (SELECT *, k % 2 = 0 AND NOT late AND CASE WHEN pl IS NOT NULL THEN NOT pl ELSE mark IS NOT NULL AND k % 3 = 0 END
      AND NOT (k % 5 = 0) AS waits FROM q),
    j AS (SELECT *, bool_or(waits) OVER (PARTITION BY name ORDER BY n) AS held FROM x)"""


def judged(t: Tables, ticks):
    sched = crons(t)
    written = sched.where("k % 3 = 0 AND last_tick_at IS NOT NULL").select(s.tick_id(F.col("name"), F.col("last_tick_at")).alias("id"), F.lit(False).alias("late"))
    fifth = sched.where("k % 5 = 0")
    done = fifth.where("last_tick_at IS NOT NULL").select(s.tick_id(F.col("name"), F.col("last_tick_at")).alias("id")).unionByName(
        s.tick_rows(ticks.join(fifth.select("name"), "name", "left_semi")).select("id"))
    return s.hold(ticks, sched, written, done, s.TICKS_PER_SWEEP)


@query("sch_forbid_hold", f"WITH {HELD} SELECT name, n, late, held FROM j")
def forbid_hold(t):
    return judged(t, stored(s.due(crons(t), NOW, s.TICKS_PER_SWEEP), "ticks")).select("name", "n", "late", "held")


@query("sch_report", f"""WITH {HELD}, c AS (SELECT name, count(*) FILTER (NOT held AND NOT late) AS emitted, count(*) FILTER (NOT held AND late) AS late, count(*) FILTER (held) AS held FROM j GROUP BY 1),
    b AS (SELECT name, max(n) > 64 AS behind FROM d GROUP BY 1)
    SELECT s.name, coalesce(emitted, 0) AS emitted, coalesce(late, 0) AS late, coalesce(held, 0) AS held, coalesce(behind, false) AS behind, NULL::VARCHAR AS error
    FROM s LEFT JOIN c USING (name) LEFT JOIN b USING (name)""")
def report(t):
    ticks = stored(s.due(crons(t), NOW, s.TICKS_PER_SWEEP), "ticks")
    return s.report(crons(t), ticks, judged(t, ticks), s.TICKS_PER_SWEEP)
