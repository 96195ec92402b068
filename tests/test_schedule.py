import datetime as dt
import zoneinfo

import pytest
from pyspark.sql import functions as F

from rowtide.operators import schedule as s

SCHEMA = "name string, cron string, due_at timestamp_ntz, time_zone string, max_lateness_seconds int, last_tick_at timestamp_ntz"


def at(text):
    return dt.datetime.fromisoformat(text) if text else None


def table(spark, cron, mark=None, zone="UTC", lateness=300, due_at=None):
    return spark.createDataFrame([("n", cron, at(due_at), zone, lateness, at(mark))], SCHEMA)


def owed(spark, now, *args, **kw):
    return [(r["tick_at"].isoformat(), r["late"]) for r in s.due(table(spark, *args, **kw), now, 500).orderBy("n").collect()]


def values(field, first, last):
    out = set()
    for term in field.split(","):
        span, _, step = term.partition("/")
        lo, hi = (first, last) if span == "*" else (int(span.split("-")[0]), int(span.split("-")[-1]))
        out |= set(range(lo, hi + 1, int(step or 1)))
    return out


def walked(cron, zone, after, until):
    """Every instant after one and up to another that an expression names: each minute is asked for its wall time."""
    minute, hour, day, month, weekday = cron.split()
    own = values(minute, 0, 59), values(hour, 0, 23), values(day, 1, 31), values(month, 1, 12), {x % 7 for x in values(weekday, 0, 7)}
    out, t = [], after.replace(second=0) + dt.timedelta(minutes=after.second == 0 or 1)
    while t <= until:
        local = t.replace(tzinfo=dt.timezone.utc).astimezone(zoneinfo.ZoneInfo(zone))
        dom, dow = local.day in own[2], local.isoweekday() % 7 in own[4]
        right = (dow if day == "*" else dom) if "*" in (day, weekday) else dom or dow
        # a pinned hour that comes twice is meant once, at first
        if local.minute in own[0] and local.hour in own[1] and local.month in own[3] and right and (hour[0] == "*" or not local.fold):
            out.append(t)
        t += dt.timedelta(minutes=1)
    return out


#: (expression, zone, watermark, seconds of lateness, now): forward and backward shifts of zones on four continents and quiet days.
CASES = [
    ("*/7 * * * *", "UTC", "2031-05-14T08:03:00", 5400, "2031-05-14T09:00:00"),
    ("15 1 * * *", "Europe/Lisbon", "2027-03-27T12:00:00", 172800, "2027-03-28T23:00:00"),
    ("15 1,5 * * *", "Europe/Lisbon", "2027-03-28T00:10:00", 86400, "2027-03-28T20:00:00"),
    ("*/20 1 * * *", "Europe/Lisbon", "2027-03-28T00:00:00", 86400, "2027-03-28T09:00:00"),
    ("40 * * * *", "Europe/Lisbon", "2027-03-27T23:00:00", 86400, "2027-03-28T04:00:00"),
    ("45 1 * * *", "Europe/Lisbon", "2027-10-30T20:00:00", 86400, "2027-10-31T12:00:00"),
    ("45 * * * *", "Europe/Lisbon", "2027-10-30T22:00:00", 86400, "2027-10-31T03:30:00"),
    ("10 23 * * *", "America/Santiago", "2026-09-04T00:00:00", 3 * 86400, "2026-09-06T12:00:00"),
    ("20 0 * * *", "America/Santiago", "2026-09-05T00:00:00", 2 * 86400, "2026-09-06T20:00:00"),
    ("0 */3 * * *", "Africa/Casablanca", "2027-02-06T00:00:00", 2 * 86400, "2027-02-08T00:00:00"),
    ("0 * * * *", "Antarctica/Troll", "2025-10-25T23:30:00", 86400, "2025-10-26T05:30:00"),
    ("45 * * * *", "Australia/Lord_Howe", "2026-04-04T13:00:00", 86400, "2026-04-04T16:10:00"),
    ("30 2 * * *", "Australia/Lord_Howe", "2026-10-02T00:00:00", 3 * 86400, "2026-10-04T20:00:00"),
    ("5 6 31 * *", "Asia/Kathmandu", "2029-01-31T05:00:00", 70 * 86400, "2029-04-01T00:00:00"),
    ("0 12 */9 * 3", "Pacific/Chatham", "2028-02-20T00:00:00", 20 * 86400, "2028-03-08T00:00:00"),
    ("*/25 4-6 * 2 *", "Asia/Tehran", None, 4 * 3600, "2030-02-11T03:00:00"),
]


@pytest.mark.parametrize("cron, zone, mark, lateness, now", CASES)
def test_due_is_what_the_clock_says(spark, cron, zone, mark, lateness, now):
    horizon = at(now) - dt.timedelta(seconds=lateness)
    want = walked(cron, zone, max(horizon, at(mark) or horizon), at(now))
    assert [t for t, _ in owed(spark, now, cron, mark, zone=zone, lateness=lateness)] == [t.isoformat() for t in want]


def test_a_lost_span_is_one_late_tick(spark):
    assert owed(spark, "2033-11-09 17:26:00", "*/15 * * * *", "2033-11-08T04:20:00", lateness=1200) == [("2033-11-08T04:30:00", True), ("2033-11-09T17:15:00", False)]
    # nothing was owed where the first wall time after the watermark was skipped
    assert owed(spark, "2027-03-29 12:00:00", "15 1 * * *", "2027-03-28T00:30:00", zone="Europe/Lisbon", lateness=60) == []


def test_one_shot(spark):
    now = "2034-07-19 06:45:00"
    assert owed(spark, now, None, None, due_at="2034-07-18T22:15:00") == [("2034-07-18T22:15:00", False)]
    assert owed(spark, now, None, "2034-07-18T22:15:00", due_at="2034-07-18T22:15:00") == []
    assert owed(spark, now, None, None, due_at="2034-07-19T06:46:00") == []


def test_bad_expressions_are_reported(spark):
    bad = ["50-10 * * * *", "5/10 * * * *", "* * * *", "*/0 * * * *", "a * * * *", "61 * * * *"]
    df = spark.createDataFrame([(b, b, None, "UTC", 300, None) for b in [*bad, "1-5/2,9 0 * JAN sun"]], SCHEMA)
    got = {r["name"]: r["cron_error"] for r in s.compiled(df).collect()}
    assert {k for k, e in got.items() if e} == set(bad)
    row = s.compiled(df).where("cron_error IS NULL").first()
    assert (row["cron_minute"], row["cron_month"], row["cron_weekday"]) == ([1, 3, 5, 9], [1], [0])
    ticks = s.due(df, "2034-07-19 06:45:00", 64)
    rep = {r["name"]: r for r in s.report(df.withColumn("concurrency_policy", F.lit("Allow")), ticks, ticks.withColumn("held", F.lit(False)), 64).collect()}
    assert rep["5/10 * * * *"]["error"] and rep["5/10 * * * *"]["emitted"] == 0


def test_next(spark):
    nxt = lambda *a, **k: s.next_owed(table(spark, *a, **k), "2027-03-28 00:00:00").first()["next_at"]
    assert nxt("15 1 * * *", "2027-03-28T00:00:00", zone="Europe/Lisbon") == at("2027-03-29T00:15:00")
    assert nxt("0 0 29 2 *") == at("2028-02-29T00:00:00") and nxt("0 0 30 2 *") is None


def test_tick_id_is_fixed(spark):
    import uuid

    want = str(uuid.uuid5(uuid.UUID(s.TICK_NAMESPACE), "harbour-tide\n2034-07-19T06:45:00.000Z"))
    assert spark.sql("SELECT TIMESTAMP_NTZ'2034-07-19 06:45:00' AS t").select(s.tick_id(F.lit("harbour-tide"), F.col("t"))).first()[0] == want


def test_cap_and_watermark(spark):
    df = table(spark, "* * * * *", "2034-07-18T19:00:00", lateness=86400).withColumn("concurrency_policy", F.lit("Allow"))
    ticks = s.due(df, "2034-07-19 06:45:00", 64)
    assert ticks.count() == 65
    taken = ticks.where("n <= 64")
    assert s.advance(df, taken).first()["last_tick_at"] == at("2034-07-18T20:04:00")
    assert s.advance(df, taken.where("false")).first()["last_tick_at"] == at("2034-07-18T19:00:00")
    assert s.report(df, ticks, taken.withColumn("held", F.lit(False)), 64).first()["behind"] is True
