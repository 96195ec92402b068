"""Tables of schedules and the ticks they owe; nothing here waits or runs anything.

A schedule is (name, cron | due_at, time_zone, max_lateness_seconds, last_tick_at); instants are
zone-free timestamps in UTC. The instants of each distinct (expression, zone) are rows, made once and
joined with the schedules by date, however many schedules share them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowtide.functions.ids import uuid5
from rowtide.session import stored

# The namespace of tick ids, the ticks one sweep resolves per schedule.
TICK_NAMESPACE = "ae72b8e0-46f3-4bba-907c-646629b08839"
TICKS_PER_SWEEP = 64
LONGEST_WAIT_DAYS = 3000  # any date of the calendar comes again within eight years
PAIR = ("cron", "time_zone")
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
WEEKDAYS = ("SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT")
BOUNDS = {"minute": (0, 59), "hour": (0, 23), "day": (1, 31), "month": (1, 12), "weekday": (0, 7)}

TERM = r"^(?:(\*)|(\d{1,2})(?:-(\d{1,2}))?)(?:/(\d{1,3}))?$"


def _values(field: Column, first: int, last: int) -> Column:
    """The sorted values a field names; null when a term wraps, steps from a single value, or is malformed."""

    def term(text: Column) -> Column:
        part = lambda i: F.nullif(F.regexp_extract(text, TERM, i), F.lit("")).cast("int")
        star = F.regexp_extract(text, TERM, 1) == "*"
        lo = F.when(star, first).otherwise(part(2))
        hi = F.when(star, last).otherwise(F.coalesce(part(3), part(2)))
        single = ~star & part(3).isNull()
        ok = text.rlike(TERM) & (lo <= hi) & (F.coalesce(part(4), F.lit(1)) >= 1) & ~(single & part(4).isNotNull())
        inside = (lo >= first) & (hi <= last)
        return F.when(ok & inside, F.sequence(lo, hi, F.coalesce(part(4), F.lit(1))))

    lists = F.transform(F.split(field, ","), term)
    return F.when(F.forall(lists, lambda x: x.isNotNull()), F.array_sort(F.array_distinct(F.flatten(lists))))


def _named(text: Column, names: tuple[str, ...], base: int) -> Column:
    out = F.upper(text)
    for i, name in enumerate(names):
        out = F.replace(out, F.lit(name), F.lit(str(i + base)))
    return out


def rules(df: DataFrame, cron: str = "cron") -> DataFrame:
    """Each distinct expression of `df`, parsed once: (__cron, cron_minute, …, cron_error)."""
    return _parsed(df.select(F.col(cron).alias("__cron")).dropna().distinct(), "__cron")


def compiled(df: DataFrame, cron: str = "cron", parsed: DataFrame | None = None) -> DataFrame:
    """Add the value lists of each row's five-field expression (`cron_minute`, …) and `cron_error`, by its text."""
    parsed = rules(df, cron) if parsed is None else parsed
    return df.join(parsed, df[cron] == parsed["__cron"], "left").drop("__cron")


def _parsed(df: DataFrame, cron: str) -> DataFrame:
    parts = F.split(F.trim(cron), r"\s+")
    text = {n: F.get(parts, F.lit(i)) for i, n in enumerate(BOUNDS)}
    text["month"], text["weekday"] = _named(text["month"], MONTHS, 1), _named(text["weekday"], WEEKDAYS, 0)
    lists = {f"cron_{n}": F.when(F.size(parts) == 5, _values(text[n], *BOUNDS[n])) for n in BOUNDS}
    stars = {f"cron_any_{n}": text[n] == "*" for n in ("day", "weekday")}
    # wild: the hour follows the clock, so a repeated hour fires twice
    out = df.withColumns({**lists, **stars, "cron_wild": text["hour"].startswith("*")})
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in lists])
    return out.withColumn("cron_error", F.when(bad, F.concat(F.lit("bad cron: "), F.col(cron))))


def fields() -> dict[str, Column]:
    """The compiled columns by name."""
    return {n: F.col(f"cron_{n}") for n in [*BOUNDS, "any_day", "any_weekday", "wild"]}


def _day_matches(day: Column, f: dict[str, Column]) -> Column:
    """Month, and day of month or weekday: when both are restricted either one is enough."""
    dom = F.array_contains(f["day"], F.dayofmonth(day))
    number = F.dayofweek(day) - 1
    dow = F.array_contains(f["weekday"], number) | ((number == 0) & F.array_contains(f["weekday"], F.lit(7)))
    either = F.when(f["any_day"], dow).when(f["any_weekday"], dom).otherwise(dom | dow)
    return F.array_contains(f["month"], F.month(day)) & either


def cron_matches(local: Column, fields: dict[str, Column]) -> Column:
    """Whether a local wall time is one the expression names."""
    clock = F.array_contains(fields["minute"], F.minute(local)) & F.array_contains(fields["hour"], F.hour(local))
    return clock & _day_matches(F.to_date(local), fields)


def _utc(local: Column, zone: Column) -> Column:
    return F.convert_timezone(zone, F.lit("UTC"), local)


def _local(utc: Column, zone: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), zone, utc)


def _instants(days: DataFrame, parsed: DataFrame) -> DataFrame:
    """(cron, time_zone, day, utc, real): every instant the expressions name on the local dates of `days`.

    A wall time the zone skips comes back shifted by the gap and is `real` only if the expression names the
    shifted time too. A repeated one is its earlier instant; where the hour is not pinned the later one, by the
    offset that holds a day on, is an instant as well.
    """
    zone, f = F.col("time_zone"), fields()
    df = compiled(days, parsed=parsed).withColumn("__hour", F.explode("cron_hour")).withColumn("__minute", F.explode("cron_minute"))
    df = df.withColumn("__local", F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("__hour"), F.col("__minute")))
    df = df.withColumn("__utc", _utc(F.col("__local"), zone)).withColumn("__next", F.col("__utc") + F.make_dt_interval(F.lit(1)))
    df = df.withColumn("__back", _local(F.col("__utc"), zone))
    df = df.withColumn("__later", F.col("__local") - (_local(F.col("__next"), zone) - F.col("__next")))
    real = F.array_contains(f["hour"], F.hour("__back")) & F.array_contains(f["minute"], F.minute("__back"))
    again = f["wild"] & (F.col("__later") > F.col("__utc")) & (_local(F.col("__later"), zone) == F.col("__local"))
    first, second = F.struct(F.col("__utc").alias("utc"), real.alias("real")), F.struct(F.col("__later").alias("utc"), F.lit(True).alias("real"))
    return df.select(*PAIR, "day", F.inline(F.when(again, F.array(first, second)).otherwise(F.array(first)))).distinct()


def _matching_days(points: DataFrame, parsed: DataFrame, last: Column, take: int) -> DataFrame:
    """(cron, time_zone, from, day): the first `take` matching dates of each (cron, time_zone, from) point.

    Each pair's calendar is walked once, from its first point up to `last`, which may use the compiled columns and
    the last point `__hi`. A window holds one pair's dates, which no number of schedules makes longer.
    """
    pairs = compiled(points.groupBy(*PAIR).agg(F.min("from").alias("__lo"), F.max("from").alias("__hi")), parsed=parsed).where("cron_error IS NULL")
    days = pairs.withColumn("day", F.explode(F.sequence("__lo", F.greatest(last, "__lo")))).where(_day_matches(F.col("day"), fields()))
    w = Window.partitionBy(*PAIR).orderBy("day")
    listed = days.select(*PAIR, "day", F.coalesce(F.date_add(F.lag("day").over(w), 1), "__lo").alias("__since"),
                         F.array_compact(F.array(*[F.lead("day", i).over(w) for i in range(take)])).alias("__days"))
    reach = listed.select(*PAIR, "__days", F.explode(F.sequence("__since", "day")).alias("from"))
    return points.join(reach, [*PAIR, "from"]).select(*PAIR, "from", F.explode("__days").alias("day"))


def _first_after(df: DataFrame, parsed: DataFrame, at: str, last: Column, take: int, real: bool) -> DataFrame:
    """(name, first): the first instant behind `at` of each row, as struct (utc, real), among `take` matching dates.

    An instant is joined only where the one before it on its date is not behind `at`, so a row meets one per date.
    """
    df = df.select("name", *PAIR, at, F.to_date(_local(F.col(at), F.col("time_zone"))).alias("from"))
    near = _matching_days(df.select(*PAIR, "from").dropna().distinct(), parsed, last, take)
    instants = _instants(near.select(*PAIR, "day").distinct(), parsed)
    instants = instants.where("real") if real else instants
    before = F.lag("utc").over(Window.partitionBy(*PAIR, "day").orderBy("utc"))
    met = df.join(near, [*PAIR, "from"]).join(instants.withColumn("__before", before), [*PAIR, "day"])
    met = met.where((F.col("utc") > F.col(at)) & (F.col("__before").isNull() | (F.col("__before") <= F.col(at))))
    return met.groupBy("name").agg(F.min(F.struct("utc", "real")).alias("first"))


def _horizon(schedules: DataFrame, at: Column) -> DataFrame:
    """The columns a sweep needs, with the lateness horizon and `__start`: the later of horizon and watermark."""
    horizon = at - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("max_lateness_seconds").cast("decimal(18,6)"))
    df = schedules.select("name", *PAIR, "due_at", "last_tick_at", horizon.alias("__horizon"))
    return df.withColumn("__start", F.greatest("__horizon", "last_tick_at"))


def due(schedules: DataFrame, now: str, cap: int) -> DataFrame:
    """(name, tick_at, late, n) of the ticks owed at `now`, `n` counting from 1, oldest first.

    From the lateness horizon on every tick is owed, up to `cap` + 1 so that a caller can tell there
    are more. Of an older span only the first missed tick is given, marked late; a schedule without a
    watermark starts at the horizon. Schedules whose expression is malformed owe nothing here.

    Instants are made once per (expression, zone) and joined with the schedules by date; the parsed expressions,
    a row each, are written first.
    """
    at = F.lit(now).cast("timestamp_ntz")
    df, parsed = _horizon(schedules, at), stored(rules(schedules), "rules")
    by_cron = df.where("cron IS NOT NULL")
    old = _first_after(by_cron.where("last_tick_at < __horizon"), parsed, "last_tick_at", F.date_add(F.to_date(at), 1), 3, real=False)
    lost = old.select("name", F.when(F.col("first.real"), F.col("first.utc")).alias("__lost"))
    by_cron = by_cron.join(lost, "name", "left").withColumn("__lost", F.when(F.col("__lost") < F.col("__horizon"), F.col("__lost")))

    # local dates lie within a day of UTC dates
    first_day, last_day = F.date_sub(F.to_date(F.min("__start")), 1), F.date_add(F.to_date(at), 1)
    spans = compiled(by_cron.groupBy(*PAIR).agg(first_day.alias("__lo")), parsed=parsed).where("cron_error IS NULL")
    days = spans.withColumn("day", F.explode(F.sequence("__lo", F.greatest(last_day, "__lo")))).where(_day_matches(F.col("day"), fields()))
    instants = _instants(days.select(*PAIR, "day"), parsed).where(F.col("real") & (F.col("utc") <= at))
    instants = instants.select(*PAIR, "utc", F.to_date("utc").alias("date")).distinct()
    dated = by_cron.where(F.col("__start") < at).withColumn("date", F.explode(F.sequence(F.to_date("__start"), F.to_date(at))))
    met = dated.join(instants, [*PAIR, "date"]).where(F.col("utc") > F.col("__start"))
    counted = met.withColumn("__n", F.row_number().over(Window.partitionBy("name").orderBy("utc"))).where(F.col("__n") <= cap + 1)
    on_time = counted.select("name", F.col("utc").alias("tick_at"), F.lit(False).alias("late"), (F.col("__n") + F.col("__lost").isNotNull().cast("int")).alias("n"))
    late = by_cron.where("__lost IS NOT NULL").select("name", F.col("__lost").alias("tick_at"), F.lit(True).alias("late"), F.lit(1).alias("n"))
    mark = F.col("last_tick_at")
    once = df.where(F.col("cron").isNull() & (F.col("due_at") <= at) & (mark.isNull() | (mark < F.col("due_at"))))
    return on_time.unionByName(late).unionByName(once.select("name", F.col("due_at").alias("tick_at"), F.lit(False).alias("late"), F.lit(1).alias("n")))


def next_owed(schedules: DataFrame, now: str) -> DataFrame:
    """(name, next_at): the next instant each schedule owes a runnable tick; null when it owes none."""
    df, parsed = _horizon(schedules, F.lit(now).cast("timestamp_ntz")), stored(rules(schedules), "rules")
    f, mark = fields(), F.col("last_tick_at")
    # four matching dates: a week apart at most, or two months (the 31st), or the eight years between two 29ths of February
    all_year = F.size(f["month"]) == 12
    ahead = F.when(all_year & (f["any_day"] | ~f["any_weekday"]), 28).when(all_year, 4 * 62).otherwise(LONGEST_WAIT_DAYS)
    found = _first_after(df.where("cron IS NOT NULL"), parsed, "__start", F.date_add(F.col("__hi"), ahead.cast("int")), 4, real=True)
    single = F.when(mark.isNull() | (mark < F.col("due_at")), F.col("due_at"))
    return df.join(found, "name", "left").select("name", F.when(F.col("cron").isNull(), single).otherwise(F.col("first.utc")).alias("next_at"))


def iso(c: Column) -> Column:
    """An instant as `yyyy-MM-ddTHH:mm:ss.fffZ`."""
    text = c.cast("string")
    return F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.lit("."), F.rpad(F.substring(text, 21, 3), 3, "0"), F.lit("Z"))


def tick_id(name: Column, at: Column) -> Column:
    """The key of a tick, the same wherever it is computed."""
    return uuid5(TICK_NAMESPACE, F.concat(name, F.lit("\n"), iso(at)))


def tick_rows(ticks: DataFrame, caller: str | None = None) -> DataFrame:
    """Ticks as rows to insert where their key is new."""
    return ticks.select(tick_id(F.col("name"), F.col("tick_at")).alias("id"), F.col("name").alias("schedule"), "tick_at", "late",
                        F.lit(caller).cast("string").alias("caller"))


def advance(schedules: DataFrame, resolved: DataFrame) -> DataFrame:
    """Watermarks moved to each schedule's last resolved tick; never backwards."""
    last = resolved.groupBy("name").agg(F.max("tick_at").alias("__last"))
    joined = schedules.join(last, "name", "left")
    return joined.withColumn("last_tick_at", F.greatest("last_tick_at", "__last")).drop("__last")


def hold(ticks: DataFrame, schedules: DataFrame, written: DataFrame, done: DataFrame, cap: int) -> DataFrame:
    """`held` per owed tick: under `Forbid` a tick and all later ones wait until the one before has an outcome.

    `written` is (id, late) of ticks written before, `done` the ids with an outcome. A late tick asked
    for no work, so nothing waits on it and it does not wait. One schedule has at most `cap` ticks.
    """
    forbids = schedules.select("name", "last_tick_at", (F.col("concurrency_policy") == "Forbid").alias("__forbid"))
    w = Window.partitionBy("name").orderBy("n")
    df = ticks.where(F.col("n") <= cap).join(forbids, "name")
    df = df.withColumns({"__prev": F.lag("tick_at").over(w), "__prev_late": F.lag("late").over(w)})
    prior = tick_id(F.col("name"), F.coalesce("__prev", "last_tick_at"))
    df = df.withColumn("__prior", prior)
    old = written.select(F.col("id").alias("__prior"), F.col("late").alias("__old_late"))
    ended = done.select(F.col("id").alias("__prior")).distinct().withColumn("__done", F.lit(True))
    df = df.join(old, "__prior", "left").join(ended, "__prior", "left")
    asked = F.coalesce(~F.coalesce(F.col("__prev_late"), F.col("__old_late")), F.lit(False))
    waits = F.col("__forbid") & ~F.col("late") & asked & F.col("__done").isNull()
    held = F.max(waits).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.select("name", "tick_at", "late", "n", held.alias("held"))


def report(schedules: DataFrame, ticks: DataFrame, judged: DataFrame, cap: int) -> DataFrame:
    """(name, emitted, late, held, behind, error) of one sweep."""
    counted = judged.groupBy("name").agg(
        F.count_if(~F.col("held") & ~F.col("late")).alias("emitted"),
        F.count_if(~F.col("held") & F.col("late")).alias("late"),
        F.count_if("held").alias("held"),
    )
    more = ticks.groupBy("name").agg((F.max("n") > cap).alias("behind"))
    every = compiled(schedules).select("name", F.col("cron_error").alias("error"))
    joined = every.join(counted, "name", "left").join(more, "name", "left")
    return joined.select("name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("emitted", "late", "held")],
                         F.coalesce("behind", F.lit(False)).alias("behind"), "error")
