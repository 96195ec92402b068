"""Delivery of change records: write-back, routing, dead letters, redrive, lag, retention, invalidation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rowtide.plans.groups import number_rows, running

# Deliveries before a record is set aside, the backlog a reader may have.
MAX_DELIVERIES = 5
GROUP_BUDGET = 100_000


def enriched(rows: DataFrame, now: Column, source: str, key: str = "id") -> DataFrame:
    """Rows to write back: keyed and not processed yet. Rows that come back processed are dropped, which ends the loop."""
    todo = rows.where(F.col(key).isNotNull() & F.col("processed_at").isNull())
    return todo.withColumns({"processed_at": now, "source": F.lit(source)})


def route_by_table(records: DataFrame, routes: Mapping[str, Callable[[DataFrame], DataFrame]], table: str = "table") -> dict[str, DataFrame]:
    """One pipeline per table; records of other tables are ignored."""
    return {name: run(records.where(F.col(table) == name)) for name, run in routes.items()}


def dead_letters(failed: DataFrame, group: Column, deliveries: Column, refused: Column, limit: int = MAX_DELIVERIES) -> DataFrame:
    """Where each failed record goes, unchanged: `<group>-dead` past the limit or when refused by policy, else `<group>-retry`."""
    dead = (deliveries > limit) | F.coalesce(refused, F.lit(False))
    return failed.withColumn("stream", F.concat(group, F.when(dead, "-dead").otherwise("-retry")))


def redrive(streams: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(streams with every dead letter moved back to retry, report of (grp, redriven, pending, lag)).

    `groups` is (grp, pending, lag); a group without dead letters reports 0.
    """
    dead = F.col("stream").endswith("-dead")
    base = F.regexp_replace("stream", "-dead$", "")
    moved = streams.withColumn("stream", F.when(dead, F.concat(base, F.lit("-retry"))).otherwise(F.col("stream")))
    counted = streams.where(dead).groupBy(base.alias("grp")).agg(F.count(F.lit(1)).alias("redriven"))
    report = groups.join(counted, "grp", "left").select("grp", F.coalesce("redriven", F.lit(0)).alias("redriven"), "pending", "lag")
    return moved, report


def entries_after(log: DataFrame, position: str, points: DataFrame, at: str, span: int = 1 << 16) -> DataFrame:
    """`points` with `after`: how many log entries lie behind each point's `at`.

    The log is counted per range of `span` positions, which combines before the shuffle. Only ranges that a point lies in are
    looked into: their entries and the distinct points are put in one order and numbered. So the work is one pass over the log,
    and no entry meets more than one row for a point. A null `at` has all entries behind it.
    """
    entries = log.select(F.col(position).cast("bigint").alias("__p")).where("__p IS NOT NULL")
    block = F.floor(F.col("__p") / F.lit(span)).alias("__b")
    asked = points.select(F.col(at).cast("bigint").alias("__p")).where("__p IS NOT NULL").distinct().withColumn("__b", block)
    counted = entries.groupBy(block).agg(F.count(F.lit(1)).alias("__n"))
    held = asked.select("__b").distinct()
    # entries up to the end of each range, ranges without entries included
    ranges = counted.unionByName(held.withColumn("__n", F.lit(0).cast("bigint"))).groupBy("__b").agg(F.sum("__n").alias("__n"))
    upto = running(ranges, [], ["__b"], "__upto", "sum", "__n")
    inside = entries.withColumn("__b", block).join(held, "__b", "left_semi").withColumn("__w", F.lit(1))
    order = inside.groupBy("__b", "__p").agg(F.sum("__w").alias("__w")).unionByName(asked.withColumn("__w", F.lit(0).cast("bigint")))
    ranked = running(order.groupBy("__b", "__p").agg(F.sum("__w").alias("__w"), F.bool_or(F.col("__w") == 0).alias("__asked")), ["__b"], ["__p"], "__seen", "sum", "__w")
    total = counted.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n")).scalar()
    found = ranked.where("__asked").join(upto, "__b").select("__p", (total - F.col("__upto") + F.col("__n") - F.col("__seen")).cast("bigint").alias("after"))
    return points.join(found, F.col(at) == F.col("__p"), "left").drop("__p").withColumn("after", F.coalesce("after", total).cast("bigint"))


def consumer_lag(log: DataFrame, position: str, groups: DataFrame | Sequence[tuple[str, int, int, bool]], budget: int = GROUP_BUDGET) -> DataFrame:
    """(grp, lag, pending, state) of declared readers, a table or a list of (grp, position: last read, pending, retired: was retired).

    `lag` counts log entries after the position. Past the budget a reader is `retired`; a retired one that is back is moved
    `to-tail` (lag 0) when still past it. Readers are rows: the plan is the same for three and for a hundred thousand.
    """
    if not isinstance(groups, DataFrame):
        groups = log.sparkSession.createDataFrame(list(groups), "grp string, position bigint, pending bigint, retired boolean")
    readers = groups.select("grp", F.col("position").alias("__at"), F.col("pending").cast("bigint").alias("pending"), F.col("retired").alias("__was"))
    flat = entries_after(log, position, readers, "__at")
    over = F.col("after") + F.col("pending") > budget
    flat = flat.withColumn("state", F.when(over & F.col("__was"), "to-tail").when(over, "retired").otherwise("reading"))
    cleared = F.col("state") == "to-tail"
    return flat.select("grp", F.when(cleared, 0).otherwise(F.col("after")).alias("lag"), F.when(cleared, 0).otherwise(F.col("pending")).alias("pending"), "state")


def retained(log: DataFrame, position: str, acked: DataFrame, declared: Sequence[str], keep: int) -> DataFrame:
    """Entries some reader has not acknowledged, and in any case the newest `keep`.

    `acked` is (grp, position). Nothing is trimmed until every declared reader is in it.
    """
    known = acked.where(F.col("grp").isin(list(declared))).select("grp").distinct().count()
    if known < len(set(declared)):
        return log
    low = acked.agg(F.min("position").alias("low")).scalar()
    newest = log.select(position).orderBy(F.desc(position)).limit(keep).agg(F.min(position).alias("from")).scalar()
    return log.where((F.col(position) > low) | (F.col(position) >= newest))


def invalidations(changes: DataFrame, at: str, order: Sequence[str], table: str, trace: str, period: str = "1 second", count: int = 10_000) -> DataFrame:
    """One call per period and `count` records: the changed tables (null = everything) and the first non-empty trace."""
    timed = changes.withColumn("period", F.window(F.col(at), period)["start"])
    numbered = number_rows(timed, ["period"], order, "__rn")
    part = F.floor((F.col("__rn") - 1) / count).cast("int")
    first = F.min_by(F.nullif(trace, F.lit("")), F.when(F.col(trace) != "", F.col("__rn")))
    out = numbered.groupBy("period", part.alias("part")).agg(
        F.array_sort(F.collect_set(table)).alias("tables"),
        F.bool_or(F.col(table).isNull()).alias("all"),
        F.coalesce(first, F.lit("")).alias("trace"),
    )
    return out.select("period", "part", F.when(~F.col("all"), F.col("tables")).alias("tables"), "trace")
