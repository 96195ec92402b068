"""Joins the optimizer does not derive by itself, and the ones that need a stated null or key rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rowtide.functions.rows import micros
from rowtide.plans.groups import HOT_ROWS, running


def has_child(parent: DataFrame, child: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Parents with at least one (already filtered) child."""
    return parent.join(child, _equal(parent, child, on), "left_semi")


def _equal(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[a] == right[b] for a, b in on])


def computed(df: DataFrame, key: str, fields: Mapping[str, Column], exists: Column) -> DataFrame:
    """A relation computed from each row: one object where `exists` holds, else null."""
    return df.withColumn(key, F.when(exists, F.struct(*[c.alias(n) for n, c in fields.items()])))


def asof_left(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_at: str,
    right_at: str,
    left_id: str,
    right_id: str,
    match: str = "match",
    strict: bool = False,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Each left row with the latest right row of its key at or before it (before it when `strict`).

    Both sides are stacked and the last right row is carried forward in time order, so every row is
    shuffled once and no pair of rows is formed. Rows whose key or time is null match nothing and
    are not shuffled.
    """
    whole = F.col(left_at).isNotNull()
    for c in on:
        whole = whole & F.col(c).isNotNull()
    alone, left, right = left.where(~whole), left.where(whole), right.dropna(subset=[*on, right_at])
    keys = [f"__k{i}" for i in range(len(on))]
    empty = F.lit(None).cast(right.schema.simpleString())
    stack = left.select(
        *[F.col(c).alias(k) for c, k in zip(on, keys)],
        F.col(left_at).alias("__at"), F.lit(0 if strict else 1).alias("__side"), F.col(left_id).alias("__id"),
        F.struct(*left.columns).alias("__left"), empty.alias("__right"),
    ).unionByName(
        right.select(
            *[F.col(c).alias(k) for c, k in zip(on, keys)],
            F.col(right_at).alias("__at"), F.lit(1 if strict else 0).alias("__side"), F.col(right_id).alias("__id"),
            F.lit(None).cast(left.schema.simpleString()).alias("__left"), F.struct(*right.columns).alias("__right"),
        )
    )
    filled = running(stack, keys, ["__at", "__side", "__id"], "__last", "last", "__right", hot_rows)
    matched = filled.where(F.col("__left").isNotNull()).select("__left.*", F.col("__last").alias(match))
    return matched.unionByName(alone.withColumn(match, empty))


def either_key(left: DataFrame, right: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """Inner join on `key = first OR key = second` as two equi joins; a pair matching both appears once."""
    by_first = left.join(right, left[key] == right[first])
    by_second = left.join(right, left[key] == right[second]).where(right[first].isNull() | (right[second] != right[first]))
    return by_first.unionAll(by_second)


#: Microseconds that stand for an open start or end, beyond every timestamp.
_OPEN = 1 << 59


def in_interval(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, open_ended: bool = False, step: int = 2) -> DataFrame:
    """Points with every interval [start, end) that holds them, whatever the lengths.

    Time is cut into blocks of 2, 4, 8, ... microseconds (each `step`-th power); an interval goes to the one or two blocks of
    the first size that is at least its length, and a point looks into its own block of every size that occurs, at most
    60 / `step` of them. So an interval has two rows however long it is, a point one row for each class of lengths, and a block
    has at most 2^(`step` + 1) times as many points as its intervals hold. A block with many points is a skewed key of an inner
    join, which adaptive execution splits. A null start or end is no interval, or with `open_ended` one without that bound.
    """
    spans = intervals.withColumns({"__lo": micros(intervals, start), "__hi": micros(intervals, end)})
    if open_ended:
        spans = spans.withColumns({"__lo": F.coalesce("__lo", F.lit(-_OPEN)), "__hi": F.coalesce("__hi", F.lit(_OPEN))})
    spans = spans.where(F.col("__lo") < F.col("__hi"))
    bits = F.length(F.bin(F.col("__hi") - F.col("__lo") - 1))
    spans = spans.withColumn("__level", (F.ceil(bits / F.lit(step)) * step).cast("int"))
    block = lambda x: F.expr(f"shiftright({x}, __level)")
    spread = spans.withColumn("__block", F.explode(F.sequence(block("__lo"), block("__hi - 1"))))

    levels = spans.agg(F.collect_set("__level").alias("levels")).scalar()  # 60 / step numbers at most
    keyed = points.withColumn("__at", micros(points, at)).where("__at IS NOT NULL").withColumn("__levels", levels)
    keyed = keyed.withColumn("__point_level", F.explode("__levels"))
    keyed = keyed.withColumn("__point_block", F.expr("shiftright(__at, __point_level)")).drop("__levels")
    match = (F.col("__point_level") == F.col("__level")) & (F.col("__point_block") == F.col("__block"))
    within = (F.col("__at") >= F.col("__lo")) & (F.col("__at") < F.col("__hi"))
    return keyed.join(spread, match & within).drop("__at", "__point_level", "__point_block", "__lo", "__hi", "__level", "__block")


def overlapping(left: DataFrame, start: str, end: str, right: DataFrame, other_start: str, other_end: str, open_ended: bool = False) -> DataFrame:
    """Pairs of [start, end) intervals that overlap: either the left one begins inside the right, or the right one later inside the left.

    Both cases are joins of points with intervals, so long and open-ended intervals cost no more rows than short ones.
    """
    if both := sorted(set(left.columns) & set(right.columns)):
        raise ValueError(f"both sides have {both}; rename them")
    whole = lambda df, a, b: df.where(F.col(a) < F.col(b)) if not open_ended else df.where(F.coalesce(F.col(a) < F.col(b), F.lit(True)))
    left, right = whole(left, start, end), whole(right, other_start, other_end)

    def begins(df: DataFrame, column: str) -> DataFrame:  # an open start lies before every other start
        kind = df.schema[column].dataType.simpleString()
        first = F.lit("0001-01-01 00:00:00").cast(kind)
        return df.withColumn("__begin", F.coalesce(F.col(column), first)) if open_ended else df.withColumn("__begin", F.col(column))

    columns = [*left.columns, *right.columns]
    first = in_interval(begins(left, start), "__begin", right, other_start, other_end, open_ended).select(*columns)
    second = in_interval(begins(right, other_start), "__begin", left, start, end, open_ended)
    later = F.col(start).isNull() & F.col(other_start).isNotNull() | (F.col(other_start) > F.col(start))
    return first.unionByName(second.where(later).select(*columns))


def newer_than_latest(df: DataFrame, at: str, days: int) -> DataFrame:
    """Rows within `days` of the table's latest row; the boundary is a scalar subquery."""
    latest = df.agg((F.max(at) - F.make_dt_interval(F.lit(days))).alias("from")).scalar()
    return df.where(F.col(at) > latest)


def each_panel(df: DataFrame, panels: Sequence[str], name: str = "panel") -> DataFrame:
    """Every row once per declared panel; the panels are a fixed list, so no join is needed."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(p) for p in panels])))


def unnest_aligned(df: DataFrame, arrays: Mapping[str, Column], position: str = "pos") -> DataFrame:
    """One row per position of several aligned arrays, with that position."""
    kept = df.columns
    named = df.withColumns({f"__a_{n}": c for n, c in arrays.items()})
    zipped = F.arrays_zip(*[F.col(f"__a_{n}") for n in arrays])
    out = named.select(*kept, F.posexplode(zipped).alias(position, "__item"))
    return out.select(*kept, position, *[F.col(f"__item.__a_{n}").alias(n) for n in arrays])


def optional_fact(df: DataFrame, facts: DataFrame, on: Sequence[tuple[str, str]], theta: Column) -> DataFrame:
    """Left join on keys plus a range predicate; rows without a fact keep nulls."""
    return df.join(facts, _equal(df, facts, on) & theta, "left")


def missing(child: DataFrame, parent: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Child rows whose key is set and not present in the parent."""
    keyed = child.dropna(subset=[c for c, _ in on])
    return keyed.join(parent, _equal(keyed, parent, on), "left_anti")


def scope_from_parent(child: DataFrame, parent: DataFrame, on: Sequence[tuple[str, str]], scope: str = "scope_id", derived: bool = False) -> DataFrame:
    """Children take their parent's scope, whatever they carried. Without a parent or a scope there a row
    is dropped when `derived`, else marked a `violation`."""
    cols = [f"__p{i}" for i in range(len(on))]
    scopes = parent.select(*[F.col(p).alias(n) for n, (_, p) in zip(cols, on)], F.col(scope).alias("__scope"))
    match = reduce(lambda a, b: a & b, [child[c] == F.col(n) for n, (c, _) in zip(cols, on)])
    if derived:
        joined = child.join(scopes.dropna(subset=["__scope"]), match)
    else:
        joined = child.join(scopes, match, "left").withColumn("violation", F.col("__scope").isNull())
    return joined.withColumn(scope, F.col("__scope")).drop(*cols, "__scope")


def null_safe(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Join where two nulls are the same key."""
    return left.join(right, reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in on]), how)
