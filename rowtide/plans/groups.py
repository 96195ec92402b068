"""Ordered work inside groups that stays spread out when one group holds much of the data.

A plain window sends every row of a group to one task. These helpers count the groups first, combined before the shuffle, as a
part of the same plan: nothing runs before the caller's action, and where the count finds no hot group, adaptive execution
drops the branch for them. Groups of up to `hot_rows` rows take the plain window. A larger one is cut into slices of the
order at splitters drawn from its own rows by their hash, about `hot_rows` / 4 rows apart, so that a row has its slice
whenever and wherever it is calculated; each slice is scanned on its own and a per-slice carry, one row per (hot
group, slice), joins the slices together. The result equals the plain window's, row for row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, FloatType

# Rows of one group that a single task may order; the window operator spills well past this.
HOT_ROWS = 2_000_000
_SLICES = 256  # of a hot group at most, about
_SLICE, _CARRY, _HITS, _CUTS = "__slice", "__carry", "__rows", "__splitters"


def hot_groups(df: DataFrame, keys: Sequence[str], hot_rows: int | None = HOT_ROWS) -> DataFrame | None:
    """(keys, __rows) of the groups above `hot_rows`, at most count(df) / hot_rows rows, not yet calculated; None without a number."""
    if hot_rows is None:
        return None
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(_HITS)).where(F.col(_HITS) > hot_rows)


def _marked(df: DataFrame, keys: Sequence[str], marks: DataFrame, how: str) -> DataFrame:
    """Join a small table of groups to their rows; null keys are groups too."""
    named = F.broadcast(marks.select(*[F.col(k).alias(f"__h_{k}") for k in keys], *[c for c in marks.columns if c not in keys]))
    same = _all([F.col(k).eqNullSafe(F.col(f"__h_{k}")) for k in keys]) if keys else F.lit(True)
    return df.join(named, same, how).drop(*[f"__h_{k}" for k in keys])


def split_hot(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary groups, rows of hot groups); `hot` is small by construction."""
    marks = hot.select(*keys, F.lit(True).alias("__hot"))
    return _marked(df, keys, marks, "left_anti"), _marked(df, keys, marks, "inner").drop("__hot")


def _all(conds: Sequence[Column]) -> Column:
    out = conds[0]
    for cond in conds[1:]:
        out = out & cond
    return out


def _slices(rows: DataFrame, keys: Sequence[str], order: Sequence[str], hot: DataFrame, hot_rows: int | None) -> DataFrame:
    """Each row of the hot groups with its slice: how many of its group's splitters stand before it in the order."""
    at, fine = F.struct(*order), 8  # every eighth of the values drawn is a splitter, which evens out the slices
    pieces = F.least(F.ceil(F.col(_HITS) / F.lit((hot_rows or HOT_ROWS) / 4)), F.lit(_SLICES))
    every = F.greatest(F.floor(F.col(_HITS) / (pieces * fine)), F.lit(1))
    drawn = _marked(rows, keys, hot, "inner").where(F.pmod(F.xxhash64(*order), every) == 0)
    splitters = drawn.groupBy(*keys).agg(F.sort_array(F.collect_set(at)).alias(_CUTS))  # about 8 * `_SLICES` values a group at most
    splitters = splitters.withColumn(_CUTS, F.filter(_CUTS, lambda _, i: i % fine == fine - 1))
    cut = _marked(rows, keys, splitters, "left")
    return cut.withColumn(_SLICE, F.coalesce(F.size(F.filter(_CUTS, lambda s: s < at)), F.lit(0))).drop(_CUTS)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    kind: str = "count",
    value: str | None = None,
    hot_rows: int | None = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Add a running `count`, `sum` or `last` (last non-null) of `value` per group in `order`.

    `order` lists ascending columns that identify a row within its group. Floating sums are refused.
    A caller who knows the groups to be small takes the plain window by `hot_rows=None`, and one who knows the hot
    groups hands them in as `hot`, in the form `hot_groups` gives. Nothing runs while the plan is built.
    """
    if kind == "count":
        local, total, zero = F.count(F.lit(1)), F.count(F.lit(1)), F.lit(0)
    elif kind == "sum":
        if isinstance(df.schema[value].dataType, (FloatType, DoubleType)):
            raise TypeError(f"{value}: floating sums depend on how a group is cut; cast to a decimal first")
        local, total, zero = F.sum(value), F.sum(value), F.lit(0)
    elif kind == "last":
        local = F.last(value, ignorenulls=True)
        total = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order)))
        zero = None
    else:
        raise ValueError(f"unknown running kind {kind}")

    def over(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(name, local.over(w))

    hot = hot_groups(df, keys, hot_rows) if hot is None else hot
    if hot is None:
        return over(df, keys)
    cold, big = split_hot(df, keys, hot)
    sliced = _slices(big, keys, order, hot, hot_rows)
    totals = sliced.groupBy(*keys, _SLICE).agg(total.alias(_CARRY))
    before = F.last(_CARRY, ignorenulls=True) if kind == "last" else F.sum(_CARRY)
    past = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.withColumn(_CARRY, before.over(past))
    carry = carry.select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.col(_SLICE).alias("__s"), _CARRY)
    match = _all([F.col(_SLICE) == F.col("__s"), *[F.col(k).eqNullSafe(F.col(f"__h_{k}")) for k in keys]])
    # one row per (hot group, slice): at most hot groups + slices rows
    joined = over(sliced, [*keys, _SLICE]).join(F.broadcast(carry), match, "left")
    if kind == "last":
        merged = F.coalesce(F.col(name), F.col(_CARRY))
    else:
        merged = F.when(F.col(name).isNull() & F.col(_CARRY).isNull(), None).otherwise(
            F.coalesce(F.col(name), zero) + F.coalesce(F.col(_CARRY), zero)
        )
    done = joined.withColumn(name, merged).select(*df.columns, name)
    return over(cold, keys).unionByName(done)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn", hot_rows: int | None = HOT_ROWS, hot: DataFrame | None = None) -> DataFrame:
    """1-based position of each row in its group."""
    return running(df, keys, order, name, "count", hot_rows=hot_rows, hot=hot)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salt_on: Sequence[str], salts: int = 64) -> DataFrame:
    """The first `n` rows of each group, exactly: every salt keeps its own first `n`, then the group does.

    Only `salts * n` rows of a group meet in one task, whatever the group's size.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)))
    for by in ([*keys, "__salt"], list(keys)):
        w = Window.partitionBy(*by).orderBy(*order)
        salted = salted.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")
    return salted.drop("__salt")


def collect_parts(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    item: Column,
    size: int,
    name: str = "items",
    part: str = "part",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Ordered arrays of each group's items, `size` per row: part 0, 1, 2 … hold the whole group.

    A group of up to `size` items is one row; a larger one continues in further rows, so no task
    or row ever holds more than `size` items.
    """
    numbered = number_rows(df, keys, order, "__rn", hot_rows)
    chunk = F.floor((F.col("__rn") - 1) / F.lit(size)).cast("int")
    listed = numbered.select(*keys, chunk.alias(part), F.struct(F.col("__rn"), item.alias("v")).alias("__item"))
    return (
        listed.groupBy(*keys, part)
        .agg(F.sort_array(F.collect_list("__item")).alias("__items"))
        .select(*keys, part, F.transform("__items", lambda x: x["v"]).alias(name))
    )
