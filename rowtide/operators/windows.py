"""Ordered operators per key: numbering, running totals, carried values, latest and first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rowtide.plans.groups import HOT_ROWS, running


def latest_per_key(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The row with the highest `seq` of each key; an aggregate, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("__row")).select(*keys, "__row.*")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "total", hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Sum of `value` up to each row of its group."""
    return running(df, keys, order, name, "sum", value, hot_rows)


def forward_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], marker: Column, trace: Column, name: str = "trace", hot_rows: int | None = HOT_ROWS, unknown: str | None = "") -> DataFrame:
    """Rows between markers take the last marker's trace, `unknown` before the first. Marker rows are dropped."""
    marked = df.withColumn("__is", F.coalesce(marker, F.lit(False)))
    marked = marked.withColumn("__trace", F.when(F.col("__is"), F.coalesce(trace, F.lit(""))))
    filled = running(marked, keys, order, name, "last", "__trace", hot_rows)
    return filled.where(~F.col("__is")).withColumn(name, F.coalesce(name, F.lit(unknown))).drop("__is", "__trace")


def first_trace(df: DataFrame, keys: Sequence[str], position: str, trace: str, name: str = "trace") -> DataFrame:
    """The first non-empty trace of each batch; '' when it has none."""
    at = F.when(F.col(trace) != "", F.col(position))
    return df.groupBy(*keys).agg(F.coalesce(F.min_by(trace, at), F.lit("")).alias(name))
