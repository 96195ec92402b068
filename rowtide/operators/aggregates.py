"""Aggregates beyond the grouped read: ordered strings, arrays and objects in bounded parts, and bags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rowtide.plans.groups import collect_parts


def count_exact(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """(first, last, total) of a page: the total ignores limit and offset; an empty page has null bounds."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    last = F.least(F.col("total"), F.lit(offset + limit)) - 1
    inside = (F.col("total") > offset) & F.lit(limit > 0)
    return total.select(F.when(inside, F.lit(offset)).alias("first"), F.when(inside, last).alias("last"), "total")


def json_arrays(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], size: int) -> DataFrame:
    """JSON arrays of each group's rows, `size` rows to a part."""
    parts = collect_parts(df, keys, order, F.struct(*columns), size, "__rows")
    return parts.withColumn("rows", F.to_json("__rows", {"ignoreNullFields": "false"})).drop("__rows")


def strings(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, size: int, sep: str = ", ") -> DataFrame:
    """Ordered `sep`-joined text of each group's non-null values, `size` values to a part."""
    parts = collect_parts(df.dropna(subset=[value]), keys, order, F.col(value), size, "__items")
    return parts.withColumn("joined", F.array_join("__items", sep)).drop("__items")


def arrays(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, size: int) -> DataFrame:
    """Ordered arrays of each group's values."""
    return collect_parts(df, keys, order, value, size, "items")


def objects(df: DataFrame, keys: Sequence[str], name: str, value: str, size: int) -> DataFrame:
    """Objects name → value of each group's rows, `size` members to a part; names are unique in a group."""
    parts = collect_parts(df, keys, [name], F.struct(F.col(name), F.col(value)), size, "__items")
    return parts.withColumn("object", F.map_from_entries("__items")).drop("__items")


def pivot_counts(df: DataFrame, keys: Sequence[str], column: str, values: Mapping[str, object]) -> DataFrame:
    """`sum(CASE WHEN column = value THEN 1 ELSE 0 END)` per named value."""
    return df.groupBy(*keys).agg(*[
        F.sum(F.when(F.col(column) == v, 1).otherwise(0)).alias(n) for n, v in values.items()
    ])


def filtered_counts(df: DataFrame, keys: Sequence[str], conditions: Mapping[str, Column]) -> DataFrame:
    """`count(*) FILTER (WHERE …)` per named condition."""
    return df.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def regex_max(df: DataFrame, keys: Sequence[str], column: str, pattern: str, name: str = "highest") -> DataFrame:
    """The highest number the pattern's first group finds in the group's texts; null when none matches."""
    found = F.nullif(F.regexp_extract(column, pattern, 1), F.lit(""))
    return df.groupBy(*keys).agg(F.max(found.cast("bigint")).alias(name))


def multiplicity(df: DataFrame) -> DataFrame:
    """Each distinct row with its number of copies."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies"))
