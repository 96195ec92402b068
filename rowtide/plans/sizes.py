"""Size checks that decide between a broadcast and a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

SMALL_BYTES = 10 * 1024 * 1024  # a change set that is broadcast


def rows_within(df: DataFrame, limit: int) -> bool:
    """Whether `df` has at most `limit` rows; tasks count before anything moves."""
    return df.count() <= limit


def row_bytes(columns: Sequence[str]) -> Column:
    """About what a row takes in memory: its text and a fixed width per column."""
    return F.octet_length(F.to_json(F.struct(*columns))) + F.lit(16 * len(columns))
