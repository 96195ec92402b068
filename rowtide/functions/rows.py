"""Whole-row expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType


def same_values(left: Sequence[str], right: Sequence[str]) -> Column:
    """Null-safe equality column by column; true for no columns."""
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)], F.lit(True))


def non_finite(df: DataFrame) -> Column:
    """Whether any floating column of the row is NaN or infinite."""
    inf = float("inf")
    bad = [
        F.coalesce(F.isnan(f.name) | F.abs(f.name).eqNullSafe(F.lit(inf)), F.lit(False))
        for f in df.schema.fields
        if isinstance(f.dataType, (DoubleType, FloatType))
    ]
    return reduce(lambda a, b: a | b, bad, F.lit(False))


class Stages:
    """Values that several expressions use, each a column of its own that is computed once per row.

    What one result keeps later may use what it kept before, so every value lies one projection further on.
    """

    def __init__(self):
        self._steps: list[dict[str, Column]] = []

    def keeper(self) -> Callable[[Column], Column]:
        """A function for one result: it names a value and gives back the column to use in its place."""
        depth = count()

        def keep(value: Column) -> Column:
            level = next(depth)
            if level == len(self._steps):
                self._steps.append({})
            name = f"__s{level}_{len(self._steps[level])}"
            self._steps[level][name] = value
            return F.col(name)

        return keep

    def names(self) -> list[str]:
        return [name for step in self._steps for name in step]

    def add_to(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, step: d.withColumns(step), self._steps, df)


def interval_micros(text: str) -> Column:
    """A day-time interval, given as SQL text, as whole microseconds."""
    text = f"CAST({text} AS INTERVAL DAY TO SECOND)"
    parts = (("DAY", 86_400_000_000), ("HOUR", 3_600_000_000), ("MINUTE", 60_000_000))
    whole = " + ".join(f"extract({unit} FROM {text}) * {size}L" for unit, size in parts)
    return F.expr(f"{whole} + CAST(extract(SECOND FROM {text}) * 1000000 AS BIGINT)")


def micros(df: DataFrame, column: str) -> Column:
    """A timestamp column as whole microseconds, in an order no session time zone changes."""
    if df.schema[column].dataType.simpleString() == "timestamp_ntz":
        return interval_micros(f"(`{column}` - TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    return F.unix_micros(column)


def canonical_json(columns: Sequence[str]) -> Column:
    """A row's JSON with its fields in name order, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
