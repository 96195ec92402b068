"""Entity rules, rules across rows, and key uniqueness after typing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: letters, numbers, punctuation, symbols and white space.
PLAIN_TEXT = r"^[\p{L}\p{N}\p{P}\p{S}\s]+$"


@dataclass(frozen=True)
class Rule:
    """What a column must satisfy; a null value breaks only `required`."""

    column: str
    required: bool = False
    uuid: bool = False
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None

    def checks(self) -> Mapping[str, Column]:
        c, out = F.col(self.column), {}
        if self.required:
            out["required"] = c.isNull()
        if self.uuid:
            out["uuid"] = ~c.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
        if self.min_length is not None:
            out["min_length"] = F.char_length(c) < self.min_length
        if self.max_length is not None:
            out["max_length"] = F.char_length(c) > self.max_length
        if self.pattern is not None:
            out["pattern"] = ~c.rlike(self.pattern)
        return {f"{self.column}.{n}": v for n, v in out.items()}


def violations(df: DataFrame, key: str, rules: Sequence[Rule]) -> DataFrame:
    """(key, rule) for each rule a row breaks."""
    broken = [F.when(c, F.lit(n)) for r in rules for n, c in r.checks().items()]
    return df.select(key, F.explode(F.array_compact(F.array(*broken))).alias("rule"))


def cross_row(df: DataFrame, refs: Mapping[str, tuple[DataFrame, str, str]], rules: Mapping[str, Column]) -> DataFrame:
    """Judge each row with the rows its references name: `ok`, `refused` (rules answered false), `error`.

    `refs` maps a struct name to (table, column here, unique key there). A rule that answers neither
    true nor false is a program error, not a refusal.
    """
    own = df.columns
    for name, (other, here, there) in refs.items():
        side = other.select(F.col(there).alias(f"__{name}_key"), F.struct(*other.columns).alias(name))
        df = df.join(side, df[here] == side[f"__{name}_key"], "left").drop(f"__{name}_key")
    answers = df.withColumns({f"__r_{n}": c for n, c in rules.items()})
    refused = F.array_compact(F.array(*[F.when(~F.col(f"__r_{n}"), F.lit(n)) for n in rules]))
    failed = F.array_compact(F.array(*[F.when(F.col(f"__r_{n}").isNull(), F.lit(n)) for n in rules]))
    out = answers.select(*own, refused.alias("refused"), failed.alias("error"))
    return out.withColumn("ok", (F.size("refused") == 0) & (F.size("error") == 0))


def grouped_facts(df: DataFrame, key: str, **aggs: Column) -> DataFrame:
    """Facts over the many rows a reference names, one row per key, ready for `cross_row`."""
    return df.groupBy(key).agg(*[c.alias(n) for n, c in aggs.items()])


def repeated_keys(df: DataFrame, key: Column) -> DataFrame:
    """(key, n) of keys that are null or occur more than once after typing."""
    return df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("key").isNull() | (F.col("n") > 1))
