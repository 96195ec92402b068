"""Schema changes as expressions: `up` moves rows to the new schema, `down` back to the old one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class AddColumn:
    """A new column: `up` fills it from a row, else its default, else null."""

    name: str
    type: str
    default: str | None = None
    fill: str | None = None

    def up(self, df: DataFrame) -> DataFrame:
        value = F.expr(self.fill or self.default or "NULL")
        if self.fill and self.default:
            value = F.coalesce(value, F.expr(self.default))
        return df.withColumn(self.name, value.cast(self.type))

    def down(self, df: DataFrame) -> DataFrame:
        return df.drop(self.name)


@dataclass(frozen=True)
class AlterColumn:
    """A column's new type or value; `forward` and `back` are expressions over the row."""

    name: str
    forward: str
    back: str
    type: str | None = None
    old_type: str | None = None

    def up(self, df: DataFrame) -> DataFrame:
        return self._set(df, self.forward, self.type)

    def down(self, df: DataFrame) -> DataFrame:
        return self._set(df, self.back, self.old_type)

    def _set(self, df: DataFrame, text: str, kind: str | None) -> DataFrame:
        value = F.expr(text)
        return df.withColumn(self.name, value.cast(kind) if kind else value)


@dataclass(frozen=True)
class RenameColumns:
    names: Mapping[str, str]

    def up(self, df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed(dict(self.names))

    def down(self, df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed({new: old for old, new in self.names.items()})


@dataclass(frozen=True)
class DropColumn:
    """`back` gives the value the old schema sees."""

    name: str
    back: str = "NULL"
    type: str | None = None

    def up(self, df: DataFrame) -> DataFrame:
        return df.drop(self.name)

    def down(self, df: DataFrame) -> DataFrame:
        value = F.expr(self.back)
        return df.withColumn(self.name, value.cast(self.type) if self.type else value)


@dataclass(frozen=True)
class RawSql:
    """SQL over the table, named {t}."""

    forward: str
    back: str

    def up(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.sql(self.forward, t=df)

    def down(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.sql(self.back, t=df)


Change = AddColumn | AlterColumn | RenameColumns | DropColumn | RawSql


def migrate(df: DataFrame, changes: Sequence[Change]) -> DataFrame:
    """The table under the new schema."""
    return reduce(lambda d, c: c.up(d), changes, df)


def revert(df: DataFrame, changes: Sequence[Change]) -> DataFrame:
    """The table as the old schema sees it."""
    return reduce(lambda d, c: c.down(d), reversed(changes), df)


def rename_table(tables: Mapping[str, DataFrame], old: str, new: str) -> dict[str, DataFrame]:
    return {new if n == old else n: df for n, df in tables.items()}


def drop_table(tables: Mapping[str, DataFrame], name: str) -> dict[str, DataFrame]:
    return {n: df for n, df in tables.items() if n != name}


@dataclass(frozen=True)
class Constraint:
    """not null (one column), unique or check, with expressions that repair columns first."""

    name: str
    kind: str
    columns: Sequence[str] = ()
    check: str | None = None
    repair: Mapping[str, str] = None

    def repaired(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.expr(e) for c, e in (self.repair or {}).items()})

    def violations(self, df: DataFrame, key: str) -> DataFrame:
        """(key, constraint) of the repaired rows that still break it; a null check passes, null keys are distinct."""
        df = self.repaired(df)
        if self.kind == "unique":
            keyed = df.dropna(subset=list(self.columns))
            twice = keyed.groupBy(*self.columns).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
            broken = keyed.join(twice, list(self.columns), "left_semi")
        elif self.kind == "not null":
            broken = df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in self.columns]))
        else:
            broken = df.where(~F.expr(self.check))
        return broken.select(key, F.lit(self.name).alias("constraint"))


def constrain(df: DataFrame, key: str, constraints: Sequence[Constraint]) -> tuple[DataFrame, DataFrame]:
    """(repaired table, violations) of several constraints, repairs applied in order."""
    found = []
    for c in constraints:
        found.append(c.violations(df, key))
        df = c.repaired(df)
    return df, reduce(lambda a, b: a.unionByName(b), found)
