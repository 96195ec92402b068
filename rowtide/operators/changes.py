"""Change logs: entries (seq, op, row columns) with op I(nsert), D(elete) or T(runcate); an update is D then I."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rowtide.plans.groups import HOT_ROWS, running, top_per_group
from rowtide.session import stored

_CHUNK = 100_000


def fenced(log: DataFrame, after: int, target: int) -> DataFrame:
    """Entries in (after, target]."""
    return log.where((F.col("seq") > after) & (F.col("seq") <= target))


def _cleared(log: DataFrame) -> Column:
    """The position of the last truncate, null without one: a scalar subquery, which a plan computes once."""
    return log.where("op = 'T'").agg(F.max("seq").alias("t")).scalar()


def _after_truncate(log: DataFrame) -> DataFrame:
    """Row entries behind the last truncate."""
    return log.where("op <> 'T'").where(F.col("seq") > F.coalesce(_cleared(log), F.lit(-(2**63))))


def _unless_truncated(base: DataFrame, log: DataFrame) -> DataFrame:
    return base.where(_cleared(log).isNull())


def final_ops(log: DataFrame, key: Sequence[str]) -> DataFrame:
    """The last entry of each key, counted from behind the last truncate."""
    live = _after_truncate(log)
    rest = [c for c in live.columns if c not in key]
    return live.groupBy(*key).agg(F.max_by(F.struct(*rest), "seq").alias("__e")).select(*key, "__e.*")


def compact(base: DataFrame, log: DataFrame, key: Sequence[str]) -> DataFrame:
    """The table after the log: touched keys are removed, then those whose last entry inserts come back."""
    ends = final_ops(log, key)
    ons = [F.col(f"b.{k}").eqNullSafe(F.col(f"e.{k}")) for k in key]
    kept = _unless_truncated(base, log).alias("b").join(ends.select(*key).alias("e"), reduce(lambda a, b: a & b, ons), "left_anti")
    return kept.unionByName(ends.where("op = 'I'").select(*base.columns))


def expand(counted: DataFrame, copies: str) -> DataFrame:
    """Each row as many times as `copies` says; a row with very many copies is spread over tasks first."""
    chunks = counted.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col(copies) - 1) / _CHUNK))))
    inside = F.least(F.lit(_CHUNK), F.col(copies) - F.col("__chunk") * _CHUNK)
    spread = chunks.withColumn("__inside", inside).drop(copies).repartition(F.xxhash64(*[c for c in chunks.columns if c != copies]))
    return spread.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__inside")))).drop("__i", "__inside", "__chunk")


def apply_no_key(base: DataFrame, log: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """A table without a key: each D removes exactly one equal row if there is one, each I adds one.

    Rows the log does not name stay untouched. For the others only counts are needed: with c copies
    before, entries summing to s and lowest running sum m, c + s + max(0, -(c + m)) remain, since a D
    that meets no copy removes nothing.
    """
    cols = base.columns
    live = _after_truncate(log).select(*cols, "seq", F.when(F.col("op") == "I", 1).otherwise(-1).alias("__w"))
    steps = running(live, cols, ["seq"], "__run", "sum", "__w", hot_rows)
    net = stored(steps.groupBy(*cols).agg(F.sum("__w").alias("__s"), F.min("__run").alias("__m")), "net")  # read three times below
    same = reduce(lambda a, b: a & b, [F.col(f"b.{c}").eqNullSafe(F.col(f"t.{c}")) for c in cols])
    start = _unless_truncated(base, log)
    untouched = start.alias("b").join(net.select(*cols).alias("t"), same, "left_anti")
    # copies of touched rows only; a small log is broadcast and the table is not shuffled at all
    had = start.alias("b").join(net.select(*cols).alias("t"), same, "left_semi").groupBy(*cols).agg(F.count(F.lit(1)).alias("__c"))
    joined = net.alias("b").join(had.alias("t"), same, "left").select("b.*", F.coalesce("t.__c", F.lit(0)).alias("__c"))
    left = F.col("__c") + F.col("__s") + F.greatest(F.lit(0), -(F.col("__c") + F.col("__m")))
    changed = joined.select(*cols, left.cast("bigint").alias("__n")).where("__n > 0")
    return untouched.unionByName(expand(changed, "__n"))


def update_entries(updates: DataFrame, old: str, new: str, seq: str) -> DataFrame:
    """Updates (old row struct, new row struct, seq) as log entries: D of the old row, then I of the new."""
    pair = F.array(
        F.struct(F.lit("D").alias("op"), F.col(old).alias("row"), (F.col(seq) * 2).alias("seq")),
        F.struct(F.lit("I").alias("op"), F.col(new).alias("row"), (F.col(seq) * 2 + 1).alias("seq")),
    )
    return updates.select(F.explode(pair).alias("e")).select("e.seq", "e.op", "e.row.*")


def newest_entries(log: DataFrame, keep: int, table: str = "table") -> DataFrame:
    """The newest `keep` entries of each table."""
    return top_per_group(log, [table], [F.desc("seq")], keep, ["seq"])


def refresh_plan(tables: DataFrame) -> DataFrame:
    """How to bring each replica table up to date: `log`, `noop` or `seed`.

    Input per table: signature, seen_signature, seen_seq, log_from, log_target, rows_digest, seen_digest;
    null `seen_*` means never seen, null `log_*` means no usable log.
    """
    c = F.col
    same = c("signature").eqNullSafe(c("seen_signature"))
    follows = (c("log_from") == c("seen_seq")) & (c("log_target") >= c("seen_seq"))
    mode = F.when(same & follows, "log").when(same & (c("rows_digest") == c("seen_digest")), "noop").otherwise("seed")
    return tables.withColumns({"mode": mode, "next_seq": F.coalesce("log_target", F.when(mode == "noop", c("seen_seq")), F.lit(0))})


def expect_rows(df: DataFrame, expected: int) -> DataFrame:
    """Refuse a table whose row count is not the announced one."""
    found = df.count()
    if found != expected:
        raise ValueError(f"expected {expected} rows, found {found}")
    return df
