"""Weighted rows and incrementally maintained relations.

A weighted relation is a DataFrame with a signed `weight` per row; a bag keeps `copies` > 0.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowtide.functions.rows import canonical_json
from rowtide.operators.changes import expand, final_ops
from rowtide.operators.publish import merged
from rowtide.sources import versions

GLOBAL = ""  # the partition of relations that are not partitioned


class InvalidInput(ValueError):
    """A named check found rows, or a step would leave a negative multiplicity."""


def _same(cols: Sequence[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols])


def weigh(df: DataFrame, weight: int = 1) -> DataFrame:
    """Rows with a weight; negative zero becomes zero so that equal rows are one row."""
    doubles = {n: F.col(n) + F.lit(0.0) for n, t in df.dtypes if t in ("double", "float")}
    return df.withColumns({**doubles, "weight": F.lit(weight).cast("bigint")})


def net(*parts: DataFrame) -> DataFrame:
    """Weights summed per row; rows that cancel out are gone."""
    both = reduce(lambda a, b: a.unionByName(b), parts)
    cols = [c for c in both.columns if c != "weight"]
    return both.groupBy(*cols).agg(F.sum("weight").alias("weight")).where("weight <> 0")


def pending(stream: DataFrame, captured: DataFrame) -> DataFrame:
    """What the stream holds beyond the captured baseline: its weights minus the captured ones, where not 0."""
    return net(stream, captured.withColumn("weight", -F.col("weight")))


def pending_count(*relations: DataFrame) -> DataFrame:
    """How many pending rows there are; rows, not weights, since a replacement's weights sum to zero."""
    counted = [r.agg(F.count(F.lit(1)).alias("n")) for r in relations]
    return reduce(lambda a, b: a.unionByName(b), counted).agg(F.sum("n").alias("n"))


def require_empty(checks: Mapping[str, DataFrame]) -> None:
    """Named "invalid input" queries that must return nothing."""
    found = {n: rows[0] for n, df in checks.items() if (rows := df.take(1))}
    if found:
        raise InvalidInput(f"invalid input: {found}")


def capture(relations: Mapping[str, DataFrame], checks: Mapping[str, DataFrame]) -> DataFrame:
    """All pending rows of all relations as (relation, row JSON, weight), once every check is empty."""
    require_empty(checks)
    tagged = [
        df.select(F.lit(n).alias("relation"), canonical_json([c for c in df.columns if c != "weight"]).alias("row"), "weight")
        for n, df in relations.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def acknowledge(base: str, capture_id: int, delta: DataFrame) -> None:
    """Add a captured delta to the baseline at `base`; acknowledging the same capture again adds nothing.

    Capture numbers grow. Older captures are folded into net weights, so a baseline of n captures is read from log n folders.
    """
    versions.write_batch(delta, base, capture_id, lambda rows: net(rows.drop("batch")))


def baseline(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """Everything acknowledged so far, as net weights; a row removed more often than added is refused."""
    known = net(versions.read_batches(spark, base, schema).drop("batch"))
    if known.where("weight < 0").take(1):
        raise ValueError("a captured row has a negative weight")
    return known


def carry(carrier: DataFrame, log: DataFrame, key: str, projection: Mapping[str, Column]) -> DataFrame:
    """Publication actions that bring a projected carrier of current rows up to date with a log.

    The carrier holds `__key` and the projection. A row whose projection did not change is kept, not
    written; a truncate removes what the log does not insert again.
    """
    ends = final_ops(log, [key])
    gone = F.col("op") != "I"
    changes = ends.select(F.col(key).cast("string").alias("__key"), *[F.when(~gone, c).alias(n) for n, c in projection.items()], gone.alias("__gone"))
    cleared = log.where("op = 'T'").agg(F.count(F.lit(1)).alias("n")).scalar() > 0
    return merged(carrier, changes, "__key", F.when(cleared, "delete").otherwise("keep"))


def refresh_groups(view: DataFrame, touched: DataFrame, key: Sequence[str], recomputed: DataFrame) -> DataFrame:
    """Replace the touched groups of a view by their recomputation; other groups stay as they are.

    `touched` holds the group keys changed on either side, before or after; `recomputed` covers them.
    """
    return view.join(touched.select(*key).distinct(), list(key), "left_anti").unionByName(recomputed)


def maintain(view: DataFrame, delta: DataFrame, key: Sequence[str], sums: Mapping[str, Column], highest: str, value: str, rows: DataFrame) -> DataFrame:
    """A grouped view (key, total, sums…, `highest`) after a weighted delta of its input rows.

    Counts and sums move by the delta alone. A maximum only has to be looked up again in the current
    `rows` for groups whose maximum was deleted; groups that reach no rows disappear.
    """
    w = F.col("weight")
    moved = delta.groupBy(*key).agg(
        F.sum(w).alias("__total"),
        *[F.sum(w * c).alias(f"__{n}") for n, c in sums.items()],
        F.max(F.when(w > 0, F.col(value))).alias("__in"),
        F.max(F.when(w < 0, F.col(value))).alias("__out"),
    )
    # groups that may have lost their maximum: only they are looked up, and only touched groups can be
    held = view.select(*key, F.col(highest).alias("__held"))
    lost = moved.join(held, list(key)).where(F.col("__out") >= F.col("__held")).select(*key)
    found = rows.join(lost, list(key), "left_semi").groupBy(*key).agg(F.max(value).alias("__found"))
    lost = lost.join(found, list(key), "left").withColumn("__lost", F.lit(True))
    joined = view.join(moved.join(lost, list(key), "left"), list(key), "full")
    added = {n: F.coalesce(n, F.lit(0)) + F.coalesce(f"__{n}", F.lit(0)) for n in ["total", *sums]}
    top = F.when(F.col("__lost"), F.col("__found")).otherwise(F.greatest(highest, "__in"))
    return joined.withColumns({**added, highest: top}).where("total > 0").select(*key, "total", *sums, highest)


def apply_step(state: DataFrame, step: DataFrame, partition: str | None) -> tuple[DataFrame, DataFrame]:
    """(state, affected) after one complete weighted step over a bag.

    `state` holds rows with `copies`, `step` rows with `weight`. Weights are netted per row first; a
    negative result anywhere fails the whole step. `affected` is (partition, changed_rows).
    """
    cols = [c for c in state.columns if c != "copies"]
    changed = net(step.select(*cols, "weight"))
    joined = state.alias("s").join(changed.alias("d"), _same(cols, "s", "d"), "full")
    after = joined.select(
        *[F.coalesce(F.col(f"s.{c}"), F.col(f"d.{c}")).alias(c) for c in cols],
        (F.coalesce("s.copies", F.lit(0)) + F.coalesce("d.weight", F.lit(0))).alias("copies"),
    )
    if after.where("copies < 0").take(1):
        raise InvalidInput("a row would have a negative multiplicity")
    at = F.lit(GLOBAL) if partition is None else F.col(partition).cast("string")
    affected = changed.groupBy(at.alias("partition")).agg(F.count(F.lit(1)).alias("changed_rows"))
    return after.where("copies > 0"), affected


def partition_rows(state: DataFrame, affected: DataFrame, partition: str | None) -> DataFrame:
    """(partition, row) of every affected partition, each row as often as it occurs; an emptied one has a null row.

    Rows of a partition are in the order of their canonical JSON.
    """
    cols = [c for c in state.columns if c != "copies"]
    at = F.lit(GLOBAL) if partition is None else F.col(partition).cast("string")
    held = expand(state.select(at.alias("partition"), canonical_json(cols).alias("row"), "copies"), "copies")
    return affected.select("partition").join(held, "partition", "left")
