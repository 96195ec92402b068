"""Publication of a computation's output into keyed sink tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from rowtide.functions.rows import non_finite, same_values

ACTION = "action"


def check_sinks(declared: Sequence[str], outputs: Mapping[str, DataFrame]) -> None:
    """An output names exactly the declared sinks, each with a text `id`."""
    if len(set(declared)) != len(declared) or sorted(declared) != sorted(outputs):
        raise ValueError(f"declared sinks {sorted(declared)}, got {sorted(outputs)}")
    for name, df in outputs.items():
        if "id" not in df.columns or df.schema["id"].dataType.simpleString() != "string":
            raise ValueError(f"{name} has no text id")


def check_columns(sink: StructType, output: StructType, read_only: Sequence[str] = (), required: Sequence[str] = ()) -> None:
    """An output has `id`, only writable columns of the sink, and every required one."""
    names, known = set(output.fieldNames()), set(sink.fieldNames()) - set(read_only)
    if "id" not in names:
        raise ValueError("output has no id")
    if names - known:
        raise ValueError(f"not writable: {sorted(names - known)}")
    if set(required) - names:
        raise ValueError(f"required: {sorted(set(required) - names)}")


def violations(output: DataFrame, key: str = "id") -> DataFrame:
    """(id, rule, n) of everything that makes an output unpublishable; empty when it is sound."""
    counted = output.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(non_finite(output)).alias("bad"))
    rules = F.array_compact(F.array(
        F.when(F.col(key).isNull(), F.struct(F.lit("null id").alias("rule"), F.col("n").alias("n"))),
        F.when(F.col("n") > 1, F.struct(F.lit("repeated id").alias("rule"), F.col("n").alias("n"))),
        F.when(F.col("bad") > 0, F.struct(F.lit("not finite").alias("rule"), F.col("bad").alias("n"))),
    ))
    return counted.select(F.col(key).alias("id"), F.explode(rules).alias("v")).select("id", "v.rule", "v.n")


def delta_violations(upserts: DataFrame, deletes: DataFrame, key: str = "id") -> DataFrame:
    """(id, n) of ids that are null, repeated, or both upserted and deleted."""
    ids = upserts.select(key).unionByName(deletes.select(key))
    return ids.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("id").isNull() | (F.col("n") > 1))


def merged(sink: DataFrame, changes: DataFrame, key: str, absent: str | Column) -> DataFrame:
    """Every key with its next row and `action`, by one full outer join of the sink with a change set.

    `changes` has the key, any of the sink's columns and `__gone`: such a key is deleted if stored.
    Columns it does not supply keep their stored value, and a stored row equal to its change is kept.
    `absent` is the action of stored keys without a change.
    """
    given = [c for c in changes.columns if c not in (key, "__gone")]
    old = sink.select(F.col(key), *[F.col(c).alias(f"__o_{c}") for c in sink.columns if c != key], F.lit(True).alias("__old"))
    new = changes.select(F.col(key), *[F.col(c).alias(f"__n_{c}") for c in given], "__gone")
    same = same_values([f"__o_{c}" for c in given], [f"__n_{c}" for c in given])
    what = (
        F.when(F.col("__gone").isNull(), absent)
        .when(F.col("__gone"), "delete")
        .when(F.col("__old").isNull(), "insert")
        .when(same, "keep")
        .otherwise("update")
    )
    written_ = F.col("__gone").isNotNull() & ~F.col("__gone")

    def value(c: str) -> Column:
        return F.when(written_, F.col(f"__n_{c}")).otherwise(F.col(f"__o_{c}")) if c in given else F.col(f"__o_{c}")

    cols = [F.col(key) if c == key else value(c).alias(c) for c in sink.columns]
    known = F.col("__old").isNotNull() | ~F.col("__gone")
    return old.join(new, key, "full").where(known).select(*cols, what.alias(ACTION))


def actions(sink: DataFrame, output: DataFrame, key: str = "id", keep_omitted: bool = False) -> DataFrame:
    """The actions of an output: insert, update, delete, or keep for an equal or untouched row.

    `keep_omitted` keeps stored keys the output leaves out (upsert); otherwise they are deleted.
    """
    return merged(sink, output.withColumn("__gone", F.lit(False)), key, F.lit("keep" if keep_omitted else "delete"))


def _once(rows: DataFrame, key: str) -> DataFrame:
    """Each value of `key` once, taken in its order: keys that a join put in order need nothing more, others a sort, which spills.

    `distinct` holds all keys of a task in two hash tables, and adaptive execution gives a task many rows where they are short.
    """
    first = F.row_number().over(Window.partitionBy(key).orderBy(key))
    return rows.select(key, first.alias("__n")).where("__n = 1").select(key)


def delta_actions(sink: DataFrame, upserts: DataFrame, deletes: DataFrame, key: str = "id") -> DataFrame:
    """The actions of a delta: upserts are written, exactly the deleted keys go, the rest stays."""
    gone = _once(deletes, key).withColumn("__gone", F.lit(True))
    changes = upserts.withColumn("__gone", F.lit(False)).unionByName(gone, allowMissingColumns=True)
    return merged(sink, changes, key, F.lit("keep"))


def next_state(acted: DataFrame) -> DataFrame:
    """The sink after the actions."""
    return acted.where(F.col(ACTION) != "delete").drop(ACTION)


def written(acted: DataFrame) -> DataFrame:
    """Only what changes: the rows a change feed would show."""
    return acted.where(F.col(ACTION) != "keep")


def summary(acted: DataFrame) -> DataFrame:
    """One row (upserted, deleted)."""
    return acted.agg(
        F.count_if(F.col(ACTION).isin("insert", "update")).alias("upserted"),
        F.count_if(F.col(ACTION) == "delete").alias("deleted"),
    )


def ownership_conflicts(owners: DataFrame, recomputed: DataFrame, outputs: DataFrame, key: str = "id") -> DataFrame:
    """(id, owners) of ids more than one partition would own after a step.

    `owners` is (id, partition) before it, `recomputed` the partitions calculated again, `outputs`
    their rows with `partition`.
    """
    stay = owners.join(recomputed, "partition", "left_anti").select(key, "partition")
    claims = stay.unionByName(outputs.select(key, "partition"))
    return claims.groupBy(key).agg(F.count(F.lit(1)).alias("owners")).where("owners > 1")


def next_owners(owners: DataFrame, recomputed: DataFrame, outputs: DataFrame, key: str = "id") -> DataFrame:
    """(id, partition) after a step: recomputed partitions own exactly what they put out."""
    stay = owners.join(recomputed, "partition", "left_anti").select(key, "partition")
    return stay.unionByName(outputs.select(key, "partition"))


def partition_actions(sink: DataFrame, owners: DataFrame, recomputed: DataFrame, outputs: DataFrame, key: str = "id") -> DataFrame:
    """`actions` of recomputed partitions: ids they owned and no recomputed partition puts out are deleted."""
    was = owners.join(recomputed, "partition", "left_semi").select(key)
    dropped = was.join(outputs.select(key), key, "left_anti")
    return delta_actions(sink, outputs.drop("partition"), dropped, key)


def drifted_partitions(sink: DataFrame, owners: DataFrame, desired: DataFrame, key: str = "id") -> DataFrame:
    """(partition, rows) whose owned rows were edited or removed outside a publication."""
    off = actions(sink, desired, key).where(F.col(ACTION) != "keep").select(key)
    return off.join(owners.select(key, "partition"), key).groupBy("partition").agg(F.count(F.lit(1)).alias("rows"))


def publish(acted: Mapping[str, DataFrame], store: Callable[[Mapping[str, DataFrame]], object], on_complete: Callable[[], None] | None = None) -> None:
    """Store the next state of all sinks in one call, such as one commit, then run the completion hook once.

    The hook does not run after a failure.
    """
    store({name: next_state(df) for name, df in acted.items()})
    if on_complete:
        on_complete()
