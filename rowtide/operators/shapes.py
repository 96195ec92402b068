"""Shapes: filtered tables kept in step by a snapshot and the log entries behind it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rowtide.operators import changes, read
from rowtide.plans.groups import HOT_ROWS, running


def visibility(transactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a snapshot taken now has seen, over transactions (txid, open): one row (xmin, xmax) and the open ones (txid)."""
    unfinished = transactions.where("open").select("txid").distinct()
    bounds = transactions.agg(
        F.coalesce(F.min(F.when(F.col("open"), F.col("txid"))), F.max("txid") + 1).alias("xmin"), (F.max("txid") + 1).alias("xmax")
    )
    return bounds, unfinished


def snapshot(table: DataFrame, keep: Column, log: DataFrame) -> DataFrame:
    """The shape's rows, each with the log position the snapshot stands at."""
    return table.where(keep).withColumn("position", F.coalesce(log.agg(F.max("offset").alias("o")).scalar(), F.lit(0)))


def feed(log: DataFrame, after: int, scopes: Sequence[str], scope: str = "scope_id") -> DataFrame:
    """Log entries past an offset in scopes the reader reaches."""
    return log.where((F.col("offset") > after) & F.col(scope).isin(list(scopes)))


def subset(table: DataFrame, where: Sequence[tuple], params: Sequence, order: Sequence[str], limit: int, mark: int) -> DataFrame:
    """The first rows of a predicate's rows in order, stamped with the snapshot's mark."""
    return read.page(read.where(table, where, params), order, limit).withColumn("snapshot_mark", F.lit(mark))


def merge(snap: DataFrame, log: DataFrame, key: Sequence[str], xmax: int, unfinished: DataFrame) -> DataFrame:
    """A snapshot brought up to date: only changes of transactions it had not seen apply."""
    opened = unfinished.select(F.col("txid").alias("__open")).distinct()
    unseen = log.join(opened, log["txid"] == opened["__open"], "left").where((F.col("txid") >= xmax) | F.col("__open").isNotNull())
    return changes.compact(snap, unseen.drop("__open"), key)


def expired(readers: DataFrame, log: DataFrame, keep: int) -> DataFrame:
    """`expired`: readers (reader, offset) who have missed entries outside the newest `keep`, or a reset."""
    oldest = log.select("offset").orderBy(F.desc("offset")).limit(keep).agg(F.min("offset").alias("o")).scalar()
    reset = log.where("op = 'T'").agg(F.max("offset").alias("o")).scalar()
    trimmed = F.greatest(oldest - 1, F.coalesce(reset, F.lit(-1)))
    return readers.withColumn("expired", F.col("offset") < trimmed)


def compact_store(ops: DataFrame, shape: Sequence[str], key: str, value: str) -> DataFrame:
    """Ops (shape, seq, op upsert|delete|truncate, key, value) folded to current rows per shape.

    A key keeps the place of its first upsert since it was last absent.
    """
    cleared = ops.where("op = 'truncate'").groupBy(*shape).agg(F.max("seq").alias("__t"))
    live = ops.where("op <> 'truncate'").join(cleared, list(shape), "left").where(F.col("__t").isNull() | (F.col("seq") > F.col("__t")))
    up = F.col("op") == "upsert"
    ends = live.groupBy(*shape, key).agg(
        F.max_by(F.struct("op", value), "seq").alias("__e"),
        F.max(F.when(~up, F.col("seq"))).alias("__gone"),
    )
    held = ends.where("__e.op = 'upsert'")
    placed = live.where(up).join(held.select(*shape, key, "__gone"), [*shape, key])
    placed = placed.where(F.col("__gone").isNull() | (F.col("seq") > F.col("__gone"))).groupBy(*shape, key).agg(F.min("seq").alias("place"))
    return held.select(*shape, key, F.col(f"__e.{value}").alias(value)).join(placed, [*shape, key])


def idempotent_ops(ops: DataFrame, shape: Sequence[str], key: str, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """An insert of a key delivered before is an update. A truncate clears that memory, a delete does not."""
    marked = ops.withColumn("__t", F.when(F.col("op") == "truncate", 1).otherwise(0))
    timed = running(marked, shape, ["seq"], "__epoch", "sum", "__t", hot_rows).drop("__t")
    written = F.col("op").isin("insert", "update")
    first = timed.where(written).groupBy(*shape, "__epoch", key).agg(F.min("seq").alias("__first"))
    joined = timed.join(first, [*shape, "__epoch", key], "left")
    again = (F.col("op") == "insert") & (F.col("seq") > F.col("__first"))
    return joined.withColumn("op", F.when(again, "update").otherwise(F.col("op"))).select(*ops.columns)


def live_changes(before: DataFrame, after: DataFrame, key: str, keep: Column) -> DataFrame:
    """(op, row) from one version of a filtered table to the next; rows that cross the filter are inserts or deletes."""
    from rowtide.operators.publish import ACTION, actions

    acted = actions(before.where(keep), after.where(keep), key)
    return acted.where(F.col(ACTION) != "keep").withColumnRenamed(ACTION, "op")


def initial_rows(table: DataFrame, keep: Column) -> DataFrame:
    """The feed's start: every row of the filtered table as an insert."""
    return table.where(keep).withColumn("op", F.lit("insert"))


def confirm_writes(writes: DataFrame, log: DataFrame, held: DataFrame) -> DataFrame:
    """`status` of each write (key, txid, changed): confirmed, waiting, or refused.

    A write that changed rows is confirmed once the feed carries its transaction. One that changed
    none has nothing to wait for, unless the reader still holds the key: then the server refused it.
    """
    seen = log.select("txid").distinct().withColumn("__seen", F.lit(True))
    have = held.select("key").distinct().withColumn("__held", F.lit(True))
    joined = writes.join(seen, "txid", "left").join(have, "key", "left")
    none = F.col("changed") == 0
    status = (
        F.when(none & F.col("__held"), "refused").when(none, "confirmed").when(F.col("__seen"), "confirmed").otherwise("waiting")
    )
    return joined.withColumn("status", status).drop("__seen", "__held")
