"""Keyed state of streams: a value a key in Spark's state store, or small tables that a batch function carries along."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from rowtide.operators import delivery
from rowtide.operators.windows import forward_fill
from rowtide.plans.groups import HOT_ROWS
from rowtide.sources import batches, versions


def _state(rows: DataFrame, base: str, batch: int, schema: str) -> DataFrame | None:
    return None if batch == 0 else rows.sparkSession.read.schema(schema).parquet(f"{base}/state/batch={batch - 1}")


def trace_batches(base: str, reader: str, order: Sequence[str], marker: Column, trace: Column, hot_rows: int | None = HOT_ROWS) -> Callable[[DataFrame, int], None]:
    """`foreachBatch` form of the forward fill: markers carry over from earlier batches, per reader.

    Each batch is filled in parallel, however many of its rows belong to one reader; only a reader's
    last marker is kept. Output and state are written per batch number, so a repeated batch rewrites
    the same files from the same earlier state.
    """

    def apply(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        kind = rows.schema[reader].dataType.simpleString()
        before = _state(rows, base, batch, f"{reader} {kind}, trace string")
        filled = forward_fill(rows, [reader], order, marker, trace, "trace", hot_rows, unknown=None)
        marks = rows.where(marker).groupBy(reader).agg(F.max_by(F.coalesce(trace, F.lit("")), F.struct(*order)).alias("__new"))
        if before is not None:
            old = before.withColumnRenamed("trace", "__old")
            filled = filled.join(old, reader, "left")
            filled = filled.withColumn("trace", F.coalesce("trace", "__old")).drop("__old")
            marks = marks.join(old, reader, "full").select(reader, F.coalesce("__new", "__old").alias("trace"))
        else:
            marks = marks.withColumnRenamed("__new", "trace")
        versions.write_batch(filled.fillna({"trace": ""}), f"{base}/out", batch)
        versions.write_batch(marks, f"{base}/state", batch)
        rows.unpersist()

    return apply


class _Carry(StatefulProcessor):
    """Rows of one reader in order, each with the trace of the last marker at or before it; the trace is the reader's state."""

    def __init__(self, order: Sequence[str], expire_ms: int | None):
        self.order, self.expire_ms = list(order), expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.trace = handle.getValueState("trace", "trace string", self.expire_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        before = self.trace.get()[0] if self.trace.exists() else ""
        marks = batch["marks"].astype(bool)
        traces = batch["trace"].where(marks).ffill()
        if marks.any():
            self.trace.update((traces.iloc[-1],))
        batch["trace"] = traces.where(traces.notna(), before)
        yield batch[~marks].drop(columns=["marks"])

    def close(self) -> None:
        pass


class _Archive(StatefulProcessor):
    """Contents of one key in order, `size` to a part; what does not fill a part waits in the state until the key falls quiet."""

    def __init__(self, keys: int, order: Sequence[str], size: int, quiet_ms: int):
        self.keys, self.order, self.size, self.quiet_ms = keys, list(order), size, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "contents string")
        self.parts = handle.getValueState("parts", "n long")
        self.until = handle.getValueState("until", "at long")

    def _rows(self, key, contents: list[list[str]]) -> pd.DataFrame:
        first = self.parts.get()[0] if self.parts.exists() else 0
        if contents:
            self.parts.update((first + len(contents),))
        out = pd.DataFrame({"part": range(first, first + len(contents)), "content": pd.Series(["[" + ",".join(c) + "]" for c in contents], dtype=object)})
        for i in range(self.keys - 1, -1, -1):
            out.insert(0, f"k{i}", pd.Series([key[i]] * len(out), dtype=object))
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        held = (json.loads(self.held.get()[0]) if self.held.exists() else []) + batch["content"].tolist()
        full = len(held) // self.size * self.size
        if self.until.exists():
            self.handle.deleteTimer(self.until.get()[0])
        self.held.clear()
        if full < len(held):
            self.held.update((json.dumps(held[full:]),))
            quiet = max(int(batch["millis"].max()), timerValues.getCurrentWatermarkInMs()) + self.quiet_ms
            self.until.update((quiet,))
            self.handle.registerTimer(quiet)
        else:
            self.until.clear()
        yield self._rows(key, [held[i : i + self.size] for i in range(0, full, self.size)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = json.loads(self.held.get()[0])
        self.held.clear()
        self.until.clear()
        yield self._rows(key, [held])

    def close(self) -> None:
        pass


def archived(stream: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], content: str, size: int, late: str, quiet_ms: int) -> DataFrame:
    """Messages of each key as JSON arrays of `size` in order: (keys, part, content), on a stream.

    Full parts come at once. The rest of a key comes when the watermark, `late` behind the newest event, has passed the key's last
    event by `quiet_ms`; later messages begin a new part. The state holds less than a part a key. Messages must arrive in
    order from batch to batch; within a batch they are sorted. `content` is JSON text. Start the query with `started`.
    """
    order_names = {c: f"o{i}" for i, c in enumerate(order)}
    timed = stream.withWatermark(at, late)
    plain = timed.select(
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], *[(F.unix_micros(F.col(c)) if c == at else F.col(c)).alias(n) for c, n in order_names.items()],
        F.unix_millis(F.col(at)).alias("millis"), F.col(content).alias("content"), F.col(at).alias("event_at"),
    )
    kinds = [T.StructField(f"k{i}", stream.schema[c].dataType) for i, c in enumerate(keys)]
    schema = T.StructType([*kinds, T.StructField("part", T.IntegerType()), T.StructField("content", T.StringType())])
    run = _Archive(len(keys), list(order_names.values()), size, quiet_ms)
    out = plain.groupBy(*[f.name for f in kinds]).transformWithStateInPandas(run, schema, "Append", "EventTime")
    return out.select(*[F.col(f.name).alias(c) for f, c in zip(kinds, keys)], "part", "content")


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def carry_trace(stream: DataFrame, reader: str, order: Sequence[str], marker: Column, trace: Column, expire_ms: int | None = None) -> DataFrame:
    """Streaming forward fill: rows between markers take the `trace` of their reader's last marker, '' before the first.

    Marker rows are dropped. The state is one value a reader, which only a batch with a marker of that reader writes; with
    `expire_ms` it lapses that long after it was written. A reader's rows must arrive in order from batch to batch; within a
    batch they are sorted, so a batch is what one reader's rows in memory are bounded by. Start the query with `started`.
    """
    plain = {c: f"c{i}" for i, c in enumerate(stream.columns)}  # Spark hands columns over by names that Python allows
    is_marker = F.coalesce(marker, F.lit(False))
    marked = stream.select(
        *[F.col(c).alias(n) for c, n in plain.items()], is_marker.alias("marks"), F.when(is_marker, F.coalesce(trace, F.lit(""))).alias("trace")
    )
    schema = T.StructType([*[T.StructField(plain[f.name], f.dataType) for f in stream.schema.fields], T.StructField("trace", T.StringType())])
    time = "None" if expire_ms is None else "ProcessingTime"
    out = marked.groupBy(plain[reader]).transformWithStateInPandas(_Carry([plain[c] for c in order], expire_ms), schema, "Append", time)
    return out.select(*[F.col(n).alias(c) for c, n in plain.items()], "trace")


def started(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Start a query whose keyed state needs the store that keeps single values; the session's own choice is put back."""
    held = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        return writer.start()
    finally:
        spark.conf.unset(_STORE) if held is None else spark.conf.set(_STORE, held)


def write_back_batches(base: str, key: str, now: Column, source: str) -> Callable[[DataFrame, int], None]:
    """`foreachBatch` form of the write-back: unprocessed rows are enriched and written by key; echoes are dropped."""

    def apply(rows: DataFrame, batch: int) -> None:
        batches.write_batch(delivery.enriched(rows, now, source, key), base, batch, batches.newest_of([key]))

    return apply
