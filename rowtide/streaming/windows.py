"""Windowed stream aggregation with bounded state per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowtide.plans.groups import collect_parts
from rowtide.session import stored
from rowtide.sources import batches


def window_texts(stream: DataFrame, at: str, size: str, late: str, key: str, text: str, slide: str | None = None, part: Column | None = None) -> DataFrame:
    """Per window: how many distinct (key, text) there were and their texts joined in order.

    Repeats are dropped per window before anything is collected. `part` spreads one window's texts
    over several state rows; null texts are counted and not joined. For windows of any size take `window_rows` and `emit_parts`.
    """
    timed = stream.withWatermark(at, late).withColumn("window", F.window(F.col(at), size, slide))
    once = timed.withColumn("part", F.lit(0) if part is None else part).select("window", "part", key, text)
    once = once.dropDuplicates(["window", "part", key, text])
    out = once.groupBy("window", "part").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(text)).alias("texts"))
    return out.select(F.col("window.start").alias("window_start"), "part", "n", F.array_join("texts", ", ").alias("messages"))


def window_rows(stream: DataFrame, at: str, size: str, late: str, key: str, text: str, slide: str | None = None) -> DataFrame:
    """The distinct (key, text) of each window as rows (window_start, key, text), once the window has closed.

    Every state row holds one key and one text, however many a window has; nothing is collected.
    """
    timed = stream.withWatermark(at, late).withColumn("window", F.window(F.col(at), size, slide))
    once = timed.groupBy("window", key, text).agg(F.count(F.lit(1)).alias("n"))
    return once.select(F.col("window.start").alias("window_start"), key, text)


def in_parts(closed: DataFrame, key: str, text: str, size: int, least: int) -> DataFrame:
    """Closed windows with `least` records as (window_start, part, n, messages): `size` texts in order a part, null texts last.

    A window of any number of texts is ordered over many tasks, and its parts one after the other are all its texts in order.
    """
    total = closed.groupBy("window_start").agg(F.count(F.lit(1)).alias("__total")).where(F.col("__total") >= least)
    rows = closed.join(total.select("window_start"), "window_start", "left_semi").withColumn("__last", F.col(text).isNull())
    parts = collect_parts(rows, ["window_start"], ["__last", text, key], F.col(text), size, "__texts")
    joined = F.array_join(F.array_compact("__texts"), ", ")
    return parts.select("window_start", "part", F.size("__texts").cast("bigint").alias("n"), joined.alias("messages"))


def emit_parts(stream: DataFrame, key: str, text: str, base: str, checkpoint: str, size: int, least: int = 2, first_batch: int = 0, **trigger):
    """Write the parts of closed windows (of `window_rows`) as keyed batches below `base`; returns the started query."""

    def write(closed: DataFrame, batch: int) -> None:
        closed = stored(closed, "closed")  # read three times below; the stateful stages behind it run once
        batches.write_batch(keyed_by_window(in_parts(closed, key, text, size, least)), base, first_batch + batch, batches.newest_of(["id"]))

    writer = stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def at_least(closed: DataFrame, least: int) -> DataFrame:
    """Windows with `least` distinct records over all their parts. A window's parts close together, in one batch."""
    total = closed.groupBy("window_start").agg(F.sum("n").alias("__total")).where(F.col("__total") >= least)
    return closed.join(total.select("window_start"), "window_start", "left_semi")


def keyed_by_window(closed: DataFrame) -> DataFrame:
    """Rows with a key derived from their window and part, so that a window written twice is one row."""
    text = F.concat_ws("|", F.col("window_start").cast("string"), F.col("part").cast("string"))
    return closed.withColumn("id", F.sha2(text, 256))


def emit(stream: DataFrame, base: str, checkpoint: str, least: int = 2, first_batch: int = 0, **trigger):
    """Write closed windows with `least` records as keyed batches below `base`; returns the started query.

    A replayed batch overwrites its own files, and a replay under a new checkpoint writes rows with the
    same keys, so reading the newest row per key shows each window once.
    """

    def write(closed: DataFrame, batch: int) -> None:
        closed = closed.persist()  # read twice below; the stateful stages behind it should run once
        batches.write_batch(keyed_by_window(at_least(closed, least)), base, first_batch + batch, batches.newest_of(["id"]))
        closed.unpersist()

    writer = stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def dedup(stream: DataFrame, at: str, late: str, key: list[str]) -> DataFrame:
    """Drop records delivered again within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key)
