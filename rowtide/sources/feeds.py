"""Record feeds: JSON topics, row envelopes, heartbeats, change logs, databases and objects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowtide.plans.sizes import rows_within


def kafka_json(spark: SparkSession, servers: str, topic: str, schema: str) -> DataFrame:
    """A JSON topic as a typed stream from its earliest record."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .load()
    )
    return json_records(raw.select(F.col("value").cast("string").alias("value")), schema)


def json_records(df: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """The declared fields of each JSON record; text that is not JSON gives nulls."""
    return df.select(F.from_json(column, schema).alias("__r")).select("__r.*")


def unwrap_envelope(df: DataFrame, schema: str, key: str = "id", column: str = "data") -> DataFrame:
    """Rows carried as JSON text in `column`; bad JSON counts as an empty row, and rows without a key are dropped."""
    rest = [c for c in df.columns if c != column]
    return df.select(F.from_json(column, schema).alias("__r"), *rest).select("__r.*", *rest).where(F.col(key).isNotNull())


def with_heartbeat(stream: DataFrame, beats: DataFrame, at: str, **fixed: Column) -> DataFrame:
    """Union generated records (column `timestamp`) into a stream so that event time moves when input is idle.

    Columns not given in `fixed` are null in a heartbeat. Put it before the watermark, and leave beats
    out inside the aggregate: a filter on them would be pushed below the watermark and stop it.
    """
    kinds = {f.name: f.dataType for f in stream.schema.fields}
    made = {at: F.col("timestamp").cast(kinds[at]), **fixed}
    cols = [made.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()]
    return stream.unionByName(beats.select(*cols))


def every(spark: SparkSession, seconds: int = 5) -> DataFrame:
    """One generated record per `seconds`."""
    return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("advanceMillisPerBatch", seconds * 1000).load()


def change_log(log: DataFrame, after: int, target: int, pruned: int = 0, limit: int | None = None) -> DataFrame | None:
    """One table's log entries in (after, target], or None when the caller has to reload the table.

    Reload when the anchor entry was pruned or is absent, when the reader is ahead of the target, or
    when there are more than `limit` entries, when a limit is given.
    """
    if after > target or (pruned > 0 and after <= pruned):
        return None
    if after > 0 and not log.where(F.col("seq") == after).take(1):
        return None
    entries = log.where((F.col("seq") > after) & (F.col("seq") <= target))
    return entries if limit is None or rows_within(entries, limit) else None


def jdbc(spark: SparkSession, url: str, query: str, split: tuple[str, str, str, int] | None = None, **options: str) -> DataFrame:
    """Rows of a query the database runs; `split` (column, lower, upper, parts) reads it in parallel."""
    reader = spark.read.format("jdbc").options(**jdbc_options(url, query, split), **options)
    return reader.load()


def jdbc_options(url: str, query: str, split: tuple[str, str, str, int] | None = None) -> dict[str, str]:
    """Reader options: a split read names the query as a derived table, since `query` cannot be split."""
    if split is None:
        return {"url": url, "query": query}
    column, lower, upper, parts = split
    return {"url": url, "dbtable": f"({query}) AS q", "partitionColumn": column, "lowerBound": lower, "upperBound": upper,
            "numPartitions": str(parts)}


def objects(spark: SparkSession, path: str, glob: str = "*", content: bool = False) -> DataFrame:
    """Objects under a prefix with their size; contents are not read unless asked for."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select("path", "length", *(["content"] if content else []))


def check_content(found: DataFrame) -> DataFrame:
    """`matches`: whether an object's bytes hash to the SHA-256 its name `<sha256>[-suffix].ext` starts with."""
    named = F.regexp_extract("path", r"(?:^|/)([0-9a-f]{64})(?:-[^/]*)?\.[^/.]+$", 1)
    return found.withColumn("matches", F.sha2("content", 256) == named)


def start_sweep(current: DataFrame, stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Replay the table's current rows as inserts through the same batch function, then follow the stream.

    `apply(rows, batch)` must be idempotent per key, since the stream may repeat swept rows. The sweep
    is batch -1; stream batches count from 0. Returns the started query.
    """
    apply(current, -1)
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
