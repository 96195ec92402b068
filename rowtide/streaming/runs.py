"""Run a stream over what its source holds now and read the result as a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from rowtide.session import fresh_path


def drain(stream: DataFrame, mode: str = "append", start: Callable[[DataStreamWriter, SparkSession], StreamingQuery] = lambda writer, _: writer.start()) -> DataFrame:
    """Process all available input into a parquet table in the shared folder; returns that table."""
    spark = stream.sparkSession
    path, mark = fresh_path(spark, "stream"), fresh_path(spark, "mark")
    run = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", mark)
        .trigger(availableNow=True)
    )
    start(run, spark).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
