"""Session settings and the shared folder that durable intermediate tables go to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Adaptive execution re-plans joins from measured sizes and splits skewed join partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the JVM never compiles longer generated methods; beyond it Spark splits an expression into small ones
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
}


def session(name: str = "rowtide", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators assume; `extra` uses `__` for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by `spark.checkpoint.dir`.

    A local session (tests) without one gets a fresh temporary folder; a cluster must name its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="rowtide-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """Write `df` as a parquet table in the shared folder and read it back.

    This drops the lineage and survives lost executors like a checkpoint, but computes the rows only
    once and keeps them columnar, so later readers take only the columns they need.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """A table that grows by rounds: each writes its new rows into a folder of its own below one shared path."""

    def __init__(self, spark: SparkSession, label: str, schema: StructType):
        self.spark, self.schema, self.path, self.number = spark, schema, fresh_path(spark, label), 0

    def add(self, new: DataFrame) -> DataFrame:
        """Write a round's rows and read them back."""
        path = f"{self.path}/round-{self.number:06d}"
        new.select(*self.schema.fieldNames()).write.parquet(path)
        self.number += 1
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        """The rows of all rounds so far."""
        if not self.number:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)
