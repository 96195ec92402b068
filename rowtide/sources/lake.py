"""A published lake: parquet files, a catalog of their schemas, and a manifest that lists them."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _put(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def _get(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).where("value <> ''").first()[0])


def publish(tables: Mapping[str, DataFrame], base: str) -> None:
    """Write the tables, then the catalog, then the manifest; readers see the lake once that exists."""
    base, files, schemas = base.rstrip("/"), [], {}
    for name, df in tables.items():
        path = f"{base}/data/{name}"
        df.write.parquet(path)
        written = df.sparkSession.read.schema(df.schema).parquet(path).inputFiles()
        files += sorted(f"data/{name}/" + f.rsplit("/", 1)[1] for f in written)
        schemas[name] = df.schema.jsonValue()
    spark = next(iter(tables.values())).sparkSession
    _put(spark, json.dumps({"tables": schemas}), f"{base}/catalog.json")
    _put(spark, json.dumps({"catalog": "catalog.json", "files": files}), f"{base}/manifest.json")


def attach(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The lake's tables, each read from exactly the files the manifest lists."""
    base = base.rstrip("/")
    manifest = _get(spark, f"{base}/manifest.json")
    out = {}
    for name, schema in _get(spark, f"{base}/{manifest['catalog']}")["tables"].items():
        files = [f"{base}/{f}" for f in manifest["files"] if f.startswith(f"data/{name}/")]
        fields = StructType.fromJson(schema)
        out[name] = spark.read.schema(fields).parquet(*files) if files else spark.createDataFrame([], fields)
    return out
