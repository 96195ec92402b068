"""Tables published together as whole versions: a commit is one small file that names the path of every table.

The file is written last and only if no other writer has taken its version, so readers see all tables of a commit or none, and
of two writers that start from one version one is refused. Where a table format with commits of its own is available, it
takes the place of this.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from rowtide.sources import files
from rowtide.sources.batches import merged, read_batches, write_batch  # noqa: F401  kept under their old place


class VersionTaken(RuntimeError):
    """Another writer has published the version this one was about to."""


def _file(base: str, version: int) -> str:
    return f"{base}/commits/{version:012d}.json"


def newest(spark: SparkSession, base: str) -> tuple[int, dict[str, str]]:
    """(version, path of each table) of the newest commit below `base`; version 0 before the first. Reads one file."""
    found = files.names(spark, f"{base}/commits")
    return (int(found[-1].removesuffix(".json")), json.loads(files.text(spark, f"{base}/commits/{found[-1]}"))) if found else (0, {})


def commit(tables: Mapping[str, DataFrame], base: str, onto: int | None = None) -> int:
    """Publish the next state of several tables at once; tables not named keep theirs. Returns the version.

    A failure before the last step leaves the current version as it was. `onto` is the version the tables
    were made from, the current one by default: if another has been published since, `VersionTaken` is raised and nothing changes.
    """
    spark = next(iter(tables.values())).sparkSession
    version, paths = newest(spark, base)
    if onto not in (None, version):
        raise VersionTaken(f"made from version {onto}, but {version} is current")
    number, claim = version + 1, uuid.uuid4().hex
    new = {name: f"{base}/data/{name}/v{number}-{claim}" for name in tables}
    for name, df in tables.items():
        df.write.parquet(new[name])
    if not files.create(spark, _file(base, number), json.dumps({**paths, **new})):
        raise VersionTaken(f"version {number} is published")
    return number


def capture(spark: SparkSession, base: str, schemas: Mapping[str, object]) -> dict[str, DataFrame]:
    """The tables named in `schemas`, all of one commit; later publications do not show through."""
    _, paths = newest(spark, base)
    missing = sorted(set(schemas) - set(paths))
    if missing:
        raise LookupError(f"no published version of {missing}")
    return {name: spark.read.schema(schema).parquet(paths[name]) for name, schema in schemas.items()}
