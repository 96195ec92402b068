"""Small files of a folder through Hadoop's file systems, from the driver: names, whole texts, files that only one writer can create."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder, in order; none if there is no such folder. Hidden ones are left out."""
    at, system = _path(spark, folder)
    if not system.exists(at):
        return []
    found = [status.getPath().getName() for status in system.listStatus(at)]
    return sorted(n for n in found if not n.startswith((".", "_")))


def exists(spark: SparkSession, path: str) -> bool:
    at, system = _path(spark, path)
    return system.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder with all that is in it."""
    at, system = _path(spark, path)
    system.delete(at, True)


def text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    at, system = _path(spark, path)
    stream = system.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def create(spark: SparkSession, path: str, content: str) -> bool:
    """Put a file with its whole content at `path` unless there is one; whether this call put it there.

    The content is written under a hidden name first and then takes its name in one step that fails where the name is
    taken: a hard link on a local or mounted disk, a rename without overwriting elsewhere, which HDFS does atomically. So of
    any number of writers exactly one succeeds, and no reader sees part of a file.
    """
    at, system = _path(spark, path)
    jvm = spark._jvm
    system.mkdirs(at.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{uuid.uuid4().hex}")
    out = system.create(draft, False)
    out.write(bytearray(content.encode()))
    out.close()
    at, draft = system.resolvePath(at.getParent()).suffix(f"/{at.getName()}"), system.resolvePath(draft)
    try:
        if at.toUri().getScheme() == "file":
            java = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(java(at), java(draft))
        else:
            never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, at, never)
    except Py4JJavaError as e:
        if "AlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
    finally:
        system.delete(draft, False)
    return True


def in_order(spark: SparkSession, folder: str, seconds: int = 1_000_000_000) -> None:
    """Give the data files of a folder ascending times in the order of their names, which is the order a file stream takes them in."""
    at, system = _path(spark, folder)
    for k, name in enumerate(names(spark, folder)):
        system.setTimes(spark._jvm.org.apache.hadoop.fs.Path(at, name), (seconds + k) * 1000, -1)
