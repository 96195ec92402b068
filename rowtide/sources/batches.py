"""A table kept as files per batch and merged on read, whose old batches are folded together.

Batch numbers grow. Each batch is a folder of its own; `fanout` old ones are merged into one folder of the first level, `fanout` of
those into one of the second, and so on, so that a row is rewritten once a level and a reader opens a number of folders that
grows with the logarithm of the batches. The newest batch stays apart, as a restart may write it again; a batch up to the
highest folded number is a replay and adds nothing. A folder counts once its success mark is there, and a folder inside another
one's range is no longer read, so a failure between any two steps loses and doubles nothing. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rowtide.sources import files

FANOUT = 10
_FOLDS = "folds"


def _folds(spark: SparkSession, base: str) -> Iterator[tuple[int, int, int]]:
    """(level, first batch, last batch) of complete folds that lie inside no other."""
    found = []
    for name in files.names(spark, f"{base}/{_FOLDS}"):
        level, first, last = map(int, name.split("-"))
        if files.exists(spark, f"{base}/{_FOLDS}/{name}/_SUCCESS"):
            found.append((level, first, last))
    for level, first, last in found:
        if not any(a <= first and last <= b and k > level for k, a, b in found):
            yield level, first, last


def _batches(spark: SparkSession, base: str) -> list[int]:
    return sorted(int(n.removeprefix("batch=")) for n in files.names(spark, base) if n.startswith("batch="))


def _fold_path(base: str, level: int, first: int, last: int) -> str:
    return f"{base}/{_FOLDS}/{level}-{first}-{last}"


def layout(spark: SparkSession, base: str) -> tuple[list[tuple[int, int, int]], list[int]]:
    """What a reader opens: folds in the order of their batches, then the batches beyond them."""
    folds = sorted(_folds(spark, base), key=lambda f: f[1])
    mark = max((last for _, _, last in folds), default=-1)
    return folds, [b for b in _batches(spark, base) if b > mark]


def write_batch(df: DataFrame, base: str, batch_id: int, fold: Callable[[DataFrame], DataFrame] | None = None, fanout: int = FANOUT) -> None:
    """Write one batch's rows; repeating the batch overwrites the same files, so replays add nothing.

    `fold` merges the rows of several batches (with their `batch` number) into the rows to keep; without it they are kept as they are.
    """
    spark = df.sparkSession
    folds, _ = layout(spark, base)
    if any(batch_id <= last for _, _, last in folds):
        return
    df.write.mode("overwrite").parquet(f"{base}/batch={batch_id}")
    _fold(spark, base, df.schema, fold, fanout)


def _fold(spark: SparkSession, base: str, schema: T.StructType, fold: Callable[[DataFrame], DataFrame] | None, fanout: int) -> None:
    keep = fold or (lambda rows: rows)

    def write(rows: DataFrame, level: int, first: int, last: int) -> None:
        rows = keep(rows)
        if "batch" not in rows.columns:  # what has been merged belongs to the last of the batches
            rows = rows.withColumn("batch", F.lit(last).cast("bigint"))
        rows.write.mode("overwrite").parquet(_fold_path(base, level, first, last))

    _, single = layout(spark, base)
    if len(single) > fanout:
        some = single[:fanout]
        write(_read(spark, base, schema, [], some), 1, some[0], some[-1])
    level = 1
    while len(own := [f for f in layout(spark, base)[0] if f[0] == level]) >= fanout:
        own = own[:fanout]
        write(_read(spark, base, schema, own, []), level + 1, own[0][1], own[-1][2])
        level += 1


def _read(spark: SparkSession, base: str, schema: T.StructType, folds: Sequence[tuple[int, int, int]], single: Sequence[int]) -> DataFrame:
    numbered = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    parts = []
    if folds:
        parts.append(spark.read.schema(numbered).parquet(*[_fold_path(base, *f) for f in folds]))
    if single:
        parts.append(spark.read.schema(numbered).option("basePath", base).parquet(*[f"{base}/batch={b}" for b in single]))
    if not parts:
        return spark.createDataFrame([], numbered)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_batches(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """All rows of all batches, with their `batch` number; of merged batches what the fold kept."""
    return _read(spark, base, T.StructType.fromDDL(schema), *layout(spark, base))


def sweep(spark: SparkSession, base: str) -> int:
    """Delete folders that lie inside a complete fold, once no reader that began before needs them; how many there were."""
    folds, single = layout(spark, base)
    paths = [f"{base}/batch={b}" for b in _batches(spark, base) if b not in set(single)]
    own = {f"{level}-{a}-{b}" for level, a, b in folds}
    for name in files.names(spark, f"{base}/{_FOLDS}"):
        level, first, last = map(int, name.split("-"))
        if name not in own and any(a <= first and last <= b and k > level for k, a, b in folds):
            paths.append(f"{base}/{_FOLDS}/{name}")
    for path in paths:
        files.remove(spark, path)
    return len(paths)


def newest_of(key: Sequence[str], order: Sequence[str] = ("batch",)) -> Callable[[DataFrame], DataFrame]:
    """A fold that keeps the newest row of each key."""
    return lambda rows: rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), F.struct(*order)).alias("__row")).select(*key, "__row.*")


def merged(batches: DataFrame, key: Sequence[str], order: Sequence[str] = ("batch",)) -> DataFrame:
    """The newest row of each key over all batches."""
    return newest_of(key, order)(batches).drop("batch")
