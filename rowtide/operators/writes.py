"""Keyed writes: each takes the table and the written rows and returns the table's next state."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rowtide.plans.sizes import SMALL_BYTES, row_bytes


class DuplicateKey(ValueError):
    """A written key is repeated, or already present where it must not be."""


def _check_unique(rows: DataFrame, key: Sequence[str]) -> int:
    """Refuse a repeated key; the rows' size in bytes comes from the same aggregate."""
    keys = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(rows.columns)).alias("bytes"))
    seen = keys.agg(F.max("n").alias("n"), F.max_by(F.struct(*key), "n").alias("key"), F.sum("bytes").alias("bytes")).first()
    if (seen["n"] or 0) > 1:
        raise DuplicateKey(f"written twice: {seen['key']}")
    return seen["bytes"] or 0


def insert(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Append rows; columns they do not name are null; a key that is taken or repeated is an error."""
    _check_unique(rows, key)
    taken = table.join(rows.select(*key), list(key), "left_semi").select(*key).take(1)
    if taken:
        raise DuplicateKey(f"already present: {taken[0]}")
    return table.unionByName(rows, allowMissingColumns=True)


def ignore_duplicates(table: DataFrame, rows: DataFrame, key: Sequence[str], first_by: str | None = None) -> DataFrame:
    """Append rows whose key is new; of a key written twice the row lowest by `first_by` is kept."""
    if first_by:
        rest = [c for c in rows.columns if c not in key]
        rows = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), first_by).alias("__r")).select(*key, "__r.*")
    else:
        rows = rows.dropDuplicates(list(key))
    fresh = rows.join(_present(table, rows, key), list(key), "left_anti")
    return table.unionByName(fresh, allowMissingColumns=True)


def _present(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """The table's keys that `rows` touches: reads key columns only, and is no larger than `rows`."""
    return table.select(*key).join(rows.select(*key), list(key), "left_semi")


def merge_duplicates(table: DataFrame, rows: DataFrame, key: Sequence[str], small: int = SMALL_BYTES) -> DataFrame:
    """Upsert: a row's supplied columns replace the stored ones, nulls included; new keys are appended.

    A change set of up to `small` bytes is broadcast and the table is not shuffled; a larger one is
    merged by one full outer join.
    """
    size = _check_unique(rows, key)
    supplied = [c for c in rows.columns if c not in key]
    marked = rows.select(*key, *[F.col(c).alias(f"__n_{c}") for c in supplied], F.lit(True).alias("__new"))

    def merge(joined: DataFrame) -> DataFrame:
        picked = {c: F.when(F.col("__new"), F.col(f"__n_{c}")).otherwise(F.col(c)) for c in supplied}
        return joined.withColumns(picked).select(*table.columns)

    if size > small:
        return merge(table.join(marked, list(key), "full"))
    updated = merge(table.join(F.broadcast(marked), list(key), "left"))
    touched = table.select(*key).join(F.broadcast(rows.select(*key)), list(key), "left_semi")
    return updated.unionByName(rows.join(touched, list(key), "left_anti"), allowMissingColumns=True)


def update_where(table: DataFrame, pred: Column, values: Mapping[str, Column]) -> DataFrame:
    """Set columns on rows where `pred` is true; a null predicate matches nothing."""
    hit = F.coalesce(pred, F.lit(False))
    kinds = {f.name: f.dataType for f in table.schema.fields}
    return table.withColumns({c: F.when(hit, v.cast(kinds[c])).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(table: DataFrame, pred: Column) -> DataFrame:
    """Rows where `pred` is not true."""
    return table.where(~F.coalesce(pred, F.lit(False)))


def returning(table: DataFrame, pred: Column, values: Mapping[str, Column] | None = None) -> DataFrame:
    """The rows an update (or, without values, a delete) touches, as the write leaves or removes them."""
    hit = table.where(pred)
    return hit.withColumns(dict(values)) if values else hit


def affected(table: DataFrame, pred: Column) -> DataFrame:
    """How many rows a predicate reaches."""
    return table.agg(F.count_if(pred).alias("affected"))


def json_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values as JSON text for JSON columns: a string becomes a JSON string, null stays null."""

    def text(c: str) -> Column:
        listed = F.to_json(F.array(c), {"ignoreNullFields": "false"})
        return F.when(F.col(c).isNotNull(), F.substring(listed, F.lit(2), F.length(listed) - 2))

    return df.withColumns({c: text(c) for c in columns})


def drop_all(df: DataFrame) -> int:
    """Consume a DataFrame and discard its rows; returns how many there were."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    return seen.get["rows"]


def route(df: DataFrame, collection: str, operation: Column, trace: Column, key: str) -> DataFrame:
    """(topic, key, value): each record goes to `flat-<collection>`, stamped with its operation, collection and trace."""
    stamps = {"operation": operation, "collection": F.col(collection), "traceparent": trace}
    own = [c for c in df.columns if c not in stamps]
    body = F.struct(*own, *[v.alias(n) for n, v in stamps.items()])
    return df.select(
        F.concat(F.lit("flat-"), collection).alias("topic"),
        F.col(key).cast("string").alias("key"),
        F.to_json(body, {"ignoreNullFields": "false"}).alias("value"),
    )


def to_kafka(routed: DataFrame, servers: str) -> None:
    """Send routed records; the `topic` column picks each record's topic."""
    routed.write.format("kafka").option("kafka.bootstrap.servers", servers).save()


def to_folders(routed: DataFrame, path: str) -> None:
    """The same routing into one folder per topic."""
    routed.write.partitionBy("topic").parquet(path)


def deliver(
    df: DataFrame,
    key: str,
    body: str,
    send: Callable[[str, str], int],
    retries: int = 3,
    first_wait: float = 2.0,
    longest_wait: float = 30.0,
    accepted: Sequence[int] = (200, 201, 204),
) -> DataFrame:
    """Send each row's body, retrying with doubling waits; (key, attempts, status, delivered) per row.

    `send(key, body)` returns a status and must absorb repeats by key: a lost task sends its rows
    again. Write the result once rather than evaluating it twice.
    """
    import pandas as pd

    def run(batches):
        import time

        for pdf in batches:
            out = []
            for k, text in zip(pdf[key], pdf[body]):
                wait, attempts, status = first_wait, 0, -1
                while attempts <= retries:
                    attempts += 1
                    try:
                        status = send(str(k), text)
                    except OSError:
                        status = -1
                    if status in accepted or attempts > retries:
                        break
                    time.sleep(wait)
                    wait = min(wait * 2, longest_wait)
                out.append((k, attempts, status, status in accepted))
            yield pd.DataFrame(out, columns=[key, "attempts", "status", "delivered"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, body).mapInPandas(run, f"{key} {kind}, attempts int, status int, delivered boolean")
