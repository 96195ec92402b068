"""Computations: declared queries over declared tables, calculated and published, whole or per partition."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from rowtide.functions.ids import content_key
from rowtide.functions.rows import micros
from rowtide.operators import publish
from rowtide.plans.groups import HOT_ROWS, collect_parts, hot_groups, number_rows, running
from rowtide.session import Rounds, stored

Tables = Mapping[str, DataFrame]

@dataclass(frozen=True)
class Computation:
    """Named queries over `reads`, a calculation from their results to `{sink: rows}`, and its sinks."""

    name: str
    reads: Sequence[str]
    queries: Mapping[str, Callable[[Tables], DataFrame]]
    calculate: Callable[[Tables], Tables]
    to: Sequence[str]
    sink_writes: Mapping[str, str] = field(default_factory=dict)
    on_complete: Callable[[], None] | None = None


def run(spec: Computation, lookup: Callable[[str], DataFrame], sinks: Tables) -> dict[str, DataFrame]:
    """Publication actions per sink. The result must name exactly the declared sinks and be sound."""
    tables = {n: lookup(n) for n in spec.reads}
    outputs = dict(spec.calculate({n: q(tables) for n, q in spec.queries.items()}))
    publish.check_sinks(spec.to, outputs)
    for name, rows in outputs.items():
        publish.check_columns(sinks[name].schema, rows.schema)
        bad = publish.violations(rows).take(1)
        if bad:
            raise ValueError(f"{spec.name}: {name}: {bad[0]}")
    return {n: publish.actions(sinks[n], rows, keep_omitted=spec.sink_writes.get(n) == "upsert") for n, rows in outputs.items()}


def coverage(reads: DataFrame, sources: DataFrame, sinks: DataFrame | None = None, parents: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """(name, cover): all a computation depends on and writes to, as sorted (role, table, revision) of `reads`, `to` and `parent`.

    `reads` and `sinks` are (name, table), `sources` (table, revision); `parents` is (name, table) of the computations
    a computation waits for and `runs` (table, revision) how often each has completed. There is no cover where a table is
    unknown, a parent has not completed, or parents are all there is. The list is as long as the declaration.
    """
    used = reads.select("name", F.lit("reads").alias("role"), "table")
    if sinks is not None:
        used = used.unionByName(sinks.select("name", F.lit("to").alias("role"), "table"))
    joined = used.join(sources, "table", "left")
    if parents is not None:
        done = parents.join(runs.where("revision > 0"), "table", "left")
        joined = joined.unionByName(done.select("table", "name", F.lit("parent").alias("role"), "revision"))
    pairs = F.sort_array(F.collect_list(F.struct("role", "table", "revision")))
    known = F.bool_and(F.col("revision").isNotNull()) & F.bool_or(F.col("role") != "parent")
    listed = joined.groupBy("name").agg(pairs.alias("cover"), known.alias("__known"))
    return listed.select("name", F.when(F.col("__known"), F.col("cover")).alias("cover"))


def stale(specs: DataFrame, covers: DataFrame, completed: DataFrame) -> DataFrame:
    """(name, stale): whether a computation's (version, cover) differs from the completed one's, or has none."""
    now = specs.join(covers, "name", "left").select("name", F.struct("version", "cover").alias("__now"), F.col("cover").alias("__cover"))
    then = completed.select("name", F.struct("version", "cover").alias("__then"))
    joined = now.join(then, "name", "left")
    return joined.select("name", (F.col("__cover").isNull() | ~F.col("__now").eqNullSafe(F.col("__then"))).alias("stale"))


def unchanged(current: DataFrame, completed: DataFrame) -> DataFrame:
    """Computations (name, version, digest, sink_revision) that need no recalculation: all equal the completed run's."""
    on = ["name", "version", "digest", "sink_revision"]
    return current.join(completed.select(*on), on, "left_semi").select("name")


def by_partition(
    df: DataFrame,
    partition: str,
    order: Sequence[str],
    partial: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    merge: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
    rows: int | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """A pure calculation per partition, in the way the caller chooses for partitions of every size.

    Without `merge` each partition is one call of `partial`. With it every partition is cut into ordered pieces of
    `rows`, `partial` runs on each piece and `merge` combines the pieces' results, also where there is one piece only.
    """
    if (merge is None) != (rows is None):
        raise ValueError("pieces need both merge and rows")
    if merge is None:
        return df.groupBy(partition).applyInPandas(partial, schema)
    numbered = number_rows(df, [partition], order, "__rn", hot_rows)
    pieces = numbered.withColumn("__piece", F.floor((F.col("__rn") - 1) / rows)).drop("__rn")

    def piece(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return partial(pdf.drop(columns="__piece"))

    return pieces.groupBy(partition, "__piece").applyInPandas(piece, schema).groupBy(partition).applyInPandas(merge, schema)


def changed_only(df: DataFrame, partition: Column, changed: DataFrame, name: str = "__partition") -> DataFrame:
    """Rows of the partitions named in `changed` (one column `key`), with their partition as text."""
    keyed = df.withColumn(name, F.coalesce(partition.cast("string"), F.lit("")))
    return keyed.join(changed.select(F.col("key").alias(name)).distinct(), name, "left_semi")


def iterate(plan: Callable[[DataFrame], DataFrame], work: Callable[[DataFrame], DataFrame], finish: Callable[[DataFrame], DataFrame], schema: str, rounds: int = 100) -> DataFrame:
    """Plan jobs (key, input) from all answers so far, run the new ones, and finish when a round plans none.

    `work` maps new jobs to answers of `schema`, which starts with `key`. A plan that no longer names
    an answered job, or gives it another input, is refused. Only keys and digests of inputs are stored; a round's plan is
    read once for them and once more, with its inputs, where there is new work.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    known = Rounds(spark, "answers", spark.createDataFrame([], schema).schema)
    ran = None
    for _ in range(rounds):
        answers = known.all()
        planned = plan(answers)
        jobs = fresh = stored(planned.select("key", F.sha2("input", 256).alias("__input")), "jobs")
        if ran is not None:
            if ran.join(jobs, ["key", "__input"], "left_anti").take(1):
                raise ValueError("a later plan drops a job that has an answer, or gives it another input")
            fresh = jobs.join(ran.select("key"), "key", "left_anti")
        if not fresh.take(1):
            return finish(answers)
        # before the first answer every job is new
        known.add(work(planned if ran is None else planned.join(fresh.select("key"), "key", "left_semi")))
        ran = jobs
    raise RuntimeError(f"no end after {rounds} rounds")


def cached(jobs: DataFrame, cache: DataFrame, work: Callable[[DataFrame], DataFrame], now: Column) -> tuple[DataFrame, DataFrame]:
    """(answers of all jobs, next cache): equal (code, command, input) is computed once, known answers not at all.

    `jobs` has `code`, `command` and `input`, each may be null; `cache` is (key, answer, accessed); `work` adds `answer`.
    A cache that answers one key in different ways is refused.
    """
    if split := conflicts(cache).take(1):
        raise ValueError(f"the cache holds {split[0]['answers']} answers of {split[0]['key']}")
    keyed = jobs.withColumn("key", content_key(F.col("code"), F.col("command"), F.col("input")))
    wanted = keyed.select("key", "code", "command", "input").dropDuplicates(["key"])
    misses = wanted.join(cache.select("key"), "key", "left_anti")
    fresh = stored(work(misses).select("key", "answer"), "answers")
    hits = cache.join(wanted.select("key", F.lit(True).alias("__hit")), "key", "left")
    touched = hits.withColumn("accessed", F.when(F.col("__hit"), now).otherwise(F.col("accessed"))).drop("__hit")
    store = touched.unionByName(fresh.withColumn("accessed", now))
    return keyed.join(store.select("key", "answer").dropDuplicates(["key"]), "key"), store


def conflicts(answers: DataFrame) -> DataFrame:
    """(key, answers) of keys that were answered in different ways; a pure job has none."""
    return answers.groupBy("key").agg(F.count_distinct("answer").alias("answers")).where("answers > 1")


def evicted(cache: DataFrame, entries: int, size: int, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """The cache cut to its most recently used answers within both limits."""
    aged = cache.withColumns({"__age": -micros(cache, "accessed"), "__bytes": F.octet_length("answer").cast("bigint") + 128})
    aged = aged.withColumn("__back", F.reverse("key"))  # a tie-break that is fixed and spreads over slices
    hot = hot_groups(aged, [], hot_rows)
    ranked = running(aged, [], ["__age", "__back"], "__n", "count", hot_rows=hot_rows, hot=hot)
    sized = running(ranked, [], ["__age", "__back"], "__total", "sum", "__bytes", hot_rows, hot)
    return sized.where((F.col("__n") <= entries) & (F.col("__total") <= size)).select(*cache.columns)


def select_fields(answer: Column, names: Sequence[str]) -> Column:
    """An answer's JSON object with only the named top-level properties, in that order; null when it is no object."""
    if not names:
        raise ValueError("name at least one field")
    members = F.from_json(answer, "map<string,variant>")
    listed = [
        F.when(F.map_contains_key(members, n), F.concat(F.lit(f"{json.dumps(n)}:"), F.coalesce(F.to_json(F.element_at(members, n)), F.lit("null"))))
        for n in dict.fromkeys(names)
    ]
    return F.when(F.ltrim(answer).startswith("{"), F.concat(F.lit("{"), F.concat_ws(",", *listed), F.lit("}")))


def nest(parents: DataFrame, key: str, path: Sequence[str], rows: DataFrame, row_key: str, order: str, size: int) -> DataFrame:
    """Fill the empty array at `path` of each parent's struct column with its rows in order, the order column dropped.

    `path` is (struct column, field, …). A parent with more than `size` rows continues in further
    parts. Order keys are unique per parent and not negative.
    """
    bad = rows.groupBy(row_key, order).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | (F.col(order) < 0) | F.col(order).isNull())
    if bad.take(1):
        raise ValueError(f"{order} must be unique and not negative")
    shown = [c for c in rows.columns if c not in (row_key, order)]
    parts = collect_parts(rows, [row_key], [order], F.struct(*shown), size, "__rows")
    joined = parents.join(parts, parents[key] == parts[row_key], "left").drop(parts[row_key])
    kind = parts.schema["__rows"].dataType.simpleString()
    filled = F.coalesce(F.col("__rows"), F.array().cast(kind))
    column = F.col(path[0]).withField(".".join(path[1:]), filled)
    return joined.withColumns({path[0]: column, "part": F.coalesce("part", F.lit(0))}).drop("__rows")


def stages(tables: Tables, steps: Sequence[tuple[str, str | Callable[[Tables], DataFrame], bool]]) -> DataFrame:
    """Named relations in order, each over the tables and earlier ones; the last one is the result.

    A step is (name, SQL naming relations as {name} or a function, keep). A kept step is written once
    and read by all later ones; the others stay one plan.
    """
    known, last = dict(tables), None
    spark = next(iter(known.values())).sparkSession
    for name, step, keep in steps:
        last = spark.sql(step, **known) if isinstance(step, str) else step(known)
        if keep:
            last = stored(last, name)
        known[name] = last
    return last


def check_result(schema: StructType, declared: Sequence[str]) -> None:
    """A query's result has the declared columns even when it has no rows."""
    if sorted(schema.fieldNames()) != sorted(declared):
        raise ValueError(f"declared {sorted(declared)}, got {sorted(schema.fieldNames())}")
