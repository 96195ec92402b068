"""Message steps: functions from a DataFrame of (`content`, `meta`) to another, batch and streaming alike.

`content` is a struct (or JSON text, where a step says so) and `meta` a map<string, string>.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rowtide.plans.groups import collect_parts

ERROR = "_error"  # the metadata key a failed step's message carries its error under
Step = Callable[[DataFrame], DataFrame]


def messages(df: DataFrame, content: Sequence[str | Column], meta: Mapping[str, Column] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Rows as messages; columns in `keep` stay beside them."""
    return df.select(*keep, F.struct(*content).alias("content"), _map(meta or {}).alias("meta"))


def _map(entries: Mapping[str, Column]) -> Column:
    if not entries:
        return F.from_json(F.lit("{}"), "map<string,string>")
    pairs = [x for k, v in entries.items() for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))]
    return F.create_map(*pairs)


def meta(key: str) -> Column:
    """A metadata value, '' when the message has none."""
    return F.coalesce(F.try_element_at("meta", F.lit(key)), F.lit(""))


def mapping(df: DataFrame, root: Mapping[str, Column] | None = None, meta: Mapping[str, Column] | None = None) -> DataFrame:
    """A new content (kept when `root` is None); metadata writes are merged over the old, after the content.

    Both read the message as it came in.
    """
    made = {}
    if root is not None:
        made["content"] = F.struct(*[c.alias(n) for n, c in root.items()])
    if meta:
        written = F.array(*[F.lit(k) for k in meta])
        old = F.map_filter("meta", lambda k, _: ~F.array_contains(written, k))
        made["meta"] = F.map_concat(old, _map(meta))
    return df.withColumns(made)


def drop_deleted(df: DataFrame, deleted: Column) -> DataFrame:
    """Messages a mapping deletes are dropped; an unknown answer keeps them."""
    return df.where(~F.coalesce(deleted, F.lit(False)))


def json_paths(df: DataFrame, paths: Mapping[str, str]) -> DataFrame:
    """JSON text content replaced by an object of path lookups; `$._meta.key` reads metadata.

    A null first path drops the message, as a null result does.
    """

    def look(path: str) -> Column:
        if path.startswith("$._meta."):
            return F.try_element_at("meta", F.lit(path.removeprefix("$._meta.")))
        return F.get_json_object("content", path)

    first = next(iter(paths.values()))
    out = df.where(look(first).isNotNull())
    return out.withColumn("content", F.struct(*[look(p).alias(n) for n, p in paths.items()]))


def branch(df: DataFrame, request: Step, steps: Sequence[Step], keep_original: bool = False) -> DataFrame:
    """Run steps on a mapped copy of each message; `keep_original` gives back the messages as they were."""
    out = reduce(lambda d, s: s(d), steps, request(df))
    return df if keep_original else out


def switch(df: DataFrame, cases: Sequence[tuple[Column | None, Sequence[Step]]]) -> DataFrame:
    """The first case that matches (or has no check) runs its steps; messages none matches pass through.

    Every case must give the columns the message has.
    """
    at = F.lit(len(cases))
    for i, (check, _) in reversed(list(enumerate(cases))):
        at = F.lit(i) if check is None else F.when(check, F.lit(i)).otherwise(at)
    chosen = df.withColumn("__case", at)
    arms = [reduce(lambda d, s: s(d), steps, chosen.where(F.col("__case") == i).drop("__case")) for i, (_, steps) in enumerate(cases)]
    arms.append(chosen.where(F.col("__case") == len(cases)).drop("__case"))
    return reduce(lambda a, b: a.unionByName(b), arms)


def switch_map(df: DataFrame, cases: Sequence[tuple[Column | None, Mapping[str, Column]]]) -> DataFrame:
    """`switch` whose cases only map content fields: one projection, no branches to union."""
    fields = list(cases[0][1])
    out = {}
    for f in fields:
        value = F.col(f"content.{f}")
        for check, root in reversed(cases):
            value = root[f] if check is None else F.when(check, root[f]).otherwise(value)
        out[f] = value
    return df.withColumn("content", F.struct(*[c.alias(n) for n, c in out.items()]))


def attempt(df: DataFrame, steps: Sequence[tuple[Column, Mapping[str, Column]]]) -> DataFrame:
    """Steps (error, new content) in turn: where `error` is not null the message is flagged and skips the rest."""
    failed = F.try_element_at("meta", F.lit(ERROR)).isNotNull()
    for error, root in steps:
        flagged = F.when(~failed & error.isNotNull(), F.map_concat("meta", F.create_map(F.lit(ERROR), error))).otherwise(F.col("meta"))
        run = ~failed & error.isNull()
        kept = df.schema["content"].dataType
        content = F.struct(*[F.when(run, c).otherwise(F.col(f"content.{n}") if n in kept.fieldNames() else F.lit(None)).alias(n)
                             for n, c in {**{n: F.col(f"content.{n}") for n in kept.fieldNames()}, **root}.items()])
        df = df.withColumns({"content": content, "meta": flagged})
    return df


def catch(df: DataFrame, root: Mapping[str, Column]) -> DataFrame:
    """Only flagged messages take the new content fields, with the flag readable; the flag is cleared."""
    failed = F.try_element_at("meta", F.lit(ERROR)).isNotNull()
    names = df.schema["content"].dataType.fieldNames()
    content = F.struct(*[F.when(failed, root[n]).otherwise(F.col(f"content.{n}")).alias(n) if n in root else F.col(f"content.{n}").alias(n) for n in names])
    return df.withColumns({"content": content, "meta": F.map_filter("meta", lambda k, _: k != ERROR)})


def must_succeed(df: DataFrame) -> DataFrame:
    """Fail the run on a message that is still flagged."""
    error = F.try_element_at("meta", F.lit(ERROR))
    said = F.concat(F.lit("a step failed and nothing caught it: "), error)
    return df.withColumn("meta", F.when(error.isNotNull(), F.raise_error(said)).otherwise(F.col("meta")))


def unarchive(df: DataFrame, kind: str = "string") -> DataFrame:
    """JSON text content that is an array becomes one message per element, metadata kept; anything else none."""
    return df.withColumn("content", F.explode(F.from_json("content", f"array<{kind}>")))


def archive(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """Messages of each key as JSON arrays of `size` in order: (keys, part, content)."""
    parts = collect_parts(df, keys, order, F.col("content"), size, "__items")
    return parts.withColumn("content", F.to_json("__items")).drop("__items")


def enrich(df: DataFrame, column: str, call: Callable[[str], str], name: str = "response") -> DataFrame:
    """A request per row of a text column; the response text is added as `name`. The client runs inside tasks."""
    schema = StructType([*df.schema.fields, StructField(name, StringType())])

    def run(batches):
        for pdf in batches:
            yield pdf.assign(**{name: [call(x) for x in pdf[column]]})

    return df.mapInPandas(run, schema)


def log(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """Pass messages through; the observation holds the metrics once the run is over."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), seen


def retried(apply: Callable[[DataFrame, int], None], times: int = 3, wait: float = 2.0, longest: float = 30.0) -> Callable[[DataFrame, int], None]:
    """A batch function that is tried again after a failure, with doubling waits; the last failure stands."""
    import time

    def run(rows: DataFrame, batch: int) -> None:
        pause = wait
        for left in range(times, -1, -1):
            try:
                return apply(rows, batch)
            except Exception:
                if not left:
                    raise
                time.sleep(pause)
                pause = min(pause * 2, longest)

    return run
