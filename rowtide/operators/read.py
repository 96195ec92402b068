"""The declarative read: projection, filters, embeds, grouped aggregates, order and paging."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowtide.plans.groups import collect_parts

COMPARE = {
    "eq": lambda c, v: c == v,
    "neq": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
}


@dataclass(frozen=True)
class Param:
    """A positional parameter, counted from 1; a position that was not supplied binds NULL."""

    position: int


# A predicate is (column, operator, value), ("and" | "or", [predicates]) or ("not", predicate).
Predicate = tuple


def condition(pred: Predicate, params: Sequence[Any] = (), df: DataFrame | None = None) -> Column:
    """The three-valued condition a predicate states; `df` qualifies column names when given."""
    if pred[0] in ("and", "or") and len(pred) == 2:
        parts = [condition(p, params, df) for p in pred[1]]
        return reduce((lambda a, b: a & b) if pred[0] == "and" else (lambda a, b: a | b), parts)
    if pred[0] == "not":
        return ~condition(pred[1], params, df)
    name, op, value = pred
    if isinstance(value, Param):
        value = params[value.position - 1] if value.position <= len(params) else None
    negate = op.startswith("not.")
    op = op.removeprefix("not.")
    c = df[name] if df is not None else F.col(name)
    out = _simple(c, op, value, negate)
    return ~out if negate else out


def _simple(c: Column, op: str, value: Any, negate: bool) -> Column:
    if op in COMPARE:
        return COMPARE[op](c, F.lit(value))
    if op in ("like", "ilike"):
        if not negate and re.fullmatch(r"[*%]+", value):
            return c.isNotNull()
        pattern = value.replace("*", "%")
        return c.like(pattern) if op == "like" else c.ilike(pattern)
    if op == "is":
        word = str(value).lower()
        if word in ("null", "none"):
            return c.isNull()
        if word == "unknown":
            return c.cast("boolean").isNull()
        if word in ("true", "false"):
            return c.eqNullSafe(F.lit(word == "true"))
        raise ValueError(f"invalid is value {value}")
    if op == "in":
        return c.isin(*value) if value else F.lit(False)
    if op == "any":
        return F.lit(None).cast("boolean") if value is None else c.isin(*value) if value else F.when(c.isNotNull(), F.lit(False))
    if op == "plfts":
        return text_match(c, value)
    raise ValueError(f"unsupported operator {op}")


def text_match(c: Column, query: str) -> Column:
    """Every term of `query` occurs in the text as a whole word, case-folded; no stemming."""
    terms = [t for t in re.split(r"[^\w]+", query.lower()) if t]
    if not terms:
        return F.lit(False)
    low, word = F.lower(c), r"[\p{L}\p{N}]"
    return reduce(lambda a, b: a & b, [low.rlike(rf"(?<!{word})\Q{t}\E(?!{word})") for t in terms])


def where(df: DataFrame, preds: Sequence[Predicate], params: Sequence[Any] = ()) -> DataFrame:
    """Rows for which every predicate is true."""
    for p in preds:
        df = df.where(condition(p, params))
    return df


def select(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Named columns; "alias:column" renames and "*" takes the rest as they are."""
    out: list[tuple[str, Column]] = []
    for term in columns:
        if term == "*":
            out += [(c, F.col(c)) for c in df.columns]
        else:
            key, _, source = term.rpartition(":")
            out.append((key or source, F.col(source)))
    names = [k for k, _ in out]
    if len(set(names)) != len(names):
        raise ValueError(f"duplicate select key in {names}")
    return df.select(*[c.alias(k) for k, c in out])


def json_rows(df: DataFrame, name: str = "row") -> DataFrame:
    """Each row as one JSON object; nulls are kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def order_by(df: DataFrame, *terms: str) -> DataFrame:
    """Sort by "column[.asc|.desc][.nullsfirst|.nullslast]"; nulls are largest unless stated."""
    return df.orderBy(*[order_term(t) for t in terms])


def order_term(term: str) -> Column:
    name, *mods = term.split(".")
    down = "desc" in mods
    first = "nullsfirst" in mods or (down and "nullslast" not in mods)
    c = F.col(name)
    if down:
        return c.desc_nulls_first() if first else c.desc_nulls_last()
    return c.asc_nulls_first() if first else c.asc_nulls_last()


def page(df: DataFrame, order: Sequence[str], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Ordered rows after `offset`, at most `limit`; without an order any such rows."""
    df = order_by(df, *order) if order else df
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def aggregate(df: DataFrame, group: Sequence[str], aggs: Mapping[str, tuple[str, str]], order: Sequence[str] = ()) -> DataFrame:
    """`aggs` maps an alias to (sum|avg|min|max|count, column or "*"); the rest is the grouping."""
    if any(t.split(".")[0] not in group for t in order):
        raise ValueError("aggregated reads order by grouped columns only")
    exprs = [
        (F.count(F.lit(1)) if col == "*" else getattr(F, fn)(col)).alias(alias) for alias, (fn, col) in aggs.items()
    ]
    out = df.groupBy(*group).agg(*exprs) if group else df.agg(*exprs)
    return order_by(out, *order) if order else out


@dataclass(frozen=True)
class Embed:
    """A related table under `key`: one object (`many=False`) or arrays of objects.

    `on` pairs (parent column, child column). Arrays hold at most `size` children per row, a number `many` requires; a parent
    with more continues in further rows, numbered by `<key>_part`.
    """

    key: str
    table: str
    on: Sequence[tuple[str, str]]
    many: bool = False
    inner: bool = False
    select: Sequence[str] = ("*",)
    where: Sequence[Predicate] = ()
    order: Sequence[str] = ()
    embeds: Sequence[Embed] = field(default=())
    size: int | None = None

    def __post_init__(self):
        if self.many and self.size is None:
            raise ValueError(f"{self.key}: say how many children a row may hold")


Lookup = Callable[[str], DataFrame]
MAX_DEPTH = 16


def embed(parent: DataFrame, spec: Embed, lookup: Lookup, depth: int = 1) -> DataFrame:
    """Attach the relation; children are filtered before the join."""
    if depth > MAX_DEPTH:
        raise ValueError(f"embeds go {MAX_DEPTH} levels deep, not further")
    child = where(lookup(spec.table), spec.where)
    for inner in spec.embeds:
        child = embed(child, inner, lookup, depth + 1)
    extra = [n for e in spec.embeds for n in ([e.key, f"{e.key}_part"] if e.many else [e.key])]
    shown = select(child, [*spec.select, *([] if "*" in spec.select else extra)])
    wanted = F.struct(*[F.col(t.rpartition(":")[2]).alias(n) for t, n in _terms(spec.select, extra, child, shown)])
    links = [f"__on{i}" for i in range(len(spec.on))]
    keyed = child.withColumns({n: F.col(c) for n, (_, c) in zip(links, spec.on)})
    match = reduce(lambda a, b: a & b, [parent[p] == F.col(n) for n, (p, _) in zip(links, spec.on)])
    how = "inner" if spec.inner else "left"
    if not spec.many:
        return parent.join(keyed.select(*links, wanted.alias(spec.key)), match, how).drop(*links)
    part = f"{spec.key}_part"
    arrays = collect_parts(keyed.dropna(subset=links), links, list(spec.order), wanted, spec.size, spec.key, part)
    kind = arrays.schema[spec.key].dataType.simpleString()
    return (
        parent.join(arrays, match, how)
        .drop(*links)
        .withColumn(part, F.coalesce(part, F.lit(0)))
        .withColumn(spec.key, F.coalesce(spec.key, F.array().cast(kind)))
    )


def reached(parent: DataFrame, specs: Sequence[Embed], lookup: Lookup) -> DataFrame:
    """The rows of `parent` that have a child under every inner relation."""
    for spec in specs:
        if spec.inner:
            child = reached(where(lookup(spec.table), spec.where), spec.embeds, lookup)
            links = [f"__on{i}" for i in range(len(spec.on))]
            keys = child.select(*[F.col(c).alias(n) for n, (_, c) in zip(links, spec.on)])
            match = reduce(lambda a, b: a & b, [parent[p] == F.col(n) for n, (p, _) in zip(links, spec.on)])
            parent = parent.join(keys, match, "left_semi")
    return parent


def _terms(columns: Sequence[str], extra: Sequence[str], child: DataFrame, shown: DataFrame) -> list[tuple[str, str]]:
    terms: list[str] = []
    for t in columns:
        terms += child.columns if t == "*" else [t]
    if "*" not in columns:
        terms += extra
    return list(zip(terms, shown.columns))


def pick_relation(relations: Mapping[str, Embed], target: str, hint: str | None = None) -> Embed:
    """The one relation to `target`, by its name when several exist."""
    found = {n: r for n, r in relations.items() if r.table == target and hint in (None, n, r.on[0][0])}
    if len(found) != 1:
        raise ValueError(f"{'ambiguous' if found else 'unknown'} relation to {target}: {sorted(found)}")
    return next(iter(found.values()))


def read(
    lookup: Lookup,
    table: str,
    columns: Sequence[str] = ("*",),
    filters: Sequence[Predicate] = (),
    embeds: Sequence[Embed] = (),
    order: Sequence[str] = (),
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """One declarative read. `lookup` gives each table as the reader may see it.

    A page counts rows of `table` that all inner embeds reach; each comes with all parts of its children.
    """
    df = where(lookup(table), filters)
    paged = limit is not None or bool(offset)
    own = all(t.split(".")[0] in df.columns for t in order)
    if paged and own:
        df = page(reached(df, embeds, lookup), order, limit, offset)
    for e in embeds:
        df = embed(df, e, lookup)
    if paged and not own:
        df = page(df, order, limit, offset)
    elif order:
        df = order_by(df, *order)
    extra = [n for e in embeds for n in ([e.key, f"{e.key}_part"] if e.many else [e.key])]
    return select(df, columns if "*" in columns else [*columns, *extra])


def tagged_reads(df: DataFrame, reads: Mapping[str, Sequence[Predicate]], name: str = "request") -> DataFrame:
    """Many pending reads of one table as a single scan: their OR, each row tagged with the reads it answers."""
    if len(reads) > 64:
        raise ValueError("one call takes up to 64 reads")
    conds = {k: reduce(lambda a, b: a & b, [condition(p) for p in ps]) for k, ps in reads.items()}
    tags = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in conds.items()]), lambda x: x.isNotNull())
    return df.where(reduce(lambda a, b: a | b, conds.values())).withColumn(name, F.explode(tags))


def with_defaults(df: DataFrame, defaults: Mapping[str, tuple[str, Any]]) -> DataFrame:
    """Columns the table does not have yet take their declared (type, default); present nulls stay null."""
    missing = {n: F.lit(v).cast(t) for n, (t, v) in defaults.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df


def key_page(df: DataFrame, key: str, after: int, rows: int, budget: int) -> DataFrame:
    """The rows behind `after` by their key: at most `rows`, and at most `budget` bytes as one JSON array.

    Keys are unique whole numbers from 0 to 2^53 - 1. Only the page itself is ordered and sized: it is
    cut to `rows` + 2 before any byte is counted, the last key delivered included so that a copy of it
    cannot hide behind a page's end.
    """
    c = F.col(key)
    if after < 0 and df.where(c.isNull() | (c < 0) | (c > 2**53 - 1) | (c != F.floor(c))).take(1):
        raise ValueError(f"{key} must be a non-negative whole number")
    near = df.where(c >= after).orderBy(key).limit(rows + 2)
    if near.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1):
        raise ValueError(f"{key} must strictly increase")
    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    so_far = Window.orderBy(key)
    sized = near.where(c > after).withColumns({
        "__n": F.row_number().over(so_far),
        "__bytes": F.lit(1) + F.sum(F.octet_length(text) + 1).over(so_far),
    })
    # a first row over the budget cannot be delivered at all
    over = F.raise_error(F.lit("a row exceeds the page's bytes"))
    sized = sized.withColumn("__bytes", F.when((F.col("__n") == 1) & (F.col("__bytes") > budget), over).otherwise(F.col("__bytes")))
    return sized.where((F.col("__n") <= rows) & (F.col("__bytes") <= budget)).drop("__n", "__bytes")


def capture_text(df: DataFrame, limit: int = 1 << 20, name: str = "text") -> DataFrame:
    """Canonical JSON per row: sorted columns, 64-bit and decimal values as text; over `limit` bytes is an error."""
    exact = {"bigint", "decimal"}
    cols = [
        F.col(c).cast("string").alias(c) if df.schema[c].dataType.simpleString().split("(")[0] in exact else F.col(c)
        for c in sorted(df.columns)
    ]
    text = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    checked = F.when(F.octet_length(text) > limit, F.raise_error(F.lit("row exceeds the capture limit"))).otherwise(text)
    return df.select(checked.alias(name))


def digest(df: DataFrame) -> DataFrame:
    """One order-independent digest of the table's rows, with their count.

    Row hashes are added up lane by lane, so the work combines before the shuffle and copies of a
    row count as often as they occur. It tells changed content apart; it is not a signature.
    """
    hashed = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256).alias("h"))
    lanes = [F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = hashed.select(*[x.alias(f"l{i}") for i, x in enumerate(lanes)]).agg(
        *[F.sum(f"l{i}").alias(f"s{i}") for i in range(4)], F.count(F.lit(1)).alias("rows")
    )
    text = F.concat_ws(":", *[F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("string") for i in range(4)], F.col("rows").cast("string"))
    return sums.select(F.sha2(text, 256).alias("digest"), "rows")
