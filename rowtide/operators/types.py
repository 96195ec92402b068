"""The fifteen portable types: canonical forms, checks, order, and lossless projections.

Every rule is a column expression over text (or native) columns, so a whole table is normalised in
one scan. An invalid value gives null plus the column's name in `_errors`.
"""

from __future__ import annotations

import zoneinfo
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, StructType

from rowtide.functions.rows import Stages, interval_micros

ERRORS = "_errors"

# The longest duration in seconds, and the spellings each type admits.
MAX_DURATION_SECONDS = 315_576_000_000
BASE64 = r"^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
INTEGER = r"^-?\d+$"
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
TIME = r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,6}0*)?$"
CLOCK = r"([01]\d|2[0-3]):[0-5]\d:[0-5]\d"
STAMP = rf"^\d{{4}}-\d\d-\d\d[T ]{CLOCK}(?:\.(\d+))?(Z|[+-]([01]\d|2[0-3])(?::?[0-5]\d)?)$"

# The physical column types each portable type may come from.
WHOLE = ("tinyint", "smallint", "int", "bigint")
PHYSICAL = {
    "string": ("string",),
    "bool": ("boolean",),
    "int32": WHOLE,
    "int64": (*WHOLE, "string"),
    "double": ("float", "double"),
    "bytes": ("binary",),
    "uuid": ("string",),
    "timestamp": ("timestamp", "timestamp_ntz"),
    "date": ("date",),
    "time": ("string", "time"),
    "timezone": ("string",),
    "duration": ("interval",),
    "decimal": (*WHOLE, "decimal", "string"),
    "json": ("string", "variant"),
    "geojson": ("string", "variant"),
}


Keep = Callable[[Column], Column]


def _inline(value: Column) -> Column:
    """A value used several times is written out each time; code generation evaluates equal parts once."""
    return value


@dataclass(frozen=True)
class Field:
    type: str
    precision: int | None = None
    scale: int | None = None


def _group(c: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(c, pattern, i)


def _all(*conds: Column) -> Column:
    return reduce(lambda a, b: a & b, conds)


def _six(fraction: Column) -> Column:
    """A fraction's digits as exactly six; null when digits beyond the sixth matter."""
    return F.when(F.length(F.rtrim(fraction, F.lit("0"))) <= 6, F.rpad(F.substring(fraction, 1, 6), 6, "0"))


def _date(c: Column) -> Column:
    ok = _all(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), ~c.startswith("0000"), c.try_cast("date").isNotNull())
    return F.when(ok, c)


def _time(c: Column) -> Column:
    parts = r"^(\d{2}:\d{2}:\d{2})(?:\.(\d+))?$"
    return F.when(c.rlike(r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?$"),
                  F.concat(_group(c, parts, 1), F.lit("."), _six(_group(c, parts, 2))))


def _stamp(c: Column, keep: Keep = _inline) -> Column:
    """UTC text with six fraction digits from text with an offset of up to 23:59."""
    zone, fraction = keep(F.translate(F.regexp_extract(c, STAMP, 3), ":", "")), keep(F.regexp_extract(c, STAMP, 2))
    minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.coalesce(F.substring(zone, 4, 2).try_cast("int"), F.lit(0))
    behind = F.when(zone == "Z", 0).when(zone.startswith("-"), -minutes).otherwise(minutes)
    local = F.concat(F.substring(c, 1, 10), F.lit(" "), F.substring(c, 12, 8)).try_cast("timestamp_ntz")
    utc = keep(F.when((zone != "") & ~c.startswith("0000"), local - F.make_dt_interval(F.lit(0), F.lit(0), behind)))
    at, micros = keep(utc.cast("string")), _six(fraction)
    whole = F.concat(F.substring(at, 1, 10), F.lit("T"), F.substring(at, 12, 8), F.lit("."), micros, F.lit("Z"))
    return F.when(F.year(utc).between(1, 9999), whole)


def stamp_text(c: Column) -> Column:
    """A zone-free timestamp as `yyyy-MM-ddTHH:mm:ss.ffffffZ`, whatever the session's zone."""
    text = c.cast("timestamp_ntz").cast("string")
    return F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.lit("."),
                    F.rpad(F.substring(text, 21, 6), 6, "0"), F.lit("Z"))


def duration_seconds(c: Column, keep: Keep = _inline) -> Column:
    """Seconds of `PT…S`, `[H:]MM:SS[.f]` or `PT…H…M…S` text as decimal(38,6); null when malformed."""
    number = r"\d{1,18}(?:\.\d{1,6}0*)?"
    iso = rf"(?i)^PT(?=\d)(?:{number}H)?(?:{number}M)?(?:{number}S)?$"
    clock = r"^(?:(\d{1,18}):)?([0-5]\d):([0-5]\d(?:\.\d{1,6}0*)?)$"
    from_clock = F.replace(F.regexp_replace(c, clock, "PT$1H$2M$3S"), F.lit("PTH"), F.lit("PT"))
    spelled = keep(F.when(c.rlike(iso), F.upper(c)).when(c.rlike(clock), from_clock))
    total, rest = F.lit(0).cast("decimal(38,6)"), F.substring(spelled, 3, 1 << 30)
    for unit, size in (("H", 3600), ("M", 60), ("S", 1)):
        amount = F.when(F.contains(rest, F.lit(unit)), F.split_part(rest, F.lit(unit), F.lit(1))).try_cast("decimal(24,6)")
        total = (total + (F.coalesce(amount, F.lit(0)) * size).cast("decimal(38,6)")).cast("decimal(38,6)")
        rest = F.split_part(rest, F.lit(unit), F.lit(-1))  # all of it where the unit is missing
    return F.when(spelled.isNotNull(), total)


def _plain(number: Column) -> Column:
    """A decimal's text without end zeros behind the point."""
    text = number.cast("string")
    return F.when(F.contains(text, F.lit(".")), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)


def duration_text(seconds: Column) -> Column:
    """`PT<seconds>[.<fraction>]S` of a non-negative decimal number of seconds."""
    return F.concat(F.lit("PT"), _plain(seconds.cast("decimal(38,6)")), F.lit("S"))


def _duration(c: Column, source: str, keep: Keep = _inline) -> Column:
    if source == "protojson":
        c = F.regexp_replace(c, "^([0-9.]+)s$", "PT$1S")
    seconds = keep(duration_seconds(c, keep))
    return F.when(seconds <= MAX_DURATION_SECONDS, duration_text(seconds))


def _digits(c: Column, keep: Keep = _inline) -> tuple[Column, Column]:
    """A number's text as its digits without outer zeros and the power of ten of the last one; zero is ("", 0)."""
    mantissa, power = F.split_part(F.lower(c), F.lit("e"), F.lit(1)), F.split_part(F.lower(c), F.lit("e"), F.lit(2))
    written = F.ltrim(F.translate(mantissa, "+-.", ""), F.lit("0"))
    digits = keep(F.rtrim(written, F.lit("0")))
    behind = F.length(F.split_part(mantissa, F.lit("."), F.lit(2)))
    last = F.when(power == "", 0).otherwise(power.try_cast("int")) - behind + F.length(written) - F.length(digits)
    return digits, keep(F.when(digits == "", 0).otherwise(last))


def _decimal(c: Column, f: Field, keep: Keep = _inline) -> Column:
    """The cast decides the value; it is exact if the first and the last digit lie within the field."""
    if f.precision is None or f.scale is None or not (1 <= f.precision <= 38 and 0 <= f.scale <= f.precision):
        raise ValueError("a decimal field has a precision of 1..38 and a scale of 0..precision")
    digits, last = _digits(c, keep)
    fits = (last >= -f.scale) & (F.length(digits) + last <= f.precision - f.scale)
    value = F.when(digits == "", F.lit(0).cast(f"decimal(38,{f.scale})")).when(fits, c.try_cast(f"decimal(38,{f.scale})"))
    return F.when(c.rlike(NUMBER), _plain(keep(value)))


def _json(c: Column) -> Column:
    lone = r"\\u[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F])|(?<!\\u[dD][89abAB][0-9a-fA-F]{2})\\u[dD][c-fC-F][0-9a-fA-F]{2}"
    plain = ~c.rlike(r"(?<!\\)(?:\\\\)*\\u0000") & ~c.rlike(lone)
    # the parser stops behind the first value; what follows it cannot be sound in an array and an object alike
    listed, named = F.json_array_length(F.concat(F.lit("["), c, F.lit("]"))), F.json_object_keys(F.concat(F.lit('{"x":'), c, F.lit("}")))
    single = (listed == 1) & (F.size(named) == 1)
    return F.when(plain & single, F.to_json(F.try_parse_json(c)))


def _positions(c: Column, at_least: int, closed: bool = False) -> Column:
    """Whether an array of positions is long enough, in bounds, and (rings) ends where it starts."""

    def inside(p: Column) -> Column:
        bounds = p[0].between(-180, 180) & p[1].between(-90, 90)
        return F.coalesce((F.size(p) >= 2) & F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x)) & bounds, F.lit(False))

    ok = (F.size(c) >= at_least) & F.forall(c, inside)
    return F.coalesce(ok & (F.element_at(c, 1) == F.element_at(c, -1)) if closed else ok, F.lit(False))


def _shapes(c: Column) -> Column:
    """The shapes of a geometry, every collection replaced by its members however deep; null for a broken collection.

    No geometry is nested deeper than its text has braces. Rounds that find nothing to open cost one look at a flag.
    """
    kind = lambda g: F.get_json_object(g, "$.type") == "GeometryCollection"
    members = lambda g: F.from_json(F.get_json_object(g, "$.geometries"), "array<string>")

    def opened(g: Column) -> Column:
        return F.when(kind(g), F.coalesce(members(g), F.array(F.lit(None).cast("string")))).otherwise(F.array(g))

    def step(state: Column, _: Column) -> Column:
        more = F.exists(state["shapes"], lambda g: F.coalesce(kind(g), F.lit(False)))
        shapes = F.when(state["open"] & more, F.flatten(F.transform(state["shapes"], opened))).otherwise(state["shapes"])
        return F.struct(shapes.alias("shapes"), (state["open"] & more).alias("open"))

    start = F.struct(F.array(c).alias("shapes"), F.lit(True).alias("open"))
    rounds = F.sequence(F.lit(0), F.length(c) - F.length(F.replace(c, F.lit("{"))))
    return F.aggregate(rounds, start, step, lambda state: state["shapes"])


def _geometry(c: Column) -> Column:
    return F.coalesce(F.forall(_shapes(c), _shape), F.lit(False))


def _shape(c: Column) -> Column:
    kind, spots = F.get_json_object(c, "$.type"), F.get_json_object(c, "$.coordinates")

    def parsed(nesting: int) -> Column:
        return F.from_json(spots, "array<" * nesting + "double" + ">" * nesting)

    def every(a: Column, check, least: int = 1) -> Column:
        return F.coalesce((F.size(a) >= least) & F.forall(a, check), F.lit(False))

    ring = lambda r: _positions(r, 4, True)
    ok = (
        F.when(kind == "Point", _positions(F.array(parsed(1)), 1))
        .when(kind == "MultiPoint", _positions(parsed(2), 1))
        .when(kind == "LineString", _positions(parsed(2), 2))
        .when(kind == "MultiLineString", every(parsed(3), lambda x: _positions(x, 2)))
        .when(kind == "Polygon", every(parsed(3), ring))
        .when(kind == "MultiPolygon", every(parsed(4), lambda p: every(p, ring)))
    )
    return F.coalesce(ok.otherwise(F.lit(False)), F.lit(False))


def _feature(c: Column) -> Column:
    shape, props = F.get_json_object(c, "$.geometry"), F.get_json_object(c, "$.properties")
    props_ok = props.isNull() | props.startswith("{")
    return (F.get_json_object(c, "$.type") == "Feature") & (shape.isNull() | _geometry(shape)) & props_ok


def geojson_ok(c: Column) -> Column:
    """Whether GeoJSON text has known shapes, positions in bounds, and closed rings of four or more."""
    kind = F.get_json_object(c, "$.type")
    features = F.from_json(F.get_json_object(c, "$.features"), "array<string>")
    return (
        F.when(kind == "Feature", _feature(c))
        .when(kind == "FeatureCollection", F.coalesce(F.forall(features, _feature), F.lit(False)))
        .otherwise(_geometry(c))
    )


def canonical(c: Column, f: Field, source: str = "canonical", keep: Keep = _inline) -> Column:
    """A text column's canonical value for its field; null where the value is not admitted.

    `keep` may put a value that is used several times into a column of its own, see `normalize`.
    """
    kind = f.type
    if kind == "string":
        return F.when(~F.contains(c, F.lit("\0")), c)
    if kind == "bool":
        short = source in ("postgres", "electric")
        true, false = (["true", "t"], ["false", "f"]) if short else (["true"], ["false"])
        return F.when(c.isin(true), F.lit(True)).when(c.isin(false), F.lit(False))
    if kind == "int32":
        return F.when(c.rlike(INTEGER), c.try_cast("int"))
    if kind == "int64":
        return F.when(c.rlike(INTEGER), c.try_cast("bigint").cast("string"))
    if kind == "double":
        value = F.when(c.rlike(NUMBER), c.try_cast("double"))
        return F.when(F.abs(value) < float("inf"), value + F.lit(0.0))
    if kind == "bytes":
        hexed = F.when(c.rlike(r"^\\x([0-9a-fA-F]{2})*$"), F.base64(F.unhex(F.substring(c, 3, 1 << 30))))
        padded = F.when(c.rlike(BASE64), F.base64(F.unbase64(F.when(c.rlike(BASE64), c))))
        return padded if source in ("canonical", "protojson") else F.coalesce(hexed, padded)
    if kind == "uuid":
        return F.when(F.lower(c).rlike(UUID), F.lower(c))
    if kind == "timezone":
        return F.when(c.isin(sorted(zoneinfo.available_timezones())) & ~c.rlike(r"^([+-]|UTC[+-]|GMT[+-])"), c)
    if kind == "decimal":
        return _decimal(c, f, keep)
    if kind == "geojson":
        return F.when(geojson_ok(c), _json(c))
    if kind == "timestamp":
        return _stamp(c, keep)
    simple = {"date": _date, "time": _time, "json": _json}
    if kind in simple:
        return simple[kind](c)
    if kind == "duration":
        return _duration(c, source, keep)
    raise ValueError(f"unknown type {kind}")


def normalize(df: DataFrame, fields: Mapping[str, Field], source: str = "canonical") -> DataFrame:
    """Declared columns in canonical form, and `_errors`: the names of columns whose value is refused."""
    stages = Stages()
    made = {n: canonical(F.col(n).cast("string"), f, source, stages.keeper()) for n, f in fields.items()}
    staged = stages.add_to(df).withColumns({f"__c_{n}": c for n, c in made.items()})
    wrong = F.array_compact(F.array(*[F.when(F.col(n).isNotNull() & F.col(f"__c_{n}").isNull(), F.lit(n)) for n in fields]))
    out = staged.withColumn(ERRORS, wrong).withColumns({n: F.col(f"__c_{n}") for n in fields})
    return out.drop(*stages.names(), *[f"__c_{n}" for n in fields])


def refuse_errors(df: DataFrame) -> DataFrame:
    """Fail the job on the first row with refused values; otherwise pass the rows through."""
    said = F.concat(F.lit("invalid type value: "), F.concat_ws(", ", ERRORS))
    return df.withColumn(ERRORS, F.when(F.size(ERRORS) > 0, F.raise_error(said)).otherwise(F.col(ERRORS)))


def project_lossless(df: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """Columns whose exact value another engine could round, as exact text; other columns unchanged."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def project(name: str, kind: str) -> Column | None:
        c, physical = F.col(name), kinds[name].simpleString()
        if kind in ("json", "geojson") and physical == "variant":
            return F.to_json(c)
        if kind in ("int64", "decimal", "json", "geojson", "date", "time"):
            return c.cast("string")
        if kind == "bytes":
            return F.base64(c)
        if kind == "timestamp":
            return stamp_text(F.to_utc_timestamp(c.cast("timestamp_ntz"), F.current_timezone()) if physical == "timestamp" else c)
        if kind == "duration":
            if "year" in physical or "month" in physical:
                raise TypeError(f"{name}: a duration cannot contain calendar months or years")
            micros = interval_micros(f"`{name}`")
            seconds = (micros.cast("decimal(20,0)") / 1_000_000).cast("decimal(38,6)")
            return F.when(micros < 0, F.raise_error(F.lit("duration cannot be negative"))).otherwise(duration_text(seconds))
        return None

    made = {n: project(n, k) for n, k in fields.items()}
    return df.withColumns({n: c for n, c in made.items() if c is not None})


def admit_physical(schema: StructType, fields: Mapping[str, str]) -> None:
    """Refuse a column whose physical type is not one its portable type may come from, rows or no rows."""
    for name, kind in fields.items():
        physical = _base(schema[name].dataType)
        if physical != "void" and physical not in PHYSICAL[kind]:
            raise TypeError(f"{name}: {physical} requires an explicit cast for {kind}")


def _base(t: DataType) -> str:
    text = t.simpleString()
    return "interval" if text.startswith("interval day") else text.split("(")[0].split("<")[0]


def check_boundary(schema: StructType, fields: Sequence[str]) -> None:
    """A result has exactly the declared columns, rows or no rows."""
    got = set(schema.fieldNames())
    if len(schema) != len(got) or got != set(fields):
        raise TypeError(f"missing {sorted(set(fields) - got)}, extra {sorted(got - set(fields))}")


def compare(a: Column, b: Column, kind: str) -> Column:
    """-1, 0 or 1 by the type's own order, over canonical text; JSON types have none."""
    if kind in ("json", "geojson"):
        raise TypeError(f"{kind} has no order")
    if kind == "decimal":
        short, exact = r"^-?(\d{1,20}(\.\d{1,18})?|\d{1,11}(\.\d{1,9})?[eE][+-]?\d)$", "decimal(38,18)"  # text a decimal holds exactly
        return F.when(a.rlike(short) & b.rlike(short), _three_way(a.try_cast(exact), b.try_cast(exact))).otherwise(_by_value(a, b))
    if kind == "duration":
        return _three_way(duration_seconds(a), duration_seconds(b))
    typed = {"int64": "bigint", "int32": "int", "double": "double", "bool": "boolean"}.get(kind, "string")
    return _three_way(a.cast(typed), b.cast(typed))


def _by_value(a: Column, b: Column) -> Column:
    """Signs decide first, then the place of the first digit, then the digits themselves; null for what is no number."""

    def order(c: Column) -> Column:
        digits, last = _digits(c)
        top = F.when(c.rlike(NUMBER), F.length(digits) + last)  # the place of the first digit
        return F.when(top.isNotNull(), F.struct(F.when(digits == "", 0).when(c.startswith("-"), -1).otherwise(1).alias("sign"), top.alias("top"), digits.alias("digits")))

    return F.transform(F.array(F.struct(order(a).alias("a"), order(b).alias("b"))), lambda p: _by_order(p["a"], p["b"]))[0]


def _by_order(a: Column, b: Column) -> Column:
    size = _three_way(F.struct(a["top"], a["digits"]), F.struct(b["top"], b["digits"]))
    return F.when(a["sign"] != b["sign"], _three_way(a["sign"], b["sign"])).otherwise(a["sign"] * size)


def _three_way(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def to_protojson(c: Column, kind: str) -> Column:
    """The proto JSON spelling: durations as `<seconds>s`, everything else canonical."""
    return F.concat(F.regexp_extract(c, r"^PT(.*)S$", 1), F.lit("s")) if kind == "duration" else c


def from_protojson(c: Column, f: Field) -> Column:
    """A proto JSON value in canonical form."""
    return canonical(c, f, "protojson")
