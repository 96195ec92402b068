import pytest
from pyspark.sql import functions as F

from rowtide.operators import types as ty, validate as v
from rowtide.operators.types import Field

ROW = {
    "string": "Zürich ⛰ north", "bool": "false", "int32": "-77001", "int64": "-5120000000000000003", "double": "-0.03125", "bytes": "3q2+7wo=",
    "uuid": "41d7be09-25fa-4c83-b16e-90d3c5a1f27e", "timestamp": "1987-02-11T04:05:06.000700Z", "date": "1969-07-20", "time": "03:14:15.926535",
    "timezone": "Asia/Kathmandu", "duration": "PT90061.25S", "decimal": "-90071992547409930000001.000251",
    "json": '{"k":{"n":-2.5},"list":[false,"y"]}', "geojson": '{"type":"LineString","coordinates":[[7.5,47.25],[8.5,46],[9,46.5]]}',
}
# (type, source, given, canonical or None when refused)
CASES = [
    ("bool", "postgres", "t", True), ("bool", "canonical", "t", None), ("int32", "canonical", "2147483648", None), ("int32", "canonical", "1.0", None),
    ("int64", "canonical", "-0007", "-7"), ("int64", "canonical", "9223372036854775808", None), ("double", "duckdb", "-0", 0.0), ("double", "duckdb", "1e400", None),
    ("bytes", "postgres", "\\xdeadbeef0a", "3q2+7wo="), ("bytes", "canonical", "\\x00ff", None), ("bytes", "canonical", "3q2+7wo", None),
    ("uuid", "canonical", "41D7BE09-25FA-4C83-B16E-90D3C5A1F27E", ROW["uuid"]), ("uuid", "canonical", "41d7", None),
    ("timestamp", "canonical", "1994-05-30 21:17:48.6050040+05:45", "1994-05-30T15:32:48.605004Z"), ("timestamp", "canonical", "1994-05-30T21:17:48", None),
    ("timestamp", "canonical", "1994-05-30T21:17:48.6050047Z", None), ("timestamp", "canonical", "1994-04-31T21:17:48Z", None),
    ("timestamp", "canonical", "2024-12-31T23:30:00-23:59", "2025-01-01T23:29:00.000000Z"), ("timestamp", "canonical", "0001-01-01T00:00:00+01", None),
    ("timestamp", "canonical", "2024-01-01T24:00:00Z", None), ("timestamp", "canonical", "2023-02-29T10:00:00.000000Z", None), ("timestamp", "canonical", "0000-01-01T10:00:00.000000Z", None), ("timestamp", "canonical", "2024-01-01T00:00:00+24:00", None),
    ("date", "canonical", "2023-02-29", None), ("date", "canonical", "0000-01-01", None), ("date", "canonical", "2024-2-1", None),
    ("time", "canonical", "08:00:00", "08:00:00.000000"), ("time", "canonical", "24:00:00", None), ("time", "canonical", "08:00:00.1234567", None),
    ("timezone", "canonical", "UTC+3", None), ("timezone", "canonical", "Mars/Olympus", None),
    ("duration", "canonical", "41:07:09.5", "PT148029.5S"), ("duration", "canonical", "02:03", "PT123S"), ("duration", "canonical", "PT1H0.5M2S", "PT3632S"),
    ("duration", "protojson", "30s", "PT30S"), ("duration", "canonical", "-PT3S", None), ("duration", "canonical", "P1M", None), ("duration", "canonical", "PT", None),
    ("duration", "canonical", "PT0S", "PT0S"), ("duration", "canonical", "PT100S", "PT100S"), ("duration", "canonical", "PT315576000000S", "PT315576000000S"),
    ("duration", "canonical", "PT315576000000.000001S", None), ("duration", "canonical", "PT1.0000001S", None),
    ("decimal", "canonical", "+001.50e2", "150"), ("decimal", "canonical", "-0.000", "0"), ("decimal", "canonical", ".5", "0.5"), ("decimal", "canonical", "1e-6", "0.000001"),
    ("decimal", "canonical", "1e-7", None), ("decimal", "canonical", "1e32", None), ("decimal", "canonical", "1e20000", None), ("decimal", "canonical", "12x", None),
    ("json", "canonical", "{bad", None), ("json", "canonical", '"\\u0000"', None), ("json", "canonical", '"\\ud83d"', None),
    ("geojson", "canonical", '{"type":"Point","coordinates":[181,0]}', None), ("geojson", "canonical", '{"type":"Point","coordinates":[1]}', None),
    ("geojson", "canonical", '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1]]]}', None), ("geojson", "canonical", '{"type":"Sphere","coordinates":[]}', None),
    ("geojson", "canonical", '{"type":"Feature","geometry":null,"properties":{}}', '{"geometry":null,"properties":{},"type":"Feature"}'),
    ("geojson", "canonical", '{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,200]}]}', None),
]


def field(kind):
    return Field(kind, 38, 6) if kind == "decimal" else Field(kind)


def test_canonical_row_is_unchanged(spark):
    df = spark.createDataFrame([tuple(ROW.values())], ", ".join(f"`{k}` string" for k in ROW))
    got = ty.refuse_errors(ty.normalize(df, {k: field(k) for k in ROW})).first()
    import json

    for k, want in ROW.items():
        if k in ("json", "geojson"):
            assert json.loads(got[k]) == json.loads(want)
        else:
            assert str(got[k]).lower() == want.lower(), k


@pytest.mark.parametrize("kind, source", sorted({(k, s) for k, s, _, _ in CASES}))
def test_cases(spark, kind, source):
    cases = {g: want for k, s, g, want in CASES if (k, s) == (kind, source)}
    df = spark.createDataFrame([(g,) for g in cases], "given string")
    got = {r[0]: r[1] for r in df.select("given", ty.canonical(F.col("given"), field(kind), source)).collect()}
    assert got == cases


def test_errors_name_the_columns(spark):
    df = spark.createDataFrame([("1", "x"), (None, "2")], "a string, b string")
    out = ty.normalize(df, {"a": Field("int64"), "b": Field("int64")})
    assert [r["_errors"] for r in out.collect()] == [["b"], []]
    with pytest.raises(Exception, match="invalid type value: b"):
        ty.refuse_errors(out).collect()


def test_compare(spark):
    cases = [("decimal", "10", "9.99", 1), ("decimal", "-10", "-9.99", -1), ("decimal", "0", "-0.0", 0), ("decimal", "1e2", "100", 0), ("decimal", "0.5", "0.45", 1), ("decimal", "1e30", "999999999999999999999999999999", 1), ("decimal", "-1e30", "5", -1),
             ("int64", "9", "10", -1), ("duration", "PT90S", "PT1M30S", 0), ("duration", "PT9S", "PT10S", -1), ("bool", "true", "false", 1), ("string", "b", "a", 1)]
    got = spark.range(1).select(*[ty.compare(F.lit(a), F.lit(b), k) for k, a, b, _ in cases]).first()
    assert list(got) == [c[3] for c in cases]
    with pytest.raises(TypeError):
        ty.compare(F.lit("1"), F.lit("2"), "json")


def test_boundaries_hold_for_zero_rows(spark):
    empty = spark.createDataFrame([], "a double, b string")
    with pytest.raises(TypeError, match="explicit cast"):
        ty.admit_physical(empty.schema, {"a": "int32"})
    with pytest.raises(TypeError, match="missing"):
        ty.check_boundary(empty.schema, ["a", "c"])
    months = spark.sql("SELECT INTERVAL '3' MONTH AS d WHERE false")
    with pytest.raises(TypeError, match="months"):
        ty.project_lossless(months, {"d": "duration"})


def test_lossless_projection(spark):
    df = spark.sql("SELECT INTERVAL '11 20:34:56.000789' DAY TO SECOND AS d, TIMESTAMP_NTZ'1958-12-05 17:40:02.25' AS t, -7205759403792794113 AS n, X'c0ffee11' AS b")
    got = ty.project_lossless(df, {"d": "duration", "t": "timestamp", "n": "int64", "b": "bytes"}).first()
    assert tuple(got) == ("PT1024496.000789S", "1958-12-05T17:40:02.250000Z", "-7205759403792794113", "wP/uEQ==")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kathmandu")
    try:
        zoned = spark.sql("SELECT TIMESTAMP'1994-05-30 21:17:48' AS t")
        assert ty.project_lossless(zoned, {"t": "timestamp"}).first()[0] == "1994-05-30T15:32:48.000000Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    with pytest.raises(Exception, match="negative"):
        ty.project_lossless(spark.sql("SELECT INTERVAL '-1' SECOND AS d"), {"d": "duration"}).collect()


def test_rules(spark):
    df = spark.createDataFrame([("d90a4be2-51c7-4f86-a3de-0b7782e6c914", "hi"), ("x", ""), ("y", None), ("z", "a\x01")], "id string, message string")
    rules = [v.Rule("id", required=True, uuid=True), v.Rule("message", required=True, min_length=1, max_length=500, pattern=v.PLAIN_TEXT)]
    got = sorted((r["id"], r["rule"]) for r in v.violations(df, "id", rules).collect())
    assert got == [("x", "id.uuid"), ("x", "message.min_length"), ("x", "message.pattern"), ("y", "id.uuid"), ("y", "message.required"), ("z", "id.uuid"), ("z", "message.pattern")]


def test_cross_row_tells_refusal_from_error(spark):
    owned = spark.createDataFrame([("t1", "ann"), ("t2", None)], "id string, owner string")
    rows = spark.createDataFrame([(1, "t1", "bob"), (2, "t1", "ann"), (3, "t2", "ann")], "id int, target string, owner string")
    out = v.cross_row(rows, {"owned": (owned, "target", "id")}, {"own-target": F.col("owned.owner") != F.col("owner")})
    assert sorted((r["id"], r["ok"], r["refused"], r["error"]) for r in out.collect()) == [
        (1, True, [], []), (2, False, ["own-target"], []), (3, False, [], ["own-target"])]


def test_keys_fold_case(spark):
    df = spark.createDataFrame([("A",), ("a",), (None,), ("b",)], "id string")
    assert sorted((r["key"] or "", r["n"]) for r in v.repeated_keys(df, F.lower("id")).collect()) == [("", 1), ("a", 2)]


def test_geometry_collections_of_any_depth(spark):
    """Every member counts however deep it lies; a member that is no shape refuses the whole."""
    good, bad = '{"type":"Point","coordinates":[1,2]}', '{"type":"Point","coordinates":[1,200]}'

    def wrapped(text, times):
        return wrapped(f'{{"type":"GeometryCollection","geometries":[{text}]}}', times - 1) if times else text

    cases = [(str(n), wrapped(x, n), x is good) for n in (0, 1, 3, 4, 9) for x in (good, bad)]
    cases += [("mixed", wrapped(f"{good},{wrapped(bad, 4)}", 2), False), ("empty", wrapped("", 5), True), ("null", wrapped("null", 3), False),
              ("feature", f'{{"type":"Feature","geometry":{wrapped(good, 6)}}}', True), ("no list", '{"type":"GeometryCollection","geometries":5}', False)]
    df = spark.createDataFrame(cases, "name string, text string, ok boolean").withColumn("got", ty.canonical(F.col("text"), Field("geojson")).isNotNull())
    assert [r["name"] for r in df.where("got <> ok").collect()] == []


def test_decimals_are_exact_or_refused(spark):
    cases = [("1e-7", "0.0000001"), ("1E3", "1000"), ("5.", "5"), ("0e999999999999", "0"), ("1e99999999999", None), ("12345.6", "12345.6"), ("123456", None),
             ("1.23456789", None), ("-1.50e-3", "-0.0015"), ("", None), (None, None)]
    df = spark.createDataFrame(cases, "text string, expected string").withColumn("got", ty.canonical(F.col("text"), Field("decimal", 12, 7)))
    assert df.where(~F.col("got").eqNullSafe(F.col("expected"))).collect() == []


def test_json_is_one_value(spark):
    """Text behind the first value is refused, whatever it tries to close."""
    bad = ['{"a":1},{"b":2}', '{"a":1} {"b":2}', '{"a":1}}', '{"a":1}],[{"b":2}', '{"a":1}]],[[2', '{"a":1},"y":2', '{"a":1}},{"x":2', "1 2", ""]
    good = ['{"a":[1,2]}', "[]", "null", '"x, y"', '{"a":{"b":"]},{"}}', "1.5"]
    df = spark.createDataFrame([(x, False) for x in bad] + [(x, True) for x in good], "text string, ok boolean")
    got = df.withColumn("got", ty.canonical(F.col("text"), Field("json")).isNotNull())
    assert [r["text"] for r in got.where("got <> ok").collect()] == []
