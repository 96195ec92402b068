"""Rules for null times, pages of parents, null job inputs and negative weights."""

import pytest
from pyspark.sql import functions as F

from rowtide.operators import compute, deltas, joins, read
from rowtide.operators.read import Embed


def test_null_times_and_keys_match_nothing(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", None), (3, None, 5), (4, "b", 5)], "id int, k string, t int")
    right = spark.createDataFrame([(1, "a", None), (2, "b", 4), (3, None, 1)], "rid int, k string, at int")
    got = joins.asof_left(left, right, ["k"], "t", "at", "id", "rid").collect()
    assert {r["id"]: r["match"] and r["match"]["rid"] for r in got} == {1: None, 2: None, 3: None, 4: 2}


def test_a_page_counts_parents(spark):
    tables = {
        "p": spark.createDataFrame([(1,), (2,), (3,)], "id int"),
        "c": spark.createDataFrame([(1, i) for i in range(5)] + [(3, 9)], "pid int, v int"),
    }
    children = lambda **more: Embed("c", "c", [("id", "pid")], many=True, order=("v",), **more)
    got = read.read(tables.get, "p", embeds=[children(size=2)], order=["id"], limit=2).collect()
    assert [(r["id"], r["c_part"]) for r in sorted(got, key=lambda r: (r["id"], r["c_part"]))] == [(1, 0), (1, 1), (1, 2), (2, 0)]
    inner = read.read(tables.get, "p", embeds=[children(inner=True, size=9)], order=["id"], offset=1, limit=1).collect()
    assert [r["id"] for r in inner] == [3]
    assert read.read(tables.get, "p", limit=1).count() == 1
    with pytest.raises(ValueError, match="how many"):
        children()
    for size in (1, 2, 100):  # the parts of any size, put together, are the same rows
        parts = read.read(tables.get, "p", embeds=[children(size=size)]).select("id", F.posexplode_outer("c"), "c_part")
        assert [(r["id"], r["col"] and r["col"]["v"]) for r in parts.orderBy("id", "c_part", "pos").collect()] == [*[(1, i) for i in range(5)], (2, None), (3, 9)]


def test_null_inputs_are_jobs_and_split_caches_are_refused(spark):
    jobs = spark.createDataFrame([(1, "c", "m", None), (2, "c", "m", ""), (3, "c", "m", None)], "id int, code string, command string, input string")
    cache = spark.createDataFrame([], "key string, answer string, accessed timestamp")
    work = lambda d: d.withColumn("answer", F.coalesce(F.upper("input"), F.lit("none")))
    got, store = compute.cached(jobs, cache, work, F.current_timestamp())
    assert {r["id"]: r["answer"] for r in got.collect()} == {1: "none", 2: "", 3: "none"} and store.count() == 2
    split = spark.createDataFrame([("k", "x"), ("k", "y")], "key string, answer string").withColumn("accessed", F.current_timestamp())
    with pytest.raises(ValueError, match="2 answers"):
        compute.cached(jobs, split, work, F.current_timestamp())


def test_a_negative_baseline_is_refused(spark, tmp_path):
    base = str(tmp_path / "base")
    delta = spark.createDataFrame([("r", "{}", -3)], "relation string, row string, weight bigint")
    deltas.acknowledge(base, 1, delta)
    with pytest.raises(ValueError, match="negative"):
        deltas.baseline(spark, base, "relation string, row string, weight bigint, batch bigint")
