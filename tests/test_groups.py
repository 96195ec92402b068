"""Ordered group work must give the same rows whether or not a group is hot."""

import pytest
from pyspark.sql import Window, functions as F

from rowtide.operators import sets, joins, windows
from rowtide.operators.compute import by_partition, evicted
from rowtide.plans import groups as g
from rowtide.plans.sizes import rows_within


def skewed(spark, n=600):
    """A third of all rows have key 0, one key is null, values are sometimes null."""
    i = F.col("id")
    key = F.when(i % 3 == 0, 0).when(i % 50 == 1, None).otherwise(i % 7 + 1)
    return spark.range(n).select(key.alias("k"), ((i * 37) % 101).alias("at"), i, F.when(i % 4 == 0, i).alias("v"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_running_equals_a_plain_window(spark):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    plain = {"count": F.count(F.lit(1)), "sum": F.sum("v"), "last": F.last("v", ignorenulls=True)}
    for kind, agg in plain.items():
        want = rows(df.withColumn("r", agg.over(w)))
        for limit in (20, 10**6):
            assert rows(g.running(df, ["k"], ["at", "id"], "r", kind, "v", hot_rows=limit)) == want, (kind, limit)


def test_running_over_the_whole_table(spark):
    df = skewed(spark)
    w = Window.orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = rows(df.withColumn("r", F.sum("v").over(w)))
    assert rows(g.running(df, [], ["at", "id"], "r", "sum", "v", hot_rows=50)) == want


def test_last_carries_structs_across_slices(spark):
    df = skewed(spark).withColumn("s", F.when(F.col("id") % 97 == 0, F.struct("id", "at")))
    w = Window.partitionBy("k").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = rows(df.withColumn("r", F.last("s", ignorenulls=True).over(w)))
    assert rows(g.running(df, ["k"], ["at", "id"], "r", "last", "s", hot_rows=20)) == want


def test_hot_slices_are_spread(spark):
    df = skewed(spark, 3000)
    hot = g.hot_groups(df, ["k"], 800)
    assert [r["k"] for r in hot.collect()] == [0]
    cold, big = g.split_hot(df, ["k"], hot)
    assert cold.count() + big.count() == 3000 and big.count() == 1000
    sliced = g._slices(big, ["k"], ["at", "id"], hot, 800)
    assert sliced.groupBy("__slice").count().agg(F.max("count")).first()[0] < 400


def test_collect_parts_keeps_everything(spark):
    df = skewed(spark)
    parts = g.collect_parts(df, ["k"], ["at", "id"], F.col("id"), 16, hot_rows=20)
    assert parts.agg(F.max(F.size("items"))).first()[0] == 16
    back = parts.select("k", "part", F.posexplode("items")).orderBy("part", "pos").where("k = 0").select("col").collect()
    assert [r[0] for r in back] == [r[0] for r in df.where("k = 0").orderBy("at", "id").select("id").collect()]
    assert parts.select(F.explode("items")).count() == 600


def test_top_per_group(spark):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy(F.desc("at"), "id")
    want = rows(df.withColumn("r", F.row_number().over(w)).where("r <= 5").drop("r"))
    assert rows(g.top_per_group(df, ["k"], [F.desc("at"), F.col("id")], 5, ["id"], salts=8)) == want


def test_asof_with_a_hot_key_and_ties(spark):
    left = skewed(spark).select(F.col("k").alias("key"), "at", "id")
    right = skewed(spark, 300).where("id % 5 = 0").select(F.col("k").alias("key"), "at", F.col("id").alias("rid"))
    expected = left.join(right, (left.key == right.key) & (right.at <= left.at), "left").groupBy(left.id).agg(
        F.max(F.when(F.col("rid").isNotNull(), F.struct(right.at, "rid"))).alias("m"))
    want = {r["id"]: r["m"] and r["m"]["rid"] for r in expected.collect()}
    for limit in (20, 10**6):
        got = joins.asof_left(left, right, ["key"], "at", "at", "id", "rid", hot_rows=limit)
        assert {r["id"]: r["match"] and r["match"]["rid"] for r in got.collect()} == want
    strict = joins.asof_left(left, right, ["key"], "at", "at", "id", "rid", strict=True).where("match.at >= at")
    assert strict.count() == 0


def test_forward_fill_hot(spark):
    df = skewed(spark).fillna({"k": -1})
    args = (["k"], ["at", "id"], F.col("id") % 11 == 0, F.col("id").cast("string"))
    assert rows(windows.forward_fill(df, *args, hot_rows=20)) == rows(windows.forward_fill(df, *args))


def test_partition_calculation_in_pieces(spark):
    df = skewed(spark).dropna(subset=["k"]).select(F.col("k").cast("string").alias("p"), "id")
    one = lambda pdf: pdf.groupby("p", as_index=False).agg(n=("id", "size"), s=("id", "sum"))
    add = lambda pdf: pdf.groupby("p", as_index=False).agg({"n": "sum", "s": "sum"})
    got = by_partition(df, "p", ["id"], one, "p string, n long, s long", add, rows=16, hot_rows=20)
    want = rows(df.groupBy("p").agg(F.count("*"), F.sum("id")))
    assert rows(got) == want
    for size in (1, 10**6):
        assert rows(by_partition(df, "p", ["id"], one, "p string, n long, s long", add, rows=size)) == want
    assert rows(by_partition(df, "p", ["id"], one, "p string, n long, s long")) == want


def test_floating_sums_are_refused(spark):
    with pytest.raises(TypeError, match="decimal"):
        g.running(skewed(spark).withColumn("v", F.col("v").cast("double")), ["k"], ["at", "id"], "r", "sum", "v")


def test_eviction_hot(spark):
    cache = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.repeat(F.lit("x"), (F.col("id") % 9).cast("int")).alias("answer"),
                                    F.timestamp_seconds(F.col("id") % 20).alias("accessed"))
    assert rows(evicted(cache, 200, 20_000, hot_rows=40)) == rows(evicted(cache, 200, 20_000))
    kept = evicted(cache, 200, 20_000)
    assert 100 < kept.count() < 200 and kept.agg(F.min(F.unix_seconds("accessed"))).first()[0] >= 13


def test_size_checks_read_no_more_than_they_need(spark):
    df = spark.range(100)
    assert rows_within(df, 100) and not rows_within(df, 99)


def test_intervals_do_not_depend_on_the_session_zone(spark):
    points = spark.range(0, 24 * 4).select(F.expr("TIMESTAMP_NTZ'2026-03-08 00:00:00' + make_dt_interval(0, 0, id * 15)").alias("at"), "id")
    spans = spark.range(0, 12).select(F.expr("TIMESTAMP_NTZ'2026-03-08 00:00:00' + make_dt_interval(0, id * 2, 30)").alias("lo"))
    spans = spans.withColumn("hi", F.expr("lo + INTERVAL 100 MINUTE"))
    want = rows(points.join(spans, (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert rows(joins.in_interval(points, "at", spans, "lo", "hi")) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_the_caller_may_know_the_hot_groups(spark):
    """The plain window runs no job while the plan is built, and hot groups handed in give the same rows."""
    df = spark.range(600).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 20).alias("k"), "id", (F.col("id") * 7).alias("v"))
    tracker, counted = spark.sparkContext.statusTracker(), g.hot_groups(df, ["k"], 100)
    spark.sparkContext.setJobGroup("plain", "no job")
    plain = g.running(df, ["k"], ["id"], "total", "sum", "v", None)
    assert not tracker.getJobIdsForGroup("plain")
    spark.sparkContext.setJobGroup("rest", "")
    given = g.running(df, ["k"], ["id"], "total", "sum", "v", 100, counted)
    assert counted is not None and plain.exceptAll(given).count() == given.exceptAll(plain).count() == 0


def test_an_interval_takes_few_rows_however_long(spark):
    """Lengths from none to centuries, open ends, both sides of the epoch: the plain range join's rows, two blocks an interval at most."""
    day = lambda c: F.expr(f"TIMESTAMP_NTZ'1969-06-01 00:00:00' + make_dt_interval(CAST({c} AS INT), 0, 0, CAST(id % 3 AS DECIMAL(18,6)) / 1000000)")
    points = spark.range(0, 400).select(day("id * 40 - 4000").alias("at"), F.col("id").alias("p")).union(spark.sql("SELECT CAST(NULL AS TIMESTAMP_NTZ), -1L"))
    spans = spark.range(0, 60).select(day("id * 97 - 3000").alias("lo"), F.when(F.col("id") % 7 > 0, day("id * 97 - 3000 + int(pow(1.25, id))")).alias("hi"), F.col("id").alias("s"))
    spans = spans.withColumn("lo", F.when(F.col("s") % 11 > 0, F.col("lo")))
    plain = points.join(spans, (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
    assert rows(joins.in_interval(points, "at", spans, "lo", "hi")) == rows(plain)
    bounds = F.coalesce(F.col("at") >= F.col("lo"), F.lit(True)) & F.coalesce(F.col("at") < F.col("hi"), F.lit(True))
    want = rows(points.where("at IS NOT NULL").join(spans, bounds))
    for step in (1, 2, 5):
        assert rows(joins.in_interval(points, "at", spans, "lo", "hi", True, step)) == want


def test_intervals_that_overlap(spark):
    at = lambda c: F.expr(f"TIMESTAMP'2024-01-01 00:00:00' + make_dt_interval(0, CAST({c} AS INT))")
    a = spark.range(0, 50).select(F.col("id").alias("x"), at("id * 5").alias("a"), F.when(F.col("id") % 9 > 0, at("id * 5 + id % 4 * 30")).alias("b"))
    c = spark.range(0, 50).select(F.col("id").alias("y"), F.when(F.col("id") % 8 > 0, at("id * 7 - 60")).alias("c"), at("id * 7 - 60 + id % 5 * 20").alias("d"))
    inside = lambda df: rows(df.select("x", "y"))
    plain = (F.col("a") < F.col("d")) & (F.col("c") < F.col("b")) & (F.col("a") < F.col("b")) & (F.col("c") < F.col("d"))
    assert inside(joins.overlapping(a, "a", "b", c, "c", "d")) == inside(a.join(c, plain))
    ok = lambda x, y: F.coalesce(F.col(x) < F.col(y), F.lit(True))
    assert inside(joins.overlapping(a, "a", "b", c, "c", "d", True)) == inside(a.join(c, ok("a", "d") & ok("c", "b") & ok("a", "b") & ok("c", "d")))


def test_no_job_runs_before_the_action(spark):
    """One group holds nine tenths of the rows: the plan is built without a job, and gives the plain window's rows."""
    key = F.when(F.col("id") % 10 > 0, F.lit("hot")).otherwise(F.when(F.col("id") % 20 == 0, F.col("id").cast("string")))
    df = spark.range(4000).select(key.alias("k"), ((F.col("id") * 37) % 1009).alias("at"), "id", F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "no job")
    built = {kind: g.running(df, ["k"], ["at", "id"], "r", kind, "v", 300) for kind in ("count", "sum", "last")}
    parts = g.collect_parts(df, ["k"], ["at", "id"], F.col("id"), 100, hot_rows=300)
    assert not tracker.getJobIdsForGroup("building")
    spark.sparkContext.setJobGroup("rest", "")
    w = Window.partitionBy("k").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    for kind, agg in {"count": F.count(F.lit(1)), "sum": F.sum("v"), "last": F.last("v", ignorenulls=True)}.items():
        assert rows(built[kind]) == rows(df.withColumn("r", agg.over(w)))
    assert parts.agg(F.sum(F.size("items"))).first()[0] == 4000


def test_closure_takes_few_rounds_on_a_long_chain(spark, monkeypatch):
    """100,000 nodes in a row that end in a cycle: as many rounds as the logarithm of the chain at most."""
    made, add = [], sets.Rounds.add
    monkeypatch.setattr(sets.Rounds, "add", lambda self, new: made.append(self.path) or add(self, new))
    edges = spark.range(100_000).select(F.col("id").alias("src"), F.when(F.col("id") == 99_999, 99_900).otherwise(F.col("id") + 1).alias("dst"))
    apart = spark.range(200_000, 200_050).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = sets.closure(edges.unionByName(apart), spark.createDataFrame([(7,)], "node long"))
    assert got.agg(F.count("node"), F.min("node"), F.max("node"), F.count_distinct("node")).first()[:] == (99_993, 7, 99_999, 99_993)
    assert sum("reached" in p for p in made) <= 18


def test_closure_through_branches_and_chains(spark):
    import random

    rng = random.Random(3)
    for _ in range(3):
        n = 60
        pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(25)} | {(i, i + 1) for i in range(n - 1) if i % 13}
        reached, todo = set(), [0, 20]
        while todo:
            x = todo.pop()
            if x not in reached:
                reached.add(x)
                todo += [b for a, b in pairs if a == x]
        edges = spark.createDataFrame([*pairs, (None, 3), (0, None), *list(pairs)[:5]], "src int, dst int")
        got = [r["node"] for r in sets.closure(edges, spark.createDataFrame([(0,), (20,), (20,)], "node int")).collect()]
        assert sorted(got) == sorted(reached)


def test_closure_of_long_chains_stores_rows_in_proportion_to_the_links(spark, monkeypatch):
    """Chains above the limit are shortened before shortcuts are made; the rows of all shortcuts and levels stay a multiple of the links."""
    made, add = [], sets.Rounds.add

    def counted(self, new):
        out = add(self, new)
        made.append(out.count())
        return out

    monkeypatch.setattr(sets.Rounds, "add", counted)
    monkeypatch.setattr(sets, "stored", lambda df, label, write=sets.stored: (lambda out: made.append(out.count()) or out)(write(df, label)))
    n = 40_000
    edges = spark.range(n).select((F.col("id") * 7919 % n).alias("src"), ((F.col("id") + 1) * 7919 % n).alias("dst")).where(f"src <> {(n - 1) * 7919 % n}")
    start = 100 * 7919 % n
    got = sets.closure(edges, spark.createDataFrame([(start,), (None,)], "node long"), chained=500)
    assert got.agg(F.count("node"), F.count_distinct("node"), F.count(F.lit(1))).first()[:] == (n - 100, n - 100, n - 99)
    assert sum(made) < 10 * n


def test_closure_with_nodes_taken_out_follows_branches_cycles_and_seeds(spark):
    import random

    rng = random.Random(11)
    for chained in (0, 4):
        n = 80
        pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(20)} | {(i, i + 1) for i in range(n - 1) if i % 17} | {(200, 201), (201, 200), (300, 300), (301, 300)}
        seeds = [3, 40, 41, 201, 301, 999]
        reached, todo = set(), list(seeds)
        while todo:
            x = todo.pop()
            if x not in reached:
                reached.add(x)
                todo += [b for a, b in pairs if a == x]
        edges = spark.createDataFrame([*pairs, (None, 3), (0, None), *list(pairs)[:5]], "src int, dst int")
        got = sets.closure(edges, spark.createDataFrame([(x,) for x in [*seeds, 40]], "node int"), chained=chained)
        assert sorted(r["node"] for r in got.collect()) == sorted(reached)
