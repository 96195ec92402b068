import pytest
from pyspark.sql import functions as F

from rowtide.operators import changes as c, deltas as d, publish as p, shapes as s, writes as w
from rowtide.session import fresh_path


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def log(spark, text):
    """"D1a I1c T" as entries with seq 1, 2, 3."""
    out = [(i + 1, e[0], int(e[1]) if len(e) > 1 else None, e[2:] or None) for i, e in enumerate(text.split())]
    return spark.createDataFrame(out, "seq bigint, op string, id int, v string")


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")


def test_compact(spark, base):
    assert rows(c.compact(base, log(spark, "D1a I1c I3x D2b"), ["id"])) == [(1, "c"), (3, "x")]
    assert rows(c.compact(base, log(spark, "I4y T I5z"), ["id"])) == [(5, "z")]
    every = log(spark, "D1a I1c I3x D2b I6q")
    assert rows(c.compact(base, c.fenced(every, 2, 4), ["id"])) == [(1, "a"), (3, "x")]
    assert rows(c.compact(base, c.fenced(every, 9, 9), ["id"])) == [(1, "a"), (2, "b")]


def test_without_a_key_one_copy_goes_per_delete(spark):
    bag = spark.createDataFrame([("p",), ("p",), ("q",), (None,)], "v string")
    entries = lambda *e: spark.createDataFrame([(i, op, v) for i, (op, v) in enumerate(e)], "seq bigint, op string, v string")
    assert rows(c.apply_no_key(bag, entries(("D", "p"), ("D", None)))) == [("p",), ("q",)]
    # a delete that meets no copy removes nothing, so the insert after it stays
    assert rows(c.apply_no_key(bag, entries(("D", "z"), ("I", "z"), ("I", "q"), ("D", "q"), ("D", "q"), ("D", "q"), ("I", "q")))) == [("p",), ("p",), ("q",), ("z",), (None,)]
    assert rows(c.apply_no_key(bag, entries(("I", "k"), ("T", None), ("I", "k"), ("I", "k")))) == [("k",), ("k",)]


def test_expand_spreads_many_copies(spark):
    df = spark.createDataFrame([("a", 250_000), ("b", 1)], "v string, n bigint")
    out = c.expand(df, "n")
    assert rows(out.groupBy("v").count()) == [("a", 250_000), ("b", 1)]


def test_refresh_plan(spark):
    df = spark.createDataFrame([("follows", "s", "s", 5, 5, 9, 1, 2), ("same", "s", "s", 5, 7, 9, 1, 1), ("gap", "s", "s", 5, 7, 9, 1, 2),
                                ("new schema", "t", "s", 5, 5, 9, 1, 1), ("never", "s", None, None, None, None, 1, None)],
                               "name string, signature string, seen_signature string, seen_seq int, log_from int, log_target int, rows_digest int, seen_digest int")
    assert rows(c.refresh_plan(df), "name", "mode", "next_seq") == [("follows", "log", 9), ("gap", "seed", 9), ("never", "seed", 0), ("new schema", "seed", 9), ("same", "noop", 9)]


def test_weighted_steps(spark):
    bag = lambda *r: spark.createDataFrame(list(r), "id string, group_id string, copies bigint")
    step = lambda *r: spark.createDataFrame(list(r), "id string, group_id string, weight int")
    state, hit = d.apply_step(bag(("x", "a", 2)), step(("x", "a", -1)), "group_id")
    assert rows(state) == [("x", "a", 1)] and rows(hit) == [("a", 1)]
    state, hit = d.apply_step(bag(("x", "a", 2)), step(("x", "a", -2), ("x", "a", 1), ("x", "a", 1)), "group_id")
    assert rows(state) == [("x", "a", 2)] and rows(hit) == []
    with pytest.raises(d.InvalidInput):
        d.apply_step(bag(("x", "a", 1)), step(("x", "a", -2), ("y", "a", 1)), "group_id")
    state, hit = d.apply_step(bag(("x", "a", 1)), step(("x", "a", -1), ("x", "b", 2)), "group_id")
    assert rows(hit, "partition") == [("a",), ("b",)]
    row = '{"group_id":"b","id":"x"}'
    assert rows(d.partition_rows(state, hit, "group_id")) == [("a", None), ("b", row), ("b", row)]
    state, hit = d.apply_step(bag(("x", "a", 1)), step(("x", "a", 1)), None)
    assert rows(hit) == [("", 1)]


def test_bag_differences_and_negative_zero(spark):
    b = lambda *v: d.weigh(spark.createDataFrame([(x,) for x in v], "v double"))
    assert rows(d.pending(b(1.0, 2.0), b(1.0, 1.0, 2.0))) == [(1.0, -1)]
    assert rows(d.pending(b(-0.0), b(0.0))) == []


def test_pending_count_counts_rows_not_weights(spark):
    old, new = (d.weigh(spark.createDataFrame([x], "id int, v string")) for x in ((1, "a"), (1, "b")))
    assert d.pending_count(d.pending(new, old)).first()[0] == 2


def test_checks_abort_a_capture(spark, base):
    with pytest.raises(d.InvalidInput, match="negative"):
        d.capture({"t": d.weigh(base)}, {"negative": base.where("id = 1")})


def view_of(arts, cards):
    joined = arts.join(cards, arts["card_id"] == cards["cid"]).select(arts["set_id"], "level", "status", F.regexp_extract("run", r"run-(\d+)", 1).cast("int").alias("run"))
    return joined


def sums():
    return {"drawn": F.when(F.col("status") == "drawn", 1).otherwise(0), "pending": F.when(F.col("status") == "pending", 1).otherwise(0)}


def test_join_aggregate_is_maintained(spark):
    cards = spark.createDataFrame([("a", "run-1"), ("b", "run-2"), ("c", "run-1")], "cid string, hint string")
    arts = spark.createDataFrame([("a:2", "a", "deck", 2, "run-1", "pending"), ("b:2", "b", "deck", 2, "run-2", "drawn"), ("c:2", "c", "other", 2, "run-1", "failed")],
                                 "id string, card_id string, set_id string, level int, run string, status string")
    key = ["set_id", "level"]

    def computed(joined):
        return joined.groupBy(*key).agg(F.count(F.lit(1)).alias("total"), *[F.sum(x).alias(n) for n, x in sums().items()], F.max("run").alias("run_number"))

    now = view_of(arts, cards)
    view = computed(now)
    assert rows(view) == [("deck", 2, 2, 1, 1, 2), ("other", 2, 1, 0, 0, 1)]
    # deleting the card with the highest run, then the group's last card
    for gone, left in (("b", [("deck", 2, 1, 0, 1, 1), ("other", 2, 1, 0, 0, 1)]), ("a", [("other", 2, 1, 0, 0, 1)])):
        delta = view_of(arts, cards.where(F.col("cid") == gone)).withColumn("weight", F.lit(-1))
        cards = cards.where(F.col("cid") != gone)
        view = d.maintain(view, delta, key, sums(), "run_number", "run", view_of(arts, cards))
        assert rows(view) == left == rows(computed(view_of(arts, cards)))


def test_carrier(spark):
    held = spark.createDataFrame([("1", "x"), ("2", "y"), ("9", "z")], "__key string, kind string")
    entries = spark.createDataFrame([(1, "D", 1, "x", 5), (2, "I", 1, "x", 6), (3, "D", 2, "y", 5), (4, "I", 3, "w", 5)], "seq bigint, op string, id int, kind string, n int")
    got = lambda lg: rows(d.carry(held, lg, "id", {"kind": F.col("kind")}), "__key", "action")
    assert got(entries) == [("1", "keep"), ("2", "delete"), ("3", "insert"), ("9", "keep")]
    cleared = entries.unionByName(spark.createDataFrame([(3, "T")], "seq bigint, op string"), allowMissingColumns=True).where("NOT (seq = 3 AND op = 'D')")
    assert got(cleared) == [("1", "delete"), ("2", "delete"), ("3", "insert"), ("9", "delete")]


def test_publication(spark):
    sink = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), ("c", 3, "z")], "id string, n int, note string")
    out = spark.createDataFrame([("a", 1), ("b", 5), ("d", 4)], "id string, n int")
    acted = p.actions(sink, out)
    assert rows(acted, "id", "action") == [("a", "keep"), ("b", "update"), ("c", "delete"), ("d", "insert")]
    assert rows(p.next_state(acted)) == [("a", 1, "x"), ("b", 5, None), ("d", 4, None)] and tuple(p.summary(acted).first()) == (2, 1)
    assert tuple(p.summary(p.actions(sink, out, keep_omitted=True)).first()) == (2, 0)
    assert tuple(p.summary(p.actions(sink, out.where("false"), keep_omitted=True)).first()) == (0, 0)
    deletes = spark.createDataFrame([("c",), ("zz",)], "id string")
    assert rows(p.delta_actions(sink, out, deletes), "id", "action") == [("a", "keep"), ("b", "update"), ("c", "delete"), ("d", "insert")]
    assert p.delta_violations(out, spark.createDataFrame([("a",)], "id string")).first()["id"] == "a"
    with pytest.raises(ValueError):
        p.check_sinks(["t"], {"t": out, "u": out})
    with pytest.raises(ValueError, match="required"):
        p.check_columns(sink.schema, out.schema, required=["note"])
    with pytest.raises(ValueError, match="not writable"):
        p.check_columns(sink.schema, out.schema, read_only=["n"])


def test_repeated_deletes_count_once_without_a_hash_table_of_keys(spark):
    sink = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, v int")
    ups = spark.createDataFrame([("d", 4)], "id string, v int")
    deletes = spark.createDataFrame([("a",), ("c",), ("a",), (None,), (None,), ("x",)], "id string")
    acted = p.delta_actions(sink, ups, deletes)
    assert rows(acted, "id", "v", "action") == [("a", 1, "delete"), ("b", 2, "keep"), ("c", 3, "delete"), ("d", 4, "insert")]
    assert "Aggregate" not in acted._jdf.queryExecution().executedPlan().toString()


def test_partitions_own_their_ids(spark):
    sink = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "id string, n int")
    owners = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "q")], "id string, partition string")
    again = spark.createDataFrame([("p",), ("r",)], "partition string")
    out = spark.createDataFrame([("a", 2, "r")], "id string, n int, partition string")
    assert p.ownership_conflicts(owners, again, out).count() == 0
    assert rows(p.partition_actions(sink, owners, again, out), "id", "n", "action") == [("a", 2, "update"), ("b", 1, "delete"), ("c", 1, "keep")]
    assert rows(p.next_owners(owners, again, out)) == [("a", "r"), ("c", "q")]
    stolen = spark.createDataFrame([("c", 2, "p")], "id string, n int, partition string")
    assert rows(p.ownership_conflicts(owners, again, stolen)) == [("c", 2)]


def test_writes(spark, base):
    new = spark.createDataFrame([(2, None), (3, "n")], "id int, v string")
    for small in (0, 10_000):  # one full join, or the broadcast of a measured change set
        assert rows(w.merge_duplicates(base, new, ["id"], small)) == [(1, "a"), (2, None), (3, "n")]
    assert rows(w.ignore_duplicates(base, new, ["id"])) == [(1, "a"), (2, "b"), (3, "n")]
    with pytest.raises(w.DuplicateKey, match="present"):
        w.insert(base, new, ["id"])
    with pytest.raises(w.DuplicateKey, match="twice"):
        w.merge_duplicates(base, new.unionByName(new), ["id"])
    nulls = spark.createDataFrame([(1, None), (2, "b")], "id int, v string")
    pred = F.col("v") == "b"
    assert rows(w.update_where(nulls, pred, {"v": F.lit("q")})) == [(1, None), (2, "q")] and rows(w.delete_where(nulls, pred)) == [(1, None)]
    assert w.affected(nulls, pred).first()[0] == 1 and w.returning(nulls, F.lit(False)).count() == 0
    texts = spark.createDataFrame([('a"b', None, [1, 2])], "s string, n string, a array<int>")
    assert tuple(w.json_columns(texts, ["s", "n", "a"]).first()) == ('"a\\"b"', None, "[1,2]")


def test_shapes(spark):
    ops = spark.createDataFrame([("s", 1, "upsert", "a", 1), ("s", 2, "upsert", "b", 1), ("s", 3, "upsert", "a", 2), ("s", 4, "delete", "b", None), ("s", 5, "upsert", "b", 3),
                                 ("t", 1, "upsert", "a", 1), ("t", 2, "truncate", None, None), ("t", 3, "upsert", "c", 1)], "shape string, seq int, op string, key string, value int")
    assert rows(s.compact_store(ops, ["shape"], "key", "value")) == [("s", "a", 2, 1), ("s", "b", 3, 5), ("t", "c", 1, 3)]
    feed = spark.createDataFrame([("s", i, op, "k") for i, op in enumerate(["insert", "insert", "delete", "insert", "truncate", "insert", "update", "insert"])],
                                 "shape string, seq int, op string, key string")
    for limit in (3, 10**6):
        got = [r["op"] for r in s.idempotent_ops(feed, ["shape"], "key", limit).orderBy("seq").collect()]
        assert got == ["insert", "update", "delete", "update", "truncate", "insert", "update", "update"]
    snap = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    lg = spark.createDataFrame([(1, "D", 1, "a", 3), (2, "I", 1, "seen", 3), (3, "D", 2, "b", 5), (4, "I", 3, "open", 4)], "seq int, op string, id int, v string, txid int")
    opened = spark.createDataFrame([(4,)], "txid int")
    assert rows(s.merge(snap, lg, ["id"], 5, opened)) == [(1, "a"), (3, "open")]
    readers = spark.createDataFrame([("old", 1), ("new", 3)], "reader string, offset int")
    entries = spark.createDataFrame([(i, "I") for i in range(1, 6)], "offset int, op string")
    assert rows(s.expired(readers, entries, keep=2)) == [("new", 3, False), ("old", 1, True)]
    assert rows(s.expired(readers, entries.unionByName(spark.createDataFrame([(6, "T")], "offset int, op string")), keep=1000), "reader", "expired") == [("new", True), ("old", True)]
    wr = spark.createDataFrame([("a", 1, 0), ("b", 1, 0), ("c", 9, 1), ("d", 3, 2)], "key string, txid int, changed int")
    held = spark.createDataFrame([("a",)], "key string")
    assert rows(s.confirm_writes(wr, lg, held), "key", "status") == [("a", "refused"), ("b", "confirmed"), ("c", "waiting"), ("d", "confirmed")]


def test_acknowledging_twice_adds_nothing(spark, base):
    path = fresh_path(spark, "ack")
    for _ in range(2):
        d.acknowledge(path, 1, d.weigh(base))
    assert rows(d.baseline(spark, path, "id int, v string, weight bigint")) == [(1, "a", 1), (2, "b", 1)]
