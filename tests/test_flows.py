import datetime as dt
import hashlib
import json
import threading

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rowtide.functions import ids, text
from rowtide.operators import compute as c, delivery as d, evolve as e, messages as m, writes
from rowtide.session import fresh_path
from rowtide.sources import batches, files, feeds, lake, versions
from rowtide.streaming import stateful, windows as w
from rowtide.streaming.runs import drain


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def msg(spark, *items):
    df = spark.createDataFrame(list(items), "id int, n int, kind string")
    return m.messages(df, ["id", "n"], {"kind": F.col("kind")})


def test_steps(spark):
    df = msg(spark, (1, 4, "a"), (2, 0, "b"), (3, None, None))
    out = m.mapping(df, None, {"kind": F.lit("z"), "n": F.col("content.n")})
    assert rows(out, "content.id", m.meta("kind"), m.meta("n"), m.meta("nope")) == [(1, "z", "4", ""), (2, "z", "0", ""), (3, "z", "", "")]
    assert rows(m.drop_deleted(df, F.col("content.n") == 0), "content.id") == [(1,), (3,)]
    to = lambda v: lambda x: m.mapping(x, {"id": F.col("content.id"), "n": F.lit(v)})
    first = m.switch(df, [(m.meta("kind") == "a", [to(10)]), (F.col("content.id") < 3, [to(20)])])
    assert rows(first, "content.id", "content.n") == [(1, 10), (2, 20), (3, None)]
    flat = m.switch_map(df, [(m.meta("kind") == "a", {"id": F.col("content.id"), "n": F.lit(10)}), (None, {"id": F.col("content.id"), "n": F.lit(0)})])
    assert rows(flat, "content.id", "content.n") == [(1, 10), (2, 0), (3, 0)]


def test_try_and_catch(spark):
    df = msg(spark, (1, 4, "a"), (2, 0, "b"))
    tried = m.attempt(df, [(F.when(F.col("content.n") == 0, F.lit("zero")), {"n": F.try_divide(F.lit(8), F.col("content.n")).cast("int")}), (F.lit(None).cast("string"), {"n": F.col("content.n") + 1})])
    assert rows(tried, "content.id", "content.n", m.meta("_error")) == [(1, 3, ""), (2, 0, "zero")]
    with pytest.raises(Exception, match="nothing caught it: zero"):
        m.must_succeed(tried).collect()
    caught = m.must_succeed(m.catch(tried, {"n": F.lit(-1)}))
    assert rows(caught, "content.id", "content.n", m.meta("_error")) == [(1, 3, ""), (2, -1, "")]


def test_unarchive_of_a_non_array_gives_nothing(spark):
    df = spark.createDataFrame([('["a","b"]',), ("{}",), ("[]",)], "content string").withColumn("meta", F.create_map(F.lit("k"), F.lit("v")))
    assert rows(m.unarchive(df), "content", m.meta("k")) == [("a", "v"), ("b", "v")]


def test_templates_traces_and_ids(spark):
    df = spark.range(1).withColumn("meta", F.create_map(F.lit("id"), F.lit("7")))
    made = text.interpolate('/${! meta("coll")}x?id=${_meta.id}&${HOME}${NO}', env={"HOME": "h"})
    assert df.select(made).first()[0] == "/x?id=7&h"
    ok = "00-" + "a" * 32 + "-" + "b" * 16 + "-01"
    assert list(df.select(*[text.traceparent(F.lit(x)) for x in (ok, ok.upper(), None)]).first()) == [ok, "", ""]
    assert df.select(ids.seed(F.lit("job"))).first()[0] == int.from_bytes(hashlib.sha256(b"job").digest()[:4], "big")
    assert list(df.select(text.unaccent(F.lit("Ćœur São ß")), text.same_unaccented(F.lit("é"), F.lit("E"))).first()) == ["Coeur Sao ss", False]
    with pytest.raises(Exception, match="not a int"):
        df.select(text.cast_exact(F.lit("1.5"), "int")).collect()
    keys = df.select(ids.content_key(F.lit("ab"), F.lit("c")), ids.content_key(F.lit("a"), F.lit("bc"))).first()
    assert keys[0] != keys[1]


def test_delivery_retries_then_gives_up(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "bad")], "id int, body string")
    out = writes.deliver(df, "id", "body", lambda k, b: 201 if b == "ok" else 500, first_wait=0.0)
    assert rows(out) == [(1, 1, 201, True), (2, 4, 500, False)]


def test_lag_and_retention(spark):
    log = spark.range(1, 101).withColumnRenamed("id", "pos")
    got = rows(d.consumer_lag(log, "pos", [("a", 90, 0, False), ("b", 10, 5, False), ("c", 10, 5, True), ("d", 90, 1, True)], budget=50))
    assert got == [("a", 10, 0, "reading"), ("b", 90, 5, "retired"), ("c", 0, 0, "to-tail"), ("d", 10, 1, "reading")]
    acked = spark.createDataFrame([("a", 95), ("b", 98)], "grp string, position bigint")
    assert d.retained(log, "pos", acked, ["a", "b"], keep=10).agg(F.min("pos")).first()[0] == 91
    assert d.retained(log, "pos", acked, ["a", "b"], keep=2).agg(F.min("pos")).first()[0] == 96
    assert d.retained(log, "pos", acked, ["a", "b", "c"], keep=2).count() == 100


def test_job_cache(spark):
    jobs = spark.createDataFrame([("v1", "x", "in"), ("v1", "x", "in"), ("v2", "x", "in")], "code string, command string, input string")
    empty = spark.createDataFrame([], "key string, answer string, accessed timestamp_ntz")
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    answers, store = c.cached(jobs, empty, lambda j: j.withColumn("answer", F.concat("code", F.lit("!"))), now)
    assert rows(answers, "code", "answer") == [("v1", "v1!"), ("v1", "v1!"), ("v2", "v2!")] and store.count() == 2
    again, _ = c.cached(jobs, store, lambda j: j.withColumn("answer", F.lit("new")), now)
    assert rows(again, "answer") == [("v1!",), ("v1!",), ("v2!",)]
    assert c.conflicts(store.unionByName(store.withColumn("answer", F.lit("?")))).count() == 2


def test_a_plan_may_not_change_its_jobs(spark):
    def plan(answers):
        n = answers.count()
        return spark.createDataFrame([("a", f"input{n}")], "key string, input string")

    with pytest.raises(ValueError, match="later plan"):
        c.iterate(plan, lambda jobs: jobs.select("key", F.lit(1).alias("answer")), lambda a: a, "key string, answer int")


def test_plan_rounds_store_no_inputs(spark, monkeypatch):
    tables, write = [], c.stored
    monkeypatch.setattr(c, "stored", lambda df, label: tables.append(df.columns) or write(df, label))
    first = spark.createDataFrame([("a", "xx"), ("b", "yyyy"), ("b", "yyyy")], "key string, input string")
    given = []

    def plan(answers):
        return first.unionByName(answers.where("answer > 2 AND key = 'b'").distinct().select(F.lit("c").alias("key"), F.lit("zzz").alias("input")))

    def work(jobs):
        given.append(rows(jobs, "key", "input"))
        return jobs.select("key", F.char_length("input").alias("answer"))

    got = c.iterate(plan, work, lambda a: a, "key string, answer int")
    assert rows(got, "key", "answer") == [("a", 2), ("b", 4), ("b", 4), ("c", 3)]
    assert given == [[("a", "xx"), ("b", "yyyy"), ("b", "yyyy")], [("c", "zzz")]]
    assert len(tables) == 3 and all(columns == ["key", "__input"] for columns in tables)


def test_staleness(spark):
    reads = spark.createDataFrame([("x", "t"), ("x", "u"), ("y", "t"), ("z", "gone")], "name string, table string")
    sources = spark.createDataFrame([("t", 3), ("u", 1)], "table string, revision int")
    covers = c.coverage(reads, sources)
    specs = spark.createDataFrame([("x", 1), ("y", 2), ("z", 1)], "name string, version int")
    done = covers.join(spark.createDataFrame([("x", 1), ("y", 1), ("z", 1)], "name string, version int"), "name")
    assert rows(c.stale(specs, covers, done)) == [("x", False), ("y", True), ("z", True)]


def test_select_fields(spark):
    df = spark.createDataFrame([('{"b": [1, {"c": null}], "a": "x\\"y", "n": null}',), ("[1]",)], "j string")
    got = [r[0] for r in df.select(c.select_fields(F.col("j"), ["a", "b", "n", "zz"])).collect()]
    assert json.loads(got[0]) == {"a": 'x"y', "b": [1, {"c": None}], "n": None} and got[1] is None


def test_nesting_refuses_repeated_order_keys(spark):
    parents = spark.createDataFrame([(1,)], "id int").withColumn("doc", F.struct(F.array().cast("array<struct<v:string>>").alias("rows")))
    child = spark.createDataFrame([(1, 0, "a"), (1, 0, "b")], "pid int, ord int, v string")
    with pytest.raises(ValueError):
        c.nest(parents, "id", ["doc", "rows"], child, "pid", "ord", 10)


def test_migrations_go_both_ways(spark):
    df = spark.createDataFrame([(1, "a", 5)], "id int, name string, n int")
    changes = [e.AddColumn("tier", "int", "0"), e.AlterColumn("n", "n * 100", "n / 100", "bigint", "int"), e.RenameColumns({"name": "title"}), e.DropColumn("id", "1", "int")]
    up = e.migrate(df, changes)
    assert up.dtypes == [("title", "string"), ("n", "bigint"), ("tier", "int")] and tuple(up.first()) == ("a", 500, 0)
    assert rows(e.revert(up, changes), "id", "name", "n") == [(1, "a", 5)]
    rule = e.Constraint("u", "unique", ["name"])
    twice = df.unionByName(df).unionByName(df.withColumn("name", F.lit(None).cast("string"))).unionByName(df.withColumn("name", F.lit(None).cast("string")))
    assert rule.violations(twice, "id").count() == 2


def test_lake_shows_only_listed_files(spark):
    base = fresh_path(spark, "lake")
    lake.publish({"t": spark.range(5), "empty": spark.range(0)}, base)
    spark.range(9).write.mode("append").parquet(f"{base}/data/t")
    got = lake.attach(spark, base)
    assert got["t"].count() == 5 and got["empty"].count() == 0


def test_versions(spark):
    base, schemas = fresh_path(spark, "v"), {"a": "id long", "b": "id long"}
    with pytest.raises(LookupError):
        versions.capture(spark, base, schemas)
    assert versions.commit({"a": spark.range(1), "b": spark.range(10)}, base) == 1
    before = versions.capture(spark, base, schemas)
    assert versions.commit({"a": spark.range(2)}, base, onto=1) == 2  # b keeps its rows
    with pytest.raises(versions.VersionTaken):
        versions.commit({"a": spark.range(3)}, base, onto=1)
    failing = spark.range(3).select(F.when(F.col("id") < 9, F.raise_error(F.lit("no"))).cast("long").alias("id"))
    with pytest.raises(PySparkException):
        versions.commit({"a": spark.range(4), "b": failing}, base)
    counts = lambda tables: {n: df.count() for n, df in tables.items()}
    assert counts(before) == {"a": 1, "b": 10}
    assert counts(versions.capture(spark, base, schemas)) == {"a": 2, "b": 10}


def test_a_version_is_published_once(spark, monkeypatch):
    """A writer that read the pointer before another one committed is refused."""
    base = fresh_path(spark, "v")
    versions.commit({"a": spark.range(1)}, base)
    old = versions.newest(spark, base)
    versions.commit({"a": spark.range(2)}, base)
    monkeypatch.setattr(versions, "newest", lambda *_: old)
    with pytest.raises(versions.VersionTaken):
        versions.commit({"a": spark.range(3)}, base)
    monkeypatch.undo()
    assert versions.capture(spark, base, {"a": "id long"})["a"].count() == 2


def test_covers_name_sinks_and_parents(spark):
    frame = spark.createDataFrame
    reads = frame([("a", "t"), ("b", "t"), ("c", "gone")], "name string, table string")
    sinks = frame([("a", "s"), ("d", "s")], "name string, table string")
    parents = frame([("b", "p"), ("d", "q"), ("e", "p")], "name string, table string")
    sources, runs = frame([("t", 4), ("s", 9)], "table string, revision long"), frame([("p", 2), ("q", 0)], "table string, revision long")
    got = {r["name"]: r["cover"] and [tuple(x) for x in r["cover"]] for r in c.coverage(reads, sources, sinks, parents, runs).collect()}
    assert got == {"a": [("reads", "t", 4), ("to", "s", 9)], "b": [("parent", "p", 2), ("reads", "t", 4)], "c": None, "d": None, "e": None}


def test_objects_and_content(spark):
    folder = fresh_path(spark, "objects")
    spark.createDataFrame([("x",)], "v string").write.text(folder)
    found = feeds.objects(spark, folder, "*.txt", content=True)
    assert found.select("length").first()[0] == 2
    name = lambda body, end: "a/" + hashlib.sha256(body).hexdigest() + end
    df = spark.createDataFrame([(name(b"x", ".txt"), b"x"), (name(b"x", "-thumb.png"), b"x"), (name(b"y", ".txt"), b"x"), ("a/plain.txt", b"x")], "path string, content binary")
    assert [r["matches"] for r in feeds.check_content(df).collect()] == [True, True, False, False]


def test_change_log_asks_for_a_reload(spark):
    log = spark.range(1, 11).select(F.col("id").alias("seq"))
    assert feeds.change_log(log, 3, 7).count() == 4
    assert feeds.change_log(log, 0, 7).count() == 7
    assert feeds.change_log(log.where("seq > 3"), 3, 7) is None and feeds.change_log(log, 3, 7, pruned=3) is None
    assert feeds.change_log(log, 3, 7, limit=3) is None and feeds.change_log(log, 8, 7) is None


def test_jdbc_options():
    assert feeds.jdbc_options("jdbc:x", "select 1") == {"url": "jdbc:x", "query": "select 1"}
    assert feeds.jdbc_options("jdbc:x", "select 1", ("id", "0", "9", 3))["dbtable"] == "(select 1) AS q"


HELLO = "id string, message string, operation string, ts timestamp"


def test_windowed_messages(spark):
    """A repeat counts once, a heartbeat is ignored, a lone record gives nothing, a null message counts but is not joined."""
    src, base = fresh_path(spark, "hello"), fresh_path(spark, "out")
    at = lambda s: f"2024-01-01 00:{s}"
    data = [("1", "b", "create", at("00:01")), ("2", "a", "create", at("00:02")), ("2", "a", "create", at("00:03")), ("3", None, "create", at("00:29")),
            ("4", "lone", "create", at("00:31")), ("h", None, "heartbeat", at("09:00"))]
    spark.createDataFrame(data, "id string, message string, operation string, t string").select("id", "message", "operation", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(HELLO).parquet(src)
    texts = w.window_texts(stream.withColumn("message", F.when(F.col("operation") == "create", F.col("message"))), "ts", "30 seconds", "10 seconds", "id", "message")
    w.emit(texts, base, fresh_path(spark, "mark")).awaitTermination()
    out = versions.read_batches(spark, base, "window_start timestamp, n long, messages string")
    assert rows(out, "n", "messages") == [(3, "a, b")]


def test_markers_carry_over_batches(spark):
    base = fresh_path(spark, "trace")
    apply = stateful.trace_batches(base, "r", ["pos"], F.col("m").isNotNull(), F.col("m"), hot_rows=2)
    make = lambda *x: spark.createDataFrame(list(x), "r string, pos int, m string")
    apply(make(("a", 1, None), ("a", 2, "t1"), ("a", 3, None), ("b", 1, "u1"), ("a", 4, None)), 0)
    for _ in range(2):  # the batch is repeated
        apply(make(("a", 5, None), ("b", 2, None), ("a", 6, ""), ("a", 7, None)), 1)
    apply(make(("a", 8, None), ("b", 3, None)), 2)
    out = versions.read_batches(spark, f"{base}/out", "r string, pos int, trace string")
    assert rows(out, "r", "pos", "trace") == [("a", 1, ""), ("a", 3, "t1"), ("a", 4, "t1"), ("a", 5, "t1"), ("a", 7, ""), ("a", 8, ""), ("b", 2, "u1"), ("b", 3, "u1")]


def test_write_back_does_not_echo(spark):
    rows_ = spark.createDataFrame([(1, None, None), (None, None, None), (2, "t", "s")], "id int, processed_at string, source string")
    assert rows(d.enriched(rows_, F.lit("now"), "me")) == [(1, "now", "me")]


def test_dedup_stream(spark):
    src = fresh_path(spark, "dup")
    spark.range(50).select(F.col("id"), F.lit("2024-01-01").cast("timestamp").alias("ts")).write.parquet(src)
    stream = spark.readStream.schema("id long, ts timestamp").parquet(src)
    assert drain(w.dedup(stream.unionByName(stream), "ts", "1 hour", ["id"])).count() == 50


def test_two_writers_stopped_before_the_last_step(spark, monkeypatch):
    """Both have read one version and written their tables; one commit stands, whole, and the other writer is told."""
    base = fresh_path(spark, "v")
    versions.commit({"a": spark.range(1)}, base)
    both, create, out = threading.Barrier(2), files.create, {}

    def late(*args):
        both.wait(60)
        return create(*args)

    monkeypatch.setattr(files, "create", late)

    def write(n):
        try:
            out[n] = versions.commit({"a": spark.range(n)}, base, onto=1)
        except versions.VersionTaken:
            out[n] = None

    writers = [threading.Thread(target=write, args=(n,)) for n in (5, 7)]
    for w_ in writers:
        w_.start()
    for w_ in writers:
        w_.join()
    monkeypatch.undo()
    won = [n for n, version in out.items() if version == 2]
    assert len(out) == 2 and len(won) == 1 and None in out.values()
    assert versions.capture(spark, base, {"a": "id long"})["a"].count() == won[0]
    assert versions.commit({"a": spark.range(9)}, base) == 3 and versions.newest(spark, base)[0] == 3


def test_a_file_is_created_once(spark):
    path = fresh_path(spark, "claims") + "/one.json"
    assert files.create(spark, path, "é 1") and not files.create(spark, path, "2")
    assert files.text(spark, path) == "é 1" and files.names(spark, path.rpartition("/")[0]) == ["one.json"]
    assert files.names(spark, path + "-none") == []


def test_old_batches_are_folded(spark):
    """Any number of batches reads as few folders; replays and torn folds change nothing."""
    base, plain = fresh_path(spark, "kept"), fresh_path(spark, "plain")
    make = lambda i: spark.createDataFrame([(i % 7, i), (100 + i, i)], "k long, v long").coalesce(1)
    for i in range(45):
        batches.write_batch(make(i), base, i, batches.newest_of(["k"]), fanout=3)
        make(i).write.parquet(f"{plain}/batch={i}")
        if i == 20:
            spark.range(1).write.parquet(f"{base}/folds/4-0-20")
            files.remove(spark, f"{base}/folds/4-0-20/_SUCCESS")  # a writer that was lost while it folded
    for again in (0, 17, 38, 44):
        batches.write_batch(make(again), base, again, batches.newest_of(["k"]), fanout=3)
    folds, single = batches.layout(spark, base)
    assert len(single) <= 4 and len(folds) <= 9 and folds[0][0] >= 3
    every = spark.read.parquet(plain)
    want = rows(batches.merged(every, ["k"]))
    got = batches.read_batches(spark, base, "k long, v long")
    assert rows(batches.merged(got, ["k"])) == want and got.count() < every.count()
    assert batches.sweep(spark, base) > 30 and batches.sweep(spark, base) == 0
    assert rows(batches.merged(batches.read_batches(spark, base, "k long, v long"), ["k"])) == want


def test_traces_carry_over_a_restart(spark):
    """The trace of a reader outlives the query; a reader without a marker has none, a null marker clears it."""
    src, mark, out = (fresh_path(spark, n) for n in ("src", "mark", "out"))
    schema = "r string, pos int, m string, on boolean"
    data = [[("a", 2, "t1", True), ("a", 1, None, False), ("b", 1, "u", True), ("a", 3, None, False)], [("a", 4, None, None), ("b", 2, None, False), ("c", 1, None, False)],
            [("a", 5, None, True), ("a", 6, None, False), ("b", 3, None, False), (None, 1, "n", True), (None, 2, None, False)]]
    for k, some in enumerate(data):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        traced = stateful.carry_trace(stream, "r", ["pos"], F.col("on"), F.col("m"))
        writer = traced.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True)
        stateful.started(writer, spark).awaitTermination()
    got = spark.read.schema("r string, pos int, trace string").parquet(out)
    assert rows(got.na.fill("null", ["r"]), "r", "pos", "trace") == [
        ("a", 1, ""), ("a", 3, "t1"), ("a", 4, "t1"), ("a", 6, ""), ("b", 2, "u"), ("b", 3, "u"), ("c", 1, ""), ("null", 2, "n")]


def test_archive_on_a_stream(spark):
    """Full parts come at once, the rest when its key falls quiet; what comes later begins a new part."""
    src, mark, out = (fresh_path(spark, n) for n in ("src", "mark", "out"))
    schema = "k string, ts timestamp, i int, content string"
    at = lambda m: dt.datetime(2030, 1, 1, 0, m)
    batch = lambda *x: [(k, at(m), i, str(i)) for k, m, i in x]
    data = [batch(("a", 2, 2), ("a", 1, 1), ("b", 1, 10), ("a", 2, 3)), batch(("a", 5, 4), ("a", 6, 5), (None, 6, 20)), batch(("z", 50, 0)), batch(("b", 51, 11), ("b", 52, 12), ("b", 53, 13))]
    for some in data:
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        parts = stateful.archived(stream, ["k"], "ts", ["ts", "i"], "content", 2, "1 minute", 60_000)
        writer = parts.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True)
        stateful.started(writer, spark).awaitTermination()
    got = spark.read.schema("k string, part int, content string").parquet(out).na.fill("null", ["k"])
    assert rows(got, "k", "part", "content") == [
        ("a", 0, "[1,2]"), ("a", 1, "[3,4]"), ("a", 2, "[5]"), ("b", 0, "[10]"), ("b", 1, "[11,12]"), ("null", 0, "[20]"), ("z", 0, "[0]")]


def test_lag_of_many_readers(spark):
    """Ranges with and without entries, positions before and behind the log, nulls; the plan does not know how many there are."""
    log = spark.range(0, 500).select((F.col("id") * 3 % 701 + F.when(F.col("id") % 2 == 0, 5000).otherwise(0)).alias("pos"))
    log = log.unionByName(spark.createDataFrame([(None,), (7,), (7,)], "pos long"))
    points = spark.range(-50, 6000, 7).select(F.col("id").alias("at")).unionByName(spark.createDataFrame([(None,), (7,), (7,)], "at long"))
    held = sorted(r["pos"] for r in log.collect() if r["pos"] is not None)
    for span in (1, 64, 1 << 16):
        for r in d.entries_after(log, "pos", points, "at", span).collect():
            assert r["after"] == sum(r["at"] is None or p > r["at"] for p in held), (span, r)
    assert d.entries_after(log.where("false"), "pos", points.limit(3), "at").agg(F.max("after")).first()[0] == 0


def test_windows_of_many_texts(spark):
    """One window of 20,000 texts in parts that are its texts in order; no part was named."""
    src, base = fresh_path(spark, "many"), fresh_path(spark, "out")
    text = F.when(F.col("id") % 10 > 0, F.concat(F.lit("t"), F.lpad((F.col("id") * 7919 % 20_000).cast("string"), 5, "0")))
    made = spark.range(20_000).select("id", text.alias("message"), F.lit("2024-01-01 00:00:01").cast("timestamp").alias("ts"))
    late = spark.createDataFrame([(-1, "x")], "id long, message string").withColumn("ts", F.lit("2024-01-02").cast("timestamp"))
    made.unionByName(made).unionByName(late).coalesce(2).write.parquet(src)
    stream = spark.readStream.schema("id long, message string, ts timestamp").parquet(src)
    w.emit_parts(w.window_rows(stream, "ts", "1 hour", "1 hour", "id", "message"), "id", "message", base, fresh_path(spark, "mark"), 3000).awaitTermination()
    got = batches.read_batches(spark, base, "part int, n long, messages string").orderBy("part").collect()
    assert [(r["part"], r["n"]) for r in got] == [*((i, 3000) for i in range(6)), (6, 2000)]
    want = sorted(r["message"] for r in made.where("message IS NOT NULL").collect())
    assert ", ".join(r["messages"] for r in got if r["messages"]).split(", ") == want
