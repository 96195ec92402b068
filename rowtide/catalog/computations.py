"""Registered queries: computations."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rowtide.catalog.registry import ORDERS_LOG, ORDERS_V2, Tables, query
from rowtide.operators import compute as c, publish, read
from rowtide.session import fresh_path, stored
from rowtide.sources import versions


@query("cmp_coverage", """SELECT c_custkey AS name, c_nationkey % 5 = 0 OR c_custkey % 4 = 0 OR c_custkey % 10 = 7
    OR (c_custkey % 10 = 3 AND c_custkey IN (SELECT o_custkey FROM orders)) AS stale FROM customer""")
def cmp_coverage(t: Tables):
    # each customer is a computation that reads a source per order priority, writes to its segment and waits for its nation
    k, named, segment, nation = F.col("name"), F.col("c_custkey").alias("name"), F.concat(F.lit("to/"), "c_mktsegment"), F.concat(F.lit("of/"), "c_nationkey")
    reads = t.orders.select(F.col("o_custkey").alias("name"), F.concat_ws("/", "o_custkey", "o_orderpriority").alias("table")).distinct()
    sources = t.orders.groupBy(F.concat_ws("/", "o_custkey", "o_orderpriority").alias("table")).agg(F.max("o_orderkey").alias("revision"))
    sources = sources.unionByName(t.customer.groupBy(segment.alias("table")).agg(F.max("c_custkey").alias("revision")))
    runs = t.nation.select(F.concat(F.lit("of/"), "n_nationkey").alias("table"), (F.col("n_nationkey") % 5).cast("bigint").alias("revision"))
    covers = c.coverage(reads, sources, t.customer.select(named, segment.alias("table")), t.customer.select(named, nation.alias("table")), runs)
    specs = t.customer.select(named, F.lit(2).alias("version"))
    moved = lambda x: ((k % 10 == 3) & (x["role"] == "reads") | (k % 10 == 7) & (x["role"] == "to")).cast("int")
    before = F.transform("cover", lambda x: x.withField("revision", x["revision"] - moved(x)))
    done = covers.select("name", F.when(k % 4 == 0, 1).otherwise(2).alias("version"), before.alias("cover"))
    return c.stale(specs, covers, done)


@query("cmp_skip_unchanged", f"WITH {ORDERS_V2} SELECT o_orderstatus AS name FROM orders WHERE false UNION ALL SELECT DISTINCT 'same' FROM orders")
def skip_unchanged(t):
    def row(name, df):
        return read.digest(df).select(F.lit(name).alias("name"), F.lit(1).alias("version"), "digest", F.lit(7).alias("sink_revision"))

    current = row("same", t.orders).unionByName(row("changed", t.orders_v2))
    return c.unchanged(current, row("same", t.orders).unionByName(row("changed", t.orders)))


@query("cmp_run", """SELECT CAST(o_custkey AS VARCHAR) AS id, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1""")
def cmp_run(t):
    spec = c.Computation(
        name="totals", reads=["orders"], to=["totals"],
        queries={"cents": lambda s: s["orders"].select("o_custkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))},
        calculate=lambda q: {"totals": q["cents"].groupBy(F.col("o_custkey").cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))},
    )
    old = t.orders_v2.groupBy(F.col("o_custkey").cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("cents"))
    return publish.next_state(c.run(spec, lambda n: getattr(t, n), {"totals": old})["totals"])


def by_month(df):
    return df.select("o_orderkey", "o_totalprice", F.concat_ws("/", F.substring("o_orderpriority", 1, 1), F.date_format("o_orderdate", "yyyy-MM")).alias("p"), "o_orderdate")


SCHEMA = "__partition string, n bigint, cents bigint, top double"


def partial(pdf: pd.DataFrame) -> pd.DataFrame:
    cents = (pdf["o_totalprice"] * 100).round().astype("int64").sum()
    return pd.DataFrame({"__partition": [pdf["__partition"].iloc[0]], "n": [len(pdf)], "cents": [cents], "top": [pdf["o_totalprice"].max()]})


def combine(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.groupby("__partition", as_index=False).agg({"n": "sum", "cents": "sum", "top": "max"})


@query("cmp_partitioned", f"""WITH {ORDERS_LOG}, k AS (SELECT *, left(o_orderpriority, 1) || '/' || strftime(o_orderdate, '%Y-%m') AS p FROM orders_v2),
    ch AS (SELECT DISTINCT left(o_orderpriority, 1) || '/' || strftime(o_orderdate, '%Y-%m') AS p FROM orders_log)
    SELECT p AS __partition, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, max(o_totalprice) AS top FROM k WHERE p IN (SELECT p FROM ch) GROUP BY 1""")
def cmp_partitioned(t):
    touched = by_month(t.orders_log).select(F.col("p").alias("key"))
    rows = c.changed_only(by_month(t.orders_v2), F.col("p"), touched)
    return c.by_partition(rows.select("__partition", "o_orderkey", "o_totalprice"), "__partition", ["o_orderkey"], partial, SCHEMA, combine, rows=1000)


@query("udf_group", """SELECT o_orderpriority AS __partition, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, max(o_totalprice) AS top FROM orders GROUP BY 1""")
def udf_group(t):
    rows = t.orders.select(F.col("o_orderpriority").alias("__partition"), "o_orderkey", "o_totalprice")
    return c.by_partition(rows, "__partition", ["o_orderkey"], partial, SCHEMA, combine, rows=1000)


@query("cmp_iterative_plan", """WITH n AS (SELECT doc_id, text, len(string_split(text, ' ')) AS words FROM documents),
    l AS (SELECT doc_id, max(length(w)) AS longest FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM n WHERE words > 60) GROUP BY 1)
    SELECT doc_id, words, longest FROM n LEFT JOIN l USING (doc_id)""")
def iterative_plan(t):
    docs = t.documents.select("doc_id", "text")

    def plan(answers):
        first = docs.select(F.concat(F.lit("words:"), "doc_id").alias("key"), F.col("text").alias("input"))
        long = answers.where("key LIKE 'words:%' AND answer > 60").select(F.regexp_replace("key", "^words:", "").cast("bigint").alias("doc_id"))
        second = docs.join(long, "doc_id").select(F.concat(F.lit("longest:"), "doc_id").alias("key"), F.col("text").alias("input"))
        return first.unionByName(second)

    def work(jobs):
        words = F.split("input", " ")
        value = F.when(F.col("key").startswith("words:"), F.size(words)).otherwise(F.array_max(F.transform(words, F.char_length)))
        return jobs.select("key", value.cast("bigint").alias("answer"))

    def finish(answers):
        part = lambda n: answers.where(F.col("key").startswith(f"{n}:")).select(F.regexp_replace("key", "^.*:", "").cast("bigint").alias("doc_id"), F.col("answer").alias(n))
        return part("words").join(part("longest"), "doc_id", "left")

    return c.iterate(plan, work, finish, "key string, answer bigint")


def jobs(t: Tables):
    return t.documents.select("doc_id", F.lit("count.v1").alias("code"), F.col("lang").alias("command"), F.col("text").alias("input"))


@query("cmp_job_cache", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR EXISTS (SELECT 1 FROM documents o WHERE o.doc_id % 3 = 0 AND o.text = d.text AND o.lang = d.lang) THEN 'known' ELSE CAST(length(text) AS VARCHAR) END AS answer FROM documents d")
def job_cache(t):
    earlier = jobs(t).where("doc_id % 3 = 0")
    then, now = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-01", "2024-01-02"))
    empty = t.spark.createDataFrame([], "key string, answer string, accessed timestamp_ntz")
    first = c.cached(earlier, empty, lambda j: j.withColumn("answer", F.lit("known")), then)[1]
    answers, _ = c.cached(jobs(t), stored(first, "cache"), lambda j: j.withColumn("answer", F.char_length("input").cast("string")), now)
    return answers.select("doc_id", "answer")


@query("cmp_job_cache_evict", """WITH c AS (SELECT doc_id, ts, octet_length(encode(text)) + 128 AS b, reverse(sha256(CAST(doc_id AS VARCHAR))) AS back FROM
      (SELECT doc_id, text, TIMESTAMP '2024-01-01' + to_days((doc_id % 5)::INT) AS ts FROM documents)),
    r AS (SELECT *, row_number() OVER w AS n, sum(b) OVER w AS total FROM c WINDOW w AS (ORDER BY ts DESC, back ROWS UNBOUNDED PRECEDING))
    SELECT doc_id FROM r WHERE n <= 90 AND total <= 250000""")
def job_cache_evict(t):
    day = F.make_dt_interval((F.col("doc_id") % 5).cast("int"))
    cache = t.documents.select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("key"), F.col("text").alias("answer"),
                               (F.lit("2024-01-01").cast("timestamp_ntz") + day).alias("accessed"))
    return c.evicted(cache, entries=90, size=250000).select("doc_id")


@query("cmp_select", """SELECT event_id, '{"k":' || (props ->> '$.k') || ',"t":"' || event_type || '"}' AS answer FROM events""")
def cmp_select(t):
    answer = F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', "t": "'), "event_type", F.lit('", "x": [1, 2]}'))
    return t.events.select("event_id", c.select_fields(answer, ["k", "t", "none"]).alias("answer"))


@query("cmp_nest_rows", """WITH n AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 30 AS part FROM events),
    g AS (SELECT user_id, part, list({event_type: event_type, value: value} ORDER BY event_id) AS items FROM n GROUP BY ALL)
    SELECT c_custkey, coalesce(part, 0) AS part, CAST(to_json({name: c_name, feed: {items: coalesce(items, [])}}) AS VARCHAR) AS doc FROM customer LEFT JOIN g ON c_custkey = user_id""")
def nest_rows(t):
    empty = F.array().cast("array<struct<event_type:string,value:double>>")
    parents = t.customer.select("c_custkey", F.struct(F.col("c_name").alias("name"), F.struct(empty.alias("items")).alias("feed")).alias("doc"))
    rows = t.events.select("user_id", "event_id", "event_type", "value")
    return c.nest(parents, "c_custkey", ["doc", "feed", "items"], rows, "user_id", "event_id", 30).withColumn("doc", F.to_json("doc"))


@query("cmp_stages", """WITH line AS (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS revenue FROM lineitem GROUP BY 1),
    cust AS (SELECT o_custkey, sum(revenue) AS revenue, count(*) AS n FROM orders JOIN line ON o_orderkey = l_orderkey GROUP BY 1)
    SELECT n_name, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(n) AS BIGINT) AS orders FROM cust JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def cmp_stages(t):
    tables = {n: getattr(t, n) for n in ("lineitem", "orders", "customer", "nation")}
    return c.stages(tables, [
        ("line", "SELECT l_orderkey, sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS revenue FROM {lineitem} GROUP BY 1", False),
        ("cust", "SELECT o_custkey, sum(revenue) AS revenue, count(*) AS n FROM {orders} JOIN {line} ON o_orderkey = l_orderkey GROUP BY 1", True),
        ("out", lambda s: s["cust"].join(s["customer"], F.col("o_custkey") == F.col("c_custkey")).join(s["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy("n_name").agg(F.sum("revenue").cast("double").alias("revenue"), F.sum("n").alias("orders")), False),
    ])


@query("udf_on_complete", f"""WITH {ORDERS_V2} SELECT o_orderkey, o_totalprice, greatest(c_acctbal, 0) AS c_acctbal, 1 AS completed, 0 AS torn
    FROM orders_v2 JOIN customer ON o_custkey = c_custkey""")
def on_complete(t):
    base, done = fresh_path(t.spark, "sinks"), []
    sinks = {"orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double", "customer": "c_custkey bigint, c_acctbal double"}
    orders, customers = t.orders_v2.select("o_orderkey", "o_custkey", "o_totalprice"), t.customer.select("c_custkey", F.greatest("c_acctbal", F.lit(0.0)).alias("c_acctbal"))
    versions.commit({"orders": t.orders.select(*orders.columns), "customer": t.customer.select(*customers.columns)}, base)

    def step(customer):
        now = versions.capture(t.spark, base, sinks)
        acted = {"orders": publish.actions(now["orders"], orders, "o_orderkey"), "customer": publish.actions(now["customer"], customer, "c_custkey")}
        publish.publish(acted, lambda tables: versions.commit(tables, base), lambda: done.append(1))

    try:  # the second sink fails after the first is written: neither may change
        step(customers.withColumn("c_acctbal", F.when(F.col("c_custkey") > 0, F.raise_error(F.lit("failed"))).cast("double")))
    except PySparkException:
        pass
    torn = versions.capture(t.spark, base, sinks)["orders"].exceptAll(t.orders.select(*orders.columns)).count()
    step(customers)
    now = versions.capture(t.spark, base, sinks)
    return now["orders"].join(now["customer"], F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "o_totalprice", "c_acctbal", F.lit(len(done)).alias("completed"), F.lit(torn).cast("int").alias("torn"))
