"""The queries of this folder by name, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowtide.llm import collocations, decontamination, divergence, html, languages, licenses, logbilinear, neighbours, packing, simhash, suffixdedup, tokencounts, toxicity

#: The rank file of byte_bpe_50k.json: the same vocabulary and ids.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_decontamination(spark, sf_dir):
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op2_license_scan(spark, sf_dir):
    found = licenses.detect(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["rule"].startswith("phrase "))
    every = F.concat(F.transform("base", lambda m: m["label"]), F.transform("licenses", lambda m: m["label"]))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"),
        F.array_min(F.transform("base", lambda m: m["first_word"])).alias("first_word"), F.array_max(F.transform("base", lambda m: m["first_word"])).alias("last_word"),
        joined(F.transform("base", lambda m: m["label"])).alias("base_labels"), joined(every).alias("labels"),
        F.coalesce(F.array_max(F.transform("licenses", lambda m: m["confidence"])), F.lit(0.0)).alias("score"),
    )


@query
def op3_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), RANKS)


def fold(n: int, id: str = "doc_id"):
    """crc32 of the id as text, modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % n, F.lit(0))


@query
def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = languages.fit(docs.where(fold(4) != 2))
    return languages.identify(docs, model).withColumn("held_out", fold(4) == 2)


@query
def op6_nearest_neighbours(spark, sf_dir):
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query
def op7_logbilinear_lm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return logbilinear.score(docs, fold(10) != 0).withColumn("held_out", fold(10) == 0)


@query
def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold(5) != 0))
    return toxicity.detect(docs, model).withColumn("held_out", fold(5) == 0)


@query
def op5_token_counts(spark, sf_dir):
    counts = tokencounts.count_tokens(table(spark, sf_dir, "documents"), RANKS)
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


@query
def op9_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@query
def op10_html_extraction(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"), keep=["url"])


@query
def op11_collocations(spark, sf_dir):
    return collocations.mine(table(spark, sf_dir, "documents"))


@query
def op13_suffix_dedup(spark, sf_dir):
    return suffixdedup.deduplicate(table(spark, sf_dir, "documents")).drop("removed")


@query
def op12_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL["op1_decontamination"] = rf"""
WITH i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item, w[k : k + least(len(w), 10) - 1] AS p
        FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT len(p) AS n FROM win),
spots AS (SELECT r, k, n, w[k : k + n - 1] AS p
       FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT r, k, n, item FROM spots JOIN win USING (p)),
places AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + n - 1)) AS x FROM (SELECT DISTINCT r, k, n FROM hits)) GROUP BY r),
own AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN own USING (r)
"""

SQL["op11_collocations"] = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOW}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
s AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM w WHERE len(w) > 0),
n AS (SELECT lang, count(*) AS n FROM s GROUP BY lang),
f AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS c
      FROM s, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, k AS m, phrase, c AS a, string_split(phrase, ' ') AS x FROM f WHERE k > 1),
cut AS (SELECT lang, m, phrase, a, k, array_to_string(x[1 : k], ' ') AS f1, array_to_string(x[k + 1 : m], ' ') AS f2 FROM c, (SELECT unnest([1, 2]) AS k) WHERE k < m),
sc AS (SELECT cut.*, l.c AS l, r.c AS r, (CAST(1000000 AS HUGEINT) * a * a) // (CAST(l.c AS HUGEINT) * r.c) AS score
       FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = f1 JOIN f r ON r.lang = cut.lang AND r.phrase = f2),
low AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, array_to_string(x[k : k + 1], ' ') AS phrase, max(a) AS b FROM c, (SELECT unnest([1, 2]) AS k) WHERE m = 3 GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN longer ON longer.lang = low.lang AND longer.phrase = low.phrase WHERE b IS NULL OR 100 * b < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

SQL["op12_source_divergence"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all({_LOW}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
size AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
cell AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
own AS (SELECT lang, source, sum(c) AS n FROM cell GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
p AS (SELECT g.lang, g.source, k.term, coalesce(cell.c, 0) AS c,
             1 + (CAST(1000000000 AS HUGEINT) * (coalesce(cell.c, 0) + 2)) // CAST(coalesce(own.n, 0) + 2 * v AS HUGEINT) AS p,
             1 + (CAST(1000000000 AS HUGEINT) * (k.c + 2)) // CAST(size.n + 2 * v AS HUGEINT) AS q
      FROM g JOIN kept k USING (lang) JOIN size USING (lang) LEFT JOIN own ON own.lang = g.lang AND own.source = g.source
      LEFT JOIN cell ON cell.lang = g.lang AND cell.source = g.source AND cell.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
          UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

SQL["op13_suffix_dedup"] = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT r, i, md5(b[i : i + 399]) AS m FROM (SELECT r, b, unnest(generate_series(1, octet_length(b) - 399)) AS i FROM d WHERE octet_length(b) >= 400)),
again AS (SELECT m FROM s GROUP BY m HAVING count(*) > 1),
hit AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM s SEMI JOIN again USING (m)),
run AS (SELECT r, min(i) AS a, max(i) + 399 AS z FROM (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM hit) GROUP BY r, k),
edge AS (SELECT r, a, z, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) + 1 AS since, lead(a) OVER (PARTITION BY r ORDER BY a) AS next FROM run),
own AS (SELECT r, sum(z - a + 1) AS n_removed, count(*) AS n_spans FROM run GROUP BY r),
part AS (SELECT r, a, hex(CASE WHEN a > since THEN b[since : a - 1] ELSE ''::BLOB END) || hex(CASE WHEN next IS NULL AND z < octet_length(b) THEN b[z + 1 : octet_length(b)] ELSE ''::BLOB END) AS h
         FROM edge JOIN d USING (r)),
kept AS (SELECT r, sha256(unhex(string_agg(h, '' ORDER BY a))) AS kept FROM part GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, coalesce(kept, sha256(b)) AS kept_sha256
FROM d LEFT JOIN own USING (r) LEFT JOIN kept USING (r)
"""
