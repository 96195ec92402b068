"""The corpus pipeline: language, toxicity, near-duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on every document the one before it kept and returns the columns of documents; the last
one returns packed pieces. Every result is written as Parquet to the shared folder and read again, so a lost executor
repeats tasks of one stage only. Columns besides doc_id and text travel as one struct and clash with nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowtide.llm import decontamination, languages, packing, simhash, toxicity
from rowtide.llm.registry import RANKS, table
from rowtide.session import stored

#: No SQL says this: the stages learn models and pack; tests/llm compares it with a brute-force version.
ORACLE_SQL = None


def _kept(docs: DataFrame, run: Callable[[DataFrame], DataFrame], stays: Column) -> DataFrame:
    """The rows of `docs` for which `stays` holds in the result of `run`, with all their columns."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = run(docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *rest).alias("_rest"))).where(stays)
    return found.select(*(F.col("_rest").getField(c).alias(c) if c in rest else F.col(c) for c in docs.columns))


KEEP = ["text", "_rest"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts that are null, have no letter or could be one of two languages; learned from all rows with a language."""
    model = languages.fit(docs)
    return _kept(docs, lambda d: languages.identify(d, model, keep=KEEP), (F.col("lang_pred") != languages.UNKNOWN) & ~F.col("ambiguous"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that are predicted toxic; learned from all labels of documents that are left."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _kept(docs, lambda d: toxicity.detect(d, model, keep=KEEP), F.col("predicted") == 0)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one with the smallest id."""
    return _kept(docs, lambda d: simhash.near_duplicates(d, keep=KEEP), F.col("stays"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a window of a benchmark item."""
    items = table(spark, sf_dir, "benchmark")
    return _kept(docs, lambda d: decontamination.decontaminate(d, items, keep=KEEP), F.col("n_hit") == 0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, in sequences of 2048 tokens."""
    return packing.pack(docs, RANKS)


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", benchmark), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
