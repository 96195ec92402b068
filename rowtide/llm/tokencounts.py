"""Token counts: the pieces of each distinct pre-token are counted once and joined to the documents' pre-token frequencies.

1. Every block of texts gives its distinct pre-tokens with their numbers; they are summed by pre-token over the corpus.
2. Each distinct pre-token is split once; the table (pre-token, frequency, pieces) is stored.
3. Pre-tokens that make up at least 1 / `hot` of the corpus go to every task as a table; there are `hot` of them at most,
   whatever the corpus. They are the hot join keys, so the join that follows has none.
4. The rest of each document's pre-tokens is joined by pre-token and summed by document.

No list of ids is ever made. What shuffles is one row for each block's distinct pre-token and one for each rare
pre-token of a document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rowtide.llm import pretokens as R, texts as X
from rowtide.session import stored

SPECIAL = ("<|endoftext|>",)
HOT = 1 << 20
_PENDING = 400_000  # distinct pre-tokens that a task holds before it hands them on


def summed(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by("token").aggregate([("n", "sum")])
    return pa.table({"token": out["token"], "n": out["n_sum"]})


def frequencies(batches: Iterator[tuple[pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(distinct values, numbers) of blocks, summed as far as a task's memory goes."""
    pending, rows = [], 0
    for tokens, n in batches:
        pending.append(pa.table({"token": tokens, "n": pa.array(n, pa.int64())}))
        rows += len(tokens)
        if rows > _PENDING:
            table = summed(pending)
            pending, rows = [table], len(table)
            if rows > _PENDING // 2:
                yield from table.to_batches()
                pending, rows = [], 0
    if pending:
        yield from summed(pending).to_batches()


def rare(doc: np.ndarray, codes: np.ndarray, dictionary: pa.Array, n_docs: int) -> tuple[pa.Array, pa.Array]:
    """Lists of each document's distinct values among (doc, code) places, and of their numbers."""
    pairs, times = np.unique(doc * max(1, len(dictionary)) + codes, return_counts=True)
    owner, code = np.divmod(pairs, max(1, len(dictionary)))
    counts = np.bincount(owner, minlength=n_docs)
    return X.lists(dictionary.take(pa.array(code)), counts), X.lists(pa.array(times.astype(np.int64)), counts)


def count_tokens(
    docs: DataFrame, ranks: str, id: str = "doc_id", text: str = "text", keep: Sequence[str] = (), special: tuple[str, ...] = SPECIAL, hot: int = HOT
) -> DataFrame:
    """Per row of `docs`: id, kept columns, n_bytes (UTF-8) and n_tokens of its whole text.

    `ranks` is the path of a byte-level vocabulary's rank file. A null or empty text has no byte and no token. Repeated
    rows each come back, rows with one id and different texts too. Other columns are not looked at; kept ones must
    not be called n_bytes or n_tokens.
    """
    base, back = X.kept(docs, id, text, keep)

    def numbers(batches):
        def each():
            for block in X.blocks(batches, text):
                dictionary, codes, _ = R.distinct(block.column(text), special)
                yield dictionary, np.bincount(codes, minlength=len(dictionary))

        yield from frequencies(each())

    def pieces(batches):
        for batch in batches:
            sizes = [len(p) for p in R.encode(batch.column("token").to_pylist(), ranks, special)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], [*batch.schema.names, "pieces"])

    counted = base.select(text).mapInArrow(numbers, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    vocabulary = stored(counted.mapInArrow(pieces, "token binary, n bigint, pieces bigint"), "pretokens")
    total = vocabulary.agg(F.sum("n")).first()[0] or 0
    known = vocabulary.where(F.col("n") * hot >= total).select("token", "pieces").toArrow().combine_chunks()  # `hot` rows at most
    names, known_pieces = pa.array(known["token"].to_pylist(), pa.binary()), known["pieces"].to_numpy()

    def documents(batches):
        row = TaskContext.get().partitionId() << 40
        for block in X.blocks(batches, text):
            n = block.num_rows
            dictionary, codes, first = R.distinct(block.column(text), special)
            at = pc.fill_null(pc.index_in(dictionary, names), -1).to_numpy()
            value = np.where(at >= 0, known_pieces[at], 0) if len(names) else np.zeros(len(at), np.int64)
            sums = np.concatenate([[0], np.cumsum(value[codes])])
            doc = np.repeat(np.arange(n), np.diff(first))
            cold = (at < 0)[codes]
            tokens, times = rare(doc[cold], codes[cold], dictionary, n)
            size = pc.fill_null(pc.binary_length(block.column(text)), 0).cast(pa.int64())
            columns = [pa.array(np.arange(row, row + n)), *(block.column(c) for c in back), size, pa.array(sums[first[1:]] - sums[first[:-1]]), tokens, times]
            yield pa.RecordBatch.from_arrays(columns, ["_row", *back, "n_bytes", "_known", "_tokens", "_times"])
            row += n

    added = (("n_bytes", "bigint"), ("_known", "bigint"), ("_tokens", "array<binary>"), ("_times", "array<bigint>"))
    schema = X.struct(base, back, added)
    schema = type(schema)([*X.struct(base, [], (("_row", "bigint"),)).fields, *schema.fields])
    rows = stored(base.mapInArrow(documents, schema), "token-rows")
    cold = rows.select("_row", F.explode(F.arrays_zip("_tokens", "_times")).alias("x")).select("_row", F.col("x._tokens").alias("token"), F.col("x._times").alias("times"))
    cold = cold.join(vocabulary.select("token", "pieces"), "token").groupBy("_row").agg(F.sum(F.col("times") * F.col("pieces")).alias("_rest"))
    total = (F.col("_known") + F.coalesce("_rest", F.lit(0))).cast("bigint").alias("n_tokens")
    return rows.drop("_tokens", "_times").join(cold, "_row", "left").select(*back, "n_bytes", total)
