"""Toxic passages by maximum-scoring segments.

Learning: in a bounded sample of labelled documents each word is counted by the number of toxic and clean documents that
have it, and each word beginning of 4, 5 and 6 bytes by the sums of its words without the most toxic one, so that
a beginning counts only where it is a stem of several. The score is the log-odds ratio under a Dirichlet prior in proportion to
the corpus: to the number of all documents that have the entry, which a pass over the corpus counts for the words and beginnings of
`CANDIDATE` toxic documents or more. It enters the lexicon if the ratio and its z-value are large. A word scores as its best entry, any other word
costs `DRIFT`, so that a text's expected score falls.

Scoring: one linear pass over a text's hits finds every maximal segment (each best passage that no extension or
neighbour improves). Under Karlin and Altschul's limit the best score of a clean text of n words follows an extreme-value law; its
decay rate solves sum p exp(rate * score) = 1, over the scores of all words of the clean sample, so a segment gets a p-value that takes the
text's length into account. A document's evidence is -log10 of its best segment's p-value, and a logistic curve
through the sample's evidence gives the score.

Texts never shuffle: the sample of labels is small by construction and joins as a broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from rowtide.llm import texts as X
from rowtide.llm.languages import _platt
from rowtide.session import stored

SAMPLE = {1: 20_000, 0: 60_000}  # labelled documents learned from, at most about as many
PREFIXES = (4, 5, 6)
PRIOR = 0.25  # weight of the corpus, as a share of the sample
LEAST_Z, LEAST_RATIO, DRIFT = 3.5, 1.0, 0.25
CANDIDATE = 5  # toxic documents of the sample; an entry of fewer has no such z-value


@dataclass
class Model:
    entries: pa.Array  # words, and beginnings with a * after them
    scores: np.ndarray
    rate: float
    density: float  # K of the limit law
    slope: float
    bias: float


def _entries(words: pa.Array) -> list[pa.Array]:
    """The words themselves, and their beginnings; null where a word is shorter or no longer than that."""
    size = pc.binary_length(words)
    star = pa.scalar(b"*", pa.binary())
    out = [words]
    for n in PREFIXES:
        long = pc.greater(size, n)
        out.append(pc.if_else(long, pc.binary_join_element_wise(pc.binary_slice(words, 0, n), star, pa.scalar(b"", pa.binary())), None))
    return out


def segments(at: list[int], score: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a text whose hits lie at `at`; any other place costs `drift`.

    One pass with a stack of candidates; each is merged or kept once, so the time is linear in the hits.
    """
    stack: list[tuple[float, float, int, int]] = []  # sum before, sum through, first, last
    total, before = 0.0, -1
    for place, gain in zip(at, score):
        total -= drift * (place - before - 1)
        left, total, before = total, total + gain, place
        first = place
        while stack:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j -= 1
            if j < 0 or stack[j][1] >= total:
                break
            left, first = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((left, total, first, place))
    return [(a, b, hi - lo) for lo, hi, a, b in stack]


def _hits(column: pa.Array, entries: pa.Array, scores: np.ndarray):
    """(n words of each text, then (text, word places, scores) for texts with a hit)."""
    data, offsets = X.utf8(column)
    found, _, _, first = X.words(data, offsets, X.ALNUM)
    n, hits = np.diff(first), []
    if len(entries) and len(found):
        coded = found.dictionary_encode()
        best = np.zeros(len(coded.dictionary))
        for kind in _entries(coded.dictionary):
            i = pc.fill_null(pc.index_in(kind, entries, skip_nulls=True), -1).to_numpy()
            best = np.maximum(best, np.where(i >= 0, scores[i], 0))
        every = best[coded.indices.to_numpy()]
        at = np.flatnonzero(every > 0)
        doc = np.searchsorted(first, at, "right") - 1
        cuts = np.flatnonzero(np.diff(doc)) + 1
        for own, d in zip(np.split(at, cuts), doc[np.concatenate([[0], cuts])] if len(at) else ()):
            hits.append((int(d), (own - first[d]).tolist(), every[own].tolist()))
    return n, hits


def decay(gain: np.ndarray, hits: np.ndarray, words: float) -> float:
    """The root above 0 of sum p e^(r s) = 1 over all words: `hits` of them score `gain`, the others minus `DRIFT`."""
    p = hits / max(words, 2 * hits.sum())
    lo, hi = 1e-6, 60.0 / float(gain.max())
    for _ in range(80):
        mid = (lo + hi) / 2
        below = p @ np.exp(mid * gain) + (1 - p.sum()) * math.exp(-mid * DRIFT) < 1
        lo, hi = (mid, hi) if below else (lo, mid)
    return lo


def _corpus(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """(w, n): for the words and beginnings of `entries` and the words they leave out, the documents that have them, over all `texts`.

    A beginning's number is the sum of its words'. The entries come from the bounded sample and go to every task.
    """
    asked = entries.select("w").unionByName(entries.where("but IS NOT NULL").select(F.col("but").alias("w"))).distinct()
    known = pa.array(asked.toArrow()["w"].to_pylist(), pa.binary())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(known), np.int64)
        for block in X.blocks(batches, "t"):
            found, _, _, first = X.words(*X.utf8(block.column("t")), X.ALNUM)
            coded = found.dictionary_encode()
            size = max(1, len(coded.dictionary))
            doc = np.repeat(np.arange(block.num_rows), np.diff(first))
            n = np.bincount(np.unique(doc * size + coded.indices.to_numpy()) % size, minlength=len(coded.dictionary))
            for kind in _entries(coded.dictionary) if len(known) and len(found) else ():
                at = pc.fill_null(pc.index_in(kind, known, skip_nulls=True), -1).to_numpy()
                np.add.at(sums, at[at >= 0], n[at >= 0])
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([known.take(pa.array(some)), pa.array(sums[some])], ["w", "n"])

    return texts.mapInArrow(count, "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: dict[int, int] = SAMPLE) -> Model:
    """Lexicon, limit law and calibration from labels 1 and 0; other values, null ids and null texts teach nothing.

    A document with several labels is toxic if one says so.
    """
    marks = labels.where(F.col(toxic).isin(0, 1) & F.col(id).isNotNull()).groupBy(F.col(id).alias("i")).agg(F.max(toxic).cast("int").alias("y"))
    have = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64("i", F.lit(29)), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("y") == 1, sample[1] / max(1, have.get(1, 0))).otherwise(sample[0] / max(1, have.get(0, 0)))
    chosen = F.broadcast(stored(marks.where(place < share), "toxic-sample"))  # about sum(sample.values()) rows
    rows = docs.select(F.col(id).alias("i"), F.col(text).alias("t")).where("t IS NOT NULL").join(chosen, "i").select("t", "y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, rows_ = [], 0

        def flush():
            out = pa.concat_tables(pending).group_by("w").aggregate([("n1", "sum"), ("n0", "sum")])
            return pa.table({"w": out["w"], "n1": out["n1_sum"], "n0": out["n0_sum"]})

        for block in X.blocks(batches, "t"):
            y = block.column("y").to_numpy().astype(np.int64)
            data, offsets = X.utf8(block.column("t"))
            found, _, _, first = X.words(data, offsets, X.ALNUM)
            coded = found.dictionary_encode()
            codes = coded.indices.to_numpy()
            doc = np.repeat(np.arange(block.num_rows), np.diff(first))
            size = max(1, len(coded.dictionary))
            d, e = np.divmod(np.unique(doc * size + codes), size)
            n1 = np.bincount(e, weights=y[d], minlength=len(coded.dictionary)).astype(np.int64)
            n = np.bincount(e, minlength=len(coded.dictionary))
            pending.append(pa.table({"w": coded.dictionary, "n1": n1, "n0": n - n1}))
            rows_ += size
            if rows_ > 400_000:
                table = flush()
                pending, rows_ = [table], len(table)
                if rows_ > 200_000:
                    yield from table.to_batches()
                    pending, rows_ = [], 0
        if pending:
            yield from flush().to_batches()

    n1, n0 = min(have.get(1, 0), sample[1]), min(have.get(0, 0), sample[0])
    words = stored(rows.mapInArrow(count, "w binary, n1 bigint, n0 bigint").groupBy("w").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")), "toxic-words")
    lexicon = words.withColumn("but", F.lit(None).cast("binary"))
    for k in PREFIXES:  # a beginning counts what it adds to its most toxic word
        start = F.concat(F.substring("w", 1, k), F.lit(b"*")).alias("w")
        most = F.struct("n1", "w")
        rest = [(F.sum(n) - F.max_by(n, most)).alias(n) for n in ("n1", "n0")]
        lexicon = lexicon.unionByName(words.where(F.octet_length("w") > k).groupBy(start).agg(*rest, F.max_by("w", most).alias("but")))
    lexicon = stored(lexicon.where(F.col("n1") >= CANDIDATE), "toxic-entries")
    every = docs.select(F.col(text).alias("t")).where("t IS NOT NULL")
    corpus, documents = _corpus(every, lexicon), max(1, every.count())
    lexicon = lexicon.join(corpus.select("w", F.col("n").alias("all")), "w", "left").join(corpus.select(F.col("w").alias("but"), F.col("n").alias("less")), "but", "left")
    total = PRIOR * (n1 + n0)
    a = total / documents * F.greatest(F.coalesce("all", F.lit(0)) - F.coalesce("less", F.lit(0)), F.lit(1))
    rate = lambda y, n: F.log((y + a) / F.lit(n + total))
    z = F.col("s") / F.sqrt(1 / (F.col("n1") + a) + 1 / (F.col("n0") + a))
    lexicon = lexicon.withColumn("s", rate(F.col("n1"), n1) - rate(F.col("n0"), n0)).where((F.col("s") >= LEAST_RATIO) & (z >= LEAST_Z))
    table = lexicon.select("w", "s").toArrow()  # words of at least 10 or so documents of the sample
    entries, scores = pa.array(table["w"].to_pylist(), pa.binary()), table["s"].to_numpy()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in X.blocks(batches, "t"):
            n, hits = _hits(block.column("t"), entries, scores)
            best = np.zeros(block.num_rows)
            for d, at, score in hits:
                best[d] = max(s for _, _, s in segments(at, score, DRIFT))
            yield pa.RecordBatch.from_arrays([block.column("y"), pa.array(n.astype(np.int64)), pa.array(best)], ["y", "n", "best"])

    def scores_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[float, int] = {}
        for block in X.blocks(batches, "t"):
            for _, _, score in _hits(block.column("t"), entries, scores)[1]:
                for s in score:
                    sums[s] = sums.get(s, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.float64()), pa.array(list(sums.values()), pa.int64())], ["s", "n"])

    seen = rows.mapInArrow(scan, "y int, n bigint, best double").toArrow()  # a row for each of the sample
    y, n, best = (seen[c].to_numpy() for c in ("y", "n", "best"))
    clean = y == 0
    found = rows.where("y = 0").mapInArrow(scores_of, "s double, n bigint").groupBy("s").agg(F.sum("n").alias("n")).orderBy("s").toArrow()  # a row an entry at most
    typical = float(np.median(scores)) if len(scores) else 1.0
    gain, hits = np.append(found["s"].to_numpy(), typical), np.append(found["n"].to_numpy(), 0.5)
    rate = decay(gain, hits, float(n[clean].sum()) + 1.0)
    tail = n[clean] * np.exp(-rate * best[clean])
    density = (float((best[clean] > 0).sum()) + 0.5) / (float(tail[best[clean] > 0].sum()) + float(np.exp(-rate * typical) * n[clean].sum()) + 1e-9)
    x = evidence(best, n, rate, density)
    slope, bias = (_platt(x, 2 * y - 1.0, np.ones(len(y))) if len(set(y.tolist())) == 2 else (1.0, -3.0))
    return Model(entries, scores, rate, density, max(slope, 1e-3), bias)


def p_value(score: np.ndarray, n: np.ndarray, rate: float, density: float) -> np.ndarray:
    """Chance that a clean text of n words has a segment of that score."""
    return -np.expm1(-density * np.maximum(n, 1) * np.exp(-rate * np.asarray(score, float)))


def evidence(best: np.ndarray, n: np.ndarray, rate: float, density: float) -> np.ndarray:
    return np.where(best > 0, 1.0 - np.log10(np.maximum(p_value(best, n, rate, density), 1e-12)), 0.0)


def detect(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", keep: Sequence[str] = (), level: float = 0.05) -> DataFrame:
    """Per row of `docs`: id, kept columns, score (0 to 1), predicted (1 from 0.5 on), and its significant `passages`.

    A passage is (first_word, last_word, score, p_value) with a p-value of at most `level`, or the best one of a text that is predicted
    toxic. A null, empty or wordless text has no passage and the score of a text without a hit. Repeated rows each
    come back; kept columns must not have a result's name; others are not looked at.
    """
    base, back = X.kept(docs, id, text, keep)
    added = (("score", "double"), ("predicted", "int"), ("passages", "array<struct<first_word:bigint,last_word:bigint,score:double,p_value:double>>"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in X.blocks(batches, text):
            n, hits = _hits(block.column(text), model.entries, model.scores)
            best, own = np.zeros(block.num_rows), [[] for _ in range(block.num_rows)]
            for d, at, score in hits:
                found = segments(at, score, DRIFT)
                best[d] = max(s for _, _, s in found)
                own[d] = [dict(first_word=a, last_word=b, score=s, p_value=float(p_value(s, n[d], model.rate, model.density))) for a, b, s in found]
            score = 1 / (1 + np.exp(-np.clip(model.slope * evidence(best, n, model.rate, model.density) + model.bias, -30, 30)))
            for d, _, _ in hits:
                own[d] = [s for s in own[d] if s["p_value"] <= level or (score[d] >= 0.5 and s["score"] == best[d])]
            passages = pa.array(own, pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())])))
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in back), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), passages], [*back, *(c for c, _ in added)])

    return base.mapInArrow(scan, X.struct(base, back, added))
