"""Language identification with error-correcting output codes.

Every language gets a codeword; one binary classifier a bit, over hashed byte n-grams of all positions of the text, tells
the languages with a 1 there from those with a 0. The classifiers are log-ratios of n-gram frequencies, pooled by language, so that
all bits come from one count table. Decoding adds, for every language, the bits' logistic losses against its
codeword, weighted by how well each bit does on the training sample; the smallest sum wins. A runner-up that is
close marks the text as ambiguous.

Training takes a sample of at most about `sample` rows, the same number from each language where there are as many, drawn
with a fixed seed; whole texts are counted in tasks and only (language, n-gram bucket) sums come to the driver.
Prediction is one pass without a shuffle.
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

ORDERS = (2, 3, 4)
BITS = 14  # buckets of an order: 2 ** BITS
SAMPLE = 24_000
UNKNOWN = "und"
_BLOCK = 1 << 20
_SIZE = len(ORDERS) << BITS
_FOLD = np.where(((X._BYTES | 32) >= 0x61) & ((X._BYTES | 32) <= 0x7A) | (X._BYTES >= 0x80), X.LOWER, 0x20).astype(np.uint8)
_MIX = np.uint32(0x9E3779B1)


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the bucket of the n-gram at every byte; _SIZE where none begins (a text's end, only separators)."""
    folded = _FOLD[data].astype(np.uint32)
    ends = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    for k, n in enumerate(ORDERS):
        code = np.zeros(len(folded), np.uint32)
        for i in range(n):
            code[: len(folded) - i] |= folded[i:] << np.uint32(8 * i)
        blank = np.uint32(sum(0x20 << (8 * i) for i in range(n)))
        bucket = ((code * _MIX) >> np.uint32(32 - BITS)).astype(np.int32) + (k << BITS)
        bucket[(ends < n) | (code == blank)] = _SIZE
        yield bucket


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of -1 and 1: all splits of up to 7 classes, else about 10 log2 k random ones with distant rows."""
    if k <= 1:
        return np.zeros((k, 0), np.int8)
    if k <= 7:
        table = (np.arange(1, 2 ** (k - 1))[None, :] >> np.arange(k)[:, None]) & 1
        return (2 * table - 1).astype(np.int8)
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(200):
        table = rng.choice(np.array([-1, 1], np.int8), (k, math.ceil(10 * math.log2(k))))
        apart = (table[:, None, :] != table[None, :, :]).sum(2) + 10**6 * np.eye(k, dtype=np.int64)
        if apart.min() > far and np.all(np.abs(table.sum(0)) < k):
            best, far = table, int(apart.min())
    return best


@dataclass
class Model:
    """Languages, codewords (languages x bits), n-gram weights (buckets + 1 x bits), and each bit's scale, shift and weight."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    trust: np.ndarray


def margins(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean weight of each text's n-grams for every bit."""
    n = len(offsets) - 1
    out, count = np.zeros((n, weights.shape[1])), np.zeros(n)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        for bucket in grams(data, offsets):
            count[full] += np.add.reduceat((bucket < _SIZE).astype(np.int64), offsets[full])
            for b in range(weights.shape[1]):
                out[full, b] += np.add.reduceat(weights[bucket, b], offsets[full], dtype=np.float64)
    return out / np.maximum(count, 1)[:, None]


def _platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve through margins x and signs y, by damped Newton steps with a small penalty."""
    design = np.stack([x, np.ones(len(x))], 1)
    sign = np.where(y > 0, 1.0, -1.0)
    loss = lambda w: weight @ np.logaddexp(0, -sign * (design @ w)) + 0.05 * (w @ w)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (weight * (p - (sign > 0))) + 0.1 * w
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        step, size, now = np.linalg.solve(hess, grad), 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Codewords and bit classifiers from rows with a language; a null language or null text teaches nothing.

    The sample is drawn by a hash of the text, so it does not depend on how rows are stored, and copies of a text teach once.
    Without such rows every text is `und`.
    """
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t IS NOT NULL AND l IS NOT NULL")
    sizes = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    k = sizes.count()
    if not k:
        return Model([], codewords(0), np.zeros((_SIZE + 1, 0)), *(np.zeros(0),) * 3)
    share = sizes.select("l", (F.lit(float(sample)) / k / F.col("n")).alias("share"))
    if k <= 10_000:  # a row for each language
        share = F.broadcast(share)
    place = F.pmod(F.xxhash64("t", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(share, "l").where(place < F.col("share")).select("l", "t").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name in pc.unique(batch.column("l")).to_pylist():
                own = batch.filter(pc.equal(batch.column("l"), name))
                total = sums.setdefault(name, np.zeros(_SIZE + 1, np.int64))
                for block in X.blocks([own], "t", _BLOCK):
                    for bucket in grams(*X.utf8(block.column("t"))):
                        total += np.bincount(bucket, minlength=_SIZE + 1)
        for name, total in sums.items():
            at = np.flatnonzero(total[:_SIZE])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["l", "g", "n"])

    table = chosen.mapInArrow(count, "l string, g int, n bigint").groupBy("l", "g").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(r["l"] for r in sizes.select("l").collect())
    counts = np.zeros((k, _SIZE))
    counts[np.array([languages.index(x) for x in table["l"].to_pylist()], np.int64), table["g"].to_numpy()] = table["n"].to_numpy()
    rates = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)  # each language counts alike
    codes = codewords(k)
    weights = np.zeros((_SIZE + 1, codes.shape[1]), np.float32)
    for b in range(codes.shape[1]):
        weights[:_SIZE, b] = np.log(rates[codes[:, b] > 0].mean(0)) - np.log(rates[codes[:, b] < 0].mean(0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in X.blocks(batches, "t", _BLOCK):
            m = margins(*X.utf8(block.column("t")), weights)
            yield pa.RecordBatch.from_arrays([block.column("l"), X.lists(pa.array(m.ravel()), np.full(len(m), m.shape[1]))], ["l", "m"])

    bits = codes.shape[1]
    scale, shift, trust = np.ones(bits), np.zeros(bits), np.ones(bits)
    if bits:
        seen = chosen.mapInArrow(score, "l string, m array<double>").toArrow()  # `sample` rows
        if len(seen):
            m = np.array(seen["m"].to_pylist())
            own = np.array([languages.index(x) for x in seen["l"].to_pylist()])
            weight = 1 / np.bincount(own, minlength=k)[own]
            weight *= len(own) / weight.sum()
            for b in range(bits):
                sign = codes[own, b]
                scale[b], shift[b] = _platt(m[:, b], sign, weight)
                right = weight @ ((m[:, b] * scale[b] + shift[b] > 0) == (sign > 0)) / weight.sum()
                trust[b] = max(0.0, 2 * right - 1)
            if not trust.any():
                trust[:] = 1
    return Model(languages, codes, weights, scale, shift, trust / max(1e-12, trust.sum()))


def has_letter(column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a text has a letter: an ASCII one in its bytes, else any of general category L."""
    ascii_ = ((data | 32) >= 0x61) & ((data | 32) <= 0x7A) & (data < 0x80)
    seen = np.concatenate([[0], np.cumsum(ascii_)])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[i] = any(c.isalpha() for c in column[i].as_py())
    return out


def identify(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", keep: Sequence[str] = (), close: float = 0.25) -> DataFrame:
    """Per row of `docs`: id, kept columns, lang_pred, score (0 to 1, the share of exp(-loss) that the language has), ambiguous.

    A null text and one without a letter are `und` with score 0, never ambiguous; so is every text if no language was learned.
    With one language learned it is predicted with score 1. `ambiguous`: the runner-up's share is over 1 - `close` of
    the winner's. Equal losses go to the language first by name. Repeated rows each come back; kept
    columns must not have a result's name; others are not looked at.
    """
    base, back = X.kept(docs, id, text, keep)
    added = (("lang_pred", "string"), ("score", "double"), ("ambiguous", "boolean"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.languages)
        for block in X.blocks(batches, text, _BLOCK):
            column = block.column(text)
            data, offsets = X.utf8(column)
            known = has_letter(column, data, offsets) if k else np.zeros(block.num_rows, bool)
            m = np.clip(margins(data, offsets, model.weights) * model.scale + model.shift, -30, 30)
            loss = np.stack([np.log1p(np.exp(-m * code)) @ model.trust for code in model.codes]) if k else np.zeros((1, block.num_rows))
            share = np.exp(-loss * max(1, model.codes.shape[1]))
            share /= share.sum(0)
            best = share.argmax(0)
            top = share[best, np.arange(block.num_rows)]
            rest = share.copy()
            rest[best, np.arange(block.num_rows)] = 0
            names = pa.array([model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known.tolist())], pa.string())
            near = known & (k > 1) & (rest.max(0) > (1 - close) * top)
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in back), names, pa.array(np.where(known, top, 0.0)), pa.array(near)], [*back, *(c for c, _ in added)])

    return base.mapInArrow(scan, X.struct(base, back, added))
