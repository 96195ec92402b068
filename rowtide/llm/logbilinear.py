"""A class-factored log-bilinear language model trained with noise-contrastive estimation, over corpus word counts.

Counts: every word of the training documents is counted over the corpus; the table stays distributed. Words counted at least
sqrt(tokens / `vocabulary`) times, and twice, are items of the neural model, so their number grows with the corpus (as its root where counts
follow Zipf's law). Any other word belongs to one of `GROUPS` items by its last two bytes, and within its group follows the smoothed
counts. The end is an item too.

Model: the vector of an item's context is the sum of the vectors of the two items before it, each times a vector of its position. Items
are dealt to classes by their counts, of equal sums of root counts. The vector's score with a class's vector and bias is the
log-probability of the class, its score with an item's own vector and bias that of the item inside its class. Training is one pass
of numpy batches, the true class against noise classes and the true item against items of its class: first in one task
on a bounded sample of distinct texts (about `SAMPLE` of them and `SAMPLE_BYTES`, drawn by a hash) for a common start, then in every task over all its training documents from there. A row of the parameters is
averaged over the tasks that changed it, by what it learned there, `FAN` tasks at a time. A task's batches are matrix products.

Scoring: a block's distinct contexts are multiplied with all classes, and its distinct (context, class) pairs with the class's items; both
are normalised, so the item probabilities are exact. Words too rare to be known in every task are joined to the count table by
word; items and those that make up 1 / `hot` of the corpus, the hot keys, are not.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from rowtide.llm import texts as X
from rowtide.llm.tokencounts import frequencies, rare
from rowtide.session import stored

VOCABULARY, GROUPS, HOT, SAMPLE = 25_000, 64, 1 << 17, 2000
DIMENSIONS, CONTEXT, NOISE, INNER, BATCH, RATE, CHUNK = 24, 2, 96, 64, 4096, 0.2, 512
HELD = 31 << 20  # bytes; the C library does not keep blocks of 32 MB
FAN = 32  # tasks whose parameters one task averages
SAMPLE_BYTES = 16 << 20  # texts of the common start at most, beyond one text
BITS = np.float32(1 / np.log(2))  # a vector times this gives scores in powers of two, which are quicker to raise
SAFE = 80  # exponentials of scores up to it, and their sums, are normal numbers in single precision
ADDED, TILED = 2048, 128  # rows added up or moved at a time, so that they stay in the processor's cache, and multiplied
SCORED, SCAN_BYTES = 1024, 1 << 20  # rows of a score matrix, and bytes of a block of texts: a task holds these besides the model


@dataclass
class Counts:
    """What tasks know of the corpus: hot words with numbers, model words, group sums, and the totals."""

    hot: pa.Array
    hot_n: np.ndarray
    words: pa.Array
    item: np.ndarray  # of each hot word, or -1
    group_n: np.ndarray
    group_v: np.ndarray
    item_n: np.ndarray
    tokens: int
    distinct: int
    ends: int

    def base(self) -> float:
        """log10 of the base model's denominator."""
        return float(np.log10(self.tokens + 0.1 * (self.distinct + 1)))


def hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)


class Numbers:
    """The number of a word in `words`, found by its hash. A task makes one of it, so looking up a block does not cost a table of all `words`."""

    def __init__(self, words: pa.Array):
        value = hashes(words)
        self.words, self.order = words, np.argsort(value)
        self.value = value[self.order]

    def __call__(self, asked: pa.Array) -> np.ndarray:
        """Number of each word, or -1."""
        out = np.full(len(asked), -1, np.int64)
        if not len(self.words) or not len(asked):
            return out
        value = hashes(asked)
        place = np.minimum(np.searchsorted(self.value, value), len(self.value) - 1)
        hit = np.flatnonzero(self.value[place] == value)
        out[hit] = self.order[place[hit]]
        if pc.all(pc.equal(asked.take(pa.array(hit)), self.words.take(pa.array(out[hit]))), min_count=0).as_py():
            return out
        return pc.fill_null(pc.index_in(asked, self.words), -1).to_numpy().astype(np.int64)  # different words with one hash


def hold_memory() -> None:
    """Allocate and free one large block: the C library then keeps freed blocks up to this size, not asking the system for each array's pages anew."""
    np.empty(HELD, np.uint8)


def groups_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Group of each word by its last two bytes, lower-cased."""
    low = X.LOWER[data].astype(np.int64)
    last = low[end - 1] if len(end) else np.zeros(0, np.int64)
    before = np.where(end - start > 1, low[np.maximum(end - 2, 0)], 0) if len(end) else last
    return (before * 31 + last * 7) % GROUPS


def items_of(column: pa.Array, numbers: Numbers, item: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, item of each, hot number or -1 and group of each distinct one, number of the first of each text); `item` is that of each hot word."""
    found, _, _, first = X.words(*X.utf8(column), X.SOLID)
    coded = found.dictionary_encode()
    data, offsets = X.utf8(coded.dictionary)
    at, kind = numbers(coded.dictionary), groups_of(data, offsets[:-1], offsets[1:])
    own = np.append(item, -1)[at]
    own = np.where(own >= 0, own, np.count_nonzero(item >= 0) + kind)
    return coded, own[coded.indices.to_numpy()], at, kind, first


def sequences(items: np.ndarray, first: np.ndarray, n_items: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(items with an end after each text, the contexts of each, number of the first of each text); before a text stands n_items."""
    docs = len(first) - 1
    ends = first[1:] + np.arange(docs)
    out = np.full(len(items) + docs, n_items - 1, np.int64)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = items
    begin = np.concatenate([[0], ends + 1])
    place = np.arange(len(out)) - np.repeat(begin[:-1], np.diff(begin))
    context = np.full((len(out), CONTEXT), n_items, np.int64)
    for j in range(CONTEXT):
        has = place > j
        context[has, j] = out[np.flatnonzero(has) - j - 1]
    return out, context, begin


def classes_of(prior: np.ndarray) -> np.ndarray:
    """Class of each item: by falling count, in classes of equal sums of root counts; numbered from 0, none empty."""
    n = len(prior)
    order = np.argsort(-prior, kind="stable")
    mass = np.sqrt(prior[order])
    wanted = max(1, round(2 * np.sqrt(n / np.log(n + 2))))
    cut = ((np.cumsum(mass) - mass / 2) / mass.sum() * wanted).astype(np.int64)
    out = np.empty(n, np.int64)
    out[order] = np.unique(cut, return_inverse=True)[1]
    return out


def log_sum(bits: np.ndarray, bounded: bool = False) -> np.ndarray:
    """Natural logarithm of each row's sum of powers of two; `bits` is overwritten. `bounded`: no score is beyond `SAFE`, so none need be shifted."""
    if bounded:
        return np.log(np.exp2(bits, out=bits) @ np.ones(bits.shape[1], bits.dtype))
    top = bits.max(1)
    bits -= top[:, None]
    return top / BITS + np.log(np.exp2(bits, out=bits).sum(1))


def by_row(at: np.ndarray, parts: Sequence[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows of `n`, the sum of each row's values); `parts` have the values, in single precision, one after the other."""
    there = np.zeros(n, bool)
    there[at] = True
    rows, place = np.flatnonzero(there), np.empty(n, np.int64)
    width = parts[0].shape[1]
    pairs = (width + 1) // 2  # two columns are added up as one complex number
    place[rows] = np.arange(0, len(rows) * pairs, pairs)
    out = np.zeros(len(rows) * pairs, np.complex64)
    value, columns, begin = np.zeros((ADDED, 2 * pairs), np.float32), np.arange(pairs), 0
    for part in parts:
        for lo in range(0, len(part), ADDED):
            some = part[lo : lo + ADDED]
            value[: len(some), :width] = some
            to = place.take(at[begin + lo : begin + lo + len(some)])[:, None] + columns
            np.add.at(out, to.ravel(), value[: len(some)].view(np.complex64).ravel())
        begin += len(part)
    return rows, out.view(np.float32).reshape(-1, 2 * pairs)[:, :width]


def times(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """x * row; many rows at a time, as a short row alone is mostly overhead."""
    out, whole, many = np.empty_like(x), len(x) // TILED * TILED, np.tile(row, TILED)
    np.multiply(x[:whole].reshape(-1, len(many)), many, out=out[:whole].reshape(-1, len(many)))
    np.multiply(x[whole:], row, out=out[whole:])
    return out


def apart(context: np.ndarray, j: int) -> np.ndarray:
    """Places whose item j + 1 before is not the last item of the place j before."""
    row = context[:, j]
    return np.concatenate([np.arange(min(j, len(row))), np.flatnonzero(row[j:] != context[: len(row) - j, 0]) + j])


class Model:
    """Parameters in one table, a vector and a bias a row: contexts, positions, items in the order of their classes, classes."""

    def __init__(self, n_items: int, flat: np.ndarray | None = None, prior: np.ndarray | None = None):
        self.n, self.prior = n_items, prior
        self.group = classes_of(prior)
        order = np.argsort(self.group, kind="stable")
        self.row = np.empty(n_items, np.int64)
        self.row[order] = np.arange(n_items)
        self.size = np.bincount(self.group)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.noise = prior[order]
        self.group_noise = np.add.reduceat(self.noise, self.first[:-1])
        a, b, c, d = np.cumsum([n_items + 1, CONTEXT, n_items, len(self.size)])
        if flat is None:
            flat = np.random.default_rng(5).normal(0, 0.1, (d, DIMENSIONS + 1)).astype(np.float32)
            flat[a:b] = 1.0 / CONTEXT
            flat[:b, DIMENSIONS] = 0
            flat[b:c, DIMENSIONS] = np.log(self.noise / np.repeat(self.group_noise, self.size))
            flat[c:, DIMENSIONS] = np.log(self.group_noise)
        self.flat, self.places = flat, (0, a, b, c)
        self.context, self.position = flat[:a, :DIMENSIONS], flat[a:b, :DIMENSIONS]
        self.output, self.bias = flat[b:c, :DIMENSIONS], flat[b:c, DIMENSIONS]
        self.class_output, self.class_bias = flat[c:, :DIMENSIONS], flat[c:, DIMENSIONS]

    def __reduce__(self):
        return Model, (self.n, self.flat, self.prior)  # the other arrays are views of these or made of them

    def predicted(self, context: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(the predicted vectors, each with a 1 for the biases; the vectors of the items before, which end in a 0)."""
        vectors = [self.flat.take(context[:, 0], axis=0)]
        place = self.flat[self.places[1] : self.places[2]]
        out = times(vectors[0], place[0])
        for j in range(1, CONTEXT):
            if 2 * len(rest := apart(context, j)) < len(context):  # in a text, mostly the vectors of the place before
                vectors.append(np.empty_like(out))
                vectors[j][j:] = vectors[0][: len(out) - j]
                vectors[j][rest] = self.flat.take(context[rest, j], axis=0)
            else:
                vectors.append(self.flat.take(context[:, j], axis=0))
            out += times(vectors[j], place[j])
        out[:, -1] = 1
        return out, vectors

    def sorted_classes(self, group: np.ndarray) -> np.ndarray:
        """Places in stable order of class; numbers of 16 bits are sorted by digits."""
        return np.argsort(group.astype(np.uint16) if len(self.size) <= 1 << 16 else group, kind="stable")

    def by_class(self, group: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first row, row after the last, places) of each class of two items or more that is in `group`."""
        order = self.sorted_classes(group)
        ends = np.cumsum(np.bincount(group, minlength=len(self.size)))
        for c in np.flatnonzero((np.diff(ends, prepend=0) > 0) & (self.size > 1)).tolist():
            yield int(self.first[c]), int(self.first[c + 1]), order[ends[c - 1] if c else 0 : ends[c]]

    def log_probabilities(self, items: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Natural log-probabilities, normalised over all classes and over the items of each class."""
        key = context[:, 0] * (self.n + 1) + context[:, 1]
        of, distinct = pd.factorize(key)
        vectors = self.predicted(np.stack(np.divmod(distinct, self.n + 1), 1))[0]
        output, classes = self.flat[self.places[2] : self.places[3]], self.flat[self.places[3] :]
        longest = lambda x: float(np.sqrt(np.einsum("bd,bd->b", x, x).max(initial=0)))
        bounded = longest(vectors) * max(longest(output), longest(classes)) < SAFE
        normal, scaled = np.empty(len(vectors), np.float32), (classes * BITS).T
        for lo in range(0, len(vectors), SCORED):
            normal[lo : lo + SCORED] = log_sum(vectors[lo : lo + SCORED] @ scaled, bounded)
        group, row = self.group[items], self.row[items]
        pair, pairs = pd.factorize(of * len(self.size) + group)
        owner, kind = np.divmod(pairs, len(self.size))
        inner = np.empty(len(pairs), np.float32)
        single = np.flatnonzero(self.size[kind] == 1)  # what is left for a class of one item: its score
        inner[single] = np.einsum("bd,bd->b", vectors.take(owner[single], axis=0), output.take(self.first[kind[single]], axis=0))
        for first, last, at in self.by_class(kind):
            scaled = (output[first:last] * BITS).T
            for lo in range(0, len(at), SCORED):
                part = at[lo : lo + SCORED]
                inner[part] = log_sum(vectors.take(owner[part], axis=0) @ scaled, bounded)
        outer = np.empty(len(pairs), np.float32)
        for lo in range(0, len(pairs), 1 << 14):
            p = slice(lo, lo + (1 << 14))
            outer[p] = np.einsum("bd,bd->b", vectors.take(owner[p], axis=0), classes.take(kind[p], axis=0)) - normal[owner[p]] - inner[p]
        out = np.empty(len(items), np.float64)
        for lo in range(0, len(items), 1 << 14):
            p = slice(lo, lo + (1 << 14))
            out[p] = np.einsum("bd,bd->b", vectors.take(of[p], axis=0), output.take(row[p], axis=0)) + outer[pair[p]]
        return out


def shifted(drawn: np.ndarray, log_drawn: np.ndarray) -> np.ndarray:
    """Drawn rows, of noise with these log-expectations, as `noise_gradient` takes them."""
    out = drawn * -BITS
    out[..., -1] += log_drawn * BITS
    return out


def noise_gradient(q: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """Gradient of the score of each row of `q` with each of the `shifted` rows, in single precision; powers that are infinite make it 0."""
    out = q @ drawn.T
    np.exp2(out, out=out)
    out += 1
    return np.divide(-1, out, out=out)


class Trainer:
    """Noise-contrastive steps with a rate for each row of parameters."""

    def __init__(self, model: Model, noise: np.ndarray, seed: int):
        self.model, self.rng = model, np.random.default_rng(seed)
        self.group_noise, self.class_sums = model.group_noise, np.cumsum(model.group_noise)
        self.log_class = np.log(self.group_noise * NOISE / self.group_noise.sum()).astype(np.float32)
        self.sums = np.concatenate([[0.0], np.cumsum(model.noise)])
        self.log_noise = np.log(model.noise).astype(np.float32)
        self.past = np.ones(len(model.flat), np.float32)
        self.tokens = 0

    def update(self, rows: np.ndarray, grad: np.ndarray, width: int = DIMENSIONS + 1) -> None:
        """Move distinct `rows`; the bias is the last column, and rows without one have a 0 there and a `width` of one column less."""
        for lo in range(0, len(rows), ADDED):
            some, step = rows[lo : lo + ADDED], grad[lo : lo + ADDED]
            past = self.past[some] + np.einsum("bd,bd->b", step, step) / width * 4
            self.past[some] = past
            moved = step * (np.float32(RATE) / np.sqrt(past))[:, None]
            moved += self.model.flat.take(some, axis=0)
            self.model.flat[some] = moved

    def contrast(self, q: np.ndarray, true: np.ndarray, drawn: np.ndarray, start: int, log_true: np.ndarray, log_drawn: np.ndarray) -> np.ndarray:
        """One step of the true rows against the drawn rows, of the few from `start` to the last; returns the gradient of q."""
        table = self.model.flat[start:]
        own, other = table.take(true, axis=0), table[drawn]
        up = np.einsum("bd,bd->b", q, own) - log_true
        up = 1 - 1 / (1 + np.exp(-np.clip(up, -20, 20)))  # gradient of the score of the true row
        own *= up[:, None]
        down = noise_gradient(q, shifted(other, log_drawn))
        own += down @ other
        order = self.model.sorted_classes(true)  # true rows are few, so most of them are added up side by side
        kind = true[order]
        begin = np.append(0, np.flatnonzero(kind[1:] != kind[:-1]) + 1)
        push = np.add.reduceat(q.take(order, axis=0) * up[order][:, None], begin, axis=0)
        rows, grad = by_row(np.concatenate([kind[begin], drawn]), [push, down.T @ q], len(table))
        self.update(start + rows, grad)
        return own

    def back(self, context: np.ndarray, vectors: Sequence[np.ndarray], dq: np.ndarray) -> None:
        """Hand the gradient of the predicted vectors, in the order of the text, to contexts and positions."""
        m = self.model
        dq[:, -1] = 0
        place = m.flat[m.places[1] : m.places[2]]
        at, grad = [context[:, 0]], [times(dq, place[0])]
        for j in range(1, CONTEXT):  # mostly an item's own place after the one by which it was the last
            value, row, rest = times(dq, place[j]), context[:, j], apart(context, j)
            at.append(row[rest])
            grad.append(value.take(rest, axis=0))
            value[rest] = 0
            grad[0][: len(row) - j] += value[j:]
        rows, grad = by_row(np.concatenate(at), grad, m.places[1])
        self.update(m.places[1] + np.arange(CONTEXT), np.stack([np.einsum("bd,bd->d", dq, v) for v in vectors]), DIMENSIONS)
        self.update(rows, grad, DIMENSIONS)

    def classes(self, items: np.ndarray, context: np.ndarray) -> None:
        m, kind = self.model, self.model.group[items]
        drawn = np.minimum(np.searchsorted(self.class_sums, self.rng.random(NOISE) * self.class_sums[-1], "right"), len(m.size) - 1)
        q, vectors = m.predicted(context)
        self.back(context, vectors, self.contrast(q, kind, drawn, m.places[3], self.log_class[kind], self.log_class[drawn]))

    def inside(self, items: np.ndarray, context: np.ndarray) -> None:
        """One step of all classes; only the products with a class's drawn rows go class by class."""
        m, kind = self.model, self.model.group[items]
        some = m.size[kind] > 1
        items, context, kind = items[some], context[some], kind[some]
        if not len(items):
            return
        order = m.sorted_classes(kind)
        kind = kind[order]
        ends = np.append(np.flatnonzero(kind[1:] != kind[:-1]) + 1, len(kind))
        own_class = kind[ends - 1]
        lo, hi = self.sums[m.first[own_class]], self.sums[m.first[own_class + 1]]
        spot = np.sort(lo[:, None] + self.rng.random((len(lo), INNER)) * (hi - lo)[:, None])  # in the order of the rows, which is faster to find and add up
        drawn = np.searchsorted(self.sums, spot.ravel(), "right").reshape(spot.shape) - 1
        drawn = np.clip(drawn, m.first[own_class][:, None], m.first[own_class + 1][:, None] - 1)
        shift = np.log(INNER / (hi - lo)).astype(np.float32)
        true = m.row[items[order]]
        straight, vectors = m.predicted(context)
        q = straight.take(order, axis=0)
        table = m.flat[m.places[2] : m.places[3]]
        own, other = table.take(true, axis=0), table.take(drawn, axis=0)
        log_true = self.log_noise[true] + np.repeat(shift, np.diff(ends, prepend=0))
        up = 1 - 1 / (1 + np.exp(-np.clip(np.einsum("bd,bd->b", q, own) - log_true, -20, 20)))
        own *= up[:, None]
        false, against, pull = np.empty_like(other), shifted(other, self.log_noise[drawn] + shift[:, None]), np.empty_like(own)
        begin = 0
        for k, end in enumerate(ends.tolist()):
            part = q[begin:end]
            down = noise_gradient(part, against[k])
            np.matmul(down, other[k], out=pull[begin:end])
            np.matmul(down.T, part, out=false[k])
            begin = end
        own += pull
        q *= up[:, None]
        rows, grad = by_row(np.concatenate([true, drawn.ravel()]), [q, false.reshape(-1, DIMENSIONS + 1)], m.n)
        self.update(m.places[2] + rows, grad)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.back(context, vectors, own.take(back, axis=0))

    def train(self, items: np.ndarray, context: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            for lo in range(0, len(items), 4 * BATCH):
                for at in range(lo, min(lo + 4 * BATCH, len(items)), BATCH):
                    self.classes(items[at : at + BATCH], context[at : at + BATCH])
                self.inside(items[lo : lo + 4 * BATCH], context[lo : lo + 4 * BATCH])
        self.tokens += len(items)


def least_count(tokens: int, vocabulary: int = VOCABULARY) -> int:
    """How often a word must be counted to be an item."""
    return max(2, int(np.ceil(np.sqrt(tokens / vocabulary))))


def count(docs: DataFrame, text: str, hot: int = HOT, vocabulary: int = VOCABULARY) -> tuple[DataFrame, Counts]:
    """The stored table (token, n) of all words of `docs`, and what tasks need of it."""

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for block in X.blocks(batches, text):
                coded = X.words(*X.utf8(block.column(text)), X.SOLID)[0].dictionary_encode()
                yield coded.dictionary, np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))

        yield from frequencies(each())

    table = stored(docs.select(text).mapInArrow(numbers, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n")), "words")
    ends = docs.count()
    total, distinct = table.agg(F.sum("n"), F.count(F.lit(1))).first()
    tokens, distinct = (total or 0) + ends, distinct + (ends > 0)
    least = least_count(tokens, vocabulary)
    common = table.where((F.col("n") * hot >= tokens) | (F.col("n") >= least)).toArrow()  # `hot` rows at most, and the items
    hot_words, hot_n = pa.array(common["token"].to_pylist(), pa.binary()), common["n"].to_numpy()
    model = np.flatnonzero(hot_n >= least)
    words = hot_words.take(pa.array(model))
    item = np.full(len(hot_n), -1)
    item[model] = np.arange(len(model))

    def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(words)
        for batch in batches:
            names = batch.column("token")
            data, offsets = X.utf8(names)
            kind = groups_of(data, offsets[:-1], offsets[1:])
            rest = numbers(names) < 0
            n = np.bincount(kind[rest], batch.column("n").to_numpy()[rest], GROUPS).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(GROUPS, dtype=np.int32)), pa.array(n), pa.array(np.bincount(kind[rest], minlength=GROUPS))], ["c", "n", "v"])

    sums = table.mapInArrow(by_group, "c int, n double, v bigint").groupBy("c").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()  # GROUPS rows
    group_n, group_v = np.zeros(GROUPS), np.zeros(GROUPS)
    for r in sums:
        group_n[r["c"]], group_v[r["c"]] = r["n"], r["v"]
    item_n = np.concatenate([hot_n[model].astype(float), group_n, [float(ends)]])
    return table, Counts(hot_words, hot_n, words, item, group_n, group_v, item_n, tokens, distinct, ends)


def fit(docs: DataFrame, counts: Counts, text: str, sample: int = SAMPLE) -> Model:
    """The averaged model of one pass over all `docs`, started from about `sample` of them."""
    n_items = len(counts.item_n)
    noise = (counts.item_n + 1) / (counts.item_n + 1).sum()
    model = Model(n_items, prior=noise)
    if not counts.ends:
        return model
    rows, width = model.flat.shape
    names, types = ("chunk", "p", "x", "w"), (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    schema = "chunk int, p binary, x binary, w binary"

    def packed(chunk: int, p: np.ndarray, x: np.ndarray, w: np.ndarray) -> list[pa.Array]:
        value = (chunk, p.astype(np.int32).tobytes(), x.astype(np.float32).tobytes(), w.astype(np.float32).tobytes())
        return [pa.array([v], t) for v, t in zip(value, types)]

    def unpacked(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for p, x, w in zip(*(table[c].to_pylist() for c in names[1:])):
            yield np.frombuffer(p, np.int32), np.frombuffer(x, np.float32).reshape(-1, width), np.frombuffer(w, np.float32)

    def learned(own: Trainer, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Train on the texts; the rows that it changed, by chunk, each with the growth of its sum of squared gradients."""
        hold_memory()
        before, numbers = own.past.copy(), Numbers(counts.hot)
        for block in X.blocks(batches, text, SCAN_BYTES):
            _, items, _, _, first = items_of(block.column(text), numbers, counts.item)
            own.train(*sequences(items, first, n_items)[:2])
        for lo in range(0, rows, CHUNK):
            grown = own.past[lo : lo + CHUNK] - before[lo : lo + CHUNK]
            if len(p := np.flatnonzero(grown > 0)):
                yield pa.RecordBatch.from_arrays(packed(lo // CHUNK, lo + p, own.model.flat[lo + p], grown[p]), names)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from learned(Trainer(Model(n_items, prior=noise), noise, 1), batches)

    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    share = min(sample / counts.ends, SAMPLE_BYTES / max(1, size))
    place = F.pmod(F.xxhash64(F.col(text), F.lit(43)), F.lit(1 << 30)) / float(1 << 30)
    sample_rows = docs.where(place < share).select(text).distinct().repartition(1)  # copies of a text begin once
    flat, past = model.flat, np.ones(rows, np.float32)
    for p, x, w in unpacked(sample_rows.mapInArrow(begin, schema).toArrow()):
        flat[p] = x
        past[p] += w

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Trainer(Model(n_items, flat.copy(), noise), noise, 1000 + TaskContext.get().partitionId())
        own.past = past.copy()
        yield from learned(own, batches)

    def mean(key: tuple, table: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        total, weight = np.zeros((CHUNK, width)), np.zeros(CHUNK)
        for p, x, w in unpacked(table):
            total[p - chunk * CHUNK] += x * w[:, None].astype(np.float64)
            weight[p - chunk * CHUNK] += w
        p = np.flatnonzero(weight > 0)
        return pa.table([pa.array([key[1].as_py()], pa.int32()), *packed(chunk, chunk * CHUNK + p, total[p] / weight[p, None], weight[p])], ["task", *names])

    # a mean of means by their weights is the mean, so tasks meet `FAN` at a time however many there are
    learnt = docs.select(text).mapInArrow(local, schema).withColumn("task", F.spark_partition_id()).select("task", *names)
    tasks = docs.rdd.getNumPartitions()
    while True:
        learnt = learnt.withColumn("task", F.expr(f"int(task / {FAN})")).groupBy("chunk", "task").applyInArrow(mean, f"task int, {schema}")
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            break
    averaged = learnt.select(*names).toArrow()  # the model
    out = flat.copy()
    for p, x, _ in unpacked(averaged):
        out[p] = x
    return Model(n_items, out, noise)


def score(
    docs: DataFrame, train: Column, id: str = "doc_id", text: str = "text", keep: Sequence[str] = (), hot: int = HOT, vocabulary: int = VOCABULARY
) -> DataFrame:
    """Per row of `docs`: id, kept columns, n_tokens, n_known, train_tokens, base_score, score; learned where `train` holds.

    A text's tokens are its words (split at ASCII white space, A-Z lower-cased) and an end; a null or wordless text is the end alone.
    base_score adds log10((c + 0.1) / (N + 0.1 (V + 1))) over the tokens, score the log10 of the model's probabilities. With
    nothing to learn from, all items of the model are alike. Repeated rows each come back; kept columns must not have
    a result's name; others are not looked at.
    """
    base, back = X.kept(docs, id, text, keep)
    learn = docs.where(train).select(text)
    table, counts = count(learn, text, hot, vocabulary)
    model = fit(learn, counts, text)
    hot_log = np.log10(counts.hot_n + 0.1)
    group_log = np.log10(counts.group_n + 0.1 * (counts.group_v + 1))
    n_words, n_items, denominator = len(counts.words), len(counts.item_n), counts.base()
    end_log = float(np.log10(counts.ends + 0.1))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_memory()
        row, numbers = TaskContext.get().partitionId() << 40, Numbers(counts.hot)
        for block in X.blocks(batches, text, SCAN_BYTES):
            n = block.num_rows
            coded, items, at, kind, first = items_of(block.column(text), numbers, counts.item)
            codes = coded.indices.to_numpy()
            logs, cold, oov = np.append(hot_log, 0.0)[at], at < 0, np.append(counts.item, -1)[at] < 0
            group_part = np.where(oov, logs - group_log[kind], 0.0)[codes]  # of a word of a group: log10 of its share there
            logs, cold = logs[codes], cold[codes]
            doc = np.repeat(np.arange(n), np.diff(first))
            total = lambda values: np.bincount(doc, values, n)
            seq, context, begin = sequences(items, first, n_items)
            neural = model.log_probabilities(seq, context) / np.log(10)
            neural = np.bincount(np.repeat(np.arange(n), np.diff(begin)), neural, n)
            tokens, times = rare(doc[cold], codes[cold], coded.dictionary, n)
            size = np.diff(begin)
            columns = [
                pa.array(np.arange(row, row + n)), *(block.column(c) for c in back), pa.array(size.astype(np.int64)),
                pa.array(total((~cold).astype(float)).astype(np.int64) + (counts.ends > 0)), pa.array(total(logs) + end_log - size * denominator),
                pa.array(neural + total(group_part)), tokens, times,
            ]
            yield pa.RecordBatch.from_arrays(columns, ["_row", *back, "n_tokens", "_known", "_base", "_score", "_tokens", "_times"])
            row += n

    added = (("n_tokens", "bigint"), ("_known", "bigint"), ("_base", "double"), ("_score", "double"), ("_tokens", "array<binary>"), ("_times", "array<bigint>"))
    schema = X.struct(base, back, (*added, ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")))
    schema = type(schema)([*X.struct(base, [], (("_row", "bigint"),)).fields, *schema.fields[: len(back) + len(added)]])
    rows = stored(base.mapInArrow(scan, schema), "scored")
    cold = rows.select("_row", F.explode(F.arrays_zip("_tokens", "_times")).alias("x")).select("_row", F.col("x._tokens").alias("token"), F.col("x._times").alias("times"))
    value = F.col("times") * F.coalesce(F.log10(F.col("n") + 0.1), F.lit(-1.0))
    cold = cold.join(table, "token", "left").groupBy("_row").agg(F.sum(value).alias("_rest"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("_more"))
    rest = F.coalesce("_rest", F.lit(0.0))
    return rows.drop("_tokens", "_times").join(cold, "_row", "left").select(
        *back, "n_tokens", (F.col("_known") + F.coalesce("_more", F.lit(0))).cast("bigint").alias("n_known"), F.lit(counts.tokens).cast("bigint").alias("train_tokens"),
        (F.col("_base") + rest).alias("base_score"), (F.col("_score") + rest).alias("score"),
    )
