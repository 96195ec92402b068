"""Benchmark decontamination: an FM-index per shard of training text, searched for every benchmark window.

A shard is a block of whole texts. Its words become symbols: one for each word of the benchmark, none for any
other word. Words outside the benchmark end a run, no window can cross one, and runs shorter than the shortest
window hold none, so the index has the remaining runs only, each closed by a break of its own. Windows are found by
backward search over wavelet-matrix ranks of the Burrows-Wheeler transform, all windows at a time; places come from
sampled suffix positions (every 8th and the first of each run) by walking back. Overlapping places are merged into
removal spans.

Scale: texts never shuffle. A benchmark goes to the tasks in blocks of about `block_bytes` of text, in which equal rows are one and
an item that is longer is cut into parts that overlap by a window less a word. A benchmark of several blocks passes over the
shards once for each, and every pass but the last is written to the shared folder, with the spans and items found so far. So a
task, the driver and a plan hold one block whatever the benchmark's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from rowtide.llm import texts as X
from rowtide.session import stored

WINDOW = 10
BENCHMARK_BLOCK = 2 << 20
_SAMPLE = 8
_STATE = (("n_words", "bigint"), ("spans", "array<struct<first_word:bigint,last_word:bigint,first_byte:bigint,last_byte:bigint>>"), ("items", "array<string>"))


class Phrases:
    """Distinct windows of benchmark texts over the benchmark's own word numbers, and the items of each."""

    def __init__(self, ids: Sequence[str], texts: Sequence[str], window: int = WINDOW):
        data, offsets = X.utf8(pa.array(texts, pa.string()))
        found, _, _, first = X.words(data, offsets, X.ALNUM)
        coded = found.dictionary_encode()
        self.words, symbols = coded.dictionary, coded.indices.to_numpy() + 1
        owners: dict[tuple, set] = {}
        for item, a, b in zip(ids, first[:-1], first[1:]):
            own = symbols[a:b].tolist()
            for i in range(max(1, len(own) - window + 1) if own else 0):
                owners.setdefault(tuple(own[i : i + window]), set()).add(item)
        self.lengths = np.array([len(p) for p in owners], np.int64)
        self.table = np.zeros((len(owners), window), np.int64)
        for i, p in enumerate(owners):
            self.table[i, : len(p)] = p
        self.items = [sorted(v) for v in owners.values()]

    def shortest(self) -> int:
        return int(self.lengths.min()) if len(self.lengths) else 0


class FmIndex:
    """Full-text index of `symbols` (1..top, 0 closes a run): wavelet ranks for search, samples for places."""

    def __init__(self, symbols: np.ndarray, top: int):
        n = len(symbols)
        stops = symbols == 0
        # each break sorts as a symbol of its own, so no comparison runs past one
        rank = np.where(stops, np.cumsum(stops) - 1, symbols + int(stops.sum()))
        order, step = np.argsort(rank, kind="stable"), 1
        while True:
            new = np.empty(n, np.int64)
            if step == 1:
                key = rank
            else:
                half = step // 2
                key = rank * (n + 1)
                key[: n - half] += rank[half:] + 1
                order = np.argsort(key, kind="stable")
            in_order = key[order]
            new[order] = np.concatenate([[0], np.cumsum(in_order[1:] != in_order[:-1])])
            rank, step = new, step * 2
            if rank[order[-1]] == n - 1:
                break
        before = symbols[order - 1]  # the last symbol is a break, so the first row is right too
        self.before, self.n = before, n
        self.first = np.searchsorted(symbols[order], np.arange(top + 2))
        begins = np.concatenate([[True], stops[:-1]])
        self.sampled = (order % _SAMPLE == 0) | begins[order]
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]
        self.levels, left = [], before
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (left >> bit) & 1
            self.levels.append((bit, np.concatenate([[0], np.cumsum(ones)]).astype(np.int32), n - int(ones.sum())))
            left = np.concatenate([left[ones == 0], left[ones == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often `symbol` stands before row `at` of the transform."""
        low = np.zeros_like(at)
        for bit, ones, zeros in self.levels:
            set_ = ((symbol >> bit) & 1).astype(bool)
            low, at = (np.where(set_, zeros + ones[x], x - ones[x]) for x in (low, at))
        return at - low

    def search(self, table: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that occur and their row intervals, by one backward step a column."""
        alive = np.arange(len(lengths))
        lo, hi, left = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.n, np.int64), lengths.copy()
        done = []
        while len(alive):
            symbol = table[alive, left - 1]
            base = self.first[symbol]
            lo, hi = base + self.rank(symbol, lo), base + self.rank(symbol, hi)
            left = left - 1
            ended = (left == 0) & (hi > lo)
            done.append((alive[ended], lo[ended], hi[ended]))
            on = (left > 0) & (hi > lo)
            alive, lo, hi, left = alive[on], lo[on], hi[on], left[on]
        return tuple(np.concatenate(x) for x in zip(*done)) if done else (alive, lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of transform rows: back to a sampled one, as many places further on."""
        place, steps, open_ = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(open_):
            hit = self.sampled[rows]
            place[open_[hit]] = self.samples[self.sample_rank[rows[hit]]] + steps
            rows, open_ = rows[~hit], open_[~hit]
            symbol = self.before[rows]
            rows = self.first[symbol] + self.rank(symbol, rows)
            steps += 1
        return place


def runs_of(symbols: np.ndarray, first: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of known words of at least `shortest`, each closed by a 0, and the word number of every place."""
    known = symbols > 0
    opens = known.copy()
    opens[1:] &= ~known[:-1]
    inner = first[:-1][first[:-1] < len(symbols)]
    opens[inner] = known[inner]
    begin = np.flatnonzero(opens)
    run = np.cumsum(opens) - 1
    size = np.bincount(run[known], minlength=len(begin))
    begin, size = begin[size >= shortest], size[size >= shortest]
    total = size + 1
    ends = np.cumsum(total)
    place = np.repeat(begin - (ends - total), total) + np.arange(ends[-1] if len(ends) else 0)
    out = symbols[np.minimum(place, len(symbols) - 1)] if len(place) else np.zeros(0, np.int64)
    out[ends - 1] = 0
    return out, place


def _parts(window: int, block_bytes: int):
    """mapInArrow function: items (i, t) longer than a block as parts whose windows are the item's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(batch.column("i").to_pylist(), batch.column("t").to_pylist()):
                parts = [t]
                if len(t.encode()) > block_bytes:
                    found, start, end, _ = X.words(*X.utf8(pa.array([t])), X.ALNUM)
                    words, parts, at = [w.decode() for w in found.to_pylist()], [], 0
                    ends = np.cumsum(end - start + 1)
                    while not parts or at + window - 1 < len(words):
                        base = ends[at - 1] if at else 0
                        to = max(at + window, int(np.searchsorted(ends, base + block_bytes, "right")))
                        parts.append(" ".join(words[at:to]))
                        at = to - window + 1
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(parts), pa.string()), pa.array(parts, pa.string())], ["i", "t"])

    return run


def _scan(phrases: Phrases, text: str, back: list[str], carry: list[str], later: bool):
    """mapInArrow function of one pass."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shortest, top = phrases.shortest(), len(phrases.words)
        for block in X.blocks(batches, text):
            data, offsets = X.utf8(block.column(text))
            found, start, end, first = X.words(data, offsets, X.ALNUM)
            n = block.num_rows
            cover = np.zeros(len(found) + 1, np.int64)
            items: dict[int, set] = {}
            if later:
                for d, (old_spans, old_items) in enumerate(zip(block.column("spans").to_pylist(), block.column("items").to_pylist())):
                    for s in old_spans:
                        cover[first[d] + s["first_word"]] += 1
                        cover[first[d] + s["last_word"] + 1] -= 1
                    if old_items:
                        items[d] = set(old_items)
            if shortest and len(found) >= shortest:
                symbols = pc.fill_null(pc.index_in(found, phrases.words), -1).to_numpy().astype(np.int64) + 1
                seq, place = runs_of(symbols, first, shortest)
                if len(seq):
                    index = FmIndex(seq, top)
                    which, lo, hi = index.search(phrases.table, phrases.lengths)
                    times = hi - lo
                    rows = np.repeat(lo - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum()) if len(which) else np.zeros(0, np.int64)
                    at, phrase = place[index.locate(rows)], np.repeat(which, times)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + phrases.lengths[phrase], -1)
                    doc = np.searchsorted(first, at, "right") - 1
                    for pair in np.unique(doc * len(phrases.lengths) + phrase).tolist():
                        d, p = divmod(pair, len(phrases.lengths))
                        items.setdefault(d, set()).update(phrases.items[p])
            hit = np.cumsum(cover)[:-1] > 0
            opens, closes = hit.copy(), hit.copy()
            opens[1:] &= ~hit[:-1]
            closes[:-1] &= ~hit[1:]
            inner = first[:-1][first[:-1] < len(hit)]
            opens[inner] = hit[inner]
            ends = first[1:][(first[1:] > 0)] - 1
            closes[ends] = hit[ends]
            a, b = np.flatnonzero(opens), np.flatnonzero(closes)
            doc = np.searchsorted(first, a, "right") - 1
            span = pa.StructArray.from_arrays(
                [pa.array(x.astype(np.int64)) for x in (a - first[doc], b - first[doc], start[a] - offsets[doc], end[b] - offsets[doc])],
                ["first_word", "last_word", "first_byte", "last_byte"],
            )
            columns = [block.column(c) for c in carry]
            columns += [pa.array(np.diff(first).astype(np.int64)), X.lists(span, np.bincount(doc, minlength=n)), pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [*carry, *(c for c, _ in _STATE)])

    return scan


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    keep: Sequence[str] = (), window: int = WINDOW, block_bytes: int = BENCHMARK_BLOCK,
) -> DataFrame:
    """Per row of `docs`: id, kept columns, n_words, removal `spans`, the `items` found (sorted), n_hit.

    Words are runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII. A window is `window` consecutive
    words of an item, or the whole item if shorter. A null or wordless text has no words and no hit; a null or wordless
    item has no window; an item whose id is null counts as the item ''. Equal item ids are one item. Repeated
    rows of `docs` each come back. An empty benchmark hits nothing. Other columns of either table are not looked at.
    """
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL")
    items = stored(items.distinct().mapInArrow(_parts(window, block_bytes), "i string, t string"), "benchmark")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    parts = items.withColumn("p", F.pmod(F.xxhash64("i", "t"), F.lit(n)))
    base, back = X.kept(docs, id, text, keep)
    out = base
    for p in range(n):  # as many passes as the benchmark has blocks, one as a rule
        rows = parts.where(F.col("p") == p).orderBy("i", "t").collect()
        carry = list(dict.fromkeys([*back, text])) if p + 1 < n else back
        phrases = Phrases([r["i"] for r in rows], [r["t"] for r in rows], window)
        out = out.mapInArrow(_scan(phrases, text, back, carry, p > 0), X.struct(base, carry, _STATE))
        if p + 1 < n:
            out = stored(out, "searched")
    covered = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last_word"] - s["first_word"] + 1)
    return out.withColumn("n_hit", covered)


def without_spans(text: str, spans: Sequence[dict]) -> str:
    """`text` without the bytes of its removal spans."""
    data, out, at = text.encode(), [], 0
    for s in spans:
        out.append(data[at : s["first_byte"]])
        at = s["last_byte"]
    return b"".join([*out, data[at:]]).decode()
