"""Suffix-array deduplication: every byte in a string of `window` bytes that also starts elsewhere is removed.

A collection's Burrows-Wheeler transform is built column by column: a round puts one symbol of each document in front of its
suffix and moves the suffix to its new row, which is the number of smaller symbols plus those of its own before it; the common
prefix with the row above is one more than the least of the rows it passed over. Neighbours with a common prefix of `window` or
more are the repeated strings.

Only strings of `window` bytes matter, and those that can be equal are brought together first:

1. The anchor of a string is its `GRAM`-byte piece with the least hash, the leftmost of equal ones. Equal strings have equal
   anchors at equal places, so an anchor that occurs once anywhere ends the matter for all strings that have it.
2. The strings of one anchor occurrence are consecutive; the stretch of text they cover is its context. Contexts are the
   documents of the collection. Equal contexts are one document that is there several times; an anchor with only one
   distinct context needs no text at all.
3. Distinct contexts of an anchor are a group, laid out so that the anchor has the same columns in all of them. Only suffixes
   that start in the same column can begin with equal strings, so a round's rows are those of its column.
4. A group of more than `group_rows` distinct contexts is halved by start column: the strings of either half share a stretch of
   bytes in their middle, and contexts that differ there part. Halving ends with single strings, so no group stays large.

Scale: texts shuffle twice, once with the contexts to fetch and once with the spans to remove; else rows of hashes move. Tables
between the steps are written to the shared folder and read in sequence. A task holds one block of whole groups and the
rows of one round. Contexts are told apart by 128-bit digests, strings of different contexts by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from rowtide.llm import texts as X
from rowtide.session import stored

WINDOW, GRAM = 400, 64
GROUP_ROWS = 2048
_PIECE = 1 << 20  # string starts that are hashed at a time
_BLOCK = 16_384  # contexts of a block, about
_PLACE = np.uint64((1 << 24) - 1)
_ODD, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_SYMBOL = np.array([xxhash.xxh64_intdigest(bytes([b]), 13) | 1 for b in range(256)], np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Grams:
    """Hashes of all `gram`-byte pieces of a buffer by prefix sums modulo 2^64."""

    def __init__(self, longest: int):
        self.up, self.down = _powers(_ODD, longest), _powers(pow(_ODD, -1, 1 << 64), longest)

    def __call__(self, data: np.ndarray, gram: int) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_SYMBOL[data] * self.up[: len(data)], out=total[1:])
        out = total[gram:] - total[:-gram]
        out *= self.down[: len(out)]
        out ^= out >> np.uint64(32)
        out *= _MIX
        out ^= out >> np.uint64(29)
        return out


def anchors(data: np.ndarray, offsets: np.ndarray, grams: Grams, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of string starts with one anchor, none across texts: (text, first start, starts, anchor place, anchor hash)."""
    span = window - gram + 1
    if len(data) < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    value = grams(data, gram)
    n = len(value)
    ranked = np.full(-(-n // span) * span, ~np.uint64(0))
    ranked[:n] = (value & ~_PLACE) | np.arange(n, dtype=np.uint64)
    rows = ranked.reshape(-1, span)
    before = np.minimum.accumulate(rows, 1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(after[: n - span + 1], before[span - 1 : n]) & _PLACE
    whole = np.zeros(len(least) + 1, np.int32)  # whether a start's string lies in one text
    size = np.diff(offsets)
    long = size >= window
    np.add.at(whole, offsets[:-1][long], 1)
    np.add.at(whole, offsets[1:][long] - window + 1, -1)
    whole = np.cumsum(whole[:-1]) > 0
    opens = whole.copy()
    opens[1:] &= ~whole[:-1] | (least[1:] != least[:-1])
    closes = whole.copy()
    closes[:-1] &= ~whole[1:] | opens[1:]
    first = np.flatnonzero(opens)
    at = least[first].astype(np.int64)
    return np.searchsorted(offsets, first, "right") - 1, first, np.flatnonzero(closes) - first + 1, at, value[at]


def _pieces(data: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(number of the first text, place in it, data, offsets): a block at once, a longer text by overlapping pieces."""
    if len(data) <= _PIECE + window:
        yield 0, 0, data, offsets
        return
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for start in range(a, max(a + 1, b - window + 1), _PIECE):
            part = data[start : min(b, start + _PIECE + window - 1)]
            yield k, start - a, part, np.array([0, len(part)])


def _anchors(window: int, gram: int):
    """mapInArrow function: texts to anchor runs (t: digest of the text, h: anchor, c: digest of the context, place, numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(_PIECE + 2 * window)
        for block in X.blocks(batches, "text", _PIECE):
            whole, ends = X.utf8(block.column("text"))
            for text, shift, data, offsets in _pieces(whole, ends, window):
                doc, first, starts, at, value = anchors(data, offsets, grams, window, gram)
                raw = data.tobytes()
                digests = [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(first.tolist(), (first + starts + window - 1).tolist())]
                columns = [
                    block.column("t").take(pa.array(text + doc)), pa.array(value.view(np.int64)), pa.array(digests, pa.binary()), pa.array(first - offsets[doc] + shift),
                    pa.array(starts.astype(np.int32)), pa.array((first - at).astype(np.int32) + np.int32(window - gram)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["t", "h", "c", "lo", "starts", "column"])

    return run


def _first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text of a task once."""
    seen: set[bytes] = set()
    for batch in batches:
        new = []
        for k, t in enumerate(batch.column("t").to_pylist()):
            if t not in seen:
                seen.add(t)
                new.append(k)
        yield batch.take(pa.array(new, pa.int64()))


_CONTEXT = "h bigint, c binary, n bigint, rivals bigint, g binary, x binary, base int, column int, starts int, text binary"


def _cut(window: int):
    """mapInArrow function: texts with the contexts wanted of them to one row a context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column("text"), batch.column("wanted")):
                data = memoryview(text.as_buffer())
                rows = wanted.values
                lo, starts = rows.field("lo").to_numpy(), rows.field("starts").to_numpy()
                for at in range(0, len(rows), _BLOCK):
                    some = rows.slice(at, _BLOCK)
                    cut = [bytes(data[a : a + s + window - 1]) for a, s in zip(lo[at : at + _BLOCK].tolist(), starts[at : at + _BLOCK].tolist())]
                    h, c = some.field("h"), some.field("c")
                    group = pa.array([v.to_bytes(8, "big", signed=True) for v in h.to_pylist()], pa.binary())
                    columns = [h, c, some.field("n"), some.field("rivals"), group, c, pa.array(np.zeros(len(cut), np.int32)), some.field("column"), some.field("starts"), pa.array(cut, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["h", "c", "n", "rivals", "g", "x", "base", "column", "starts", "text"])

    return run


class Transform:
    """The Burrows-Wheeler transform of texts in columns, by one symbol of each a round, from the last column to the first.

    Text i covers the columns from `column[i]`; texts of different groups are apart. After a round for column k, `rows` are the
    texts that reach it in the order of (group, suffix from k), and `common` is each suffix's common prefix with the one above.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, column: np.ndarray, group: np.ndarray):
        self.data, self.column, self.group = data, column, group
        self.place = offsets[:-1] - column  # of column 0
        self.end = column + np.diff(offsets)
        self.enter = np.argsort(-self.end, kind="stable")
        self.entered, self.at = 0, int(self.end.max(initial=0))
        self.rows, self.common = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def round(self) -> int:
        """Insert the symbols of the next column to the left; returns it."""
        k = self.at = self.at - 1
        stay = self.column[self.rows] <= k
        if not stay.all():  # texts that began further right leave; the row below takes the least prefix of those above it
            kept = np.flatnonzero(stay)
            self.common = np.minimum.reduceat(self.common[: kept[-1] + 1], np.append(0, kept[:-1] + 1)) if len(kept) else self.common[:0]
            self.rows = self.rows[kept]
        upto = int(np.searchsorted(-self.end[self.enter], -k, "left"))
        new, self.entered = self.enter[self.entered : upto], upto
        rows, common = np.concatenate([new, self.rows]), np.concatenate([np.zeros(len(new), np.int32), self.common])
        symbol = self.data[self.place[rows] + k]  # the transform's column: what stands before each suffix, in their order
        key = self.group[rows] * 256 + symbol
        order = np.argsort(key, kind="stable")
        same = np.zeros(len(rows), bool)
        same[1:] = key[order[1:]] == key[order[:-1]]
        self.rows, self.common = rows[order], np.zeros(len(rows), np.int32)
        if same.any():
            below = np.flatnonzero(same)
            self.common[below] = 1 + _least(common, order[below - 1] + 1, order[below])
        return k


def _least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of values[a..b], for each of the ranges, by minima over powers of two."""
    size = b - a + 1
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(a), values.dtype)
    for k in range(int(level.max()) + 1):
        if k:
            values = np.minimum(values[: -(1 << k - 1)], values[1 << k - 1 :])
        own = level == k
        if own.any():
            out[own] = np.minimum(values[a[own]], values[b[own] - (1 << k) + 1])
    return out


def repeated(texts: pa.Array, column: np.ndarray, starts: np.ndarray, group: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Whether the string at each of a text's starts occurs again, in another text of its group or in copies of this one (n > 1)."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    transform = Transform(np.frombuffer(texts.buffers()[2], np.uint8), at, column, group)
    marks = np.zeros((len(texts), int(starts.max(initial=0))), bool)
    last = column + starts  # columns from here on begin no string of `window`
    while transform.at > int(column.min(initial=0)):
        k = transform.round()
        rows, again = transform.rows, transform.common >= window
        again[:-1] |= again[1:].copy()
        hit = rows[again]
        hit = hit[k < last[hit]]
        marks[hit, k - column[hit]] = True
    return marks | (n[:, None] > 1) & (np.arange(marks.shape[1]) < starts[:, None])


def _ranges(marks: np.ndarray) -> pa.Array:
    """Runs of marks of each row as (first, one past the last)."""
    padded = np.zeros((marks.shape[0], marks.shape[1] + 2), np.int8)
    padded[:, 1:-1] = marks
    edge = np.diff(padded, axis=1)
    row, a = np.nonzero(edge == 1)
    b = np.nonzero(edge == -1)[1]
    runs = pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["a", "b"])
    return X.lists(runs, np.bincount(row, minlength=len(marks)))


def _repeated(window: int):
    """mapInArrow function over contexts sorted by group: those with repeated strings and the runs of their starts."""

    def block(table: pa.Table) -> pa.RecordBatch:
        group = table["g"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        number = lambda c: table[c].to_numpy().astype(np.int64)
        marks = repeated(pa.concat_arrays(table["text"].chunks), number("column"), number("starts"), group, number("n"), window)
        some = marks.any(1) if marks.shape[1] else np.zeros(len(marks), bool)
        found = table.filter(pa.array(some)).select(["g", "x"]).combine_chunks()
        arrays = [pa.concat_arrays(found[c].chunks) if len(found) else pa.array([], pa.binary()) for c in ("g", "x")]
        return pa.RecordBatch.from_arrays([*arrays, _ranges(marks[some])], ["g", "x", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < _BLOCK:
                continue
            table = pa.Table.from_batches(held)
            open_ = pc.equal(table["g"], table["g"][len(table) - 1])
            whole = table.filter(pc.invert(open_))
            if len(whole):
                yield block(whole)
                held = table.filter(open_).to_batches()
        if sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held))

    return run


def _halved(big: DataFrame, window: int) -> DataFrame:
    """Both halves of each context by the columns of its strings; a half's group has the bytes that all its strings share."""
    half = F.explode(F.array(F.struct(F.col("from").alias("p"), F.col("middle").alias("q")), F.struct((F.col("middle") + 1).alias("p"), F.col("to").alias("q"))))
    rows = big.withColumn("middle", ((F.col("from") + F.col("to") - 1) / 2).cast("int")).withColumn("_", half)
    rows = rows.where("_.p <= _.q").withColumn("p", F.greatest("column", "_.p")).withColumn("q", F.least(F.col("column") + F.col("starts") - 1, "_.q")).where("p <= q")
    byte = lambda a, b: F.substring("text", a - F.col("column") + 1, b - a)  # noqa: E731  bytes of columns a to b; each context has the shared ones
    shared = byte(F.col("_.q"), F.col("_.p") + window)
    own = byte(F.col("p"), F.col("q") + window)
    return rows.select(
        "h", "c", "n", "g", F.col("_.p").alias("from"), F.col("_.q").alias("to"), (F.col("base") + F.col("p") - F.col("column")).alias("base"),
        F.col("p").alias("column"), (F.col("q") - F.col("p") + 1).cast("int").alias("starts"), own.alias("text"), shared.alias("shared"),
    )


def spans(base: DataFrame, window: int, gram: int, group_rows: int) -> DataFrame:
    """(t, spans): for each digest of a text of `base` (t, text) with repeated strings, the byte ranges they cover, unmerged."""
    width = window - gram + 1
    runs = base.select("t", "text").mapInArrow(_anchors(window, gram), "t binary, h bigint, c binary, lo bigint, starts int, column int")
    twice = runs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    # stored, so that the join below reads two plain exchanges and a hot anchor can be split
    places = runs.join(stored(twice, "repeated-anchors"), "h", "left_semi").groupBy("t", "h", "c", "lo", "starts", "column").agg(F.count(F.lit(1)).alias("n"))
    places = stored(places, "anchors")
    contexts = places.groupBy("h", "c").agg(F.sum("n").alias("n"), F.min(F.struct("t", "lo", "starts", "column")).alias("at"))
    contexts = stored(contexts, "contexts")
    rivals = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("rivals"))
    contexts = stored(contexts.join(rivals, "h"), "contexts")
    alike = contexts.where("rivals = 1").select("h", "c", F.array(F.struct(F.lit(0).alias("a"), F.col("at.starts").alias("b"))).alias("runs"))

    wanted = contexts.where("rivals > 1").select("at.t", F.struct("h", "c", "n", "rivals", "at.lo", "at.starts", "at.column").alias("w")).groupBy("t").agg(F.collect_list("w").alias("wanted"))
    texts = base.select("t", F.col("text").cast("binary").alias("text")).mapInArrow(_first_copies, "t binary, text binary")
    fetched = texts.join(wanted, "t").select("text", "wanted").mapInArrow(_cut(window), _CONTEXT).dropDuplicates(["h", "c"])
    fetched = stored(fetched, "context-texts")

    ready, settled = [fetched.where(F.col("rivals") <= group_rows)], [alike]
    big = fetched.where(F.col("rivals") > group_rows).withColumn("from", F.lit(0)).withColumn("to", F.lit(width - 1))
    while big.take(1):  # at most the logarithm of `width` rounds
        halves = _halved(big, window)
        halves = halves.withColumn("g", F.unhex(F.md5(F.concat("g", F.encode(F.concat_ws(",", "from", "to"), "utf-8"), "shared"))))
        halves = stored(halves.withColumn("x", F.unhex(F.md5(F.concat(F.encode(F.col("column").cast("string"), "utf-8"), "text")))).drop("shared"), "halves")
        sizes = halves.groupBy("g", "x").agg(F.sum("n").alias("n")).groupBy("g").agg(F.count(F.lit(1)).alias("rivals"), F.sum("n").alias("n"))
        halves = stored(halves.join(sizes.withColumnRenamed("n", "places"), "g").where("places > 1"), "halves")
        settled.append(halves.where("rivals = 1").select("h", "c", F.array(F.struct(F.col("base").alias("a"), (F.col("base") + F.col("starts")).alias("b"))).alias("runs")))
        ready.append(halves.where((F.col("rivals") > 1) & (F.col("rivals") <= group_rows)))
        big = halves.where(F.col("rivals") > group_rows)

    rows = ready[0].select("h", "c", "n", "g", "x", "base", "column", "starts", "text")
    for more in ready[1:]:
        rows = rows.unionByName(more.select(*rows.columns))
    one = rows.groupBy("g", "x").agg(F.sum("n").alias("n"), F.first("column").alias("column"), F.first("starts").alias("starts"), F.first("text").alias("text"))
    sorted_ = one.repartition("g").sortWithinPartitions("g", "x")
    marked = sorted_.mapInArrow(_repeated(window), "g binary, x binary, runs array<struct<a:int,b:int>>")
    moved = F.transform("runs", lambda r: F.struct((r["a"] + F.col("base")).alias("a"), (r["b"] + F.col("base")).alias("b")))
    found = rows.select("g", "x", "h", "c", "base").join(marked, ["g", "x"]).select("h", "c", moved.alias("runs"))
    for more in settled:
        found = found.unionByName(more)
    in_text = F.transform("runs", lambda r: F.struct((F.col("lo") + r["a"]).alias("a"), (F.col("lo") + r["b"] + (window - 1)).alias("b")))
    return places.join(found, ["h", "c"]).select("t", in_text.alias("s")).groupBy("t").agg(F.flatten(F.collect_list("s")).alias("spans"))


_OUT = (("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string"), ("removed", "array<struct<first_byte:bigint,last_byte:bigint>>"))


def _removed(back: Sequence[str]):
    """mapInArrow function: rows with text and spans to what is left of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in X.blocks(batches, "text"):
            data, offsets = X.utf8(block.column("text"))
            n, raw = block.num_rows, data.tobytes()
            spans_, out, removed, counts, hashes = block.column("spans"), [], [], [], []
            for k in range(n):
                a, b = int(offsets[k]), int(offsets[k + 1])
                own = spans_[k].values
                left, lost = hashlib.sha256(), []
                if own is not None and len(own):
                    begin, end = own.field("a").to_numpy(), own.field("b").to_numpy()
                    order = np.argsort(begin, kind="stable")
                    begin, reach = begin[order], np.maximum.accumulate(end[order])
                    apart = np.concatenate([[True], begin[1:] > reach[:-1]])
                    lost = list(zip(begin[apart].tolist(), np.append(reach[:-1][apart[1:]], reach[-1]).tolist()))
                at = a
                for x, y in lost:
                    left.update(raw[at : a + x])
                    at = a + y
                left.update(raw[at:b])
                out += lost
                counts.append(len(lost))
                removed.append(sum(y - x for x, y in lost))
                hashes.append(left.hexdigest())
            x, y = (pa.array([s[i] - i for s in out], pa.int64()) for i in (0, 1))
            listed = X.lists(pa.StructArray.from_arrays([x, y], ["first_byte", "last_byte"]), np.array(counts))
            columns = [*(block.column(c) for c in back), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), listed]
            yield pa.RecordBatch.from_arrays(columns, [*back, *(c for c, _ in _OUT)])

    return run


def deduplicate(
    docs: DataFrame, id: str = "doc_id", text: str = "text", keep: Sequence[str] = (), window: int = WINDOW, gram: int = GRAM, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Per row of `docs`: id, kept columns, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes left, lowercase hex) and the
    `removed` byte ranges (both ends included), merged and in order.

    A byte goes if it lies in a string of `window` bytes that starts at another place too, of the same row or of another;
    rows that are alike each count. Strings are those of the input, overlaps included. Texts are UTF-8 bytes of any
    length; null is empty, and a text under `window` bytes loses nothing. Each row comes back, rows with one id too. An empty table
    gives no row. Other columns are not looked at; kept ones must not be named like the results.
    """
    if not 0 < gram <= window:
        raise ValueError("gram must be from 1 to window")
    base, back = X.kept(docs, id, text, keep)
    schema = X.struct(base, back, _OUT)
    own = base.select(*(F.col(c).alias(f"k_{i}") for i, c in enumerate(back)), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("t", F.unhex(F.md5(F.col("text").cast("binary"))))
    found = own.join(spans(own, window, gram, group_rows), "t", "left").select(*(F.col(f"k_{i}").alias(f"k_{i}") for i in range(len(back))), "text", "spans")
    flat = [f"k_{i}" for i in range(len(back))]
    done = found.mapInArrow(_removed(flat), X.struct(own, flat, _OUT))
    return done.select(*(F.col(a).alias(f.name) for a, f in zip(done.columns, schema.fields)))
