"""Near-duplicates by SimHash fingerprints and the generalised pigeonhole principle.

Fingerprints: one pass over the texts; a bit is the majority of the hashes of all word shingles, repeats included.

Candidates: equal fingerprints become one row first. The 64 bits are grouped so that correlated bits share a partition;
if t_i + 1 summed over the partitions is at least max_bits + 1, two fingerprints within max_bits differ by at most t_i in some
partition i (t_i = -1 leaves a partition out). Dynamic programming picks the thresholds, and the number of partitions with
them, by the candidates expected from the bit statistics of all fingerprints and by the keys to probe. A partition with threshold t is
probed with t of its bits masked, in every way, so partners share a key (mask, value).

Verification: keys meet their members; every pair of a bucket is compared in full, and the bucket gives a spanning forest of its
true links, not its pairs. A bucket of more than `bucket` members is not compared: its members share the key's bits, so
the other bits are cut in max_bits + 1 parts of which partners share one, and the members are dealt to those
narrower keys, again and again; a key of nearly all bits has few distinct fingerprints, so this ends. No candidate
is left out and no task compares more than `bucket` fingerprints with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from rowtide.llm import texts as X
from rowtide.llm.components import components
from rowtide.session import stored

SHINGLE, MAX_BITS, SEED, BUCKET = 3, 2, 42, 2048
_LOWER = bytes(X.LOWER.tolist())


def fingerprint_block(texts: list[str | None], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Fingerprints as unsigned 64-bit numbers; 0 without words."""
    hashes, sizes = [], []
    digest = xxhash.xxh64_intdigest
    for text in texts:
        words = (text or "").encode().translate(_LOWER).split()
        n = max(len(words) - shingle + 1, min(len(words), 1))
        sizes.append(n)
        if n:
            joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
            last = shingle if len(words) >= shingle else len(words)
            hashes += [digest(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[last - 1 :])]
    out, size = np.zeros(len(texts), np.uint64), np.array(sizes, np.int64)
    if hashes:
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = np.flatnonzero(size)
        first = np.concatenate([[0], np.cumsum(size[full])[:-1]])
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > size[full][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def grouped_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """The bits in `parts` groups of about equal size, correlated ones together. `together`: how often both bits are set."""
    p = np.diag(together) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(r, 0)
    left, out = list(range(len(p))), []
    for k in range(parts, 0, -1):
        own = [max(left, key=lambda b: (r[b, left].sum(), -b))]
        left.remove(own[0])
        while len(own) < math.ceil((len(left) + len(own)) / k):
            own.append(max(left, key=lambda b: (r[b, own].mean(), -b)))
            left.remove(own[-1])
        out.append(sorted(own))
    return out


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with the t_i + 1 adding up to `budget` at the least sum of costs[i][t_i + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for units, c in enumerate(own[: budget - used + 1]):
                if used + units not in new or cost + c < new[used + units][0]:
                    new[used + units] = (cost + c, [*ts, units - 1])
        best = new
    return best[budget]


def plan(together: np.ndarray, n: int, max_bits: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to probe."""
    p = np.diag(together) / max(n, 1)
    differ = 2 * p * (1 - p)
    choices = []
    for parts in range(1, max_bits + 3):
        groups, costs = grouped_bits(together, n, parts), []
        for bits in groups:
            at = np.array([1.0])  # chance of each distance of two fingerprints within the partition
            for b in bits:
                at = np.convolve(at, [1 - differ[b], differ[b]])
            costs.append([0.0] + [n * math.comb(len(bits), t) * 4 + n * n * at[: t + 1].sum() * math.comb(len(bits), t) / 2 for t in range(max_bits + 1)])
        cost, ts = allocate(costs, max_bits + 1)
        choices.append((cost, parts, [(g, t) for g, t in zip(groups, ts) if t >= 0]))
    return min(choices)[2]


def masks(parts: list[tuple[list[int], int]]) -> list[int]:
    """The masks of all probes: a partition's bits without any `threshold` of them."""
    out = []
    for bits, t in parts:
        whole = sum(1 << b for b in bits)
        out += [whole & ~sum(1 << b for b in off) for off in combinations(bits, t)]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fingerprints: np.ndarray, bucket: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest member) of the components within each run of equal `bucket` numbers."""
    n = len(fingerprints)
    end = np.searchsorted(bucket, bucket, "right")
    label, at = np.arange(n), np.arange(n)
    pairs, held = [], 0

    def join() -> None:
        a, b = (np.concatenate(x) for x in zip(*pairs))
        while True:
            low = np.minimum(label[a], label[b])
            old = label.copy()
            for x in (label[a], label[b]):
                np.minimum.at(label, x, low)
            while not np.array_equal(label, label[label]):
                label[:] = label[label]
            if np.array_equal(old, label):
                return

    for step in range(1, n):
        at = at[at + step < end[at]]
        if not len(at):
            break
        near = np.bitwise_count(fingerprints[at] ^ fingerprints[at + step]) <= max_bits
        if near.any():
            pairs.append((at[near], at[near] + step))
            held += int(near.sum())
        if held > 1 << 20:
            join()
            pairs, held = [], 0
    if pairs:
        join()
    moved = np.flatnonzero(label != np.arange(n))
    return fingerprints[moved], fingerprints[label[moved]]


def links(distinct: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect just what the pairs of fingerprints `f` within max_bits connect; `f` distinct, not null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64))
        for batch in batches:
            f = batch.column("f").to_numpy().astype(np.int64)
            bits = np.unpackbits(f.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096, dtype=np.int32)), pa.array(total.ravel())], ["cell", "n"])

    n = distinct.count()
    together = np.zeros(4096)
    for r in distinct.mapInArrow(count, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # 64 x 64 rows
        together[r["cell"]] = r["n"]
    probes = masks(plan(together.reshape(64, 64), n, max_bits))
    keyed = distinct.select("f", F.explode(F.array(*[F.lit(_signed(m)).cast("bigint") for m in probes])).alias("mask"))
    keyed = keyed.withColumn("value", F.col("f").bitwiseAND(F.col("mask")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # rows come sorted by key; the last key of a batch may go on in the next

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            m, v, f = (table[c].to_numpy() for c in ("mask", "value", "f"))
            fresh = np.concatenate([[True], (m[1:] != m[:-1]) | (v[1:] != v[:-1])])
            number = np.cumsum(fresh) - 1
            size = np.bincount(number)[number]
            for lo in range(0, len(f), 1 << 16):  # whole buckets, about so many rows at a time
                a, b = (int(np.searchsorted(number, number[x])) if x < len(f) else len(f) for x in (lo, lo + (1 << 16)))
                use = np.arange(a, b)[size[a:b] > 1]
                if len(use):
                    x, y = forest(f[use].astype(np.int64).view(np.uint64), number[use], max_bits)
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
            m, v = table["mask"].to_numpy(), table["value"].to_numpy()
            same = (m == m[-1]) & (v == v[-1])
            cut = len(m) - int(same[::-1].argmin()) if not same.all() else 0
            if cut:
                yield from done(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None and len(rest):
            yield from done(rest)

    found: list[DataFrame] = []
    while True:
        crowded = stored(keyed.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("mask", "value"), "crowded")
        some = bool(crowded.take(1))
        calm = keyed.join(crowded, ["mask", "value"], "left_anti") if some else keyed
        sorted_ = calm.repartition("mask", "value").sortWithinPartitions("mask", "value")
        found.append(stored(sorted_.mapInArrow(compare, "a bigint, b bigint"), "near"))
        if not some:
            break
        tight = keyed.join(crowded, ["mask", "value"], "left_semi")

        def narrower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: dict[int, list[int]] = {}
            for batch in batches:
                f, mask = (batch.column(c).to_numpy() for c in ("f", "mask"))
                for m in np.unique(mask).tolist():
                    if m not in parts:
                        free = [b for b in range(64) if not m >> b & 1]
                        parts[m] = [_signed((m | sum(1 << b for b in free[i :: max_bits + 1])) & (2**64 - 1)) for i in range(max_bits + 1)]
                    own = f[mask == m]
                    for p in parts[m]:
                        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), p, np.int64)), pa.array(own & p)], ["f", "mask", "value"])

        keyed = stored(tight.select("f", "mask", "value").mapInArrow(narrower, "f bigint, mask bigint, value bigint").distinct(), "narrower")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", keep: Sequence[str] = (), shingle: int = SHINGLE, max_bits: int = MAX_BITS, bucket: int = BUCKET
) -> DataFrame:
    """Per row of `docs`: id, kept columns, fingerprint (bigint), component_id, and `stays` for one row of each component.

    Words are split at ASCII white space, A-Z lower-cased; fewer words than a shingle are one shingle, a null or wordless text has
    fingerprint 0 and is linked like any other. component_id is the smallest id reachable over links of at most `max_bits` bits,
    null only if all those ids are null. The row that stays has that id; of several with it, one. Repeated rows each
    come back; kept columns must not have a result's name; others are not looked at.
    """
    base, back = X.kept(docs, id, text, keep)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in X.blocks(batches, text, 1 << 20):
            f = fingerprint_block(block.column(text).to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in back), pa.array(f.view(np.int64))], [*back, "fingerprint"])

    named = X.struct(base, back, [("fingerprint", "bigint"), ("component_id", "bigint"), ("stays", "boolean"), ("_row", "bigint")])
    rows = base.mapInArrow(scan, type(named)(named.fields[: len(back) + 1]))
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "fingerprints")
    small = rows.select("_row", F.col(id).alias("_id"), F.col("fingerprint").alias("f"))
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row"))
    distinct = stored(small.groupBy("f").agg(first.alias("first")), "distinct")
    roots = components(links(distinct.select("f"), max_bits, bucket))
    of = distinct.join(roots, distinct["f"] == roots["node"], "left").select("f", "first", F.coalesce("root", "f").alias("root"))
    of = stored(of, "roots")
    top = of.groupBy("root").agg(F.min("first").alias("first"))
    of = of.select("f", "root").join(top, "root").select("f", F.col("first._id").alias("component_id"), F.col("first._row").alias("_first"))
    mark = small.join(of, "f").select("_row", "component_id", (F.col("_row") == F.col("_first")).alias("stays"))
    return rows.join(mark, "_row").select(*back, "fingerprint", "component_id", "stays")
