"""Source divergence: how far the sources of a language differ in their terms, over a K2-tree of the (group, term) counts.

A group is a (lang, source); a kept term stands in at least `min_docs` documents of its language. With c the group's count of
a term, N its count of all kept terms and V their number, p = 1 + floor(10^9 (c + 2) / (N + 2 V)); two distributions differ
at a term by floor((p - q)^2 / (p + q)).

The matrix of a language is cut into stripes of about `width` terms and, where it has many sources, into tiles of about
`tile` groups. A task gets one stripe for one pair of tiles and builds its K2-tree: a square of 2^h rows and columns
whose quadrants are bits, level by level, and whose leaves are the nonzero counts. For every pair of groups the two row
paths go down together. A quadrant in which neither row has a leaf holds the same two probabilities throughout, so it is
priced by its number of terms; only leaves of one of the two rows are visited one by one. Sums of a pair over
stripes are added up by Spark. The terms that set a group apart from its language come from the same leaves.

Scale: what shuffles is one row for each term of a group and block of texts, then one for each kept (group, term).
No task holds more than a stripe of two tiles; a term of many sources spreads over the tiles. Sizes: `width` x 2 x `tile`
counts. All arithmetic is on integers: p by long division digit by digit, exact for N + 2 V below 9 x 10^17.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from rowtide.llm import texts as X
from rowtide.plans.groups import top_per_group
from rowtide.session import stored

MIN_DOCS, TOP, WIDTH, TILE = 10, 10, 4096, 128
BLOCK = 4 << 20
_PAIRS = 1 << 19  # leaves that a traversal visits at a time, about
_BYTES = np.arange(256)
#: Bytes of terms after lower-casing A-Z: a-z and everything beyond ASCII.
LETTERS = ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)


def probability(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), digit by digit."""
    left, by = np.asarray(count, np.int64) + 2, np.asarray(total, np.int64) + 2 * terms
    out, left = np.divmod(left, by)
    for _ in range(9):
        digit, left = np.divmod(left * 10, by)
        out = out * 10 + digit
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class K2Tree:
    """Places (row, column) of a square of 2^height: a bit for every quadrant of a quadrant that is not empty; leaves in tree order."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, height: int):
        code = np.zeros(len(rows), np.int64)
        for bit in range(height):
            code |= ((columns >> bit) & 1) << (2 * bit) | ((rows >> bit) & 1) << (2 * bit + 1)
        self.order = np.argsort(code, kind="stable")
        code, self.height = code[self.order], height
        self.bits, self.rank = [], []  # by level: quadrants of the nodes above; how many are set before each
        above = np.zeros(min(1, len(code)), np.int64)
        for level in range(height):
            nodes = code >> 2 * (height - 1 - level)
            nodes = nodes[np.concatenate([[True], nodes[1:] != nodes[:-1]])] if len(nodes) else nodes
            bits = np.zeros(4 * len(above), bool)
            bits[4 * np.searchsorted(above, nodes >> 2) + (nodes & 3)] = True
            self.bits.append(bits)
            self.rank.append(np.cumsum(bits) - bits)
            above = nodes

    def child(self, level: int, node: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        """The node's quadrant one level down, -1 where it is empty or the node is -1."""
        if not len(self.bits[level]):
            return np.full(len(node), -1)
        at = np.maximum(4 * node + quadrant, 0)
        return np.where((node >= 0) & self.bits[level][at], self.rank[level][at], -1)

    def descend(self, a: np.ndarray, b: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For pairs of rows (a, b) of a matrix of `terms` columns: the pair, a's leaf and b's leaf (-1: none) of every
        column in which one has a leaf, and each pair's number of columns in which neither has."""
        pair, start = np.arange(len(a)), np.zeros(len(a), np.int64)
        left = right = np.full(len(a), 0 if len(self.order) else -1)
        empty = np.zeros(len(a), np.int64)
        for level in range(self.height):
            down = self.height - 1 - level
            up, low = 2 * ((a[pair] >> down) & 1), 2 * ((b[pair] >> down) & 1)
            found = []
            for half in (0, 1):
                l, r, at = self.child(level, left, up + half), self.child(level, right, low + half), start + (half << down)
                none = (l < 0) & (r < 0)
                empty += np.bincount(pair[none], np.clip(terms - at[none], 0, 1 << down), len(a)).astype(np.int64)
                found.append([x[~none] for x in (pair, l, r, at)])
            pair, left, right, start = (np.concatenate(x) for x in zip(*found))
        return pair, left, right, empty


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's (lang, source, term) with the number of places and of documents."""
    for block in X.blocks(batches, "text", BLOCK):
        data, offsets = X.utf8(block.column("text"))
        found, _, _, first = X.words(data, offsets, LETTERS)
        coded = found.dictionary_encode()
        v, doc = max(1, len(coded.dictionary)), np.repeat(np.arange(block.num_rows), np.diff(first))
        langs, sources = block.column("lang").dictionary_encode(), block.column("source").dictionary_encode()
        group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
        own, n = np.unique(doc * v + coded.indices.to_numpy(), return_counts=True)
        key = group[own // v] * v + own % v
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        g, term = np.divmod(key[begin], v)
        lang, source = np.divmod(g, max(1, len(sources.dictionary)))
        columns = [langs.dictionary.take(pa.array(lang)), sources.dictionary.take(pa.array(source)), coded.dictionary.take(pa.array(term)).cast(pa.string())]
        places = np.add.reduceat(n, begin) if len(begin) else begin
        yield pa.RecordBatch.from_arrays([*columns, pa.array(places, pa.int64()), pa.array(np.diff(np.append(begin, len(key))), pa.int64())], ["lang", "source", "term", "n", "docs"])


_STRIPE = "lang string, source string, part string, item string, value bigint"


def _stripe(top: int):
    """applyInArrow function over one stripe of two tiles: each pair's sum (part pair), each group's first terms (part term)."""

    def run(table: pa.Table) -> pa.Table:
        kind = pc.is_null(table["term"]).to_numpy()
        groups, cells = table.filter(pa.array(kind)), table.filter(pa.array(~kind))
        lang, terms = groups["lang"][0].as_py(), groups["terms"][0].as_py()
        groups = groups.group_by("source").aggregate([("n", "max"), ("tile", "max")])  # once each
        names, total, tile = groups["source"].combine_chunks(), groups["n_max"].to_numpy(), groups["tile_max"].to_numpy()
        every, own_total = table["every"][0].as_py(), table["lang_n"][0].as_py()
        words = cells["term"].combine_chunks().dictionary_encode()
        row = pc.index_in(cells["source"].combine_chunks(), names).to_numpy().astype(np.int64)
        column = words.indices.to_numpy().astype(np.int64)
        tree = K2Tree(row, column, max(1, int(max(len(names), terms, 2) - 1).bit_length()))
        row, column, count = row[tree.order], column[tree.order], cells["n"].to_numpy()[tree.order]
        p = probability(count, total[row], every) if every else count
        zero = probability(np.zeros(len(total), np.int64), total, every) if every else np.zeros(len(total), np.int64)
        a, b = np.triu_indices(len(names), 1)
        own = table["t"][0] == table["u"][0]  # the stripe of one tile, not of two
        if not own:
            across = tile[a] != tile[b]
            a, b = a[across], b[across]
        sums, step = [], max(1, _PAIRS // max(1, terms))
        for k in range(0, len(a) if every else 0, step):
            x, y = a[k : k + step], b[k : k + step]
            pair, left, right, empty = tree.descend(x, y, terms)
            value = gap(np.where(left >= 0, p[left], zero[x[pair]]), np.where(right >= 0, p[right], zero[y[pair]]))
            out = empty * gap(zero[x], zero[y])
            np.add.at(out, pair, value)
            sums.append(out)
        sums = np.concatenate(sums) if sums else np.zeros(len(a), np.int64)
        part, source, item, value = [np.repeat("pair", len(a))], [names.take(pa.array(a))], [names.take(pa.array(b))], [sums]
        if own and len(row):
            q = probability(cells["lang_count"].to_numpy()[tree.order], np.full(len(row), own_total), every)
            above = np.flatnonzero(p > q)
            f = gap(p[above], q[above])
            rank = np.argsort(np.argsort(np.array([x.as_py().encode() for x in words.dictionary], object)))
            above_order = np.lexsort((rank[column[above]], -f, row[above]))
            above, f = above[above_order], f[above_order]
            place = np.arange(len(above)) - np.searchsorted(row[above], row[above])
            above, f = above[place < top], f[place < top]
            part.append(np.repeat("term", len(above)))
            source.append(names.take(pa.array(row[above])))
            item.append(words.dictionary.take(pa.array(column[above])))
            value.append(f)
        columns = [pa.concat_arrays(source), pa.array(np.concatenate(part), pa.string()), pa.concat_arrays(item), pa.array(np.concatenate(value), pa.int64())]
        return pa.table([pa.array([lang] * len(columns[0]), pa.string()), *columns], names=["lang", "source", "part", "item", "value"])

    return run


def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, width: int = WIDTH, tile: int = TILE
) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` rows rank the other sources of the lang by divergence, `term` rows the
    first `top` terms that the group has more often than its lang.

    Null text, lang and source are ''. Words are runs of A-Z (lower-cased), a-z and characters beyond ASCII, in whole texts of
    any length. A group whose documents have no term still meets all others; a lang without kept terms gives 0 for
    each pair. Equal values rank by item in UTF-8 order. Repeated rows count as often as they stand. An empty table gives no
    row. Other columns are not looked at, whatever their names.
    """
    base = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    counted = base.mapInArrow(_counts, "lang string, source string, term string, n bigint, docs bigint")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counted = stored(counted, "terms")
    kept = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_count")).where(F.col("docs") >= min_docs).drop("docs")
    kept = stored(kept, "kept-terms")
    cells = counted.select("lang", "source", "term", "n").join(kept, ["lang", "term"])
    cells = stored(cells, "cells")

    langs = kept.groupBy("lang").agg(F.count("term").alias("every"), F.sum("lang_count").alias("lang_n"))
    groups = base.select("lang", "source").distinct()
    groups = groups.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").na.fill(0, ["n"])
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups")).join(langs, "lang", "left").na.fill(0, ["every", "lang_n"])
    cut = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) / F.lit(size))).cast("int")
    langs = stored(langs.select("lang", "every", "lang_n", cut("every", width).alias("stripes"), cut("groups", tile).alias("tiles")), "langs")
    spot = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    groups = stored(groups.join(langs, "lang").withColumn("tile", spot("source", "tiles")), "groups")

    in_stripe = kept.join(langs, "lang").groupBy("lang", spot("term", "stripes").alias("stripe")).agg(F.count(F.lit(1)).alias("terms"))
    heads = groups.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1))).join(in_stripe, ["lang", "stripe"], "left").na.fill(0, ["terms"])
    heads = heads.withColumn("term", F.lit(None).cast("string")).withColumn("lang_count", F.lit(None).cast("bigint"))
    body = cells.join(langs, "lang").withColumn("tile", spot("source", "tiles")).withColumn("stripe", spot("term", "stripes")).withColumn("terms", F.lit(None).cast("bigint"))
    columns = ["lang", "stripe", "tile", "tiles", "source", "term", "n", "lang_count", "terms", "every", "lang_n"]
    both = heads.select(*columns).unionByName(body.select(*columns)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    both = both.withColumn("t", F.least("tile", "other")).withColumn("u", F.greatest("tile", "other")).drop("tiles", "other")
    found = stored(both.groupBy("lang", "stripe", "t", "u").applyInArrow(_stripe(top), _STRIPE), "stripes")

    pairs = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    words = found.where("part = 'term'").select("lang", "source", "item", "value")
    order = [F.desc("value"), F.asc("item")]
    words = top_per_group(words, ["lang", "source"], order, top, ["item"], 8)
    out = pairs.withColumn("part", F.lit("pair")).unionByName(words.withColumn("part", F.lit("term")))
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(*order)))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
