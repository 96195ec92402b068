"""Approximate nearest neighbours by robust-pruned directed graphs, one a shard.

Equal vectors become one point that keeps its smallest ids. Points are dealt to shards of about `shard_rows` by a hash of the vector, so a
shard is bounded whatever the table, and copies of one vector meet in one shard after each batch has already kept its few
smallest ids. A shard's graph is built in batches: a greedy beam search from the shard's middle proposes neighbours of each point, relaxed
pruning keeps a candidate only if no kept one is closer to it by the factor `alpha`, and back edges are pruned alike.

Inner products become distances by one more coordinate that gives points the same norm. That works where norms are alike, so a shard
is cut into bands: points are taken from the shard's median, which changes no query's order, and lie in one band while their norms are
within the factor `RATIO`. Every band of more than `SMALL_BAND` points has a graph of its own, smaller ones are read whole. A
query takes the bands from the longest points on and leaves out those that cannot hold a better product than it has.

The index is stored, a row a shard. Every query visits every shard: queries travel in blocks to (shard, block) tasks,
run a beam search by inner product there, and the beam is scored again in double precision on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rowtide.session import stored

SHARD_ROWS, QUERY_BLOCK = 8192, 4096
RATIO, SMALL_BAND = 1.1, 256


@dataclass(frozen=True)
class Shape:
    """Out-edges of a point, beam widths of building and search, pruning factor, points expanded in one step."""

    degree: int = 32
    build_beam: int = 64
    search_beam: int = 200
    alpha: float = 1.2
    expand: int = 4
    seed: int = 11


def beam_search(points: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int, expand: int, product: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(points, squared distances) of each query's `beam` best found, best first; -1 and inf where there are fewer.

    With `product`, -2 times the inner product takes the place of the distance.
    """
    q, n = len(queries), len(points)
    norm = np.einsum("ij,ij->i", points, points) if not product else np.zeros(n, np.float32)
    own = np.einsum("ij,ij->i", queries, queries) if not product else np.zeros(q, np.float32)
    row = np.arange(q)[:, None]
    ids = np.full((q, beam), -1, np.int64)
    dist = np.full((q, beam), np.inf, np.float32)
    open_ = np.zeros((q, beam), bool)
    seen = np.zeros((q, n + 1), bool)
    seen[:, start] = seen[:, n] = True
    ids[:, 0], open_[:, 0] = start, True
    dist[:, 0] = norm[start] + own - 2 * queries @ points[start]
    live = np.arange(q)
    while len(live):
        rank = np.argsort(np.where(open_[live], dist[live], np.inf), axis=1, kind="stable")[:, :expand]
        use = np.take_along_axis(open_[live], rank, 1)
        head = np.where(use, np.take_along_axis(ids[live], rank, 1), n)
        open_[live[:, None], rank] = False
        near = graph[head].reshape(len(live), -1)  # the row of n is all n
        near.sort(axis=1)
        fresh = ~seen[live[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[live[:, None], near] = True
        d = norm[np.minimum(near, n - 1)] + own[live][:, None] - 2 * np.einsum("ij,ikj->ik", queries[live], points[np.minimum(near, n - 1)])
        d = np.where(fresh, d, np.inf).astype(np.float32)
        all_ids = np.concatenate([ids[live], near], 1)
        all_dist = np.concatenate([dist[live], d], 1)
        all_open = np.concatenate([open_[live], fresh], 1)
        best = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        ids[live], dist[live] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_dist, best, 1)
        open_[live] = np.take_along_axis(all_open, best, 1) & np.isfinite(dist[live])
        live = live[open_[live].any(1)]
    return np.where(np.isfinite(dist), ids, -1), dist


def robust_prune(points: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours of each point `of`, from its row of `candidates` (len(points) marks none), nearest first, diverse."""
    n = len(points)
    candidates = np.sort(candidates, axis=1)
    bad = (candidates >= n) | (candidates == of[:, None])
    bad[:, 1:] |= candidates[:, 1:] == candidates[:, :-1]
    at = points[np.minimum(candidates, n - 1)]
    gap = at - points[of][:, None, :]
    dist = np.where(bad, np.inf, np.einsum("ikj,ikj->ik", gap, gap))
    order = np.argsort(dist, axis=1, kind="stable")
    candidates, dist, at = np.take_along_axis(candidates, order, 1), np.take_along_axis(dist, order, 1), np.take_along_axis(at, order[:, :, None], 1)
    norm = np.einsum("ikj,ikj->ik", at, at)
    alive, out, rows = np.isfinite(dist), np.full((len(of), degree), n, np.int64), np.arange(len(of))
    for k in range(degree):
        some = alive.any(1)
        if not some.any():
            break
        pick = alive.argmax(1)
        out[some, k] = candidates[rows, pick][some]
        chosen = at[rows, pick]
        between = norm + norm[rows, pick][:, None] - 2 * np.einsum("ij,ikj->ik", chosen, at)
        alive &= alpha * alpha * between > dist
        alive[rows, pick] = False
    return out


def build(points: np.ndarray, shape: Shape) -> tuple[np.ndarray, int]:
    """(out-edges, start) of a shard; row n of the graph and the number n stand for no point."""
    n = len(points)
    rng = np.random.default_rng(shape.seed)
    graph = np.full((n + 1, shape.degree), n, np.int64)
    if n > 1:
        graph[:n] = rng.integers(0, n, (n, shape.degree))
    start = int(np.argmin(((points - points.mean(0)) ** 2).sum(1)))
    order = rng.permutation(n)
    for lo in range(0, n, 512):
        batch = order[lo : lo + 512]
        found, _ = beam_search(points, graph, start, points[batch], shape.build_beam, shape.expand)
        options = np.concatenate([np.where(found < 0, n, found), graph[batch]], 1)
        graph[batch] = robust_prune(points, batch, options, shape.degree, shape.alpha)
        # back edges, to points that have room or are pruned anew
        to, back = graph[batch].ravel(), np.repeat(batch, shape.degree)
        to, back = to[to < n], back[to < n]
        sort = np.argsort(to, kind="stable")
        to, back = to[sort], back[sort]
        targets, first, count = np.unique(to, return_index=True, return_counts=True)
        width = min(int(count.max(initial=0)), 64)
        for part in range(0, int(count.max(initial=0)), 64):
            more = np.full((len(targets), width), n, np.int64)
            for k in range(width):
                has = count > part + k
                more[has, k] = back[first[has] + part + k]
            busy = more[:, 0] < n
            options = np.concatenate([graph[targets[busy]], more[busy]], 1)
            graph[targets[busy]] = robust_prune(points, targets[busy], options, shape.degree, shape.alpha)
    return graph, start


def _least_ids(vectors: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of one row, its point number) for the `most` smallest distinct ids of each distinct vector; points are numbered by vector."""
    keys = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
    _, point = np.unique(keys, return_inverse=True)
    order = np.lexsort((ids, point))
    p, i = point[order], ids[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (i[1:] != i[:-1])
    order, p = order[new], p[new]
    begin = np.searchsorted(p, p)
    fine = np.arange(len(p)) - begin < most
    return order[fine], p[fine]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def search(
    vectors: DataFrame, query: Column, k: int, id: str = "vec_id", vector: str = "embedding", shape: Shape = Shape(),
    shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """The k nearest found of every row where `query` holds, among the rows of other ids: query_id, rank (from 1), vec_id, score.

    Nearness is the largest inner product, in double precision on the vectors as given; ties go to the smaller id, fewer than k
    candidates are all returned. Rows take no part whose id or vector is null, whose vector is empty, all zero, has a null or non-finite
    component, or a length other than the commonest (the longer at a tie). Rows that repeat both id and vector are one; an
    empty table gives no row. Other columns are not looked at.
    """

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(v, np.float64) if v and None not in v else np.zeros(1) for v in batch.column("v").to_pylist()]
            good = [bool(np.isfinite(v).all() and v.any()) for v in rows]
            own = [v + 0.0 for v, g in zip(rows, good) if g]  # -0.0 becomes 0.0, so equal vectors have equal bytes
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("q"), pa.array([v.tobytes() for v in own], pa.binary())], ["id", "q", "v"])

    given = vectors.select(F.col(id).cast("bigint").alias("id"), F.coalesce(query, F.lit(False)).alias("q"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = stored(given.mapInArrow(clean, "id bigint, q boolean, v binary").withColumn("size", F.octet_length("v")), "vectors")
    sizes = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("q").cast("bigint")).alias("queries"))
    common = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    out = "query_id bigint, vec_id bigint, score double"
    if common is None:
        return vectors.sparkSession.createDataFrame([], out).withColumn("rank", F.lit(1)).select("query_id", "rank", "vec_id", "score")
    rows = rows.where(F.col("size") == common["size"])
    shards, blocks, most = math.ceil(common["n"] / shard_rows), max(1, math.ceil(common["queries"] / query_block)), k + 1

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.take(pa.array(_least_ids(_matrix(batch.column("v")), batch.column("id").to_numpy(), most)[0]))

    def index(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        vectors, ids = _matrix(table["v"].combine_chunks()), table["id"].to_numpy()
        order, point = _least_ids(vectors, ids, most)
        at = np.searchsorted(point, np.arange(point[-1] + 2))
        own = vectors[order[at[:-1]]]
        graphs, starts = [], []
        for band in bands(own):
            graph, start = build(lifted(*band.scaled), shape) if band.wide else (np.zeros((0, shape.degree), np.int64), 0)
            graphs.append(graph.astype(np.int32).ravel())
            starts.append(start)
        values = [key[0].as_py(), own.tobytes(), np.concatenate(graphs).tobytes(), starts, ids[order].tobytes(), at.astype(np.int64).tobytes()]
        return pa.table({n: [v] for n, v in zip(("shard", "vectors", "graph", "starts", "ids", "at"), values)}, _index_schema())

    dealt = rows.select("id", "v").mapInArrow(least, "id bigint, v binary").withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    stored_index = stored(dealt.groupBy("shard").applyInArrow(index, "shard int, vectors binary, graph binary, starts array<int>, ids binary, at binary"), "graphs")

    def visit(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            one = {c: left[c][0].as_py() for c in left.column_names}
            queries, qids = _matrix(right["v"].combine_chunks()), right["id"].to_numpy()
            own = np.frombuffer(one["vectors"], np.float64).reshape(-1, queries.shape[1])
            ids, at = np.frombuffer(one["ids"], np.int64), np.frombuffer(one["at"], np.int64)
            cut, graphs, edges = bands(own), [], np.frombuffer(one["graph"], np.int32)
            for band in cut:
                size = (len(band.points) + 1) * shape.degree if band.wide else 0
                graphs.append(edges[:size].reshape(-1, shape.degree).astype(np.int64))
                edges = edges[size:]
            for lo in range(0, len(queries), 256):
                part = queries[lo : lo + 256]
                asked, points = candidates(own, cut, graphs, one["starts"], part, most, shape)
                first = np.searchsorted(asked, np.arange(len(part) + 1))
                for i, (q, v) in enumerate(zip(qids[lo : lo + 256].tolist(), part)):
                    row = points[first[i] : first[i + 1]]
                    size = at[row + 1] - at[row]
                    score = np.repeat(own[row] @ v, size)
                    names = ids[np.repeat(at[row] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                    score, names = score[names != q], names[names != q]
                    best = np.lexsort((names, -score))[:k]
                    found.append((np.full(len(best), q), names[best], score[best]))
        q, v, s = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": q.astype(np.int64), "vec_id": v.astype(np.int64), "score": s.astype(np.float64)})

    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    parts = stored_index.withColumn("block", spread(blocks)).groupBy("shard", "block")
    asked = rows.where("q").select("id", "v").distinct().withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", spread(shards))
    near = parts.cogroup(asked.groupBy("shard", "block")).applyInArrow(visit, out)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@dataclass(frozen=True)
class Band:
    """Points of a shard whose distances from its middle are alike: their numbers, their vectors from the middle, the middle, the longest."""

    points: np.ndarray
    vectors: np.ndarray
    middle: np.ndarray
    longest: float

    @property
    def wide(self) -> bool:
        return len(self.points) > SMALL_BAND

    @property
    def scaled(self) -> tuple[np.ndarray, float]:
        """The vectors in units of their largest component and their largest squared norm."""
        own = self.vectors / (np.abs(self.vectors).max() or 1.0)
        return own, float(np.einsum("ij,ij->i", own, own).max())


def bands(vectors: np.ndarray) -> list[Band]:
    """A shard's points by falling distance from its middle, the median of each component: a band ends after the factor `RATIO`, but has `SMALL_BAND` points where there are any."""
    unit = np.abs(vectors).max()
    scaled = vectors / unit
    middle = np.median(scaled, 0)  # no few points move it
    own = scaled - middle
    norm = np.sqrt(np.einsum("ij,ij->i", own, own))
    order = np.argsort(-norm, kind="stable")
    out, at = [], 0
    while at < len(order):
        to = int(np.searchsorted(-norm[order], -norm[order[at]] / RATIO, "right"))
        to = max(to, min(len(order), at + SMALL_BAND))
        out.append(Band(order[at:to], own[order[at:to]], middle, float(norm[order[at]])))
        at = to
    return out


def candidates(
    vectors: np.ndarray, cut: list[Band], graphs: list[np.ndarray], starts: list[int], queries: np.ndarray, most: int, shape: Shape
) -> tuple[np.ndarray, np.ndarray]:
    """(query number, point) pairs to score, ordered by query: what beam searches find in wide bands, and all points of narrow ones."""
    scaled, unit = vectors / np.abs(vectors).max(), queries / np.abs(queries).max(1, keepdims=True)
    length, beam = np.sqrt(np.einsum("ij,ij->i", unit, unit)), max(shape.search_beam, 2 * most)
    best = np.full((len(queries), most), -np.inf)  # each query's highest products so far
    pairs = []
    for band, graph, start in zip(cut, graphs, starts):
        reach = unit @ band.middle + length * band.longest
        live = np.flatnonzero(reach >= best[:, -1] - 1e-9 * np.abs(reach))
        if not len(live):
            continue
        if band.wide:
            near, _ = beam_search(band.scaled[0].astype(np.float32), graph, start, unit[live].astype(np.float32), beam, shape.expand, product=True)
        else:
            near = np.broadcast_to(np.arange(len(band.points)), (len(live), len(band.points)))
        point = band.points[np.maximum(near, 0)]
        score = np.where(near >= 0, np.einsum("ij,ikj->ik", unit[live], scaled[point]), -np.inf)
        pairs.append((np.repeat(live, near.shape[1])[near.ravel() >= 0], point[near >= 0]))
        best[live] = -np.sort(-np.concatenate([best[live], score], 1), axis=1)[:, :most]
    asked, points = (np.concatenate(x) for x in zip(*pairs))
    order = np.argsort(asked, kind="stable")
    return asked[order], points[order]


def lifted(vectors: np.ndarray, top: float) -> np.ndarray:
    """Points of one norm but for a shift: the last coordinate is root(top - norm squared) - root(top), without their difference's loss."""
    norm = np.einsum("ij,ij->i", vectors, vectors)
    rest = -norm / (math.sqrt(top) + np.sqrt(np.maximum(top - norm, 0)))
    return np.concatenate([vectors, rest[:, None]], 1).astype(np.float32)


def _index_schema() -> pa.Schema:
    return pa.schema([("shard", pa.int32()), ("vectors", pa.binary()), ("graph", pa.binary()), ("starts", pa.list_(pa.int32())), ("ids", pa.binary()), ("at", pa.binary())])
