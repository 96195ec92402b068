"""Best-fit packing of documents into sequences under several capacities at once.

Every document becomes its token ids and an end id. One longer than a sequence is cut into whole sequences, the rest going
into its first piece. Pieces that fill a sequence stand alone. The others are dealt evenly into groups of about
`group_rows` and packed group by group, longest first: a piece goes to the open sequence that has room left under
every capacity (tokens, documents, attention cost as the sum of squared lengths) and is best by the chosen score, the
smallest weighted norm of what is left or the largest weighted dot-product of demand and room; it opens a new one only
if none has room. A group is bounded and does not depend on ids or sources, so no key can make it large; each one
ends with a few unfilled sequences, under 1 in 1,000 of those it makes at the default size.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowtide.llm import pretokens as R, texts as X
from rowtide.llm.tokencounts import SPECIAL
from rowtide.session import stored

GROUP_ROWS = 16_384


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence; documents and cost default to what the tokens alone allow."""

    tokens: int = 2048
    documents: int | None = None
    cost: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    score: str = "norm"

    def full(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.cost or self.tokens**2], np.float64)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of `size` but the first, which takes the rest."""
    rest = n % size or min(n, size)
    return [(0, rest), *((s, size) for s in range(rest, n, size))] if n else []


def fit(lengths: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of every piece, by best fit in order of falling length."""
    full = limits.full()
    weights = np.asarray(limits.weights)
    if limits.score not in ("norm", "dot"):
        raise ValueError(f"unknown score {limits.score}")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room = np.empty((3, 64))  # of the open sequences
    number = np.empty(64, np.int64)
    n_open = made = 0
    order = np.argsort(-lengths, kind="stable")
    least = lengths[order[-1]] if len(order) else 0
    scale = weights / full**2
    for i in order:
        size = float(lengths[i])
        need = np.array([size, 1.0, size * size])
        if np.any(need > full):
            raise ValueError(f"a piece of {int(size)} tokens exceeds the capacities {full.tolist()}")
        at = -1
        if n_open:
            r = room[:, :n_open]
            can = np.flatnonzero((r[0] >= size) & (r[1] >= 1) & (r[2] >= need[2]))
            if len(can):
                if limits.score == "norm":
                    left = r[:, can] - need[:, None]
                    at = int(can[np.argmin(scale @ (left * left))])
                else:
                    at = int(can[np.argmax((scale * need) @ r[:, can])])
        if at < 0:
            if n_open == room.shape[1]:
                room, number = np.concatenate([room, np.empty_like(room)], 1), np.concatenate([number, np.empty_like(number)])
            at, n_open = n_open, n_open + 1
            room[:, at], number[at] = full, made
            made += 1
        bins[i], offsets[i] = number[at], limits.tokens - room[0, at]
        room[:, at] -= need
        if room[0, at] < least or room[1, at] < 1 or room[2, at] < least * least:  # no piece fits any more
            n_open -= 1
            room[:, at], number[at] = room[:, n_open], number[n_open]
    return bins, offsets


def _pieces(ranks: str, special: tuple[str, ...], text: str, back: list[str], size: int, end: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in X.blocks(batches, text):
            dictionary, codes, first = R.distinct(block.column(text), special)
            ids, at = R.repeat(codes, R.encode(dictionary.to_pylist(), ranks, special))
            bound, out = at[first], []
            for d in range(block.num_rows):
                own = np.append(ids[bound[d] : bound[d + 1]], np.uint32(end)).astype("<u4")
                out += [(d, p, s, n, zlib.crc32(own[s : s + n].tobytes())) for p, (s, n) in enumerate(cut(len(own), size))]
            of, piece, start, length, crc = (np.array(x, np.int64) for x in zip(*out))
            rows = [block.column(c).take(pa.array(of)) for c in back]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], [*back, "piece", "start", "length", "ids_crc32"])

    return scan


def pack(
    docs: DataFrame, ranks: str, id: str = "doc_id", text: str = "text", keep: Sequence[str] = (), limits: Limits = Limits(),
    end: int = 0, special: tuple[str, ...] = SPECIAL, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Per piece: id, kept columns, piece, start, length, ids_crc32, sequence_id and its offset there.

    A null or empty text is the end id alone. Every piece has a token or more, each offset is the sum of the lengths before
    it in the sequence. Repeated rows are packed each for itself. A piece that exceeds a capacity by itself is an error,
    never dropped. An empty table gives no piece. Other columns are not looked at.
    """
    base, back = X.kept(docs, id, text, keep)
    added = [("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint")]
    pieces = stored(base.mapInArrow(_pieces(ranks, special, text, back, limits.tokens, end), X.struct(base, back, added)), "pieces")
    number = F.monotonically_increasing_id()  # of a stored table, so a task run again gives the same
    whole = pieces.where(F.col("length") == limits.tokens)
    part = pieces.where(F.col("length") < limits.tokens)
    groups = max(1, math.ceil(part.count() / group_rows))
    schema = X.struct(pieces, pieces.columns, [("sequence_id", "bigint"), ("offset", "bigint")])

    def place(key: tuple, table: pa.Table) -> pa.Table:
        bins, offsets = fit(table["length"].to_numpy(), limits)
        out = table.drop_columns(["_group"])
        return out.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets))

    dealt = part.withColumn("_group", F.pmod(F.xxhash64(number), F.lit(groups)))
    packed = dealt.groupBy("_group").applyInArrow(place, schema)
    alone = whole.withColumns({"sequence_id": -1 - number, "offset": F.lit(0).cast("bigint")})
    return packed.unionByName(alone)
