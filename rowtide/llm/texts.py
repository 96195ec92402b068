"""Texts of an Arrow batch as one byte buffer, and their words without a Python object per word.

Tasks work through blocks of a few megabytes, so memory does not follow the size of a partition or of an
Arrow batch. A block always holds whole texts; one longer than the limit is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

BLOCK_BYTES = 4 << 20

_BYTES = np.arange(256, dtype=np.uint8)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
#: Bytes of words after lower-casing A-Z: digits, a-z and everything beyond ASCII.
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
#: Everything but ASCII white space.
SOLID = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))


def blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in slices of up to `limit` bytes of `column`, never less than one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one buffer and the n + 1 places where texts begin and end in it; null is empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def looked_up(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """table[data] for a table of 256 single bytes or booleans; not to be written to."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), table.dtype)


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the runs of `inside` bytes, none across two texts, and the run number at each text's start."""
    return _runs(looked_up(inside, data), offsets)


def _runs(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    before = np.empty_like(solid)
    before[1:], before[:1] = solid[:-1], False
    edge = offsets[:-1][offsets[:-1] < len(solid)]
    before[edge] = False
    start = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[:-1], after[-1:] = solid[1:], False
    after[edge[edge > 0] - 1] = False
    return start, np.flatnonzero(solid & ~after) + 1, np.searchsorted(start, offsets)


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(words as binary, byte starts, byte ends, word number at each text's start); A-Z lower-cased."""
    low = looked_up(LOWER, data)
    solid = looked_up(inside, low)
    start, end, first = _runs(solid, offsets)
    ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    packed = low[solid]
    array = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(packed))])
    return array, start, end, first


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column of which row i takes the next counts[i] values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def struct(docs: DataFrame, columns: Sequence[str], added: Sequence[tuple[str, str]]) -> T.StructType:
    """Schema of `columns` of `docs` and the `added` ones; a clash of names is an error."""
    if twice := {c.lower() for c in columns} & {n.lower() for n, _ in added}:
        raise ValueError(f"kept columns {sorted(twice)} have the names of results; rename them")
    kept = [f for f in docs.select(*columns).schema.fields]
    return T.StructType(kept + [T.StructField(n, T._parse_datatype_string(t)) for n, t in added])


def kept(docs: DataFrame, id: str, text: str, keep: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """`docs` with the id, the kept columns and the text only; and what is returned of them."""
    back = list(dict.fromkeys([id, *keep]))
    return docs.select(*dict.fromkeys([*back, text])), back
