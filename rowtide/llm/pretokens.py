"""Byte-level BPE over the distinct pre-tokens of a block.

Pre-tokens follow the pattern published with the vocabulary: contractions, then runs of letters, of numbers and of other
characters, each with one space before it if there is one, then white space. The cut is made on arrays of character
classes, all texts of a block at a time. Special strings inside a text are tokens of their own, as the library
reads them by default.
"""

from __future__ import annotations

import base64
import functools
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from tokenizers.pre_tokenizers import ByteLevel

from rowtide.llm import texts as X

_OTHER, _LETTER, _NUMBER, _SPACE, _SPECIAL = range(5)
#: The characters that the pattern's \s matches, and its contractions.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other.

    Python's tables and those of `regex` are of different Unicode versions; where they differ, on points that one of them
    does not know, the tokenizer library is asked.
    """
    n = sys.maxunicode + 1
    kinds = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(n)), np.uint8, n)
    newer, every = np.full(n, _OTHER, np.uint8), "".join(map(chr, range(n)))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            newer[m.start() : m.end()] = kind
    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    for c in np.flatnonzero(out != newer).tolist():
        out[c] = next((k for k, like in ((_LETTER, "a"), (_NUMBER, "1")) if len(split(like + chr(c))) == 1), _OTHER)
    out[_WHITE] = _SPACE
    return out


@functools.cache
def encoding(path: str, special: tuple[str, ...]) -> tiktoken.Encoding:
    """The vocabulary of a rank file; special strings take the ids after the last rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={s: len(ranks) + i for i, s in enumerate(special)})


def _places(data: np.ndarray, offsets: np.ndarray, special: tuple[str, ...]) -> list[tuple[int, int]]:
    """Byte places and sizes of special strings, none across two texts."""
    raw, out = data.tobytes(), []
    for s in special:
        key, at = s.encode(), -1
        while (at := raw.find(key, at + 1)) >= 0:
            if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + len(key) - 1, "right"):
                out.append((at, len(key)))
    return sorted(out)


def cut(column: pa.Array, special: tuple[str, ...] = ()) -> tuple[pa.Array, np.ndarray]:
    """(all pre-tokens as binary in text order, number of the first of each text, with the total last)."""
    data, offsets = X.utf8(column)
    if not len(data):
        return pa.array([], pa.binary()), np.zeros(len(offsets), np.int64)
    place = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    first, n = np.searchsorted(place, offsets), len(place)
    kind = classes()[points]
    start = np.zeros(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    stop = np.zeros(n, bool)  # characters that nothing is seen beyond
    start[first[:-1][first[:-1] < n]] = True
    stop[first[1:][first[1:] > 0] - 1] = True
    if found := _places(data, offsets, special):
        kind = kind.copy()
        for at, size in found:
            a, b = np.searchsorted(place, [at, at + size])
            kind[a:b] = _SPECIAL
            start[a:b], start[a] = False, True
            if b < n:
                start[b] = True
            if a:
                stop[a - 1] = True
            stop[b - 1] = True
    # the last white space before another character is a token of its own; a plain space joins what follows
    space = kind == _SPACE
    last = space & ~stop
    last[:-1] &= ~space[1:]
    start |= last
    start[1:] &= ~(last & (points == 0x20))[:-1]
    # contractions open a run of other characters that no space joins
    quote = np.flatnonzero((points == 0x27) & start & ~stop)
    ends = np.flatnonzero(stop)
    room = ends[np.searchsorted(ends, quote)] + 1 - quote
    for s in _CONTRACTIONS:
        here = room >= len(s)
        for i, c in enumerate(s[1:], 1):
            here[here] = points[quote[here] + i] == ord(c)
        at = quote[here]
        start[at + 1] = False
        after = at + len(s)
        after = after[after < n]
        start[after[kind[after] == _LETTER]] = True
        quote, room = quote[~here], room[~here]
    begin = np.flatnonzero(start)
    bounds = np.append(place[begin], len(data)).astype(np.int32)
    tokens = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    return tokens, np.searchsorted(begin, first)


def distinct(column: pa.Array, special: tuple[str, ...]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct pre-tokens, the number of each pre-token in text order, place of the first of each text)."""
    tokens, first = cut(column, special)
    coded = tokens.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), first


def encode(pieces: list[bytes], path: str, special: tuple[str, ...]) -> list[list[int]]:
    """Ids of each pre-token."""
    e = encoding(path, special)
    ids = {s.encode(): [e._special_tokens[s]] for s in special}
    one = e._core_bpe.encode_single_piece
    return [ids.get(p) or one(p) for p in pieces]


def repeat(codes: np.ndarray, pieces: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pre-tokens in text order, place of the first id of each and of the end)."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    flat = np.fromiter((i for p in pieces for i in p), np.uint32, int(sizes.sum()))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    each = sizes[codes]
    at = np.concatenate([[0], np.cumsum(each)])
    return flat[np.repeat(begin[codes] - at[:-1], each) + np.arange(at[-1])], at
