"""Collocations, source divergence and repeated strings against brute force, through the operators and the registered queries."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import tracemalloc
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest

from rowtide.llm import collocations, divergence, registry, suffixdedup
from rowtide.session import fresh_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, source string, n bigint, rank int, part string, score double, t binary, spans string"
CLASH = (7, 8, "x", 0.5, b"t", "s")  # columns with the names of results and of inner columns
VOCABULARY = "the The of cat sat mat zebra été straße 日本 a-b x1 on it".split()


def some_docs(n=220, seed=4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = rng.choices(VOCABULARY, weights=range(len(VOCABULARY), 0, -1), k=rng.randint(0, 60))
        text = "".join(w + rng.choice([" ", " ", " ", "\t", ", ", ". ", "\n", "\x0b"]) for w in words)
        out.append([i, text, rng.choice(["en", "en", "fr", None]), rng.choice(["a", "b", "c", "é", None])])
    out += [[900, None, "en", "a"], [901, "", "xx", "only"], [901, "", "xx", "other"], [902, None, None, None], [903, "...;!", "en", "b"], out[0], out[0]]
    out.append([904, " ".join(rng.choices(VOCABULARY, k=30_000)), "de", "long"])
    return [(*row, *CLASH) for row in out]


@pytest.fixture(scope="module")
def rows():
    return some_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# collocations --------------------------------------------------------------------------------------------------


def phrases(rows, longest):
    counts, totals = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang or "und", tuple(words[i : i + k])] += 1
    return counts, totals


def mined(rows, longest=3, least=10, share=50, top=2000):
    counts, totals = phrases(rows, longest)
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    kept = collections.defaultdict(list)
    for (lang, p), a in candidates.items():
        longer = max((b for (other, q), b in candidates.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))), default=0)
        if 100 * longer < share * a or not longer:
            score, _, l, r = min((10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
            kept[lang].append((-score, -a, " ".join(p).encode(), l, r))
    out = set()
    for lang, found in kept.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return out


@pytest.mark.parametrize("longest, least, top, bucket_bytes, bucket_rows", [(3, 10, 2000, 6 << 20, 1 << 21), (3, 4, 7, 3000, 50), (4, 3, 2000, 20_000, 8)])
def test_collocations_equal_brute_force(docs, rows, longest, least, top, bucket_bytes, bucket_rows):
    """Also with many small buckets, and with every bucket dealt to parts."""
    found = collocations.mine(docs, longest=longest, least=least, top=top, bucket_bytes=bucket_bytes, bucket_rows=bucket_rows)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == mined(rows, longest, least, top=top)


def test_a_full_bitmap_changes_nothing(docs, rows, monkeypatch):
    monkeypatch.setattr(collocations, "_bitmap", lambda words: np.full(8, 255, np.uint8))
    assert {tuple(r) for r in collocations.mine(docs).collect()} == mined(rows)


def test_multikey_quicksort_counts_prefixes():
    rng = np.random.default_rng(1)
    for least, n in ((1, 0), (1, 1), (1, 300), (2, 300), (5, 400)):
        keys, weight = rng.integers(0, 6, (n, 3)), rng.integers(1, 3, n)
        for row in keys:
            row[np.cumsum(row == 0) > 0] = 0
        want = collections.Counter()
        for row, w in zip(keys.tolist(), weight.tolist()):
            for d in (1, 2, 3):
                if row[d - 1]:
                    want[tuple(row[:d])] += w
                else:
                    break
        pointer, depth, size = collocations.multikey_quicksort(keys, weight, least)
        got = {tuple(keys[p, :d].tolist()): s for p, d, s in zip(pointer, depth, size)}
        assert len(got) == len(pointer) and got == {k: v for k, v in want.items() if v >= least}


def test_scores_pass_64_bits(spark, monkeypatch):
    """Counts of 10^12 give products of 10^30; equal scores rank by count, then by bytes."""
    big = 10**12
    rows = [("en", 0, "", 5 * big), ("en", 1, "x", big + 1), ("en", 1, "y", big + 7), ("en", 2, "x y", big - 1), ("en", 1, "Ω", big), ("en", 2, "Ω Ω", big), ("en", 1, "a", 1), ("en", 2, "a a", 1)]
    monkeypatch.setattr(collocations, "frequent", lambda *_: spark.createDataFrame(rows, collocations._PHRASES))
    got = [tuple(r) for r in collocations.mine(spark.createDataFrame([], DOCS)).orderBy("rank").collect()]
    assert got == [
        ("en", 1, "Ω Ω", big, big, big, 5 * big, 10**6), ("en", 2, "a a", 1, 1, 1, 5 * big, 10**6),
        ("en", 3, "x y", big - 1, big + 1, big + 7, 5 * big, 10**6 * (big - 1) ** 2 // ((big + 1) * (big + 7))),
    ]


# source divergence ---------------------------------------------------------------------------------------------


def audited(rows, min_docs=10, top=10):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, seen, groups = collections.Counter(), collections.Counter(), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = [w.translate(LOWER) for w in term.findall(text or "")]
        for w in words:
            counts[lang, source, w] += 1
        for w in set(words):
            seen[lang, w] += 1
    out = set()
    for lang in {g[0] for g in groups}:
        kept, own = [w for (l, w), n in seen.items() if l == lang and n >= min_docs], sorted(s for l, s in groups if l == lang)
        p = lambda count, every: {w: 1 + 10**9 * (count[w] + 2) // (sum(count.values()) + 2 * len(kept)) for w in every}
        ps = {s: p({w: counts[lang, s, w] for w in kept}, kept) for s in own}
        q = p({w: sum(counts[lang, s, w] for s in own) for w in kept}, kept)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = sorted((-sum(f(ps[s][w], ps[o][w]) for w in kept), o.encode()) for o in own if o != s)
            words = sorted((-f(ps[s][w], q[w]), w.encode()) for w in kept if counts[lang, s, w] and ps[s][w] > q[w])[:top]
            out |= {(lang, s, part, item.decode(), -v, k) for part, found in (("pair", pairs), ("term", words)) for k, (v, item) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("min_docs, top, width, tile", [(10, 10, 4096, 128), (1, 3, 3, 2), (3, 10, 5, 1), (10**6, 10, 4096, 128)])
def test_divergence_equals_brute_force(docs, rows, min_docs, top, width, tile):
    """Also with stripes of a few terms, tiles of one or two groups, and without a kept term."""
    found = divergence.audit(docs, min_docs=min_docs, top=top, width=width, tile=tile)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == audited(rows, min_docs, top)


def test_divergence_counts_a_large_batch_in_little_memory():
    """Python workers share an executor with the JVM, so an Arrow batch of 10,000 texts is worked through in small blocks."""
    rng = np.random.default_rng(3)
    vocabulary = np.array(["".join(chr(97 + int(d)) for d in str(n)) for n in range(50_000)])
    texts = [" ".join(vocabulary[rng.integers(0, len(vocabulary), 350)]) for _ in range(9000)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * len(texts), "source": ["a", "b"] * (len(texts) // 2), "text": texts})
    assert batch.column("text").nbytes > 16 << 20
    tracemalloc.start()
    places = docs = 0
    for found in divergence._counts(iter([batch])):
        places, docs = places + int(found.column("n").to_numpy().sum()), docs + int(found.column("docs").to_numpy().sum())
        del found
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (places, docs) == (350 * len(texts), sum(len(set(t.split())) for t in texts))
    assert peak < 120 << 20


def test_k2_tree_walks_every_pair():
    rng = np.random.default_rng(2)
    for rows, columns, share in ((1, 1, 1.0), (5, 9, 0.3), (8, 8, 0.0), (3, 40, 0.05), (20, 16, 0.9)):
        matrix = rng.random((rows, columns)) < share
        r, c = np.nonzero(matrix)
        order = rng.permutation(len(r))
        tree = divergence.K2Tree(r[order], c[order], max(1, int(max(rows, columns, 2) - 1).bit_length()))
        a, b = np.triu_indices(rows, 1)
        pair, left, right, empty = tree.descend(a, b, columns)
        own = order[tree.order]
        for k, (x, y) in enumerate(zip(a, b)):
            assert empty[k] == (~matrix[x] & ~matrix[y]).sum()
            for leaf, row in ((left, x), (right, y)):
                at = leaf[(pair == k) & (leaf >= 0)]
                assert sorted(c[own[at]]) == np.flatnonzero(matrix[row]).tolist() and (r[own[at]] == row).all()
            assert (pair == k).sum() == (matrix[x] | matrix[y]).sum()


def test_probabilities_are_exact():
    rng = random.Random(6)
    for _ in range(500):
        total, terms = rng.randint(0, 10**rng.randint(1, 17)), rng.randint(1, 10**6)
        count = rng.randint(0, total)
        assert divergence.probability(np.array([count]), np.array([total]), terms)[0] == 1 + 10**9 * (count + 2) // (total + 2 * terms)


# repeated strings ----------------------------------------------------------------------------------------------


def deduplicated(texts, window):
    own = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + window] for b in own for i in range(len(b) - window + 1))
    out = []
    for b in own:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for x, y in pairwise([0, *gone]) if y and not x)
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def repeating_texts(seed, alphabet, n=60):
    rng = random.Random(seed)
    make = lambda k: "".join(rng.choices(alphabet, k=k))
    shared = [make(rng.randint(5, 90)) for _ in range(4)]
    out = [make(rng.randint(0, 60)) + "".join(rng.choice(shared) + make(rng.randint(0, 20)) for _ in range(rng.randint(0, 3))) for _ in range(n)]
    return [*out, None, "", out[3], out[3], out[4] + "x", "é" * 70, "é" * 9, "ab" * 60, "z" * 200, "x" + shared[0], shared[0]]


@pytest.mark.parametrize("window, gram, group_rows, alphabet", [(8, 3, 2048, "abcdefé"), (12, 5, 2, "ab"), (20, 8, 1, "abcdefgh日"), (9, 9, 3, "abc"), (7, 1, 1, "abcde")])
def test_repeated_strings_equal_brute_force(spark, window, gram, group_rows, alphabet):
    """Shared passages, copies, periodic texts; groups that must be halved down to single strings."""
    texts = repeating_texts(window, alphabet)
    df = spark.createDataFrame([(i, t, "en", "s", *CLASH) for i, t in enumerate(texts)], DOCS).repartition(4)
    found = suffixdedup.deduplicate(df, window=window, gram=gram, group_rows=group_rows).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found}
    assert len(found) == len(texts) and [got[i] for i in range(len(texts))] == deduplicated(texts, window)
    for r in found:
        data = (texts[r["doc_id"]] or "").encode()
        for s in reversed(r["removed"]):
            data = data[: s["first_byte"]] + data[s["last_byte"] + 1 :]
        assert hashlib.sha256(data).hexdigest() == r["kept_sha256"]


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "_PIECE", 37)
    data = np.random.default_rng(3).integers(97, 100, 700).astype(np.uint8)
    data[400:520] = data[100:220]
    grams, whole, parts = suffixdedup.Grams(1000), [], []
    offsets = np.array([0, 150, 700])
    suffix = lambda out, text, shift, run, own: out.extend((int(text + d), int(f - own[d] + shift + k), int(v)) for d, f, n, _, v in zip(*run) for k in range(n))
    suffix(whole, 0, 0, suffixdedup.anchors(data, offsets, grams, 30, 10), offsets)
    for text, shift, piece, own in suffixdedup._pieces(data, offsets, 30):
        suffix(parts, text, shift, suffixdedup.anchors(piece, own, grams, 30, 10), own)
    assert sorted(whole) == sorted(parts) and len(whole) == (150 - 29) + (550 - 29)


def test_the_transform_is_that_of_the_collection():
    """After each round: suffixes in order, what stands before them, and their common prefixes."""
    rng = random.Random(8)
    for _ in range(30):
        m = rng.randint(1, 12)
        texts, column = [bytes(rng.choices(b"abc", k=rng.randint(1, 12))) for _ in range(m)], np.array([rng.randint(0, 4) for _ in range(m)])
        group = np.sort(np.array([rng.randint(0, 2) for _ in range(m)]))
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        transform = suffixdedup.Transform(data, offsets, column, group)
        while transform.at > column.min():
            k = transform.round()
            want = sorted((group[i], texts[i][k - column[i] :], i) for i in range(m) if column[i] <= k < column[i] + len(texts[i]))
            got = [(group[i], texts[i][k - column[i] :]) for i in transform.rows.tolist()]
            assert got == [x[:2] for x in want]
            for above, below, common in zip(got, got[1:], transform.common[1:].tolist()):
                same = 0
                while above[0] == below[0] and same < min(len(above[1]), len(below[1])) and above[1][same] == below[1][same]:
                    same += 1
                assert common == same


def test_strings_marked_in_a_block():
    texts = pa.array([b"abcdef", b"xbcdey", b"abcdef"], pa.binary())
    marks = suffixdedup.repeated(texts, np.array([0, 0, 0]), np.array([3, 3, 3]), np.array([0, 0, 1]), np.array([1, 1, 2]), 4)
    assert marks.tolist() == [[False, True, False], [False, True, False], [True, True, True]]


# all three -----------------------------------------------------------------------------------------------------


def test_empty_tables(empty):
    assert collocations.mine(empty).count() == divergence.audit(empty).count() == suffixdedup.deduplicate(empty).count() == 0


def test_kept_columns(docs):
    found = suffixdedup.deduplicate(docs, keep=["lang", "t", "spans"])
    assert found.columns == ["doc_id", "lang", "t", "spans", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
    assert found.select("t", "spans").distinct().collect() == [(b"t", "s")]
    with pytest.raises(ValueError):
        suffixdedup.deduplicate(docs.withColumnRenamed("n", "n_bytes"), keep=["n_bytes"])


def test_queries_equal_brute_force(spark, rows, docs):
    folder = fresh_path(spark, "fixture")
    docs.write.parquet(f"{folder}/documents.parquet")
    run = lambda name: registry.QUERIES[name](spark, folder)
    assert {tuple(r) for r in run("op11_collocations").collect()} == mined(rows)
    assert {tuple(r) for r in run("op12_source_divergence").collect()} == audited(rows)
    found = run("op13_suffix_dedup")
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = sorted(zip([r[0] for r in rows], *zip(*deduplicated([r[1] for r in rows], 400))))
    assert sorted(tuple(r) for r in found.collect()) == want
