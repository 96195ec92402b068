"""Every operator against a brute-force version, with nulls, empty, long and repeated texts, clashing columns and empty tables."""

from __future__ import annotations

import collections
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowtide.llm import components, decontamination, html, languages, licenses, logbilinear, neighbours, packing, pretokens, simhash, texts, tokencounts, toxicity
from rowtide.llm.registry import RANKS

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, extra string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def solid(text):
    return (text or "").encode().translate(bytes(texts.LOWER.tolist())).split()


def some_texts(n=60, seed=3):
    rng = random.Random(seed)
    vocabulary = ["the", "Of", "straße", "señor", "été", "x1", "42", "don't", "a-b", "ÀB", "zebra", "Cat", "sat", "mat", "on", "日本", "é"]
    out = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 80))) for _ in range(n)]
    return [*out, None, "", " \n\t ", "...", out[0], out[0], out[1].upper(), " ".join(rng.choices(vocabulary, k=30_000)), "\x00nul\x1c sep", "tail <|endoftext|> 's", "  lead"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "e") for i, t in enumerate(some_texts())], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# words ---------------------------------------------------------------------------------------------------------


def test_words_are_those_of_the_pattern():
    own = some_texts()
    data, offsets = texts.utf8(pa.array(own, pa.string()).slice(2, 40))
    found, start, end, first = texts.words(data, offsets, texts.ALNUM)
    for i, t in enumerate(own[2:42]):
        assert [w.decode() for w in found.slice(first[i], first[i + 1] - first[i]).to_pylist()] == words(t)
    data, offsets = texts.utf8(pa.array(own, pa.string()))
    found, start, end, first = texts.words(data, offsets, texts.SOLID)
    assert [found.slice(a, b - a).to_pylist() for a, b in zip(first[:-1], first[1:])] == [solid(t) for t in own]
    assert all(bytes(data[a:b]).lower() == w.as_py().lower() for a, b, w in zip(start, end, found))


def test_kept_columns_must_not_clash(docs):
    with pytest.raises(ValueError, match="n_words"):
        decontamination.decontaminate(docs.withColumn("n_words", F.lit(1)), docs, item="doc_id", keep=["n_words"])
    out = tokencounts.count_tokens(docs.withColumn("n_tokens", F.lit("clash")), RANKS).where("doc_id = 0").first()  # not kept, not looked at
    assert isinstance(out["n_tokens"], int)


# 1 -------------------------------------------------------------------------------------------------------------


def windows(items):
    out = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            out[tuple(w[k : k + 10])].add("" if i is None else str(i))
    return out


@pytest.mark.parametrize("block", [1 << 20, 60_000])
def test_decontamination(spark, docs, block):
    own = some_texts()
    items = [(7, " ".join(words(own[3])[4:20])), (7, "zebra cat"), (8, own[67]), (9, None), (10, ""), (None, "SAT mat"), (11, "on on on"), (12, " ".join(words(own[5])[:10])), (13, "absent words here")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["doc_id"]: r for r in decontamination.decontaminate(docs, benchmark, block_bytes=block, keep=["text"]).collect()}
    win = windows(items)
    for d, t in enumerate(own):
        w, hit, found = words(t), set(), set()
        for size in {len(p) for p in win}:
            for k in range(len(w) - size + 1):
                if ids := win.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= ids
        r = got[d]
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(found)), d
        covered = {i for s in r["spans"] for i in range(s["first_word"], s["last_word"] + 1)}
        assert covered == hit
        if t is not None:
            assert len(words(decontamination.without_spans(t, r["spans"]))) == len(w) - len(hit)


def test_decontamination_of_empty_tables(spark, docs, empty):
    assert decontamination.decontaminate(empty, docs, item="doc_id").count() == 0
    assert {r["n_hit"] for r in decontamination.decontaminate(docs, empty, item="doc_id").collect()} == {0}


def test_index_finds_every_place():
    rng = np.random.default_rng(2)
    symbols = np.concatenate([np.append(rng.integers(1, 4, rng.integers(1, 30)), 0) for _ in range(40)])
    index = decontamination.FmIndex(symbols, 3)
    for size in (1, 2, 5):
        table = np.unique(rng.integers(1, 4, (30, size)), axis=0)
        which, lo, hi = index.search(table, np.full(len(table), size))
        got = {i: sorted(index.locate(np.arange(a, b)).tolist()) for i, a, b in zip(which.tolist(), lo, hi)}
        for i, p in enumerate(table):
            places = [k for k in range(len(symbols) - size + 1) if np.array_equal(symbols[k : k + size], p)]
            assert got.get(i, []) == places


# 2 -------------------------------------------------------------------------------------------------------------


def test_license_rules(spark, empty):
    rows = [
        (0, "Licensed under the Apache License, Version 2.0. More"), (1, "under the MIT License under the mit LICENSE"), (2, "Mit der Bahn"), (3, None),
        (4, "This work is licensed under the GNU General Public License, version 3."), (5, "Licensed under CC BY-NC 4.0."), (6, "SPDX-License-Identifier: BSD-3-Clause"),
        (7, "All rights reserved."), (8, "word " * 20_000 + "under the MIT license"), (9, "released under the CC-BY-NC-SA 4.0 license"),
    ]
    got = {r["doc_id"]: r for r in licenses.detect(spark.createDataFrame([(*r, "") for r in rows], DOCS)).collect()}
    labels = {d: {m["label"] for m in r["licenses"]} for d, r in got.items()}
    assert labels == {0: {"apache-2"}, 1: {"mit"}, 2: set(), 3: set(), 4: {"gpl-3"}, 5: {"cc-by-nc"}, 6: {"bsd-3-clause"}, 7: {"all-rights-reserved"}, 8: {"mit"}, 9: {"cc-by-nc", "cc-by-nc-sa"}}
    for d, t in rows:
        own = words(t)
        places = sorted((i, label) for p, label in licenses.PHRASES for i in range(len(own)) if own[i : i + len(p.split())] == p.split())
        assert sorted((m["first_word"], m["label"]) for m in got[d]["matches"] if m["rule"].startswith("phrase ")) == places
    assert licenses.detect(empty).count() == 0
    assert len(licenses.rules()) > 300


def test_suppression_keeps_the_stronger():
    by = {r.name: i for i, r in enumerate(licenses.rules())}
    weak, strong = by["name mit mit"], by["phrase under the mit license"]
    assert licenses.kept([(weak, 2, 3), (strong, 0, 3), (weak, 8, 9), (weak, 3, 4)]) == [(strong, 0, 3), (weak, 3, 4), (weak, 8, 9)]


def texts_of(tree, rng):
    """A text that a parsed pattern matches, its choices drawn."""
    out = ""
    for op, arg in tree:
        match str(op):
            case "LITERAL":
                out += chr(arg)
            case "IN":
                kind, value = rng.choice(arg)
                out += chr(value) if str(kind) == "LITERAL" else "7" if "DIGIT" in str(value) else "z"
            case "BRANCH":
                out += texts_of(rng.choice(arg[1]), rng)
            case "SUBPATTERN":
                out += texts_of(arg[3], rng)
            case "MAX_REPEAT":
                out += "".join(texts_of(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 1))))
            case other:
                assert other == "ASSERT_NOT"
    return out


def test_every_pattern_opens_its_own_gate():
    rng, by = random.Random(1), collections.defaultdict(list)
    for r in licenses.rules():
        by[r.label, r.pattern].append(set(r.keywords))
    for (label, pattern), gates in by.items():
        tree, whole = re._parser.parse(pattern), re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])")
        for _ in range(60):
            if found := whole.search(texts_of(tree, rng).strip()):
                assert any(g <= set(found[0].split()) for g in gates), (label, found[0])


def test_tags_and_joined_spellings_are_found(spark):
    want = {
        "MPL-1.0": "mpl-1.0", "MPL-1.1": "mpl-1.1", "MPL-2.0": "mpl-2", "EPL-1.0": "epl-1.0", "EPL-2.0": "epl-2.0", "EDL-1.0": "edl-1.0", "BSL-1.0": "bsl-1.0",
        "BUSL-1.1": "busl-1.1", "MS-PL": "ms-pl", "MS-RL": "ms-rl", "MulanPSL-2.0": "mulanpsl-2.0",
    }
    rows = [(f"SPDX-License-Identifier: {tag}", label) for tag, label in want.items()]
    rows += [("license: GPL2", "gpl-2"), ("GPL3 license", "gpl-3"), ("released under GPLv1", "gpl-1"), ("LGPL3 licence", "lgpl-3"), ("licensed under the AGPL3", "agpl-3"), ("EUPLv1.2 licence", "eupl-1.2"), ("license CeCILL2.1", "cecill-2.1")]
    got = {r["doc_id"]: {m["label"] for m in r["licenses"]} for r in licenses.detect(spark.createDataFrame([(i, t, "") for i, (t, _) in enumerate(rows)], DOCS)).collect()}
    for i, (t, label) in enumerate(rows):
        assert label in got[i], t


# 3 and 5 -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_pretokens_give_the_librarys_ids(library):
    rng = random.Random(5)
    parts = [*"ab1 \n\t'stremvld!.é　\x1c\x85", "<|endoftext|>", "'s", "'ll", "  ", "日本", "½", "𝒜", "\U0001f600"]
    own = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(20_000)] + [None]
    dictionary, codes, first = pretokens.distinct(pa.array(own, pa.string()), tokencounts.SPECIAL)
    ids, at = pretokens.repeat(codes, pretokens.encode(dictionary.to_pylist(), RANKS, tokencounts.SPECIAL))
    for i, e in enumerate(library.encode_batch([t or "" for t in own], add_special_tokens=False)):
        assert ids[at[first[i]] : at[first[i + 1]]].tolist() == e.ids, own[i]


def test_character_classes_are_the_librarys(library):
    split = library.pre_tokenizer.pre_tokenize_str
    rng, kinds = random.Random(1), pretokens.classes()
    for c in [*range(0x3000), *rng.sample(range(0xE000, 0x110000), 20_000)]:
        like = {pretokens._LETTER: "a", pretokens._NUMBER: "1", pretokens._OTHER: "!"}.get(kinds[c])
        for other in "a1!":
            assert (len(split(other + chr(c))) == 1) == (other == like), hex(c)


@pytest.mark.parametrize("hot", [tokencounts.HOT, 4])
def test_token_counts(spark, docs, empty, library, hot):
    twice = docs.unionByName(docs.where("doc_id < 5"))
    got = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in tokencounts.count_tokens(twice, RANKS, hot=hot).collect())
    own = [t or "" for t in some_texts()]
    each = [(i, len(t.encode()), len(e.ids)) for (i, t), e in zip(enumerate(own), library.encode_batch(own, add_special_tokens=False))]
    assert got == sorted(each + each[:5])
    assert tokencounts.count_tokens(empty, RANKS).count() == 0


def test_packing(spark, docs, empty, library):
    limits = packing.Limits(tokens=64, documents=5, cost=2500)
    got = packing.pack(docs.where("doc_id <> 67"), RANKS, limits=packing.Limits(tokens=64)).collect()
    bound = packing.pack(docs.where("length(text) < 60"), RANKS, limits=limits, group_rows=20).collect()
    own = some_texts()
    for rows, size in ((got, 64), (bound, 64)):
        sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
        for r in rows:
            ids = np.array(library.encode(own[r["doc_id"]] or "", add_special_tokens=False).ids + [0], "<u4")
            assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
            pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], len(ids)))
        for s in sequences.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length
            assert at <= size
            if rows is bound:
                assert len(s) <= 5 and sum(n * n for _, n in s) <= 2500
        for p in pieces.values():
            assert [(s, n) for _, s, n, _ in sorted(p)] == packing.cut(p[0][3], size)
    assert len({r["sequence_id"] for r in got}) <= 1.05 * sum(r["length"] for r in got) / 64 + 1
    assert packing.pack(empty, RANKS).count() == 0
    with pytest.raises(ValueError, match="exceeds"):
        packing.fit(np.array([60]), limits)


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_best_fit_is_that_of_the_plain_loop(score):
    rng, limits = np.random.default_rng(4), packing.Limits(tokens=100, documents=4, cost=6000, score=score)
    lengths = rng.integers(1, 70, 300)
    bins, offsets = packing.fit(lengths, limits)
    for b in set(bins.tolist()):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 4 and (own.astype(float) ** 2).sum() <= 6000
    room, at = [], {}
    full, w = limits.full(), np.array(limits.weights)
    for i in np.argsort(-lengths, kind="stable"):
        need = np.array([lengths[i], 1, float(lengths[i]) ** 2])
        can = [b for b in range(len(room)) if (room[b] >= need).all()]
        if not can:
            room.append(full.copy())
            can = [len(room) - 1]
        value = (lambda b: w / full**2 @ (room[b] - need) ** 2) if score == "norm" else (lambda b: -(w / full**2 * need) @ room[b])
        best = min(can, key=value)
        at[i] = best
        room[best] -= need
    assert bins.max() + 1 <= 1.03 * len(room) + 1  # equal scores may go to different bins


# 4 -------------------------------------------------------------------------------------------------------------


def test_languages(spark, empty):
    rng = random.Random(1)
    kinds = {"aa": ["bana", "kolo", "mira"], "bb": ["xyzz", "quux", "wexx"], "cc": ["éàü", "ßöä", "ñçé"]}
    rows = [(i, " ".join(rng.choices(kinds[k], k=rng.randint(2, 20))), k) for i, k in enumerate(rng.choices(list(kinds), k=300))]
    table = spark.createDataFrame([*rows, (900, None, "aa"), (901, "bana", None)], "doc_id bigint, text string, lang string")
    model = languages.fit(table.where("doc_id < 200 or doc_id >= 900"))
    more = spark.createDataFrame([(1000, None, ""), (1001, "", ""), (1002, "12 !?", ""), (1003, "kolo " * 50_000, ""), (1004, "日本", "")], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in languages.identify(table.unionByName(more), model).collect()}
    assert all(got[i]["lang_pred"] == k and 0.5 < got[i]["score"] <= 1 for i, _, k in rows)
    assert [got[i]["lang_pred"] for i in (900, 1000, 1001, 1002, 1003)] == ["und"] * 4 + ["aa"]
    assert got[1000]["score"] == 0 and got[1004]["lang_pred"] != "und"
    nothing = languages.fit(empty.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in languages.identify(table, nothing).collect()} == {"und"}
    one = languages.fit(table.where("lang = 'aa'"))
    assert {r["lang_pred"] for r in languages.identify(table.where("text IS NOT NULL"), one).collect()} == {"aa"}
    assert languages.identify(empty, model).count() == 0


def test_codewords_differ():
    for k in (2, 4, 7, 20):
        table = languages.codewords(k)
        assert min((table[a] != table[b]).sum() for a in range(k) for b in range(a)) >= 1
        assert (np.abs(table.sum(0)) < k).all()


# 6 -------------------------------------------------------------------------------------------------------------


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(1500, 12))
    base[300:420] = base[5]  # copies: ties
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(2000, None), (2001, [0.0] * 12), (2002, [float("nan")] + [1.0] * 11), (2003, [None] + [1.0] * 11), (2004, [1.0]), (None, base[0].tolist()), (2005, []), (7, base[7].tolist())]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<double>, rank string")
    got = collections.defaultdict(list)
    for r in neighbours.search(table, F.col("vec_id") % 10 == 0, 20, shard_rows=400).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in range(0, 1500, 10):
        score = base @ base[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(1500), -score))[:20]
        assert [r for r, _, _ in got[q]] == list(range(1, 21))
        assert all(abs(s - score[v]) < 1e-12 for _, v, s in got[q])
        assert got[q] == sorted(got[q], key=lambda x: (-x[2], x[1]))
        hits += len(set(best.tolist()) & {v for _, v, _ in got[q]})
        total += 20
    assert len(got) == 150 and hits / total >= 0.9
    few = neighbours.search(table.where("vec_id in (10, 11, 12)"), F.col("vec_id") == 10, 20).collect()
    assert sorted(r["vec_id"] for r in few) == [11, 12]
    assert neighbours.search(table.where("false"), F.lit(True), 20).count() == 0
    assert neighbours.search(table.where("vec_id = 10"), F.lit(True), 20).count() == 0


@pytest.mark.parametrize("long", [1e4, 1e9])
def test_one_long_vector_blurs_no_query(spark, long):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(1500, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    base[77] *= long
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id bigint, embedding array<double>")
    got = collections.defaultdict(set)
    for r in neighbours.search(table, F.col("vec_id") % 10 == 0, 20, shard_rows=800).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in range(0, 1500, 10):
        score = base @ base[q]
        score[q] = -np.inf
        best = set(np.argsort(-score)[:20].tolist())
        assert 77 not in best or 77 in got[q]
        hits += len(best & got[q])
    assert hits / 3000 >= 0.95


def test_pruning_keeps_no_covered_candidate():
    rng = np.random.default_rng(8)
    points = rng.normal(size=(200, 5)).astype(np.float32)
    out = neighbours.robust_prune(points, np.arange(10), np.tile(np.arange(201), (10, 1)), 8, 1.2)
    for p, row in enumerate(out):
        left, kept = sorted((i for i in range(200) if i != p), key=lambda i: ((points[i] - points[p]) ** 2).sum()), []
        while left and len(kept) < 8:
            kept.append(left[0])
            left = [i for i in left[1:] if 1.2 * np.linalg.norm(points[kept[-1]] - points[i]) > np.linalg.norm(points[p] - points[i])]
        assert row[row < 200].tolist() == kept


# 7 -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [logbilinear.HOT, 6])
def test_language_model(spark, docs, empty, hot):
    train = F.col("doc_id") % 3 != 0
    got = {r["doc_id"]: r for r in logbilinear.score(docs, train, hot=hot, vocabulary=6 if hot == 6 else 2048).collect()}
    own = {i: solid(t) + [None] for i, t in enumerate(some_texts())}
    c = collections.Counter(w for i, ws in own.items() if i % 3 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in own.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r["score"] < 0
    assert logbilinear.score(empty, F.lit(True)).count() == 0
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in logbilinear.score(docs, F.lit(False)).collect())


def test_item_probabilities_add_up_to_one_and_training_helps():
    rng = np.random.default_rng(1)
    items = np.cumsum(rng.choice([1, 1, 1, 2], 60_000)) % 9  # the next item follows from the last
    seq, context, _ = logbilinear.sequences(items, np.array([0, len(items)]), 10)
    noise = np.full(10, 0.1)
    model = logbilinear.Model(10, prior=noise)
    every = np.arange(10)
    total = lambda: np.exp(model.log_probabilities(every, np.tile(context[5], (10, 1)))).sum()
    before = model.log_probabilities(seq, context).mean()
    trainer = logbilinear.Trainer(model, noise, 1)
    for _ in range(4):
        trainer.train(seq, context)
    assert math.isclose(total(), 1, rel_tol=1e-4)
    assert model.log_probabilities(seq, context).mean() > before + 0.8


def test_the_modelled_vocabulary_grows_with_the_corpus(spark):
    rows = lambda n: spark.createDataFrame([(i, " ".join(f"w{k}x" for k in range(i % 10, n, 10)), "") for i in range(50)], DOCS)
    for n in (300, 3000):  # every word five times; all have one end
        _, counts = logbilinear.count(rows(n), "text")
        assert len(counts.words) == n and counts.group_n.sum() == 0
    assert [logbilinear.least_count(t, 25_000) for t in (10, 25_000 * 9, 25_000 * 10_000)] == [2, 3, 100]


def test_items_have_their_own_probability_inside_their_class():
    rng = np.random.default_rng(4)
    prior = 1 / np.arange(1, 401)
    group = logbilinear.classes_of(prior)
    assert sorted(set(group.tolist())) == list(range(group.max() + 1)) and (np.diff(group) >= 0).all() and group.max() > 10
    items = rng.integers(300, 400, 40_000)
    items[1::2] = 699 - items[::2]  # pairs of rare items
    model = logbilinear.Model(400, prior=prior / prior.sum())
    seq, context, _ = logbilinear.sequences(items, np.arange(0, 40_001, 2), 400)
    trainer = logbilinear.Trainer(model, prior, 1)
    for _ in range(40):
        trainer.train(seq, context)
    every = np.arange(400)
    for c in context[:20]:
        assert math.isclose(np.exp(model.log_probabilities(every, np.tile(c, (400, 1)))).sum(), 1, rel_tol=1e-4)
    second = np.arange(1, len(seq), 3)
    assert model.log_probabilities(seq[second], context[second]).mean() > math.log(1 / 100) + 1  # better than any guess without the first item's identity


# 8 -------------------------------------------------------------------------------------------------------------


def test_segments_are_those_of_the_definition():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 14)
        score = [rng.choice([-0.25] * 3 + [1.0, 0.4, 2.0]) for _ in range(n)]
        at = [i for i, s in enumerate(score) if s > 0]
        got = sorted((a, b, round(s, 6)) for a, b, s in toxicity.segments(at, [score[i] for i in at], 0.25))

        def best(lo, hi):  # the best segment, then the same on both sides of it
            options = [(sum(score[a : b + 1]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a, hi) if sum(score[a : b + 1]) > 1e-9]
            if not options:
                return []
            top = max(o[0] for o in options)
            _, _, _, a, b = max((o for o in options if o[0] > top - 1e-9), key=lambda o: (o[1], o[2]))
            return [*best(lo, a), (a, b, round(top, 6)), *best(b + 1, hi)]

        assert math.isclose(sum(s for _, _, s in got), sum(s for _, _, s in best(0, n)), abs_tol=1e-4)


def test_toxicity(spark, empty):
    rng = random.Random(4)
    plain = ["one", "two", "three", "four", "five", "six", "seven", "eight"]
    rows, labels = [], []
    for i in range(600):
        own = rng.choices(plain, k=rng.randint(5, 60))
        bad = i % 6 == 0
        if bad:
            own[rng.randrange(len(own))] = rng.choice(["Vile", "rotten"])
        rows.append((i, " ".join(own), ""))
        labels.append((i, int(bad)))
    rows += [(1000, None, ""), (1001, "", ""), (1002, "one " * 60_000 + "vile", ""), (1003, "vile", "")]
    table = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame([*labels, (3, None), (None, 1), (1000, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(table, marks.where("doc_id % 5 <> 0 or doc_id is null"))
    got = {r["doc_id"]: r for r in toxicity.detect(table, model).collect()}
    held = [i for i in range(600) if i % 5 == 0]
    assert np.mean([got[i]["predicted"] == labels[i][1] for i in held]) > 0.98
    assert got[1000]["score"] == got[1001]["score"] < 0.5 and got[1003]["predicted"] == 1
    assert got[1003]["passages"][0]["first_word"] == 0
    assert toxicity.detect(empty, model).count() == 0
    none = toxicity.fit(table, marks.where("false"))
    assert {r["predicted"] for r in toxicity.detect(table, none).collect()} == {0}


# 9 -------------------------------------------------------------------------------------------------------------


def fingerprint(text):
    w = solid(text)
    own = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    ones = [sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in own) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(own))


def classes(fingerprints, ids, max_bits=2):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    f = np.array(fingerprints, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= max_bits) + i + 1:
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def test_near_duplicates(spark, empty):
    own = some_texts(200, 9)
    own += [t + " extra" for t in own if t and len(t) > 300]
    ids = [1000 - i for i in range(len(own))]
    table = spark.createDataFrame([(i, t, "") for i, t in zip(ids, own)] + [(1000, own[0], "")], DOCS)
    rows = simhash.near_duplicates(table).collect()
    got = {r["doc_id"]: r for r in rows}
    want = classes([fingerprint(t) for t in own], ids)
    assert [got[i]["component_id"] for i in ids] == want
    assert [got[i]["fingerprint"] & (2**64 - 1) for i in ids] == [fingerprint(t) for t in own]
    assert sum(r["stays"] for r in rows) == len(set(want))
    assert all(r["component_id"] == r["doc_id"] for r in rows if r["stays"])
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("bucket", [6, 2048])
def test_links_of_crowded_buckets(spark, bucket):
    rng, own = np.random.default_rng(1), set()
    for b in rng.integers(0, 2**63, 4):
        for _ in range(90):
            x = int(b)
            for k in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(k)
            own.add(x)
    own = sorted(own)
    table = spark.createDataFrame([(simhash._signed(x),) for x in own], "f bigint")
    got = {r["node"]: r["root"] for r in components.components(simhash.links(table, 2, bucket)).collect()}
    want = classes(own, own)
    for a, b in zip(own, want):
        for c, d in zip(own, want):
            a_, c_ = simhash._signed(a), simhash._signed(c)
            assert (got.get(a_, a_) == got.get(c_, c_)) == (b == d)
            if c > a + 10**15:
                break


def test_thresholds_add_up():
    for bits in (1, 2, 3):
        parts = simhash.plan(np.diag(np.full(64, 500.0)) + 250, 1000, bits)
        assert sum(t + 1 for _, t in parts) == bits + 1
    assert simhash.allocate([[0, 5, 9], [0, 1, 2], [0, 4, 30]], 2)[1] == [-1, 1, -1]


def test_components_of_a_long_path(spark):
    table = spark.createDataFrame([(i, i + 1) for i in range(1, 200)] + [(500, 400), (400, 500), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components.components(table).collect()}
    assert got == {**{i: 1 for i in range(2, 201)}, 500: 400}
    assert components.components(table.where("false")).count() == 0


# 10 ------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><p>The name of this site and more.</p></header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><div id="cookie-notice"><p>We use cookies here, as everyone does.</p></div>
<article><h1>A title &amp; more</h1><p>First  paragraph, with <b>bold</b><br>words.<p>Second one &lt;x&gt; here.</p><div class="ad"><p>Buy this very fine thing today, it is cheap.</p></div>
<ul><li>Item one<li>Item two</ul><p>End.</p></article><section id="comments"><p>A reader says that all of this is wrong, at length.</p></section>
<aside><p>Other pages that you may like to read some day.</p></aside><form><p>Your mail address, please</p><input></form><script>var p = "<p>no</p>";</script><footer>&copy; 2020 someone</footer></body></html>"""


def test_html(spark):
    want = "A title & more\n\nFirst paragraph, with bold words.\n\nSecond one <x> here.\n\nItem one\n\nItem two\n\nEnd."
    rows = [(1, PAGE), (2, None), (3, ""), (4, "just a plain text without markup."), (5, PAGE[:700]), (6, "<p" * 50), (7, "<article>" + "<p>Long paragraph, again and again.</p>" * 3000)]
    got = {r["page_id"]: r for r in html.extract(spark.createDataFrame([(i, h, "t") for i, h in rows], "page_id bigint, html string, text string")).collect()}
    assert got[1]["text"] == want and got[1]["n_chars"] == len(want)
    assert got[2]["text"] == got[3]["text"] == "" and got[4]["text"] == rows[3][1]
    assert got[5]["text"].startswith("A title") and got[7]["text"].count("\n\n") == 2999


ARTICLE = "<article><h1>Title here</h1><p>A first paragraph, with enough words.</p><p>A second one ends here.</p></article>"


@pytest.mark.parametrize("before", ['<svg viewBox="0 0 1 1"/>', "<math/>", "<svg><title/><path d='x'/></svg>", *(f"<{t}>" for t in ("select><option>One<option", "noscript", "object", "video", "audio", "canvas", "svg", "template", "math"))])
def test_elements_left_open_or_closed_by_themselves_cut_nothing(before):
    want = html.main_text(f"<body>{ARTICLE}</body>")
    assert want.count("\n\n") == 2
    assert html.main_text(f"<body><div>{before}</div>{ARTICLE}</body>") == want
    assert html.main_text(f"<body>{before}{ARTICLE}</body>") == want
    inner = ARTICLE.replace("<p>A second", f"{before}<p>A second")
    assert html.main_text(f"<body>{inner}</body>") == want


def test_embedded_elements_part_no_text_and_formulas_stay():
    page = "<article><p>Words before <svg><svg><text>inner</text></svg><text>icon</text></svg> and <select><option>no</select>after it, <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math>.</p><video><p>No video here.</p></video><p>The end of it.</p></article>"
    assert html.main_text(page) == "Words before and after it, x=1.\n\nThe end of it."


def test_minimum_cut_is_the_cheapest_labelling():
    rng = random.Random(6)
    for _ in range(150):
        n = rng.randint(1, 7)
        costs = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 1.5)) for a in range(n) for b in range(a) if rng.random() < 0.6]
        price = lambda keep: sum(max(c, 0) if not k else max(-c, 0) for c, k in zip(costs, keep)) + sum(w for a, b, w in edges if keep[a] != keep[b])  # noqa: E731, B023
        least = min(price([bool(m >> i & 1) for i in range(n)]) for m in range(2**n))
        assert math.isclose(price(html.minimum_cut(costs, edges)), least, abs_tol=1e-6)


# the queries ---------------------------------------------------------------------------------------------------


def test_registered_queries_have_their_columns(spark):
    from rowtide.llm.registry import QUERIES

    want = {
        "op1_": "doc_id n_words n_hit n_items items_sha256 contaminated", "op2_": "doc_id n_words n_base first_word last_word base_labels labels score",
        "op3_": "doc_id piece start length ids_crc32 sequence_id offset", "op5_": "doc_id n_bytes n_tokens over_limit", "op10_": "page_id url text n_chars",
    }
    for start, columns in want.items():
        name = next(q for q in QUERIES if q.startswith(start))
        assert set(columns.split()) <= set(QUERIES[name](spark, "/root/testdata/sf0.001").columns)
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))


def test_decontamination_agrees_with_its_sql(spark):
    from rowtide.llm.registry import QUERIES, SQL
    from tests.oracle import connect, difference

    assert difference(QUERIES["op1_decontamination"](spark, "/root/testdata/sf0.001"), connect("/root/testdata/sf0.001"), SQL["op1_decontamination"]) is None
    assert hashlib.sha256(b"").hexdigest() == QUERIES["op1_decontamination"](spark, "/root/testdata/sf0.001").where("n_items = 0").first()["items_sha256"]


def test_pipeline_keeps_what_its_operators_keep(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    stages = [n for n, _ in corpus_pipeline.STAGES]
    assert stages == ["language", "toxicity", "near_duplicates", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs.unionByName(docs.where("doc_id < 3")).withColumn("score", F.when(F.col("doc_id") >= 0, "clash")).withColumn("stays", F.when(F.col("doc_id") >= 0, 1))
    odd = spark.createDataFrame([(10**9, None, "en", "s", 0, "x", 1), (10**9 + 1, "", None, None, None, None, None)], extra.schema)
    table = extra.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, sf)
        assert out.columns == table.columns
        before, after = (collections.Counter(json.dumps(list(r), default=str) for r in d.collect()) for d in (table, out))
        assert not after - before  # rows as they were
        if name == "near_duplicates":
            rows = table.select("doc_id", "text").collect()
            want = set(classes([fingerprint(r["text"]) for r in rows], [r["doc_id"] for r in rows]))
            assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == sorted(want)
        if name == "decontamination":
            win = windows([tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()])
            clean = [r["doc_id"] for r in table.select("doc_id", "text").collect() if not any(tuple(w[k : k + n]) in win for w in [words(r["text"])] for n in {len(p) for p in win} for k in range(len(w) - n + 1))]
            assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == sorted(clean)
        table = spark.createDataFrame(out.collect(), out.schema)
    packed = corpus_pipeline.pack(spark, table, sf)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in table.collect()}
