"""What stays bounded or independent of the layout: benchmark passes, detections, samples, averages."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from rowtide.llm import decontamination, languages, licenses, logbilinear, toxicity


def by_brute_force(docs, items, window):
    out = {}
    for i, text in docs:
        words, hit, found = text.split(), set(), set()
        for item, t in items:
            own = t.split()
            for k in range(max(1, len(own) - window + 1) if own else 0):
                part = own[k : k + window]
                for at in range(len(words) - len(part) + 1):
                    if words[at : at + len(part)] == part:
                        hit |= set(range(at, at + len(part)))
                        found.add(item)
        out[i] = (len(words), len(hit), sorted(found))
    return out


def test_twelve_benchmark_blocks_and_long_items(spark):
    """Each pass is a plan of one scan; equal rows are one, an item over a block is cut and keeps its windows."""
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(12)]
    make = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(f"i{k}", make(rng.randint(1, 12))) for k in range(40)] + [("long", make(150)), ("long", make(3))] + [("copied", make(9))] * 30
    docs = [(i, make(rng.randint(0, 60))) for i in range(60)] + [(99, "x " + items[40][1] + " y")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    found = decontamination.decontaminate(table, benchmark, window=4, block_bytes=150)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in found.collect()}
    assert got == by_brute_force(docs, items, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


@pytest.mark.parametrize("block_bytes", [8, 30, 10**6])
def test_parts_of_an_item_have_its_windows(block_bytes):
    rng = random.Random(3)
    for n in (1, 3, 4, 5, 40):
        words = [rng.choice(["a", "bb", "ccc", "日本"]) for _ in range(n)]
        batch = pa.RecordBatch.from_arrays([pa.array(["i"]), pa.array([" ".join(words)])], ["i", "t"])
        parts = [t.split() for out in decontamination._parts(4, block_bytes)(iter([batch])) for t in out.column("t").to_pylist()]
        windows = lambda w: {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))}
        assert set().union(*map(windows, parts)) == windows(words)


def test_no_stronger_detection_contains_a_kept_one():
    rng = random.Random(4)
    table = licenses.rules()
    for _ in range(200):
        found = []
        for _ in range(rng.randint(0, 25)):
            a = rng.randrange(20)
            found.append((rng.randrange(len(table)), a, a + rng.randrange(8)))
        found = list(dict.fromkeys(found))
        order = sorted(found, key=lambda m: (-table[m[0]].priority, m[1] - m[2], m[0], m[1]))
        want = [m for i, m in enumerate(order) if not any(k[1] <= m[1] and m[2] <= k[2] for k in order[:i])]
        assert licenses.kept(found) == sorted(want, key=lambda m: (m[1], m[2], m[0]))


def test_language_sample_does_not_depend_on_the_layout(spark):
    rng = random.Random(5)
    letters = {"a": "aeiouklm", "b": "bcdfgst", "c": "xyzqwaeo"}
    rows = [(i, "".join(rng.choices(letters[k] + " ", k=80)), k) for i, k in enumerate(rng.choices("abc", k=400))] + [(500 + i, "same text here", "a") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = [languages.fit(docs.repartition(n), sample=120) for n in (2, 7)]
    assert np.array_equal(models[0].weights, models[1].weights) and np.allclose(models[0].scale, models[1].scale)


def test_decay_solves_the_stated_sum():
    gain, hits, words = np.array([0.7, 1.5, 3.0]), np.array([40.0, 10.0, 2.5]), 5000.0
    rate = toxicity.decay(gain, hits, words)
    p = hits / words
    assert p @ np.exp(rate * gain) + (1 - p.sum()) * np.exp(-rate * toxicity.DRIFT) == pytest.approx(1, abs=1e-9) and rate > 0.1


def test_prior_counts_the_corpus(spark):
    """Documents of the whole table that have a word, or a word with the beginning, each once."""
    texts = spark.createDataFrame([("grim grimly",), ("grimly day",), ("Day day",), (None,), ("",)], "t string").where("t IS NOT NULL")
    entries = spark.createDataFrame([(bytearray(b"grim"), None), (bytearray(b"griml"), None), (bytearray(b"grim*"), bytearray(b"day"))], "w binary, but binary")
    got = {bytes(r["w"]): r["n"] for r in toxicity._corpus(texts, entries).collect()}
    assert got == {b"grim": 1, b"grim*": 2, b"day": 2}


def test_average_does_not_depend_on_the_tree(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=40))) for i in range(300)], "doc_id long, text string").repartition(9)
    counts = logbilinear.count(docs, "text")[1]
    models = []
    for fan in (2, 32):
        monkeypatch.setattr(logbilinear, "FAN", fan)
        models.append(logbilinear.fit(docs, counts, "text"))
    assert np.allclose(models[0].flat, models[1].flat, atol=1e-4)


def test_a_token_hands_one_row_of_gradient_to_the_words_before_it(monkeypatch):
    """A word's parts of both positions are added up in its place before rows are sorted out; sums are those of every single part."""
    rng = np.random.default_rng(9)
    n, sizes = 300, [0, 1, 2, 700, 0, 1500]
    prior = np.arange(1, n + 1, dtype=float) / np.arange(1, n + 1).sum()
    items, context, _ = logbilinear.sequences(rng.integers(0, n - 1, sum(sizes)), np.concatenate([[0], np.cumsum(sizes)]), n)
    dq = np.append(rng.normal(size=(len(items), logbilinear.DIMENSIONS)), np.ones((len(items), 1)), 1).astype(np.float32)
    trainer = logbilinear.Trainer(logbilinear.Model(n, prior=prior), prior, 1)
    handed, moved = [], []
    sorted_out = logbilinear.by_row
    monkeypatch.setattr(logbilinear, "by_row", lambda at, value, *a: (handed.append(len(at)), sorted_out(at, value, *a))[1])
    monkeypatch.setattr(trainer, "update", lambda rows, grad, width: moved.append((rows, grad)))
    want = np.zeros((n + 1, logbilinear.DIMENSIONS + 1))
    for j, place in enumerate(trainer.model.position):
        np.add.at(want[:, :-1], context[:, j], dq[:, :-1] * place)
    trainer.back(context, trainer.model.predicted(context)[1], dq)
    assert handed[0] <= len(items) + len(sizes) + 2 < 2 * len(items)
    got = np.zeros_like(want)
    got[moved[1][0]] = moved[1][1]
    assert np.allclose(got, want, atol=1e-4)


def test_probabilities_of_scores_beyond_single_precision():
    prior = np.arange(1, 201, dtype=float)
    model = logbilinear.Model(200, prior=prior / prior.sum())
    for scale in (1.0, 60.0):
        model.flat[:] = np.random.default_rng(2).normal(0, 0.3 * scale, model.flat.shape)
        model.flat[: model.places[2], -1] = 0
        context = np.tile([[7, 190]], (200, 1))
        found = model.log_probabilities(np.arange(200), context)
        assert np.isfinite(found).all() and abs(np.logaddexp.reduce(found)) < 1e-2


def test_a_block_is_looked_up_without_a_table_of_all_words(monkeypatch):
    """A task numbers the hot words once; words with one hash are still told apart."""
    hot, item = pa.array([b"two", b"one", b"rare", b"six"], pa.binary()), np.array([1, 0, -1, 2])
    column = pa.array(["one two  Six", None, "", "rare none\tone"])
    numbers = logbilinear.Numbers(hot)
    with monkeypatch.context() as m:
        m.setattr(logbilinear.pc, "index_in", None)
        coded, items, at, kind, first = logbilinear.items_of(column, numbers, item)
    assert coded.to_pylist() == [b"one", b"two", b"six", b"rare", b"none", b"one"] and first.tolist() == [0, 3, 3, 3, 6]
    assert at.tolist() == [1, 0, 3, 2, -1] and items.tolist() == [0, 1, 2, 3 + kind[3], 3 + kind[4], 0]
    assert [g.tolist() for g in (logbilinear.Numbers(hot[:0])(hot), numbers(hot[:0]))] == [[-1] * 4, []]
    monkeypatch.setattr(logbilinear, "hashes", lambda words: np.zeros(len(words), np.uint64))
    assert logbilinear.Numbers(hot)(pa.array([b"six", b"none", b"two"], pa.binary())).tolist() == [3, -1, 0]


def test_gradients_are_added_up_by_row_whatever_their_width():
    rng = np.random.default_rng(3)
    for width in (24, 25):
        at = rng.integers(0, 40, logbilinear.ADDED + 700)
        value = rng.normal(size=(len(at), width)).astype(np.float32)
        rows, got = logbilinear.by_row(at, [value[:300], value[300:]], 50)
        want = np.zeros((50, width))
        np.add.at(want, at, value)
        assert rows.tolist() == sorted(set(at.tolist())) and np.allclose(got, want[rows], atol=1e-3)


def test_vectors_of_a_text_are_those_of_its_places():
    """Places of a text take over the vectors of the place before; single contexts and texts of every length are as they were."""
    rng = np.random.default_rng(7)
    model = logbilinear.Model(90, prior=np.full(90, 1 / 90))
    model.flat[model.places[1] : model.places[2]] = rng.normal(size=(logbilinear.CONTEXT, logbilinear.DIMENSIONS + 1))
    sizes = [0, 1, 400, 2, 0, 3]
    texts, alone = logbilinear.sequences(rng.integers(0, 89, sum(sizes)), np.concatenate([[0], np.cumsum(sizes)]), 90)[1], rng.integers(0, 91, (300, 2))
    for context in (texts, alone, texts[:1], texts[:0]):
        found, vectors = model.predicted(context)
        assert all(np.array_equal(v, model.flat[context[:, j]]) for j, v in enumerate(vectors))
        want = sum(model.context[context[:, j]] * model.position[j] for j in range(logbilinear.CONTEXT))
        assert np.allclose(found[:, :-1], want, atol=1e-6) and (found[:, -1] == 1).all()
