"""Toxicity, language and language-model scoring: held-out accuracy, hand-made cases and odd input."""

from __future__ import annotations

import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rankloom.llm import language_mix, masked_lm, toxicity

DATA = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    rows = language_mix.op4_language_mix(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixtures_and_odd_texts(spark, docs, odd):
    en = [(i, f"the house and the garden with that thing of the {w} which we have", "en") for i, w in enumerate("oak tree wind rain storm night".split())]
    de = [(i + 50, f"der Wald und die Straße mit dem {w} das wir nicht haben", "de") for i, w in enumerate("Baum Wind Regen Sturm Nacht Haus".split())]
    model = language_mix.fit(docs(en + de))
    assert model.names == ["de", "en"]
    assert next(iter(model.proportions("the wind and the rain"))) == "en" and next(iter(model.proportions("der Regen und die Nacht"))) == "de"
    both = model.proportions("the wind and the rain with that storm of the night " * 3 + "der Regen und die Nacht mit dem Wald und das Haus " * 3)
    assert set(both) == {"en", "de"} and all(0.25 < v < 0.75 for v in both.values())
    got = language_mix.predict(docs(odd, clash=True), model).collect()
    assert len(got) == len(odd)
    for r in got:
        if r.doc_id in (5, 3, 4):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert language_mix.fit(docs([(1, "text", None)])).proportions("text") == {}
    assert language_mix.predict(docs([]), model).count() == 0
    kept = language_mix.keep_identified(docs(odd + [(20, "the wind and the rain")], clash=True), model)
    assert {r.doc_id: r.lang for r in kept.collect()}[20] == "en" and 5 not in {r.doc_id for r in kept.collect()}


def test_toxicity_on_unseen_documents(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.fit(docs, labels.where("doc_id % 3 <> 0"))
    rows = toxicity.predict(docs, model).join(labels.where("doc_id % 3 = 0").withColumnRenamed("toxic", "y"), "doc_id").collect()
    assert np.mean([bool(r.y) == r.toxic for r in rows]) > 0.93


def test_chain_feeds_earlier_probabilities(spark, docs):
    """Toxic follows from junk alone: the later model has to use the earlier one's probability."""
    rows = [(i, ("rubbish stuff " if i % 2 else "decent words ") + f"filler{i}") for i in range(200)]
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(200)] + [(None, 1, 1), (7, None, None), (999, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(rows), labels)
    assert model.weights[1][model.width] > 0
    got = {r.doc_id: r.toxic for r in toxicity.predict(docs(rows), model).collect()}
    assert np.mean([got[i] == bool(i % 2) for i in range(200)]) > 0.98


def test_toxicity_of_odd_input(spark, docs, odd):
    labels = spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(odd), labels)
    assert not any(r.toxic for r in toxicity.predict(docs(odd, clash=True), model).collect())
    assert toxicity.keep_clean(docs(odd, clash=True), model).count() == len(odd)
    assert toxicity.predict(docs([]), toxicity.fit(docs([]), labels.limit(0))).count() == 0


def test_network_gradient():
    """The step's direction agrees with differences of the loss."""
    net = masked_lm.Network.start(np.full(masked_lm.CLASSES, 1 / masked_lm.CLASSES))
    rng = np.random.default_rng(0)
    around, target = rng.integers(0, masked_lm.CLASSES + 1, (4, 64)), rng.integers(0, masked_lm.CLASSES, 64)
    before = net.log_likelihood(around, target).mean()
    squares = np.full(len(net.flat), 1e-3, np.float32)
    for _ in range(60):
        net.learn(around, target, squares)
    assert net.log_likelihood(around, target).mean() > before + 0.5


def test_sparse_steps_equal_dense_ones():
    """A step changes what dense Adagrad with the same gradients, zero elsewhere, would; the gradients are those of differences of the loss."""
    classes = 130
    rng = np.random.default_rng(0)
    around, target = rng.integers(0, classes + 1, (4, 40)), rng.integers(0, classes, 40)
    net = masked_lm.Network.start(np.full(classes, 1 / classes))
    net.flat += rng.standard_normal(len(net.flat)).astype(np.float32) * 0.05
    before, squares = net.flat.copy(), np.full(len(net.flat), 1e-3, np.float32)
    net.learn(around, target, squares)
    g = np.sqrt(np.maximum(squares - np.float32(1e-3), 0))  # of one step: the gradient's size
    live = np.flatnonzero(g > 1e-2)
    still = squares == np.float32(1e-3)
    assert len(live) > 50 and np.allclose(net.flat[still], before[still], atol=1e-4)
    assert np.allclose(np.abs(before - net.flat)[live], (0.1 * g / (np.sqrt(squares) + 1e-6))[live], rtol=0.02)
    loss = lambda flat: -masked_lm.Network(flat, classes).log_likelihood(around, target).mean()
    for i in rng.choice(live, 40, replace=False):
        up, down = before.astype(np.float64), before.astype(np.float64)
        up[i] += 1e-4
        down[i] -= 1e-4
        assert abs((loss(up) - loss(down)) / 2e-4) == pytest.approx(g[i], rel=0.05, abs=3e-4)


def test_long_words_are_counted_in_parts(docs, monkeypatch):
    monkeypatch.setattr(masked_lm, "MOST_HELD", 100)
    own = docs([(i, ("x" * 90 + f"{i % 3} ") * 2 + "a a") for i in range(9)])
    assert {r.word[-1]: r.n for r in masked_lm.count_words(own).collect()} == {"0": 6, "1": 6, "2": 6, "a": 18}


def test_masked_scores(spark, docs, odd):
    text = "the cat sat on the mat and the dog ran to the house of the man "
    rows = [(i, text * 6) for i in range(40)] + [(1000 + (r[0] or 0), r[1]) for r in odd]
    own = docs(rows, clash=True)
    words = masked_lm.vocabulary(own)
    net = masked_lm.train(own, words)
    got = {r.doc_id: r for r in masked_lm.score(own, words, net).collect()}
    assert got[1005].n_tokens == 0 and got[1005].log_likelihood == 0.0 and got[1003].n_tokens == 0
    shuffled = " ".join(np.random.default_rng(1).permutation((text * 6).split()))
    there = {r.doc_id: r.log_likelihood for r in masked_lm.score(docs([(1, text * 6), (2, shuffled)]), words, net).collect()}
    assert there[1] > there[2]
    empty = docs([])
    none = masked_lm.vocabulary(empty)
    assert masked_lm.score(empty, none, masked_lm.train(empty, none)).count() == 0


def test_score_is_the_sum_of_conditionals(docs):
    own = docs([(1, "a b c a b"), (2, "b a")])
    words = masked_lm.vocabulary(own)
    net = masked_lm.Network.start(words.frequency)
    got = {r.doc_id: r.log_likelihood for r in masked_lm.score(own, words, net).collect()}
    for k, text in ((1, "a b c a b"), (2, "b a")):
        index = words.indices(text.split())
        classes = [masked_lm.PAD] * 2 + [int(words.of_class[i]) for i in index] + [masked_lm.PAD] * 2
        want = 0.0
        for p, i in enumerate(index):
            at = p + 2
            around = np.array([[classes[at - 2]], [classes[at - 1]], [classes[at + 1]], [classes[at + 2]]])
            want += float(net.log_likelihood(around, np.array([classes[at]]))[0]) + float(words.log_share[i])
        assert got[k] == pytest.approx(want, abs=1e-3)


def test_words_outside_the_vocabulary_keep_their_counts(docs, monkeypatch):
    """A word outside scores by its own count: more often seen, likelier by just the ratio of counts, in the same bin."""
    monkeypatch.setattr(masked_lm, "VOCABULARY", 2)
    monkeypatch.setattr(masked_lm, "OTHER", 1)
    own = docs([(1, "the of " * 50), (2, "rare " * 8), (3, "rarer " * 2), (4, "once")])
    words = masked_lm.vocabulary(own)
    assert len(words.index) == 2
    net = masked_lm.Network.start(words.frequency)
    got = {r.doc_id: r.log_likelihood for r in masked_lm.score(docs([(1, "rare"), (2, "rarer"), (3, "once"), (4, "never"), (4, "rare"), (None, "the")]), words, net).collect()}
    assert got[1] - got[3] == pytest.approx(np.log(8), abs=1e-5) and got[2] - got[3] == pytest.approx(np.log(2), abs=1e-5)
    assert None in got


def test_classes_grow_with_the_corpus(docs, monkeypatch):
    own = docs([(1, " ".join(f"w{i}" for i in range(900)))])
    small = masked_lm.vocabulary(own)
    assert len(small.frequency) == masked_lm.CLASSES
    monkeypatch.setattr(masked_lm, "GROWS", 10)
    words = masked_lm.vocabulary(own)
    assert len(words.frequency) == 3 * masked_lm.CLASSES and sum(words.of_class[: len(words.index)] < 3 * masked_lm.SINGLE) == 3 * masked_lm.SINGLE
    assert masked_lm.score(own, words, masked_lm.train(own, words)).first().n_tokens == 900


def test_groups_and_classes_make_one_distribution():
    net = masked_lm.Network.start(np.arange(1, 131) / 8515)
    every = net.log_likelihood(np.tile(np.array([[3], [99], [130], [0]]), 130), np.arange(130))
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-4)


def test_each_document_is_trained_on(docs):
    sizes = np.array([1, 0, 3, 8, 2, 17, 100])
    masked = masked_lm._masked(sizes, np.random.default_rng(3))
    each = [m.sum() for m in np.split(masked, np.cumsum(sizes)[:-1])]
    assert each[1] == 0 and all(s // masked_lm.MASKED <= n <= -(-s // masked_lm.MASKED) and n > 0 for s, n in zip(sizes, each) if s)
    own = docs([(i, "a b") for i in range(40)])
    words = masked_lm.vocabulary(own)
    at = [masked_lm._positions(np.array([2] * 40))[masked_lm._masked(np.array([2] * 40), np.random.default_rng(k))] for k in range(2)]
    assert all(len(x) == 40 for x in at) and not np.array_equal(*at)
    assert not np.array_equal(masked_lm.train(own.where("doc_id = 0"), words).flat, masked_lm.Network.start(words.frequency).flat)


def test_every_position_is_trained_on(docs):
    """The turns mask each token once, and each neighbour of each token is learned from."""
    sizes = np.array([1, 0, 3, 8, 2, 17, 100])
    turns = [masked_lm._masked(sizes, np.random.default_rng(3), k) for k in range(masked_lm.MASKED)]
    assert (np.sum(turns, axis=0) == 1).all()
    own = docs([(1, " ".join(f"w{i}" for i in range(12)))])
    words = masked_lm.vocabulary(own)
    start, net = masked_lm.Network.start(words.frequency), masked_lm.train(own, words)
    moved = (start.parts[0] != net.parts[0]).any(axis=2)
    for table, off in enumerate((-2, -1, 1, 2)):
        assert [bool(moved[table][words.of_class[words.index[f"w{i}"]]]) for i in range(12)] == [0 <= i - off < 12 for i in range(12)]


def test_steep_logits_and_sums_of_runs():
    """Logits of any size give finite probabilities in single precision; runs of rows are summed as they are."""
    z = np.array([[1e6, -1e6, 0.0], [-1e9, 3.0, 3.0]], np.float32)
    assert masked_lm._log_share(z.copy(), np.array([1, 1])) == pytest.approx([-2 * masked_lm.STEEP, -np.log(2)], abs=1e-4)
    assert np.isfinite(masked_lm._error(z.copy(), np.array([1, 0]), 2)).all()
    for kind in (np.float32, np.float64):
        rows = np.random.default_rng(4).standard_normal((50, masked_lm.HIDDEN)).astype(kind)
        assert np.allclose(masked_lm._sums(rows, np.array([0, 1, 7, 49])), np.add.reduceat(rows, [0, 1, 7, 49], axis=0), atol=1e-5)


def test_words_are_cut_as_python_cuts_them():
    """Every character, at a word's edge and inside, and the cases of whole texts: Arrow's cuts are those of lower().split()."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"A{c}b" for c in every] + [c for c in every if c.isspace()] + [None, "", " \x1c ", "  a  B\u2003", "ΟΔΥΣΣΕΥΣ ΟΔΟΣ. İX", "".join(every)]
    words, sizes = masked_lm.split(pa.array(texts, pa.string()))
    want = [(t or "").lower().split() for t in texts]
    assert sizes.tolist() == [len(x) for x in want] and words.to_pylist() == [w for x in want for w in x]


def test_words_cost_less_than_objects_for_each_token(docs):
    """Cutting and counting words takes well under the CPU seconds that a Python object for each token does."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 4000) % 50_000) for _ in range(60)]

    def plain():
        counts = Counter()
        for t in texts:
            counts.update(t.lower().split())
        every = pa.array([w for t in texts for w in t.lower().split()], pa.string()).dictionary_encode()
        return counts, every.dictionary.to_pylist()

    def arrow():
        words, _ = masked_lm.split(pa.array(texts, pa.string()))
        counts, every = words.value_counts(), masked_lm.split(pa.array(texts, pa.string()))[0].dictionary_encode()
        return dict(zip(counts.field("values").to_numpy(zero_copy_only=False), counts.field("counts").to_pylist())), every.dictionary.to_numpy(zero_copy_only=False).tolist()

    def seconds(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    assert plain() == arrow()
    assert min(seconds(arrow) for _ in range(5)) < 0.8 * min(seconds(plain) for _ in range(5))


def test_batches_use_their_memory_again():
    """Steps and scores of later batches, smaller ones and ones of few groups among them, are those of a network without earlier ones."""
    classes, rng = 130, np.random.default_rng(6)
    net = masked_lm.Network.start(np.full(classes, 1 / classes))
    squares, kept = np.full(len(net.flat), 1e-3, np.float32), []
    for size, most in ((300, classes), (300, classes), (40, 5), (200, classes), (1, 1)):
        around, target = rng.integers(0, classes + 1, (4, size)), rng.integers(0, most, size)
        fresh, fresh_squares = masked_lm.Network(net.flat.copy(), classes), squares.copy()
        assert np.allclose(net.log_likelihood(around, target), fresh.log_likelihood(around, target))
        net.learn(around, target, squares)
        masked_lm.Network(fresh.flat, classes).learn(around, target, fresh_squares)
        assert np.array_equal(net.flat, fresh.flat) and np.array_equal(squares, fresh_squares)
        kept.append({use: a.__array_interface__["data"][0] for use, a in net.kept.items()})
    assert kept[0] and kept[0] == kept[-1]
