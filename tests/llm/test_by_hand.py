"""The chain of classifiers and the mixture of languages, each against its definition worked out by hand on a small table."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pytest

from rankloom.llm import language_mix, toxicity


def test_mixture_is_the_most_likely_one(docs):
    """Two languages: the proportion that a search of all steps of a thousandth finds, and the set of the best penalised likelihood."""
    en = [(i, f"the house and the garden with that thing of the {w} which we have", "en") for i, w in enumerate("oak tree wind rain storm night".split())]
    de = [(i + 50, f"der Wald und die Straße mit dem {w} das wir nicht haben", "de") for i, w in enumerate("Baum Wind Regen Sturm Nacht Haus".split())]
    model = language_mix.fit(docs(en + de))
    counts = {name: np.full(language_mix.BUCKETS, language_mix.SMOOTH) for name in ("de", "en")}
    for _, text, lang in en + de:
        for t in language_mix.trigrams(text).tolist():
            counts[lang][t] += 1
    p = {name: c / c.sum() for name, c in counts.items()}
    a, b = "der Wald und das Haus mit dem Garten ", "the tree and the wind of that night "
    for text in (a, b, a + b, a * 3 + b, a + b * 4, (a + b) * 5, a * 9 + "the night "):
        own = language_mix.trigrams(text).tolist()
        fit = lambda s: sum(math.log(s * p["de"][t] + (1 - s) * p["en"][t]) for t in own)  # noqa: B023, E731
        best = max(range(1, 1000), key=lambda s: fit(s / 1000)) / 1000
        penalty = 0.5 * math.log(len(own)) + 1
        alone = max(("de", fit(1)), ("en", fit(0)), key=lambda x: x[1])
        got = model.proportions(text)
        gain = fit(best) / 3 - penalty - alone[1] / 3
        if abs(gain) > 0.2:
            assert set(got) == ({"de", "en"} if gain > 0 else {alone[0]}), text
        if len(got) == 2:
            assert got["de"] == pytest.approx(best, abs=0.03)


def test_chain_learns_from_predictions_out_of_fold(spark, docs, monkeypatch):
    """Every model of a fold is fitted without that fold's documents; the last category's models see just what these models say of
    the documents left out, and new documents what the model of all documents says."""
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words, 12)) + (" awful" if i % 3 == 0 else "") + (" junkish" if i % 4 == 0 else "") for i in range(160)]
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 1 if i % 3 == 0 else 0) for i in range(160)], "doc_id long, quality int, toxic int")
    calls, plain = [], toxicity.fit_logistic
    monkeypatch.setattr(toxicity, "fit_logistic", lambda rows, cols, extra, y, width, **k: calls.append((rows, cols, extra.copy(), y.copy(), plain(rows, cols, extra, y, width, **k))) or calls[-1][4])
    chain = toxicity.fit(docs(list(enumerate(texts))), labels)
    folds = [zlib.crc32(t.encode()) % toxicity.FOLDS for t in texts]
    n = toxicity.FOLDS + 1
    assert len(calls) == 2 * n
    columns = [sorted(chain.columns(t)) for t in texts]

    def says(w, i, before=()):
        z = sum(w[c] for c in columns[i]) + sum(w[chain.width + k] * x for k, x in enumerate(before)) + w[-1]
        return 1 / (1 + math.exp(-z))

    apart = np.zeros(160)
    for k, (rows, cols, extra, y, w) in enumerate(calls[: n - 1]):
        inside = [i for i in range(160) if folds[i] != k]
        assert len(y) == len(inside) and extra.shape[1] == 0 and list(y) == [float(i % 4 == 0) for i in inside]
        assert [sorted(cols[rows == j].tolist()) for j in range(len(inside))] == [columns[i] for i in inside]
        for i in range(160):
            if folds[i] == k:
                apart[i] = says(w, i)
    for k, (_, _, extra, y, _) in enumerate(calls[n:]):
        inside = [i for i in range(160) if k == toxicity.FOLDS or folds[i] != k]
        assert np.allclose(extra[:, 0], apart[inside]) and list(y) == [float(i % 3 == 0) for i in inside]
    junk, toxic = calls[n - 1][4], calls[-1][4]
    for i in range(0, 160, 7):
        first = says(junk, i)
        assert chain.probabilities(texts[i]) == pytest.approx([first, says(toxic, i, [first])], abs=1e-9)
    assert all(chain.toxic(t, chain.probabilities(t)) == ("awful" in t) for t in texts)
