"""Toxicity by a classifier chain of linear models.

The categories are the label columns in order: first ``quality`` (as its opposite, junk), then ``toxic``. Each has a
logistic model on the presence of words and word beginnings; from the second on, a model also gets the probabilities of the
categories before it. It is trained with out-of-fold probabilities, from models that haven't seen the row, so that it
meets in training what it will meet in use.

Training uses a bounded sample, at most ``TRAIN_ROWS`` labelled documents by hash of their doc_id, and the
``FEATURES`` hashed features that tell a category best (chi-squared). Folds go by a hash of the text: copies share one.
Thresholds are those of the best F1 on out-of-fold probabilities. All documents are scored on their whole text.

Cases: null, empty or blank text has no feature and gets the probabilities of the intercepts, toxic false; a label that is null
(in either column) isn't used for its category, nor one without document, of several labels for a doc_id the largest counts; without labels of both kinds a category's probability is 0
and nothing is toxic; null and repeated doc_ids are kept as they are; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

HASHED, FEATURES, TRAIN_ROWS, FOLDS = 1 << 18, 1024, 16_000, 5
BEGINNINGS = (4, 5, 6)
CATEGORIES = ("junk", "toxic")
WORD_CACHE, LONG_WORD = 250_000, 64  # words kept, and the longest of them in characters
_words: dict[str, tuple[int, ...]] = {}


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of a word as white space cuts it: without signs at its ends, and its beginnings."""
    low, high = 0, len(word)
    while low < high and not word[low].isalnum():
        low += 1
    while low < high and not word[high - 1].isalnum():
        high -= 1
    word = word[low:high]
    names = {word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) >= k)} - {""}
    return tuple(sorted(zlib.crc32(x.encode("utf-8", "surrogatepass")) % HASHED for x in names))


def features(text: str | None) -> np.ndarray:
    found = []
    if len(_words) > WORD_CACHE:
        _words.clear()
    for w in set((text or "").lower().split()):
        f = _words.get(w)
        if f is None:
            f = word_features(w)
            if len(w) <= LONG_WORD:
                _words[w] = f
        found.extend(f)
    return np.unique(np.array(found, np.int64))


def fit_logistic(rows: np.ndarray, cols: np.ndarray, extra: np.ndarray, y: np.ndarray, width: int, penalty: float = 3e-4, rounds: int = 100) -> np.ndarray:
    """Weights (features, extra columns, intercept) of a penalised logistic model, by Adam on all rows at once."""
    n, k = len(y), extra.shape[1]
    w = np.zeros(width + k + 1)
    w[-1] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.bincount(rows, w[cols], minlength=n) + extra @ w[width : width + k] + w[-1]
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = np.concatenate([np.bincount(cols, e[rows], minlength=width), e @ extra, [e.sum()]]) + penalty * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the thresholds with the best F1."""
    steps = np.linspace(0.05, 0.95, 91)
    f1 = np.array([2 * (y[p >= s].sum()) / max(1, (p >= s).sum() + y.sum()) for s in steps])
    return float(np.median(steps[f1 >= f1.max() - 1e-12]))


@dataclass
class Chain:
    """Models of the categories in order. ``slot``: a hashed feature's column, or -1; weights None: nothing to learn."""

    slot: np.ndarray
    weights: list
    thresholds: list

    def __post_init__(self):
        self.width = int(self.slot.max(initial=-1)) + 1
        self.words: dict[str, tuple[int, ...]] = {}

    def columns(self, text: str | None) -> set[int]:
        """Columns of the selected features that the text has."""
        if len(self.words) > WORD_CACHE:
            self.words.clear()
        known, found = self.words, set()
        for w in set((text or "").lower().split()):
            f = known.get(w)
            if f is None:
                f = tuple(int(s) for s in self.slot[list(word_features(w))] if s >= 0)
                if len(w) <= LONG_WORD:
                    known[w] = f
            if f:
                found.update(f)
        return found

    def probabilities(self, text: str | None) -> list[float]:
        cols, p = sorted(self.columns(text)), []
        for w in self.weights:
            if w is None:
                p.append(0.0)
                continue
            z = w[cols].sum() + w[self.width : self.width + len(p)] @ np.array(p) + w[-1]
            p.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        return p

    def toxic(self, text: str | None, p: list[float]) -> bool:
        return bool((text or "").strip()) and self.weights[-1] is not None and p[-1] >= self.thresholds[-1]


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Chain:
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"), (F.max("quality") == 0).cast("int").alias("junk")).where("toxic is not null or junk is not null")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)  # bounded, so it may be broadcast
    sample = common.staged(docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "labelled")

    def tally(batches):
        seen = np.zeros((4, HASHED), np.int64)
        with common.task_memory(_words):
            for b in batches:
                for text, toxic, junk in zip(*(b.column(c).to_pylist() for c in ("text", "toxic", "junk"))):
                    f = features(text)
                    for k, y in enumerate((toxic, junk)):
                        if y is not None:
                            seen[2 * k, f] += 1
                            seen[2 * k + 1, f] += y
        some = np.flatnonzero(seen[0] + seen[2])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(s[some], pa.int64()) for s in seen)], names=["f", "n_toxic", "toxic", "n_junk", "junk"])

    sums = sample.mapInArrow(tally, "f int, n_toxic long, toxic long, n_junk long, junk long").groupBy("f").agg(*(F.sum(c).alias(c) for c in ("n_toxic", "toxic", "n_junk", "junk"))).toArrow()
    f = sums.column("f").to_numpy()
    of = sample.agg(*(e(c).alias(p + c) for c in CATEGORIES for e, p in ((F.count, "n_"), (F.sum, "")))).first()
    slot, picked = np.full(HASHED, -1, np.int32), []
    for c in CATEGORIES:
        hits, n = sums.column(c).to_numpy().astype(float), sums.column(f"n_{c}").to_numpy().astype(float)
        share = (of[c] or 0) / max(of[f"n_{c}"], 1)
        chi = np.where(n >= 4, (hits - n * share) ** 2 / np.maximum(n * share * (1 - share), 1e-9), 0) if 0 < share < 1 else np.zeros(len(n))
        order = np.lexsort((f, -chi))[: FEATURES // 2]
        picked.extend(f[order[chi[order] > 8]].tolist())
    picked = sorted(set(picked))
    slot[picked] = np.arange(len(picked))
    selector = Chain(slot, [], [])

    def select(batches):
        with common.task_memory(selector.words):
            for b in batches:
                own = [sorted(selector.columns(t)) for t in b.column("text").to_pylist()]
                fold = [zlib.crc32(t.encode("utf-8", "surrogatepass")) % FOLDS for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fold, pa.int32()), b.column("junk"), b.column("toxic"), pa.array(own, pa.list_(pa.int32()))], names=["doc_id", "fold", "junk", "toxic", "cols"])

    data = sample.mapInArrow(select, "doc_id long, fold int, junk int, toxic int, cols array<int>").orderBy("doc_id", "fold").toPandas()
    sizes = data["cols"].map(len).to_numpy(np.int64) if len(data) else np.zeros(0, np.int64)
    rows, cols = np.repeat(np.arange(len(data)), sizes), np.concatenate([np.zeros(0, np.int64), *data["cols"]]).astype(np.int64)
    fold, extra, weights, thresholds = data["fold"].to_numpy(), np.zeros((len(data), 0)), [], []

    def fit_on(some, y, extra):
        place = np.full(len(y), -1)
        place[some] = np.arange(len(some))
        used = place[rows] >= 0
        return fit_logistic(place[rows[used]], cols[used], extra[some], y[some], len(picked))

    for c in CATEGORIES:
        y = data[c].to_numpy(float)
        labelled = ~np.isnan(y)
        if not 0 < y[labelled].sum() < labelled.sum():
            weights.append(None)
            thresholds.append(1.0)
            extra = np.hstack([extra, np.zeros((len(data), 1))])
            continue
        apart = np.zeros(len(y))
        for k in range(FOLDS):
            own, rest = np.flatnonzero(fold == k), np.flatnonzero((fold != k) & labelled)
            if not len(own) or not 0 < y[rest].sum() < len(rest):
                continue
            w = fit_on(rest, y, extra)
            z = np.bincount(rows, w[cols], minlength=len(y)) + extra @ w[len(picked) : -1] + w[-1]
            apart[own] = 1 / (1 + np.exp(-np.clip(z[own], -30, 30)))
        weights.append(fit_on(np.flatnonzero(labelled), y, extra))
        thresholds.append(best_threshold(apart[labelled], y[labelled]))
        extra = np.hstack([extra, apart[:, None]])
    return Chain(slot, weights, thresholds)


def predict(docs: DataFrame, model: Chain) -> DataFrame:
    """doc_id, p_junk, p_toxic, toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        chain = shared.value
        with common.task_memory(chain.words):
            for b in batches:
                texts = b.column(1).to_pylist()
                p = [chain.probabilities(t) for t in texts]
                arrays = [b.column(0), *(pa.array([x[k] for x in p], pa.float64()) for k in range(2)), pa.array([chain.toxic(t, x) for t, x in zip(texts, p)], pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "p_junk", "p_toxic", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, p_junk double, p_toxic double, toxic boolean")


def keep_clean(docs: DataFrame, model: Chain) -> DataFrame:
    """The rows, with all columns, that aren't toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    return common.filtered(docs, lambda: shared.value, lambda chain, t: not chain.toxic(t, chain.probabilities(t)))


def op1_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return predict(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
