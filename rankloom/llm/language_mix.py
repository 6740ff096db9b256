"""Language identification by multilingual mixture inference.

For each language, the model has the probabilities of letter trigrams (words with their borders, hashed to ``BUCKETS``).
A document's trigrams are taken as drawn from a mixture of languages; expectation-maximisation estimates the proportions.
The set of languages is chosen among the nested sets of the largest proportions by likelihood less a penalty for each
language, half the logarithm of the number of trigrams, with the likelihood divided by three as trigrams overlap.

Models are fitted on a bounded sample: about ``PER_LANGUAGE`` labelled documents of each language, chosen by a hash of
their text. Whole texts are counted and predicted.

Cases: null text, or text without a letter, is ``und`` with score 0; null languages aren't learned; null and repeated
doc_ids are kept as they are; without any labelled document all predictions are ``und``; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS, PER_LANGUAGE, SMOOTH = 1 << 16, 1500, 0.05
UNKNOWN = "und"
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the trigrams of letters; a border counts as a letter of its own. None of them crosses a border."""
    if not text:
        return np.zeros(0, np.int64)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[c]
    if not letter.any():
        return np.zeros(0, np.int64)
    c = np.concatenate([[0], np.where(letter, c, 0), [0]]).astype(np.uint32)
    c = c[(c != 0) | np.concatenate([[True], c[:-1] != 0])]
    a, b, d = c[:-2], c[1:-1], c[2:]
    h = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B) + np.uint32(0x27D4EB2F)) ^ (d * np.uint32(0xC2B2AE35) << np.uint32(1))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(16)).astype(np.int64)[b != 0]


class Mixture:
    """Predicts from a matrix of trigram probabilities, one row a language."""

    def __init__(self, names: list[str], probability: np.ndarray):
        self.names, self.probability = names, probability

    def _fit(self, p: np.ndarray, counts: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
        total = counts.sum()
        for _ in range(rounds):
            mixed = share @ p
            new = share * (p @ (counts / mixed)) / total
            moved = np.abs(new - share).max()
            share = new
            if moved < 1e-4:
                break
        return share, float(counts @ np.log(share @ p))

    def proportions(self, text: str | None) -> dict[str, float]:
        """The chosen languages and their estimated proportions, the largest first; empty if there is no letter."""
        codes = trigrams(text)
        if not len(codes) or not self.names:
            return {}
        codes, counts = np.unique(codes, return_counts=True)
        p = self.probability[:, codes]
        share, _ = self._fit(p, counts, np.full(len(p), 1 / len(p)), 12)
        order = np.argsort(-share, kind="stable")
        order = order[: max(1, int((share[order] > 0.01).sum()))]
        best, chosen = -np.inf, None
        penalty = 0.5 * np.log(counts.sum()) + 1
        for k in range(1, len(order) + 1):
            own = order[:k]
            fitted, fit = self._fit(p[own], counts, share[own] / share[own].sum(), 8) if k > 1 else (np.ones(1), float(counts @ np.log(p[own[0]])))
            if fit / 3 - penalty * (k - 1) > best:
                best, chosen = fit / 3 - penalty * (k - 1), (own, fitted)
        own, fitted = chosen
        rank = np.argsort(-fitted, kind="stable")
        return {self.names[own[i]]: float(min(1.0, fitted[i])) for i in rank}


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Mixture:
    """Learns from rows with text and lang, of which ``docs`` may have any number."""
    labelled = docs.where("lang is not null and text is not null").select("lang", "text")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return Mixture([], np.zeros((0, BUCKETS)))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])
    chosen = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, own in totals.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(own[some], pa.int64())], names=["lang", "bucket", "n"])

    counted = chosen.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(sizes)
    table = np.full((len(names), BUCKETS), SMOOTH)
    table[[names.index(x) for x in counted.column("lang").to_pylist()], counted.column("bucket").to_numpy()] += counted.column("n").to_numpy()
    return Mixture(names, table / table.sum(axis=1, keepdims=True))


def predict(docs: DataFrame, model: Mixture) -> DataFrame:
    """doc_id, lang_pred, score (the proportion of that language), languages (all chosen ones with their proportions)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        mixture = shared.value
        for b in batches:
            found = [mixture.proportions(t) for t in b.column(1).to_pylist()]
            arrays = [
                b.column(0), pa.array([next(iter(x), UNKNOWN) for x in found], pa.string()), pa.array([next(iter(x.values()), 0.0) for x in found], pa.float64()),
                pa.array([list(x.items()) for x in found], pa.map_(pa.string(), pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang_pred", "score", "languages"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, languages map<string,double>")


def keep_identified(docs: DataFrame, model: Mixture, least: float = 0.5) -> DataFrame:
    """The rows, with all columns, that have a language with at least the share ``least``; a null lang gets it."""
    shared, at, lang = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text"), docs.columns.index("lang")

    def run(batches):
        mixture = shared.value
        for b in batches:
            found = [mixture.proportions(t) for t in b.column(at).to_pylist()]
            named = pa.array([n or next(iter(x), None) for n, x in zip(b.column(lang).to_pylist(), found)], b.schema.field(lang).type)
            yield b.set_column(lang, b.schema.field(lang), named).filter(pa.array([next(iter(x.values()), 0.0) >= least for x in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    found = predict(docs, fit(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages")
