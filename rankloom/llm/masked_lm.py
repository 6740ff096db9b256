"""Language-model scoring by masked pseudo-likelihood.

A window network predicts each token from the two before and the two after it: position tables of the neighbours' classes, a
hidden layer, and a distribution over classes, in two steps: groups of classes, then the classes of a group. A class is a
frequent word, a bin of other vocabulary words, or a bin of words outside the vocabulary; within its class, a word has its
share of the corpus counts, whether in the vocabulary or not. A document's score is the sum, over all its tokens, of the
logarithms of both probabilities.

All documents take part: words are counted over the whole corpus, and each partition trains the network on every
position of each of its documents, which ``MASKED`` turns mask in parts, each once; the networks are averaged in a tree, weighted by positions. What is
gathered so grows with the corpus: vocabulary, words with a class of their own and bins grow with the square root of its
tokens, from the sizes below. A training step changes only the rows that its batch touches, so that the work for a token grows with the number and size of
groups, the fourth root of the tokens. The counts of all other words stay in a table,
which the words of the scored documents are joined to. A word that the corpus doesn't have counts as one seen once.

Cases: null, empty or blank text has no token and score 0; null and repeated doc_ids are kept as they are; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, common

#: For corpora of up to ``GROWS`` squared tokens; each grows with the square root of the tokens.
VOCABULARY, SINGLE, BINS, OTHER, GROWS = 8192, 80, 32, 16, 1024
CLASSES = SINGLE + BINS + OTHER
HIDDEN, SIDE, MASKED, BATCH = 24, 2, 8, 4096
PAD = CLASSES
#: Logits at most; their exponentials and sums stay within single precision.
STEEP = 60
#: Words and bytes of counts held at once.
COUNTED, MOST_HELD = 400_000, 16 << 20


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of texts one after the other, those of Python's ``lower().split()``, and each text's number of them. Arrow cuts
    at the same characters, without an object for each token."""
    own = [(t or "").lower().strip() or None for t in texts.to_pylist()]
    parts = pc.utf8_split_whitespace(pa.array(own, pa.string()))
    return parts.flatten(), pc.fill_null(parts.value_lengths(), 0).to_numpy().astype(np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """word, n: over all documents."""

    def run(batches):
        held = []  # the first: of all slices merged so far

        def merged() -> pa.Table:
            whole = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
            held[:] = [whole.select(["word", "n_sum"]).rename_columns(["word", "n"])]
            return held[0]

        with common.task_memory(held):
            for b in batches:
                for low, high in byte_bpe.slices(b.column(0), 2_000_000):
                    counts = split(b.column(0).slice(low, high - low))[0].value_counts()
                    held.append(pa.table({"word": counts.field("values"), "n": counts.field("counts")}))
                    if sum(map(len, held[1:])) > COUNTED or sum(t.nbytes for t in held) > MOST_HELD:
                        if len(merged()) > COUNTED or held[0].nbytes > MOST_HELD // 2:
                            yield from held.pop().to_batches()
            if held:
                yield from merged().to_batches()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Words:
    """Index of each vocabulary word; of each index (then of the bins of words outside), class and log share within it, which
    for a bin is that of a word seen once; the counts of the words outside that were seen more often."""

    index: dict[str, int]
    of_class: np.ndarray
    log_share: np.ndarray
    frequency: np.ndarray
    counts: DataFrame | None

    def indices(self, words: list[str]) -> np.ndarray:
        n = len(self.index)
        found = np.fromiter(map(self.index.get, words, repeat(-1)), np.int32, len(words))
        out = np.flatnonzero(found < 0)
        hashes = np.fromiter((zlib.crc32(words[i].encode("utf-8", "surrogatepass")) for i in out.tolist()), np.int64, len(out))
        found[out] = n + hashes % (len(self.of_class) - n)
        return found

    def local(self) -> Words:
        """What tasks need."""
        return replace(self, counts=None)

    def tables(self) -> Words:
        """What tasks need once words are indices."""
        return replace(self, counts=None, index={})


def vocabulary(docs: DataFrame) -> Words:
    counts = common.staged(count_words(docs), "words")
    grown = max(1, int((counts.agg(F.sum("n")).first()[0] or 0) ** 0.5) // GROWS)
    single, bins, other = SINGLE * grown, BINS * grown, OTHER * grown
    top = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY * grown).toArrow()
    words, n = top.column("word").to_pylist(), top.column("n").to_numpy().astype(float)
    rest = counts
    if words:
        rest = counts.where((F.col("n") < int(n[-1])) | (F.col("n") == int(n[-1])) & (F.col("word") > F.lit(words[-1])))
    masses = rest.groupBy(F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(other)).alias("c")).agg(F.sum("n").alias("n"))
    outside = {r["c"]: r["n"] for r in masses.collect()}
    of_class = np.arange(len(words))
    if len(words) > single:
        mass = np.cumsum(n[single:])
        of_class[single:] = single + np.minimum(bins - 1, (mass - n[single:]) * bins / mass[-1]).astype(int)
    of_class = np.concatenate([of_class, single + bins + np.arange(other)])
    n = np.concatenate([n, [outside.get(c, 0) for c in range(other)]])
    masses = np.bincount(of_class, n, single + bins + other)
    frequency = masses + 1
    share = np.concatenate([n[: len(words)] / np.maximum(1, masses[of_class[: len(words)]]), 1 / (n[len(words) :] + 1)])
    return Words({w: i for i, w in enumerate(words)}, of_class.astype(np.int32), np.log(share), frequency / frequency.sum(), rest.where("n > 1"))


class Network:
    """Tables for the neighbours at each place, hidden bias, output weights and bias of the groups of classes and, for each
    group, of its classes: one flat vector of parameters."""

    def __init__(self, flat: np.ndarray, classes: int):
        self.flat, self.classes, self.parts, self.kept, at = flat, classes, [], {}, 0
        for shape in self.shapes(classes):
            size = int(np.prod(shape))
            self.parts.append(flat[at : at + size].reshape(shape))
            at += size

    @staticmethod
    def shapes(classes: int) -> tuple:
        groups = int(np.ceil(classes**0.5))
        size = -(-classes // groups)
        return (2 * SIDE, classes + 1, HIDDEN), (HIDDEN,), (HIDDEN, groups), (groups,), (groups, HIDDEN, size), (groups, size)

    @classmethod
    def start(cls, frequency: np.ndarray) -> Network:
        length = sum(int(np.prod(s)) for s in cls.shapes(len(frequency)))
        net = cls((np.random.default_rng(11).standard_normal(length) * 0.1).astype(np.float32), len(frequency))
        members = np.zeros(net.parts[5].size)
        members[: len(frequency)] = frequency
        members = members.reshape(net.parts[5].shape)
        net.parts[1][:] = 0
        net.parts[3][:] = np.log(np.maximum(members.sum(axis=1), 1e-30))
        net.parts[5][:] = np.where(members > 0, np.log(np.maximum(members, 1e-30)), -1e9)
        return net

    def room(self, use: str, *shape: int) -> np.ndarray:
        """Memory for one use of each batch. Taken anew for each, the system would often clear it first, which costs as much as what is done in it."""
        kept = self.kept.get(use)
        if kept is None or len(kept) < shape[0]:
            kept = self.kept[use] = np.empty(shape, self.flat.dtype)
        return kept[: shape[0]]

    def hidden(self, around: np.ndarray) -> np.ndarray:
        """Each row's hidden layer, then a one, which the biases are multiplied with."""
        n, (tables, bias) = around.shape[1], self.parts[:2]
        h, more, whole = self.room("sum", n, HIDDEN), self.room("rows", n, HIDDEN), self.room("hidden", n, HIDDEN + 1)
        _rows(tables[0], around[0], h)
        for k in range(1, 2 * SIDE):
            h += _rows(tables[k], around[k], more)
        h += bias
        np.tanh(h, out=whole[:, :HIDDEN])
        whole[:, HIDDEN] = 1
        return whole

    def logits(self, h: np.ndarray, runs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's logits of the groups and of the classes of its group; the weights of these, with the biases as their last row."""
        groups, _, size = self.parts[4].shape
        low = self.room("low", groups, HIDDEN + 1, size)
        low[:, :HIDDEN], low[:, HIDDEN] = self.parts[4], self.parts[5]
        of_groups, own = self.room("groups", len(h), groups), self.room("own", len(h), size)
        np.matmul(h, np.concatenate([self.parts[2], self.parts[3][None]]), out=of_groups)
        for g, first, last in runs:
            np.matmul(h[first:last], low[g], out=own[first:last])
        return of_groups, own, low

    def by_group(self, target: np.ndarray):
        """Rows in the order of their targets' groups; in that order, each target's group and place in it, and each group's number, first and last row."""
        group, place = np.divmod(target, self.parts[5].shape[1])
        order = _order(group, self.parts[5].shape[0])
        group = group[order]
        starts = _starts(group)
        return order, group, place[order], list(zip(group[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)]))

    def log_likelihood(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        order, group, place, runs = self.by_group(target)
        of_groups, own, _ = self.logits(self.hidden(around[:, order]), runs)
        share = _log_share(of_groups, group) + _log_share(own, place)
        total = np.empty_like(share)
        total[order] = share
        return total

    def learn(self, around: np.ndarray, target: np.ndarray, squares: np.ndarray, rate: float = 0.1) -> None:
        """One step of Adagrad on a batch of masked positions. Only what the batch touches has a gradient, and only that is changed: the
        neighbours' rows of the tables, the targets' groups, and what all share, which grows with the number of groups."""
        order, group, place, runs = self.by_group(target)
        around = around[:, order]
        n, h, past = len(target), self.hidden(around), Network(squares, self.classes)

        def step(part: int, g: np.ndarray, where=None) -> None:
            """On all of a part, or on its rows of these numbers."""
            value, before = self.parts[part], past.parts[part]
            if where is not None:
                value, before = (x.reshape(-1, *x.shape[x.ndim - g.ndim + 1 :]) for x in (value, before))
            own = g * g
            own += before if where is None else before.take(where, axis=0)
            before[... if where is None else where] = own
            np.sqrt(own, out=own)
            own += np.float32(1e-6)
            g *= rate
            g /= own
            if where is None:
                value -= g
            else:
                value[where] = value.take(where, axis=0) - g

        of_groups, own, low = self.logits(h, runs)
        d = _error(of_groups, group, n)
        back, shared = np.matmul(d, self.parts[2].T, out=self.room("back", n, HIDDEN)), h.T @ d
        own, weights = _error(own, place, n), self.room("weights", *low.shape)
        for g, first, last in runs:
            d = own[first:last]
            np.matmul(h[first:last].T, d, out=weights[g])
            back[first:last] += d @ low[g, :HIDDEN].T
        slope = np.square(h[:, :HIDDEN], out=self.room("sum", n, HIDDEN))
        back *= np.subtract(1, slope, out=slope)
        step(1, np.ones(n, back.dtype) @ back)
        step(2, shared[:HIDDEN])
        step(3, shared[HIDDEN])
        some = None if len(runs) == len(low) else [g for g, _, _ in runs]
        weights = weights if some is None else weights[some]
        step(4, weights[:, :HIDDEN], some)
        step(5, weights[:, HIDDEN], some)
        for k in range(2 * SIDE):
            order = _order(around[k], self.classes + 1)
            found = around[k].take(order)
            starts = _starts(found)
            step(0, _sums(_rows(back, order, self.room("rows", n, HIDDEN)), starts), k * (self.classes + 1) + found[starts])


def _rows(table: np.ndarray, at: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Rows of a table, put into memory at hand; ``clip`` as numpy else copies ``out`` once more."""
    return np.take(table, at, axis=0, out=out, mode="clip")


def _sums(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin at ``starts``. Taken as complex numbers, two columns at a time are added, in half the time."""
    pairs = {np.float32: np.complex64, np.float64: np.complex128}[rows.dtype.type]
    return np.add.reduceat(rows.view(pairs), starts, axis=0).view(rows.dtype)


def _order(values: np.ndarray, n: int) -> np.ndarray:
    """Puts values from 0 to n - 1 in order, equal ones as they stand; sorting is several times faster in 16 bits."""
    return np.argsort(values.astype(np.uint16) if n <= 1 << 16 else values, kind="stable")


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def _exp(z: np.ndarray) -> np.ndarray:
    """Puts the exponentials of logits that are held within ``STEEP`` in their place; gives their sums by row. Products with ones take short rows together."""
    np.exp(z, out=z)
    return z @ np.ones(z.shape[1], z.dtype)


def _log_share(z: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The logarithm of the targets' probabilities by each row's logits, whose memory it uses."""
    own = np.clip(z, -STEEP, STEEP, out=z)[np.arange(len(target)), target]
    return own - np.log(_exp(z))


def _error(z: np.ndarray, target: np.ndarray, n: int) -> np.ndarray:
    """The gradient of the mean loss of n rows by these rows' logits, in whose memory it is given."""
    total = _exp(np.clip(z, -STEEP, STEEP, out=z))
    z *= (1 / (n * total))[:, None]
    z[np.arange(len(target)), target] -= z.dtype.type(1 / n)
    return z


def _positions(sizes: np.ndarray) -> np.ndarray:
    """Places of the tokens of texts one after the other, with padding before, between and after texts."""
    return np.arange(int(sizes.sum())) + SIDE + SIDE * np.repeat(np.arange(len(sizes)), sizes)


def _turns(sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The turn, of ``MASKED``, that masks each of the tokens of texts one after the other: the first masks every ``MASKED``-th of each
    text from a random one of its first on, each further turn those after the ones of the turn before."""
    first = np.cumsum(sizes) - sizes + rng.integers(0, np.clip(sizes, 1, MASKED))
    return (np.arange(int(sizes.sum())) - np.repeat(first, sizes)) % MASKED


def _masked(sizes: np.ndarray, rng: np.random.Generator, turn: int = 0) -> np.ndarray:
    """Whether a turn masks each of the tokens."""
    return _turns(sizes, rng) == turn


def _around(classes: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([classes[at + k] for k in (*range(-SIDE, 0), *range(1, SIDE + 1))])


def indexed(docs: DataFrame, words: Words) -> DataFrame:
    """row, doc_id, words (indices of the text's tokens, 32 bits each), outside (its tokens that aren't in the vocabulary)."""
    shared = docs.sparkSession.sparkContext.broadcast(words.local())

    def run(batches):
        known = shared.value
        held = len(known.index)
        key = TaskContext.get().partitionId() << 36
        with common.task_memory():
            for b in batches:
                for low, high in byte_bpe.slices(b.column(1), 2_000_000):
                    every, sizes = split(b.column(1).slice(low, high - low))
                    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    coded = every.dictionary_encode()  # each word is looked up once
                    flat = known.indices(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
                    out = flat >= held
                    own = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(ends * np.int32(4)), pa.py_buffer(flat)])
                    outside = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(out)])[ends], pa.int32()), every.filter(pa.array(out)))
                    arrays = [pa.array(np.arange(key, key + high - low), pa.int64()), b.column(0).slice(low, high - low), own, outside]
                    key += high - low
                    yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "words", "outside"])

    return docs.select("doc_id", "text").mapInArrow(run, "row long, doc_id long, words binary, outside array<string>")


def _texts(column: pa.Array, words: Words):
    """For runs of an indexed column: start and end, word indices of the tokens of its texts one after the other, their classes with
    padding between texts, and the texts' sizes."""
    for low, high in byte_bpe.slices(column, 1_200_000):
        own = column.slice(low, high - low).to_pylist()
        flat = np.frombuffer(b"".join(own), np.int32)
        sizes = np.array([len(x) // 4 for x in own], np.int64)
        classes = np.full(len(flat) + SIDE * (len(own) + 1), len(words.frequency), np.int32)
        classes[_positions(sizes)] = words.of_class[flat]
        yield low, high, flat, classes, sizes


def train(docs: DataFrame, words: Words) -> Network:
    """The network of documents' texts."""
    return learned(indexed(docs, words), words)


def learned(own: DataFrame, words: Words) -> Network:
    """The network of indexed texts."""
    shared = own.sparkSession.sparkContext.broadcast(words.tables())

    def run(batches):
        known = shared.value
        net = Network.start(known.frequency)
        squares, seen, at_text = np.full(len(net.flat), 1e-3, np.float32), 0, 0
        with common.task_memory(net.kept):
            for b in batches:
                for _, _, _, classes, sizes in _texts(b.column(0), known):
                    at_text += 1
                    rng, places, turns = np.random.default_rng(at_text), _positions(sizes), _turns(sizes, np.random.default_rng(at_text))
                    for turn in range(MASKED):
                        at = rng.permutation(places[turns == turn])
                        for k in range(0, len(at), BATCH):
                            part = at[k : k + BATCH]
                            net.learn(_around(classes, part), classes[part], squares)
                        seen += len(at)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([net.flat.tobytes()], pa.binary())], names=["seen", "network"])

    parts = own.select("words").mapInArrow(run, "seen long, network binary").rdd.map(lambda r: (r["seen"], np.frombuffer(bytes(r["network"]), np.float32).astype(np.float64) * r["seen"]))
    start = Network.start(words.frequency)
    none = (0, np.zeros(len(start.flat)))
    total, flat = parts.treeAggregate(none, lambda x, y: (x[0] + y[0], x[1] + y[1]), lambda x, y: (x[0] + y[0], x[1] + y[1]), depth=3)
    return Network((flat / total).astype(np.float32), start.classes) if total else start


def score(docs: DataFrame, words: Words, net: Network) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum over tokens), mean_log_likelihood."""
    return scored(common.staged(indexed(docs, words), "indexed"), words, net)


def scored(own: DataFrame, words: Words, net: Network) -> DataFrame:
    """The scores of indexed texts, which are staged."""
    shared = own.sparkSession.sparkContext.broadcast((words.tables(), net.flat))

    def run(batches):
        known, flat_net = shared.value
        own_net = Network(flat_net, len(known.frequency))
        with common.task_memory(own_net.kept):
            for b in batches:
                for low, high, flat, classes, sizes in _texts(b.column(2), known):
                    at = _positions(sizes)
                    each = known.log_share[flat]
                    for k in range(0, len(at), BATCH):
                        part = at[k : k + BATCH]
                        each[k : k + BATCH] += own_net.log_likelihood(_around(classes, part), classes[part])
                    sums = np.diff(np.concatenate([[0.0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(sizes)])])
                    arrays = [b.column(0).slice(low, high - low), b.column(1).slice(low, high - low), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "n_tokens", "part"])

    parts = own.select("row", "doc_id", "words").mapInArrow(run, "row long, doc_id long, n_tokens long, part double")
    more = own.select("row", F.explode("outside").alias("word")).join(words.counts, "word").groupBy("row").agg(F.sum(F.log("n")).alias("more"))
    whole = F.col("part") + F.coalesce("more", F.lit(0.0))
    out = parts.join(more, "row", "left").select("doc_id", "n_tokens", whole.alias("log_likelihood"))
    return out.withColumn("mean_log_likelihood", F.col("log_likelihood") / F.greatest("n_tokens", F.lit(1)))


def op6_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    words = vocabulary(docs)
    own = common.staged(indexed(docs, words), "indexed")
    return scored(own, words, learned(own, words))
