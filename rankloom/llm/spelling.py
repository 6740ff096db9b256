"""Spelling variants: near words of the corpus' vocabulary, found by finite-state composition.

The vocabulary's acceptor is composed with a one-edit transducer (one code point replaced, inserted or deleted) and the
acceptor again; the pairs of words that the composition accepts are the near pairs. An edit is taken where both words first
differ, so that each pair has one accepting path.

The composition is enumerated by initial states: where the edit lies at one of the places from a to before b, both words share what they read before a
and after b. All words of a length that agree there, and those one longer, are one partition: the states that the acceptor and its mirror
image reach by those letters. Its task builds the minimised acceptor of what lies between and composes it. A word of L letters takes part with the
windows of places of length L and, as the longer word, of L - 1, two windows each. A partition of more than ``MOST_WORDS`` is cut into two of half the window,
down to single places, where it has at most two words for each letter of the alphabet; so no task holds more than a bounded number of words,
and no pair is lost. Pairs stay in the task: a word leaves with the number of its near words and the best.

Cases: null, empty and letterless text has no words; a null doc_id counts as '' in the hash that alters words; repeated rows count each; an empty
table gives an empty result; other columns are ignored. Words of any length are handled, without recursion.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_CHARS, LEAST_COUNT, TIMES = 7, 2, 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a partition, above which it is cut.
MOST_WORDS = 20_000


def vocabulary(docs: DataFrame, altered: int = 31) -> DataFrame:
    """word, n: the words of all texts. A run of letters whose hash with its doc_id is divisible by ``altered`` lacks a letter."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(rf"[A-Za-zÀ-ÿ]{{{LEAST_CHARS},}}"), F.lit(0))).alias("run"))
    lower = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    hashed = runs.select("doc_id", lower.alias("run")).select("run", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % altered == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_CHARS)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _keyed(members: DataFrame) -> DataFrame:
    """A partition's key: places, and what its words share before and after them."""
    rest = F.greatest(F.col("size") - F.col("b"), F.lit(0))
    shared = [F.substring("word", F.lit(1), F.col("a")), F.when(rest > 0, F.right("word", rest)).otherwise("")]
    return members.select("word", "n", "size", "a", "b", F.xxhash64("size", "a", "b", *shared).alias("key"))


def _windows(low, high, cut):
    return F.explode(F.array(F.struct(low.alias("a"), cut.alias("b")), F.struct(cut.alias("a"), high.alias("b"))))


def partitions(words: DataFrame, most: int) -> DataFrame:
    """word, n, size (of the shorter words), a, b, key: each word in its partitions, none of which has more than ``most`` words,
    but for those of a single place."""
    length = F.length("word")
    sized = words.select("word", "n", F.explode(F.filter(F.array(length, length - 1), lambda s: s >= LEAST_CHARS)).alias("size"))
    members = sized.select("word", "n", "size", _windows(F.lit(0), F.col("size") + 1, F.floor(F.col("size") / 2).cast("int")).alias("w")).select("word", "n", "size", "w.*")
    done, members = None, _keyed(members)
    while True:
        large = common.staged(members.groupBy("key", "a", "b").agg(F.count("*").alias("words")).where((F.col("words") > most) & (F.col("b") - F.col("a") > 1)).select("key"), "large")
        if not large.limit(1).count():
            return members if done is None else done.unionByName(members)
        small = members.join(large, "key", "left_anti").select(members.columns)
        done = small if done is None else done.unionByName(small)
        cut = members.join(large, "key", "left_semi")
        cut = cut.select("word", "n", "size", _windows(F.col("a"), F.col("b"), F.floor((F.col("a") + F.col("b")) / 2).cast("int")).alias("w"))
        members = common.staged(_keyed(cut.select("word", "n", "size", "w.*")), "cut")


class Acceptor:
    """Minimised acceptors of sets of words of one length each, which share their states. State 0 accepts the end."""

    def __init__(self):
        self.arcs: list[tuple] = [()]
        self.after: list[dict] = [{}]
        self.known: dict[tuple, int] = {}

    def state(self, arcs: tuple) -> int:
        own = self.known.get(arcs)
        if own is None:
            own = self.known[arcs] = len(self.arcs)
            self.arcs.append(arcs)
            self.after.append(dict(arcs))
        return own

    def add(self, words: list[str]) -> int | None:
        """The initial state of sorted distinct words: states are closed, and merged with equal ones, as soon as the next word
        leaves them. No words: None. The empty word alone: the end."""
        if not words:
            return None
        path, last = [[]], ""
        for word in [*words, None]:
            k = 0
            if word is not None:
                while k < len(last) and word[k] == last[k]:
                    k += 1
            for depth in range(len(last), k, -1):
                arcs = path.pop()
                path[-1].append((last[depth - 1], self.state(tuple(arcs)) if arcs else 0))
            if word is not None:
                path.extend([] for _ in range(len(word) - k))
                last = word
        return self.state(tuple(path[0])) if path[0] else 0

    def common(self, p: int, q: int, but: str = "") -> list[str]:
        """What both states accept, unless it begins with ``but``."""
        if p == q == 0:
            return [""]
        out, stack = [], [(p, q, "")]
        while stack:
            p, q, read = stack.pop()
            after = self.after[q]
            for x, to in self.arcs[p]:
                other = after.get(x)
                if other is not None and (read or x != but):
                    if to or other:
                        stack.append((to, other, read + x))
                    else:
                        out.append(read + x)
        return out

    def replaced(self, start: int):
        """Pairs of accepted words that differ in one letter: the composed states (q, no edit yet, q), each explored once."""
        tails: dict[int, list] = {}
        stack = [(start, "")]
        while stack:
            q, read = stack.pop()
            own = tails.get(q)
            if own is None:
                arcs = self.arcs[q]
                own = tails[q] = [(x + s, y + s) for i, (x, p) in enumerate(arcs) for y, r in arcs[i + 1 :] for s in self.common(p, r)]
            for u, v in own:
                yield read + u, read + v
            stack.extend((to, read + x) for x, to in self.arcs[q] if to)

    def inserted(self, short: int, long: int, at_end: bool):
        """Pairs of a word of ``short`` and one of ``long`` that has one letter more, where they first differ."""
        tails: dict[tuple, list] = {}
        stack = [(short, long, "")]
        while stack:
            p, q, read = stack.pop()
            own = tails.get((p, q))
            if own is None:
                own = tails[p, q] = [(t, y + t) for y, to in self.arcs[q] for t in self.common(p, to, y) if t or at_end]
            for u, v in own:
                yield read + u, read + v
            after = self.after[q]
            stack.extend((to, after[x], read + x) for x, to in self.arcs[p] if x in after)


def near_pairs(size: int, a: int, b: int, short: list[str], long: list[str]):
    """Near pairs among the sorted words of a partition: short ones have ``size`` letters, long ones one more."""
    machine = Acceptor()
    rest = max(size - b, 0)
    inner = lambda words: [w[a : len(w) - rest] for w in words]
    p, q = machine.add(inner(short)), machine.add(inner(long))
    if p is None:
        return
    before, after = short[0][:a], short[0][size - rest :]
    for u, v in machine.replaced(p):
        yield before + u + after, before + v + after
    if q is not None:
        for u, v in machine.inserted(p, q, b > size):
            yield before + u + after, before + v + after


NEAR = "word string, n_near long, best_n long, best string"


def near_words(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """word, n_near, best (the near word of largest n; of those, the first in code-point order), best_n; words with a near one only."""

    def run(batches):
        found: dict[str, list] = {}

        def note(word, other, n):
            own = found.get(word)
            if own is None:
                found[word] = [1, n, other]
            else:
                own[0] += 1
                if n > own[1] or n == own[1] and other < own[2]:
                    own[1:] = n, other

        def compose(rows):
            """All rows of one key; keys that collide are told apart here."""
            if len(rows) < 2:
                return
            groups: dict[tuple, list] = {}
            for word, n, size, a, b in rows:
                groups.setdefault((size, a, b, word[:a], word[len(word) - max(size - b, 0) :]), []).append((word, n))
            for (size, a, b, _, _), own in groups.items():
                count = dict(own)
                words = sorted(count)
                for u, v in near_pairs(size, a, b, [w for w in words if len(w) == size], [w for w in words if len(w) > size]):
                    note(u, v, count[v])
                    note(v, u, count[u])

        def out():
            rows = [(w, *x) for w, x in found.items()]
            found.clear()
            cols = list(zip(*rows)) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "best_n", "best"])

        key, held = None, []
        for batch in batches:
            keys = batch.column(5).to_pylist()
            for own, row in zip(keys, zip(*(batch.column(i).to_pylist() for i in range(5)))):
                if own != key:
                    compose(held)
                    key, held = own, []
                held.append(row)
            if len(found) > 50_000:
                yield out()
        compose(held)
        yield out()

    grouped = partitions(words, most).repartition("key").sortWithinPartitions("key")
    each = grouped.mapInArrow(run, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return each.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.word").alias("best"), (-F.col("b.n")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form) to (word, root): each word's last form. Counts rise along forms, so there is no circle; each round
    doubles the steps taken."""
    now = common.staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        moved = now.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved"))
        moved = common.staged(moved, "roots")
        if not moved.where("moved").limit(1).count():
            return moved.drop("moved")
        now = moved.drop("moved")


def variants(docs: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of ``docs``."""
    words = common.staged(vocabulary(docs), "vocabulary")
    near = words.join(near_words(words, most), "word", "left")
    has = F.col("best_n") >= TIMES * F.col("n")
    known = common.staged(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "near")
    last = roots(known.where("form is not null").select("word", "form"))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(common.documents(spark, sf_dir))
