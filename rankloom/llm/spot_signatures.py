"""Document fingerprints by spot signatures.

Common words (``ANCHORS``) anchor a spot; the ``CHAIN`` content words that follow it make its signature. Content words
are those that aren't anchors. The beginning of a text counts as an anchor, and so does each ``RUN``-th content word of a
run without anchors, so that lists and tables have spots too. The chain at the beginning also counts with one and with two
words, so that short texts have several. A text's fingerprint is the set of its signatures, written as
sorted hexadecimal numbers of 32 bits. Fingerprints are compared by Jaccard similarity, which is known to be too low, without
a look at the sets, if their lengths differ too much.

Cases: null text counts as empty; a text without words has the empty fingerprint, alike (1.0) to another empty one and
unlike (0.0) any other; words without content word after them are chained to the end; null doc_ids come last in descending
order, rows that share a doc_id are ordered by a hash of their text; a single document is followed by itself; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph, minhash

#: Common words of the languages at hand.
ANCHORS = frozenset(
    "the of and to in a is that it on for was with be as by this are at from or not "
    "de la le les des du un une et en que qui dans pour par sur est pas au "
    "der die das und den von zu mit sich ist ein eine dem nicht auf auch als "
    "el los las y del se por con una su para lo al".split()
)
CHAIN, RUN = 3, 12
WORD_CACHE, LONG_WORD = 300_000, 64  # words kept, and the longest of them in characters
_U64 = np.uint64
_words: dict[str, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(31))) * _U64(0x9E3779B97F4A7C15)
    return (x ^ (x >> _U64(29))) * _U64(0xBF58476D1CE4E5B9)


def _word(w: str) -> int:
    """An even number for a content word, an odd one for an anchor, 0 for what has no letter or digit."""
    low, high = 0, len(w)
    while low < high and not w[low].isalnum():
        low += 1
    while low < high and not w[high - 1].isalnum():
        high -= 1
    if low == high:
        return 0
    return xxhash.xxh64_intdigest(w[low:high].encode("utf-8", "surrogatepass")) & ~1 | (w[low:high] in ANCHORS)


def signatures(text: str) -> np.ndarray:
    """Sorted distinct signatures of a text."""
    if len(_words) > WORD_CACHE:
        _words.clear()
    get, codes = _words.get, []
    for w in text.lower().split():
        c = get(w)
        if c is None:
            c = _word(w)
            if len(w) <= LONG_WORD:
                _words[w] = c
        codes.append(c)
    words = np.array(codes, np.uint64)
    words = words[words != 0]
    if not len(words):
        return np.zeros(0, np.uint32)
    anchor = (words & _U64(1)) == 1
    at = np.arange(len(words))
    since = at - np.maximum.accumulate(np.where(anchor, at, -1))
    spot = anchor | (since % RUN == 0)
    content = words[~anchor]
    # of a spot: its anchor (0 for the beginning and for runs) and the index of the next content word
    heads = np.concatenate([np.zeros(1, np.uint64), np.where(anchor, words, _U64(0))[spot]])
    follows = np.concatenate([[0], np.cumsum(~anchor)[spot]])
    whole = follows + CHAIN <= len(content)
    if not whole.any():  # too few content words for a chain: all words are one
        content, heads, follows, n = words, heads[:1], follows[:1], len(words)
    else:
        heads, follows, n = heads[whole], follows[whole], CHAIN
    total, opening = _mix(heads + _U64(n)), []
    for k in range(n):
        total = _mix(total + content[follows + k])
        opening.append(total[:1])  # the beginning of a text has its shorter chains too
    return np.unique((np.concatenate([total, *opening]) >> _U64(32)).astype(np.uint32))


def fingerprint(found: np.ndarray) -> str:
    return found.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity; 0 without a look at the sets if their lengths already put it under ``least``."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small < least * large or not small:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (small + large - both)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_spots, fingerprint."""

    def run(batches):
        for b in batches:
            own = [signatures(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array([fingerprint(x) for x in own], pa.string())], names=["doc_id", "n_spots", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_spots long, fingerprint string")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, component_id, kept: documents are linked if their fingerprints' Jaccard similarity is at least ``percent``.

    Sets are partitioned by length so that similar ones lie in the same partition or in neighbours. In a partition, sets
    meet in the lists of the rarest signatures of each, as many as similar sets can't all miss; lists are compared in blocks,
    two a task, on whole sets, and leave spanning stars of links. Empty fingerprints and rows without doc_id link with nothing."""

    def spots(batches):
        for b in batches:
            own = [signatures(t or "") for t in b.column(1).to_pylist()]
            keys = [hashlib.sha256(x.tobytes()).hexdigest()[:32] for x in own]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(keys, pa.string()), pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())), pa.array([x.astype(np.uint64).tobytes() for x in own], pa.binary())],
                names=["doc_id", "set_key", "spots", "shingles"],
            )

    found = common.staged(docs.select("doc_id", "text").mapInArrow(spots, "doc_id long, set_key string, spots array<long>, shingles binary"), "spots")
    named = found.where("size(spots) > 0 and doc_id is not null")
    classes = named.groupBy("set_key").agg(F.min("doc_id").alias("node"))
    nodes = common.staged(named.join(classes, (named.set_key == classes.set_key) & (named.doc_id == classes.node)).select("node", "spots", "shingles").dropDuplicates(["node"]), "nodes")
    each = nodes.select("node", F.explode("spots").alias("spot"), F.size("spots").alias("n"))
    rarity = each.groupBy("spot").agg(F.count("*").alias("df")).where("df > 1")
    least = F.ceil(F.col("n") * percent / 100).cast("int")
    common_spots = each.join(rarity, "spot").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "spot"))).alias("shared"))
    # of the n - least + 1 rarest signatures, those that no other set has come first and lead to no list
    prefix = F.greatest(F.lit(0), F.col("n") - least + 1 - (F.col("n") - F.size("shared")))
    part = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")
    listed = common_spots.withColumn("part", F.explode(F.sequence(part, part + 1))).select("node", "part", F.explode(F.slice("shared", F.lit(1), prefix.cast("int"))).alias("s"))
    lists = listed.select("node", "part", F.col("s.spot").alias("spot"))
    sizes = lists.groupBy("part", "spot").agg(F.count("*").alias("size")).where("size > 1")
    entries = lists.join(sizes, ["part", "spot"]).withColumn("blocks", F.ceil(F.col("size") / minhash.BLOCK).cast("int"))
    entries = entries.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    entries = entries.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).join(nodes.select("node", "shingles"), "node")
    links = entries.groupBy("part", "spot", "low", "high").applyInArrow(lambda t: minhash.compare_blocks(t, percent), "a long, b long")
    linked = graph.connected_components(common.staged(links, "links"))
    by_class = classes.join(linked, "node", "left").select("set_key", F.coalesce("component", "node").alias("of_class"))
    out = found.select("doc_id", F.when((F.size("spots") > 0) & F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(by_class, "set_key", "left")
    component = F.coalesce("of_class", "doc_id")
    return out.select("doc_id", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_edited(docs: DataFrame) -> DataFrame:
    """Each text against its edited form and against the next document in descending order of doc_id.

    Documents go to ranges of doc_id, each of which also gets the first document of the range after it."""
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("k"), F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = [i / n for i in range(1, n)]
    bounds = keyed.agg(F.percentile_approx("k", steps, 20_000).alias("b")).first()["b"] or []
    bounds = np.unique(np.array(bounds, np.int64))

    @F.pandas_udf("int")
    def range_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, k.to_numpy()).astype(np.int32))

    ranged = keyed.withColumn("range", range_of("k"))
    # one row a range: bounded by their number
    heads = sorted((r["range"], r["first"]["k"], r["first"]["h"]) for r in ranged.groupBy("range").agg(F.max(F.struct("k", "h")).alias("first")).collect())
    onward = [(k, h, heads[(i + 1) % len(heads)][0]) for i, (_, k, h) in enumerate(heads)]
    ahead = spark.createDataFrame(onward, "k long, h long, range int")
    own = ranged.select("range", F.lit(False).alias("ahead"), "k", "h", "doc_id", "text")
    next_first = keyed.join(F.broadcast(ahead), ["k", "h"]).select("range", F.lit(True).alias("ahead"), "k", "h", "doc_id", "text")
    ordered = own.unionByName(next_first).repartition(n // 4, "range").sortWithinPartitions("range", "ahead", F.desc("k"), F.desc("h"))

    def run(batches):
        with common.task_memory(_words):
            yield from compared(batches)

    def compared(batches):
        before = None
        for b in batches:
            out = []
            for r, is_ahead, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("range", "ahead", "doc_id", "text"))):
                spots = signatures(text)
                if before is not None and before[0] == r:
                    _, key, own, own_spots = before
                    half = len(own) // 2
                    edited = own[: len(own) - half] + text[:half]
                    edited_spots = signatures(edited)
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((key, len(own), sha, fingerprint(own_spots), fingerprint(edited_spots), likeness(own_spots, edited_spots), likeness(own_spots, spots)))
                before = None if is_ahead else (r, doc_id, text, spots)
            cols = list(zip(*out)) if out else [[]] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return ordered.mapInArrow(run, COMPARED)


def op10_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edited(common.documents(spark, sf_dir))
