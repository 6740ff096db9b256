"""b-bit MinHash near-duplicates: five-word shingles, band candidates, packed low bits, exact confirmation.

Each document gets the minima of ``HASHES`` permutations of its shingles. Their bands give candidates; the low
``BITS`` bits of all minima, packed into long integers, give a similarity by counting bits, corrected for bits that agree
by chance; pairs whose estimate lies clearly under the threshold go, and the rest is confirmed on whole shingle sets.
At a similarity of 0.85, all 24 bands of 5 differ with a probability of 1e-6; the estimate has a standard deviation of
0.04 there and goes only when 0.2 under.

Documents with equal sets form a class, which one document stands for. Classes that share a bucket and have a near enough
estimate make clusters, found from the least class of each bucket, then between what is still apart. Where a bucket holds many that are apart
(texts around one common passage), these meet by the rarest shingles of their whole sets instead, which loses none: linked sets share one. Within a cluster, all
whole sets are compared, in blocks of bounded size, two blocks a task, which leaves a spanning star of the links and never a
row for each pair. No bucket and no cluster has a cap.

Cases: null, empty and blank text has no shingle and links with nothing; a null doc_id can't be named and links with
nothing (component_id null, kept true); rows that share a doc_id are one document; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import base64

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, graph

WORDS, BANDS, ROWS, BITS = 5, 24, 5, 2
HASHES = BANDS * ROWS
MARGIN = 0.2
#: Sets of a block, the shingles that they have together, on average, nodes of a block of estimates, and nodes of a bucket that are
#: apart from which on they meet by rare shingles.
BLOCK, BLOCK_SHINGLES, APART, CROWDED = 256, 3_000_000, 64, 256
WORD_CACHE, LONG_WORD = 250_000, 64  # words kept, and the longest of them in bytes
_U64 = np.uint64
_RNG = np.random.default_rng(20_240_229)
_MULTIPLY = (_RNG.integers(0, 2**31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_ADD = _RNG.integers(0, 2**32, HASHES, np.uint32)[:, None]
_POSITION = _RNG.integers(0, 2**63, WORDS, np.uint64) | _U64(1)
_BAND = _RNG.integers(0, 2**63, (BANDS, ROWS), np.uint64) | _U64(1)
_BAND_ADD = _RNG.integers(0, 2**63, BANDS, np.uint64)
_words: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(31))) * _U64(0x9E3779B97F4A7C15)
    return (x ^ (x >> _U64(29))) * _U64(0xBF58476D1CE4E5B9)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles: words are cut at ASCII white space, A-Z is lower-cased, the rest
    stays; fewer than five words are one shingle."""
    words = text.lower().split()  # on bytes, both are ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > WORD_CACHE:
        _words.clear()
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    get, hashes = _words.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = xxhash.xxh64_intdigest(w)
            if len(w) <= LONG_WORD:
                _words[w] = h
        hashes.append(h)
    h = np.array(hashes, np.uint64)
    n = len(h) - WORDS + 1
    total = h[:n] * _POSITION[0]
    for k in range(1, WORDS):
        total = _mix(total) + h[k : n + k] * _POSITION[k]
    return np.unique(_mix(total))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value under each permutation."""
    h = (shingles >> _U64(32)).astype(np.uint32)
    least = np.full(HASHES, 2**32 - 1, np.uint32)
    for low in range(0, len(h), 4096):
        least = np.minimum(least, (_MULTIPLY * h[low : low + 4096] + _ADD).min(axis=1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = _mix((least.reshape(BANDS, ROWS).astype(np.uint64) + _U64(1)) * _BAND)
    return _mix(rows.sum(axis=1, dtype=np.uint64) + _BAND_ADD).view(np.int64)


def low_bits(least: np.ndarray) -> np.ndarray:
    """BITS bits of each minimum, packed into 64-bit integers."""
    scrambled = least * np.uint32(0x9E3779B1)
    scrambled ^= scrambled >> np.uint32(15)
    bits = ((scrambled[:, None] >> np.arange(BITS, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8).ravel()
    return np.packbits(np.pad(bits, (0, -len(bits) % 64))).view(np.int64)


LONGS = -(-HASHES * BITS // 64)
SIGNED = "doc_id long, n_shingles long, set_key string, bands array<long>, bits array<long>"


def signatures(docs: DataFrame) -> DataFrame:
    """One row a document: the size of its set, a 120-bit key of the set, band keys and packed low bits."""

    def run(batches):
        with common.task_memory(_words):
            yield from signed(batches)

    def signed(batches):
        for b in batches:
            sizes, keys, bands, bits = [], [], [], []
            for text in b.column(1).cast(pa.binary()):
                s = shingle_set(text.as_py() or b"")
                sizes.append(len(s))
                if len(s):
                    least = minima(s)
                    keys.append(base64.b64encode(hashlib.blake2b(s.tobytes(), digest_size=15).digest()).decode())
                    bands.append(band_keys(least))
                    bits.append(low_bits(least))
                else:
                    keys.append(None), bands.append(None), bits.append(None)
            arrays = [b.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.string()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "set_key", "bands", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, SIGNED)


def bit_similarity(a: str, b: str):
    """Similarity by counting bits: a minimum agrees by chance in all its BITS bits with probability 2**-BITS."""
    same = F.lit(0)
    pair = sum(1 << (2 * k) for k in range(31))  # the low bit of each pair of bits, of 62
    for k in range(LONGS):
        differ = F.get(F.col(a), F.lit(k)).bitwiseXOR(F.get(F.col(b), F.lit(k)))
        either = differ.bitwiseOR(F.shiftrightunsigned(differ, 1)).bitwiseAND(F.lit(pair | 1 << 62))
        same = same + F.bit_count(either)
    agree = 1 - same / F.lit(float(HASHES))
    chance = 2.0**-BITS
    return (agree - chance) / (1 - chance)


def compare_blocks(table: pa.Table, percent: int) -> pa.Table:
    """Links among the sets of two blocks of a cluster, on whole sets: for each linked node, the least it reaches."""
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    ids, block = np.array(table.column("node")), np.array(table.column("block"))
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
    sizes = np.array([len(x) for x in sets])
    flat, rows = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    some = count[column] > 1  # what only one set has is in no intersection
    rows, column = rows[some], np.unique(column[some], return_inverse=True)[1]
    both = np.zeros((len(sets), len(sets)))
    for start in range(0, int(column.max(initial=-1)) + 1, 8192):
        own = (column >= start) & (column < start + 8192)
        hot = np.zeros((len(sets), 8192), np.float32)
        hot[rows[own], column[own] - start] = 1
        both += hot @ hot.T
    link = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    if low == high:
        np.fill_diagonal(link, False)
    else:
        link &= block[:, None] != block[None, :]
    some = link.any(axis=1)
    least = graph.least_linked(link[some][:, some], ids[some]) if some.any() else ids[:0]
    return pa.table({"a": pa.array(ids[some], pa.int64()), "b": pa.array(least, pa.int64())})


def links_within(docs: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) among the documents of each cluster (node, component, n_shingles), as spanning stars of block pairs. Blocks
    are bounded by sets and by what these hold, so that a task's memory doesn't grow with the texts."""

    def sets(batches):
        with common.task_memory(_words):
            for b in batches:
                own = [shingle_set(t.as_py() or b"").tobytes() for t in b.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.binary())], names=["node", "shingles"])

    nodes = clusters.select(F.col("node").alias("doc_id")).hint("merge")  # grows with the input: not for a broadcast
    own = docs.select("doc_id", "text").join(nodes, "doc_id", "left_semi").mapInArrow(sets, "node long, shingles binary")
    sizes = clusters.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = clusters.select("node", "component").join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    entries = own.join(placed, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    entries = entries.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    entries = entries.select("component", "low", "high", "block", "node", "shingles")
    return entries.groupBy("component", "low", "high").applyInArrow(lambda t: compare_blocks(t, percent), "a long, b long")


def rare_shingles(docs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(node, bucket): of the whole set of each of the nodes, its first shingles in an order that puts those of more than ``CROWDED`` sets
    last. A set's links share ``percent`` of it; all but one less than that come first, so that two linked sets have one of these in common."""

    def sets(batches):
        key = TaskContext.get().partitionId() << 36
        with common.task_memory(_words):
            for b in batches:
                own = [shingle_set(t.as_py() or b"").view(np.int64) for t in b.column(1).cast(pa.binary())]
                arrays = [pa.array(np.arange(key, key + len(own)), pa.int64()), b.column(0), pa.array(own, pa.list_(pa.int64()))]
                key += len(own)
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "node", "shingles"])

    some = nodes.select(F.col("node").alias("doc_id")).hint("merge")
    own = common.staged(docs.select("doc_id", "text").join(some, "doc_id", "left_semi").mapInArrow(sets, "key long, node long, shingles array<long>"), "sets")
    size = F.size("shingles")
    entries = own.select("key", "node", (size - F.ceil(size * percent / 100) + 1).alias("most"), F.explode("shingles").alias("bucket"))
    frequent = entries.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED)
    order = Window.partitionBy("key").orderBy(F.coalesce("n", F.lit(0)), "bucket")
    ranked = entries.join(frequent, "bucket", "left").withColumn("rank", F.row_number().over(order))
    return ranked.where("rank <= most").select("node", "bucket").distinct()


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """bucket, node, hub, component, apart: whether it isn't in the component of the bucket's least node."""
    out = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_hub = out.where("node = hub").select("bucket", F.col("component").alias("hub_component")).distinct()
    return out.join(of_hub, "bucket").select("bucket", "node", "hub", "component", (F.col("component") != F.col("hub_component")).alias("apart"))


def _with_hubs(entries: DataFrame) -> DataFrame:
    """bucket, node, hub: of buckets of several nodes, with the least node."""
    hubs = entries.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").drop("top")
    return common.staged(entries.join(hubs, "bucket"), "members")


def uncrowded(labelled: DataFrame, found: DataFrame, rare) -> DataFrame:
    """The members of buckets (``_labelled``), where those of crowded buckets are dealt anew by their rare shingles."""
    crowded = common.staged(labelled.where("apart").groupBy("bucket").count().where(F.col("count") > CROWDED).select("bucket"), "crowded")
    if rare is None or not crowded.limit(1).count():
        return labelled
    nodes = common.staged(labelled.join(crowded, "bucket", "left_semi").select("node").distinct(), "nodes")
    by_shingle = _labelled(_with_hubs(rare(nodes)), found)
    return common.staged(labelled.join(crowded, "bucket", "left_anti").unionByName(by_shingle), "members")


def candidate_clusters(nodes: DataFrame, least: float, rare=None) -> DataFrame:
    """(node, component): nodes that a chain of shared buckets with an estimate of at least ``least`` connects.

    Each node meets the least node of each of its buckets; where that leaves a bucket in several components, those that
    aren't with it meet the nodes of the other components, in blocks of ``APART``. ``rare(nodes)`` gives shingles (node, bucket), by which
    those of crowded buckets meet."""
    members = _with_hubs(nodes.select("node", F.explode("bands").alias("bucket")))
    bits = lambda k: nodes.select(F.col("node").alias(k), F.col("bits").alias(f"bits_{k}"))
    near = bit_similarity("bits_a", "bits_b") >= least

    star = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    star = common.staged(star.join(bits("a"), "a").join(bits("b"), "b").where(near).select("a", "b"), "pairs")
    found = graph.connected_components(star)

    labelled = common.staged(_labelled(members, found).where("node <> hub"), "members")
    labelled = uncrowded(labelled, found, rare)
    # the apart nodes of a bucket are dealt into blocks, and what they meet goes to each block: the pairs of a bucket are spread over tasks
    apart = labelled.where("apart")
    sizes = apart.groupBy("bucket").agg(F.ceil(F.count("*") / APART).cast("int").alias("blocks"))
    left = apart.join(sizes, "bucket").select("bucket", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.col("node").alias("a"), F.col("component").alias("of_a"))
    right = labelled.join(sizes, "bucket").select("bucket", "blocks", F.col("node").alias("b"), F.col("component").alias("of_b")).join(bits("b"), "b")
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    across = left.join(bits("a"), "a").join(right, ["bucket", "block"]).where((F.col("of_a") != F.col("of_b")) & near)
    across = common.staged(across.select("a", "b").distinct(), "pairs")
    return graph.connected_components(star.unionByName(across)) if across.limit(1).count() else found


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents are linked if 100 * intersection >= percent * union."""
    signed = common.staged(signatures(docs), "minhash")
    named = signed.where("n_shingles > 0 and doc_id is not null")
    classes = named.groupBy("set_key").agg(F.min("doc_id").alias("node"))
    nodes = common.staged(
        named.join(classes, (named.set_key == classes.set_key) & (named.doc_id == classes.node)).select("node", "bands", "bits", "n_shingles"), "nodes"
    )
    rare = lambda some: rare_shingles(docs, some, percent)
    clusters = candidate_clusters(nodes, percent / 100 - MARGIN, rare).join(nodes.select("node", "n_shingles"), "node")
    found = graph.connected_components(common.staged(links_within(docs, clusters, percent), "links"))
    by_class = classes.join(found, "node", "left").select("set_key", F.coalesce("component", "node").alias("of_class"))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(by_class, "set_key", "left")
    component = F.coalesce("of_class", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows, with all columns, of one document of each component; of rows that share a doc_id, one."""
    gone = near_duplicates(docs, percent).where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = common.staged(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "repeated")
    if not repeated.limit(1).count():
        return left
    once = left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return left.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(once)


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir), percent=85)
