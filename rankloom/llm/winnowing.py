"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are hashed, and their chains of ``GRAM`` words. In each run of chains that makes up ``WINDOW`` words, the chain of the least hash is
a fingerprint (the last of equal ones), so that texts that share ``WINDOW`` words in a row share a fingerprint at the same place
of it. Fingerprints of documents meet those of benchmark items by a join, and each hit is extended word by word to both
sides; what reaches ``WINDOW`` words is a shared span. An item of fewer words is one window with one fingerprint, the chain of all of
its words; documents are looked up for chains of each such length, of which there are at most ``WINDOW - 1``.

Each fingerprint carries the words around it that a window with it can have, so that extending needs neither text again.
Before the join, a bit set of fixed greatest size drops chains of documents that no item has; it loses none. Texts are read once:
what is found is written to the shared folder with a number for each row, and that number is the key from there on.

Cases: null, empty or wordless text has no words and no hits; such an item has no window. Rows that share a doc_id, or have none, get
a row each. Rows of one item_id are one item; an item without id makes hits but isn't listed or counted. Without items no
document is hit; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .pii import let

WINDOW, GRAM = 10, 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of the set for each fingerprint, and its least and greatest size.
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 23


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _positions(n: Column) -> Column:
    """0 to n - 1; none if n isn't positive."""
    return F.slice(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(1), F.greatest(n, F.lit(0)))


def _chains(hashes: Column, length: int, window: int) -> Column:
    """Of word hashes: the hash of each chain, which also says of which kind of window it is."""
    return F.transform(_positions(F.size(hashes) - (length - 1)), lambda i: F.xxhash64(F.lit(window), *[F.get(hashes, i + d) for d in range(length)]))


def _is_least(chains: Column, p: Column, run: int) -> Column:
    """Whether the chain at p is the least, and of equal ones the last, of a run of chains that lies within the text."""
    own = F.get(chains, p)

    def reach(step: int, than) -> Column:
        far = F.lit(run - 1)
        for d in range(run - 1, 0, -1):
            far = F.when(than(F.get(chains, p + step * d)), far).otherwise(F.lit(d - 1))
        return far

    return reach(-1, lambda x: x >= own) + reach(1, lambda x: x > own) >= run - 1


def fingerprints(words: Column, window: int, known=None) -> Column:
    """Array of (window, chain, place, at, around): the fingerprints of windows of so many words, with the words around them, of which the
    one at ``at`` begins the chain. ``known``: a condition on the hash of a chain."""
    length = GRAM if window == WINDOW else window
    before = window - length

    def of(chains):
        held = _positions(F.size(chains))
        if known is not None:
            held = F.filter(held, lambda p: known(F.get(chains, p)))
        if before:
            held = F.filter(held, lambda p: _is_least(chains, p, before + 1))

        def shown(p):
            first = F.greatest(p - before, F.lit(0))
            around = F.slice(words, first + 1, p + window - first)
            return F.struct(F.lit(window).alias("window"), F.get(chains, p).alias("chain"), p.alias("place"), (p - first).alias("at"), around.alias("around"))

        return F.transform(held, shown)

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: let(_chains(hashes, length, window), of))


def item_fingerprints(benchmark: DataFrame) -> DataFrame:
    """window, chain, at, around, item_id of all items."""
    worded = benchmark.select("item_id", words_of(F.col("text")).alias("words"))
    short = F.array().cast("array<struct<window:int,chain:bigint,place:int,at:int,around:array<string>>>")
    own = F.when(F.size("words") >= WINDOW, fingerprints(F.col("words"), WINDOW))
    for n in range(1, WINDOW):
        own = own.when(F.size("words") == n, fingerprints(F.col("words"), n))
    found = worded.select("item_id", F.explode(own.otherwise(short)).alias("f"))
    return common.staged(found.select("f.window", "f.chain", "f.at", "f.around", "item_id").distinct(), "fingerprints")


def bit_set(items: DataFrame) -> tuple[Column, int]:
    """A set of bits, one of which each chain of an item sets, as an array of 64-bit integers, and its number of bits."""
    bits = LEAST_BITS
    wanted = items.count() * BITS_EACH
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    spark = items.sparkSession
    bit = F.pmod("chain", F.lit(bits))
    cells = items.groupBy(F.floor(bit / 64).alias("id")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(chain, {bits}) % 64 as int))")).alias("cell"))
    filled = spark.range(bits // 64).join(cells, "id", "left").select("id", F.coalesce("cell", F.lit(0).cast("long")).alias("cell"))
    # one row, of MOST_BITS / 64 numbers at most
    return filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "cell"))), lambda x: x["cell"]).alias("cells")).scalar(), bits


def _equal(a: Column, i: Column, b: Column, j: Column, steps: list[int]) -> Column:
    """How many of the steps in a row lead to equal words."""
    far = F.lit(len(steps))
    for k in range(len(steps) - 1, -1, -1):
        far = F.when(F.get(a, i + steps[k]) == F.get(b, j + steps[k]), far).otherwise(F.lit(k))
    return far


def hits(found: DataFrame, items: DataFrame) -> DataFrame:
    """row, start, end, item_id of the shared spans of at least a window, as far as the words around a fingerprint show them."""
    met = found.select("row", F.explode("found").alias("f")).select("row", "f.window", "f.chain", "f.place", F.col("f.at").alias("own_at"), F.col("f.around").alias("own")).join(items, ["window", "chain"])
    left = _equal(F.col("own"), F.col("own_at"), F.col("around"), F.col("at"), [-d for d in range(1, WINDOW - GRAM + 1)])
    right = _equal(F.col("own"), F.col("own_at"), F.col("around"), F.col("at"), list(range(WINDOW)))
    spans = met.select("row", "window", "place", "item_id", left.alias("left"), right.alias("right"))
    spans = spans.where((F.col("left") + F.col("right") >= F.col("window")) & (F.col("right") >= F.least(F.col("window"), F.lit(GRAM))))
    return spans.select("row", (F.col("place") - F.col("left")).alias("start"), (F.col("place") + F.col("right")).alias("end"), "item_id")


def _covered(spans: Column) -> Column:
    """The number of places in the union of spans, which come in order."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    add = lambda s, x: F.struct((s["n"] + F.greatest(x["end"] - F.greatest(x["start"], s["end"]), F.lit(0))).alias("n"), F.greatest(s["end"], x["end"]).alias("end"))
    return F.aggregate(spans, zero, add, lambda s: s["n"])


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the item_ids as an array."""
    items = item_fingerprints(benchmark)
    short = sorted(r[0] for r in items.where(F.col("window") < WINDOW).select("window").distinct().collect())  # at most WINDOW - 1 numbers
    cells, bits = bit_set(items)

    def known_of(held):
        return lambda chain: let(F.pmod(chain, F.lit(bits)), lambda b: F.getbit(F.get(held, F.floor(b / 64).cast("int")), (b % 64).cast("int")) == 1)

    worded = docs.select("doc_id", words_of(F.col("text")).alias("words"), cells.alias("cells"))
    found = let(F.col("cells"), lambda held: F.concat(*[fingerprints(F.col("words"), n, known_of(held)) for n in (WINDOW, *short)]))
    rows = common.staged(worded.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), found.alias("found")), "words")
    each = hits(rows.where(F.size("found") > 0), items).groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    each = each.select("row", _covered(F.array_sort("spans")).cast("long").alias("n_hit"), "item_ids")
    out = rows.select("row", "doc_id", "n_words").join(each, "row", "left")
    listed = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), listed.alias("item_ids"),
    )


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminated(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("item_ids")
