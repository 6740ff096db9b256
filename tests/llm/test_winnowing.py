"""Winnowing against a brute-force search of windows, and the guarantee of shared spans."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from rankloom.llm import winnowing

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    """Rows (doc_id, n_words, n_hit, n_items, sha, contaminated), from all windows of all items."""
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def check(spark, docs, pairs, items):
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit("x")).withColumn("row", F.lit(1))
    got = winnowing.decontaminated(docs(pairs, True).withColumn("row", F.lit("x")).withColumn("words", F.lit(1)), bench).drop("item_ids").collect()
    want = brute(pairs, items)
    assert sorted((tuple(r) for r in got), key=str) == want
    return want


def test_windows_equal_brute_force(spark, docs):
    """Few words, so that chains repeat and tie; spans of 8 to 12 words of items at the ends and in the middle of documents."""
    rng = random.Random(11)
    vocabulary = ["a", "b", "c", "Dé", "e5"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([10, 11, 14, 40]))) for i in range(25)] + [(25, items_text := text(30)), (25, text(12)), (26, items_text)]
    pairs = []
    for i in range(120):
        w = items[rng.randrange(len(items))][1].split()
        k, n = rng.randrange(len(w)), rng.randint(8, 13)
        pairs.append((i, ", ".join([*text(rng.randint(0, 12)).split(), *w[k : k + n], *text(rng.randint(0, 12)).split()])))
    want = check(spark, docs, pairs, items)
    assert sum(r[5] for r in want) > 20 and sum(not r[5] for r in want) > 20


def test_short_items(spark, docs):
    items = [(1, "one"), (2, "two three"), (3, "A b C d e f g h i"), (4, "x " * 10), (5, ""), (6, None), (7, "!!"), (None, "four five six"), (2, "two, three")]
    pairs = [(1, "one and ONE"), (2, "two three two"), (3, "a b c d e f g h"), (4, "z a b c d e f g h i j"), (5, "x " * 25), (6, "x " * 9), (7, "four-five six"), (8, "three two")]
    want = check(spark, docs, pairs, items)
    assert [r[2] for r in want] == [2, 2, 0, 9, 25, 0, 3, 0]


def test_odd_rows(spark, docs, odd):
    check(spark, docs, odd, [(1, "the same row twice here now"), (2, "x " * 12), (3, "tie one two three four five six")])
    check(spark, docs, odd, [])
    assert winnowing.decontaminated(docs([]), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_every_shared_window_shares_a_fingerprint(spark):
    """The same ten words have the same fingerprints wherever they stand."""
    rng = random.Random(3)
    span = [rng.choice("abc") for _ in range(10)]
    texts = [(i, " ".join([*(rng.choice("abcd") for _ in range(rng.randint(0, 9))), *span, *(rng.choice("abcd") for _ in range(rng.randint(0, 9)))])) for i in range(50)]
    df = spark.createDataFrame([(-1, " ".join(span)), *texts], "doc_id long, text string")
    rows = df.select("doc_id", winnowing.words_of(F.col("text")).alias("w")).select("doc_id", F.transform(winnowing.fingerprints(F.col("w"), 10), lambda f: f["chain"]).alias("c")).collect()
    own = next(set(r.c) for r in rows if r.doc_id == -1)
    assert len(own) == 1 and all(own <= set(r.c) for r in rows)


def test_no_python_on_executors(spark):
    plan = winnowing.op12_winnowing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
