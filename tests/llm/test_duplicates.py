"""Near-duplicates and fingerprints against brute force."""

from __future__ import annotations

import os
import random
import re

import duckdb
import numpy as np

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm import graph, minhash, pivot_index, queries, spot_signatures


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset() if not words else frozenset([tuple(words)]) if len(words) < 5 else frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def components(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if linked(a, b) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(3000)]
    rows, k = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((k, " ".join(own)))
            k += 1
    return rows


def test_near_duplicates_are_those_of_brute_force(docs, odd):
    rows = corpus() + [(1000 + r[0], r[1]) for r in odd if r[0] is not None and r[0] != 9]
    sets = {k: shingles(t) for k, t in rows}

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return bool(sets[a]) and bool(sets[b]) and 100 * both >= 85 * len(sets[a] | sets[b])

    want = components(list(sets), linked)
    got = minhash.near_duplicates(docs(rows + [(None, rows[0][1])], clash=True), 85).collect()
    named = {r.doc_id: r for r in got if r.doc_id is not None}
    assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in named.items()} == {k: (len(sets[k]), want[k], want[k] == k) for k in sets}
    (nameless,) = [r for r in got if r.doc_id is None]
    assert nameless.component_id is None and nameless.kept


def test_no_documents_and_a_large_group(docs, monkeypatch):
    assert minhash.near_duplicates(docs([])).count() == 0
    base = [f"v{i}" for i in range(200)]
    rows = [(i, " ".join(base[: 190 + i % 10])) for i in range(60)]
    got = minhash.near_duplicates(docs(rows)).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_a_bucket_of_several_clusters_is_met_in_blocks(spark, monkeypatch):
    """The least node of a bucket is like none of its groups: each group still becomes one cluster."""
    monkeypatch.setattr(minhash, "APART", 3)
    rng = np.random.default_rng(5)
    groups = rng.integers(-(2**62), 2**62, (5, minhash.LONGS))
    bits = [rng.integers(-(2**62), 2**62, minhash.LONGS).tolist()] + [groups[i % 5].tolist() for i in range(40)]
    nodes = spark.createDataFrame([(i, [7], b) for i, b in enumerate(bits)], "node long, bands array<long>, bits array<long>")
    got = {r.node: r.component for r in minhash.candidate_clusters(nodes, 0.65).collect()}
    assert got == {i: (i - 1) % 5 + 1 for i in range(1, 41)}


def test_a_crowded_bucket_meets_by_rare_shingles(docs, spark, monkeypatch):
    """Texts around one passage share buckets and are apart: they are dealt to buckets that don't grow with their number, and no link is lost."""
    monkeypatch.setattr(minhash, "CROWDED", 8)
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(90):
        own = passage + [f"w{rng.randrange(10**6)}" for _ in range(40)]
        rows.append((i, " ".join(own)))
        if i % 9 == 0:  # a near copy
            rows.append((500 + i, " ".join(own[:-1] + ["other"])))
    sets = {k: shingles(t) for k, t in rows}
    want = components(list(sets), lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    seen = []
    real = minhash.uncrowded
    monkeypatch.setattr(minhash, "uncrowded", lambda labelled, *rest: seen.append((labelled, out := real(labelled, *rest))) or out)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(rows), 85).collect()}
    assert got == want and len(set(want.values())) == 90
    before, after = ([r["count"] for r in x.where("apart").groupBy("bucket").count().collect()] for x in seen[0])
    assert max(before) > 8 and max(after, default=0) <= 8


def test_keep_one_keeps_columns_and_one_of_each(docs):
    text = "one two three four five six seven"
    out = minhash.keep_one(docs([(2, text), (1, text), (1, text), (3, "other words in this text here"), (None, text)], clash=True))
    assert sorted((r.doc_id is None, r.doc_id) for r in out.collect()) == [(False, 1), (False, 3), (True, None)]
    assert "n_shingles" in out.columns


def test_bit_similarity_is_near_the_truth(spark):
    rng = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        n = 2000
        both = rng.integers(0, 2**63, int(n * share), np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 2**63, n - len(both), np.uint64)]) for _ in range(2))
        row = [(minhash.low_bits(minhash.minima(np.unique(x))).tolist()) for x in (a, b)]
        got = spark.createDataFrame([tuple(row)], "bits_a array<long>, bits_b array<long>").select(minhash.bit_similarity("bits_a", "bits_b")).first()[0]
        assert abs(got - share / (2 - share)) < 0.2


def test_block_comparison_equals_sets():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**62, 60, np.uint64))
    sets = [np.unique(np.concatenate([base[: 60 - i % 9], rng.integers(0, 2**62, i % 4, np.uint64)])) for i in range(40)]
    table = pa.table({"low": [0] * 40, "high": [1] * 40, "block": [i % 2 for i in range(40)], "node": list(range(40)), "shingles": [s.tobytes() for s in sets]})
    got = minhash.compare_blocks(table, 85)
    as_sets = [set(s.tolist()) for s in sets]
    want = components(range(40), lambda a, b: a % 2 != b % 2 and 100 * len(as_sets[a] & as_sets[b]) >= 85 * len(as_sets[a] | as_sets[b]))
    assert dict(zip(got.column("a").to_pylist(), got.column("b").to_pylist())) == {a: want[a] for a in got.column("a").to_pylist()}
    assert {a for a in range(40) if any(want[a] == want[b] for b in range(40) if b != a)} == set(got.column("a").to_pylist())


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(1, 20)] + [(30, 31), (40, 40), (None, 3), (50, 52), (52, 51)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 21)}, 30: 30, 31: 30, 50: 50, 51: 50, 52: 50}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_read_links_once(spark, monkeypatch):
    """A large star, a long chain and a star around the greatest node: later rounds have next to nothing left of the links."""
    held = []
    real = graph.common.staged
    monkeypatch.setattr(graph.common, "staged", lambda df, name: held.append((name, (out := real(df, name)).count())) or out)
    links = [(1, i) for i in range(2, 500)] + [(i, i + 1) for i in range(1000, 1400)] + [(2900, i) for i in range(2000, 2400)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 500)}, **{i: 1000 for i in range(1000, 1401)}, **{i: 2000 for i in [*range(2000, 2400), 2900]}}
    assert sum(n for name, n in held if name == "links") < 1.4 * len(links)


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def test_pivot_index_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    rows, k = [], 0
    for _ in range(60):
        centre = rng.standard_normal(16)
        for _ in range(rng.integers(1, 9)):
            rows.append((k, (centre + rng.standard_normal(16) * 0.06).astype("f4").tolist(), int(rng.integers(0, 2))))
            k += 1
    rows += [(k + 1, rows[0][1], rows[0][2]), (k + 2, rows[0][1], None), (k + 3, None, 1), (k + 4, [0.0] * 16, 1), (k + 5, [float("nan")] + [1.0] * 15, 1), (k + 6, [None] + [1.0] * 15, 1), (k + 7, [1.0, 2.0], 1), (k + 8, [], 1), (k + 9, [float("inf")] + [1.0] * 15, 1)]
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, label in rows if v and label is not None and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: x for i, _, x in rows}
    linked = lambda a, b: a != b and a in unit and b in unit and label[a] == label[b] and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= 0.98
    want = components([r[0] for r in rows], linked)
    got = pivot_index.near_duplicates(spark.createDataFrame(rows, VECTORS).withColumns({"node": F.lit(1), "degree": F.lit(2)})).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (sum(linked(i, j) for j in want), c, c == i) for i, c in want.items()}
    assert pivot_index.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_pivot_index_takes_other_types_and_repeated_ids(spark):
    """Labels of text, components in double precision, vec_ids of 32 bits; vec_id 1 stands for two vectors."""
    near, far = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, near, "a"), (1, far, "a"), (2, [1.0, 0.01], "a"), (3, near, "b"), (4, [0.01, 1.0], "a"), (5, far, "a"), (6, [-1.0, 0.0], "a"), (7, near, None)]
    got = pivot_index.near_duplicates(spark.createDataFrame(rows, "vec_id int, embedding array<double>, label string")).collect()
    assert sorted((r.vec_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (4, 1, False), (5, 1, False), (6, 6, True), (7, 7, True)]
    links = {(r.vec_id, r.n_links) for r in got}
    assert {(3, 0), (6, 0), (7, 0)} <= links and all(n > 0 for i, n in links if i in (1, 2, 4, 5))


def test_pivot_index_blocks(spark, monkeypatch):
    """A group of many blocks: counts add up."""
    monkeypatch.setattr(pivot_index, "BLOCK", 20)
    rng = np.random.default_rng(9)
    centre = rng.standard_normal(8)
    rows = [(i, (centre + rng.standard_normal(8) * 0.01).astype("f4").tolist(), 1) for i in range(100)]
    got = pivot_index.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    assert all(r.n_links == 99 and r.component_id == 0 for r in got)


def test_spot_signatures_by_hand():
    s = spot_signatures
    assert len(s.signatures("")) == 0 and s.fingerprint(s.signatures("")) == ""
    assert s.likeness(s.signatures(""), s.signatures("")) == 1.0 and s.likeness(s.signatures(""), s.signatures("word")) == 0.0
    a = "Storm over the northern coast brought heavy rain and strong wind to villages"
    assert s.fingerprint(s.signatures(a)) == s.fingerprint(s.signatures(a.upper().replace(" ", "  ") + "."))
    assert s.likeness(s.signatures(a), s.signatures(a + " of fishermen nearby today")) > 0.5
    assert s.likeness(s.signatures(a), s.signatures("Nothing in common with these other lines of text at all")) < 0.1
    assert s.likeness(np.arange(10, dtype=np.uint32), np.arange(100, dtype=np.uint32), 0.5) == 0.0
    assert len(s.signatures("x " * 10_000)) >= 1


def test_edited_texts(docs, odd):
    import hashlib

    rows = [(k, t) for k, t in odd if k is not None and k != 9] + [(100 + i, f"the story {i} of a town in the hills and its river {i * i}") for i in range(30)]
    ordered = sorted(rows, key=lambda r: -r[0])
    got = {r.doc_id: r for r in spot_signatures.compare_with_edited(docs(rows, clash=True)).collect()}
    assert len(got) == len(rows)
    for i, (k, t) in enumerate(ordered):
        own, after = t or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        r = got[k]
        a, b, c = (spot_signatures.signatures(x) for x in (own, edited, after))
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (spot_signatures.fingerprint(a), spot_signatures.fingerprint(b))
        assert (r.near_edited, r.near_next) == (spot_signatures.likeness(a, b), spot_signatures.likeness(a, c))


def test_edited_texts_with_repeated_and_missing_ids(docs, odd):
    assert spot_signatures.compare_with_edited(docs(odd)).count() == len(odd)
    assert spot_signatures.compare_with_edited(docs([])).count() == 0
    (alone,) = spot_signatures.compare_with_edited(docs([(1, "just one text here")])).collect()
    assert alone.near_next == 1.0


def test_spot_duplicates_are_those_of_brute_force(docs, odd, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rows = corpus(4) + [(1000 + r[0], r[1]) for r in odd if r[0] is not None and r[0] != 9]
    sets = {k: set(spot_signatures.signatures(t or "").tolist()) for k, t in rows}
    want = components(list(sets), lambda a, b: bool(sets[a]) and bool(sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    got = spot_signatures.near_duplicates(docs(rows + [(None, rows[0][1])], clash=True)).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert len({v for v in want.values()}) < len(want)
    assert spot_signatures.near_duplicates(docs([])).count() == 0


def cells(rows):
    return sorted(repr(tuple(r)) for r in rows)


def same_as_sql(spark, folder, name, table):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet{'/*.parquet' if os.path.isdir(f'{folder}/{table}.parquet') else ''}'")
    want = con.sql(queries.oracle_sql()[name])
    assert cells(queries.queries()[name](spark, folder).select(*want.columns).collect()) == cells(want.fetchall())


def test_op8_is_its_sql(spark):
    same_as_sql(spark, "/root/testdata/sf0.01", "op8_minhash_dedup", "documents")


def test_op7_is_its_sql(spark, tmp_path):
    same_as_sql(spark, "/root/testdata/sf0.01", "op7_pivot_index", "embeddings")
    rng = np.random.default_rng(3)
    rows = []
    for k in range(60):
        base = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 6))):
            v = base + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.12, 0.3])
            rows.append((len(rows), [float(np.float32(x)) for x in v], int(rng.integers(0, 2)) if k % 9 else None))
    rows += [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 16, 0), (1003, [0.0] * 16, 0), (1004, [float("nan")] * 16, 0), (1005, [1.0, None], 0), (1006, [float("inf")] * 16, 1), (1007, [1.0] * 3, 0), (1008, [2.0] * 3, 0)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    same_as_sql(spark, folder, "op7_pivot_index", "embeddings")
