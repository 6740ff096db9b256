"""All registered queries of the seat operators against DuckDB on the smallest tables, and properties of plans."""

from __future__ import annotations

import math
import random

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

from pyspark.sql import functions as F

from rankloom import fixtures, queries
from rankloom.operators import aggregates as ag
from rankloom.operators import similarity as sm
from rankloom.plans import dims, grid

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in fixtures.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def cell(v):
    return "~" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    got = df.collect()
    if name not in queries.oracle_sql():
        assert len(got) > 0
        return
    want = duck.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    at = [want.columns.index(c) for c in order]
    assert sorted(tuple(cell(r[c]) for c in order) for r in got) == sorted(tuple(cell(r[i]) for i in at) for r in want.fetchall())


def test_grid_takes_one_exchange(spark):
    """The pivot groups once; profiles join to its groups."""
    plan = ag.pivot_rounds(spark.createDataFrame([], "year int, counselling_type string, counselling_state string, institute_name string, institute_pincode string, state string, course_norm string, quota_norm string, allotted_category_norm string, institute_city string, round int, rank int"))
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_counts_add_up(spark):
    cat = fixtures.Catalog(spark, DATA)
    total = grid.closing_ranks(cat, grid.RankFilters(), None).agg(F.sum(sum(F.col(f"r{r}_allotment_count") for r in (1, 2, 3, 4)))).first()[0]
    assert total == cat.allot.where("institute_name is not null and allotted_category_norm is not null").count()


def test_final_seats_are_rows_of_the_fact(spark):
    cat = fixtures.Catalog(spark, DATA)
    final = grid.allotments(cat, final_only=True, sort_by=None)
    assert final.exceptAll(cat.allot).count() == 0


@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_ratio_properties(a, b):
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]
    assert sm.common_length(a, b) == sm.common_length(b, a) == slow(a, b)


def test_names_are_matched(spark):
    inst = spark.createDataFrame([(1, "Grand Medical College", "Goa", "403001"), (2, "City Hospital", "Delhi", "110001"), (3, "City Hospital Annex", "Delhi", "110001")], "institute_code long, institute_name string, state string, pincode string")
    names = spark.createDataFrame([("grand medical college", "Goa", None), ("Citty Hospital", "Delhi", "110001"), ("Unrelated Place", None, None)], "name string, state string, pincode string")
    got = {r.name: (r.institute_code, r.match_confidence) for r in sm.match_names(names, inst).collect()}
    assert got["grand medical college"] == (1, "EXACT") and got["Unrelated Place"][1] == "UNKNOWN" and got["Citty Hospital"][0] in (2, None)


def test_similar_names_equal_brute_force(spark, monkeypatch):
    """Blocks of few names, names without a shared word beginning, ties and odd names."""
    monkeypatch.setattr(sm, "OWN_BLOCK", 7)
    monkeypatch.setattr(sm, "OTHER_BLOCK", 11)
    rng = random.Random(5)
    words = "grand medical college city hospital annex institut of sciences nagar".split()
    others = sorted({" ".join(rng.sample(words, rng.randint(1, 4))) for _ in range(60)} | {"", "é日本"})
    names = {"".join(c for c in o if rng.random() > 0.15) for o in others} | {"rgand emdical oclleg", "medicalcollege", "日本é", "zzz"}
    got = sm.fuzzy_topk(spark.createDataFrame([(n,) for n in names] + [("zzz",), (None,)], "name string"), spark.createDataFrame([(o, i) for i, o in enumerate(others)], "other string, idx long")).collect()
    ordered = lambda n: " ".join(sorted(n.split()))
    want = {}
    for n in names:
        every = sorted((-sm._ratio(ordered(n), ordered(o)), i) for i, o in enumerate(others))
        for score, i in [x for x in every if x[0] <= -50][:5]:
            want[n, i] = -score
    assert {(r.name, r.idx): r.score for r in got} == want and len(got) == len(want)
    assert any(n == "rgand emdical oclleg" for n, _ in want)


def test_lossless_join_compares_few_pairs(spark, monkeypatch):
    """Names of many colleges and towns: equal to all pairs, with a small part of them compared."""
    rng = random.Random(8)
    kinds = ["government medical college", "institute of medical sciences", "district hospital", "general hospital and research centre", "memorial dental college"]
    towns = ["".join(rng.choice(["ba", "ko", "ri", "mu", "den", "gal", "pur", "nag", "tri", "shi"]) for _ in range(rng.randint(2, 5))) for _ in range(160)]
    others = sorted({f"{rng.choice(kinds)} {rng.choice(towns)}" for _ in range(400)})
    names = {"".join(c for c in o if rng.random() > 0.04) for o in rng.sample(others, 60)} | {"zzz qqq", "x", ""}
    df, dim = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(o, i) for i, o in enumerate(others)], "other string, idx long")
    compared, alone = [], []
    found, every = sm.candidates, sm.exhaustive
    monkeypatch.setattr(sm, "candidates", lambda *a: compared.append(found(*a)) or compared[-1])
    monkeypatch.setattr(sm, "exhaustive", lambda left, *a: alone.append(left.count()) or every(left, *a))
    got = {(r.name, r.idx): r.score for r in sm.fuzzy_topk(df, dim).collect()}
    ordered = lambda n: " ".join(sorted(n.split()))
    want = {}
    for n in names:
        for score, i in [x for x in sorted((-sm._ratio(ordered(n), ordered(o)), i) for i, o in enumerate(others)) if x[0] <= -50][:5]:
            want[n, i] = -score
    assert got == want
    # a fifth of the others are of a name's kind and really similar
    assert alone[0] < 20 and all(c.count() < 0.27 * len(names) * len(others) for c in compared)


def test_numbered_names_meet_few_others(spark, monkeypatch):
    """Names that differ from all others by a few digits: the k best are found by what deletions leave, and no name is left to be compared with all."""
    others = [f"supplier {i:09d}" for i in range(0, 1200, 3)]
    names = {o[:12] + o[13:] for o in others[::7]} | {o[:-1] + "x" for o in others[::50]}
    monkeypatch.setattr(sm, "candidates", lambda *a: pytest.fail("pairs by bigrams"))
    monkeypatch.setattr(sm, "exhaustive", lambda *a: pytest.fail("all pairs"))
    got = sm.fuzzy_topk(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(o, i) for i, o in enumerate(others)], "other string, idx long")).collect()
    ordered = lambda n: " ".join(sorted(n.split()))
    want = {}
    for n in names:
        for score, i in sorted((-sm._ratio(ordered(n), ordered(o)), i) for i, o in enumerate(others))[:5]:
            want[n, i] = -score
    assert {(r.name, r.idx): r.score for r in got} == want and len(got) == len(want)


def test_near_names_are_the_best(spark):
    """Short texts over few letters, of many lengths, some longer than those whose deletions are tried: what is called sure equals all pairs."""
    rng = random.Random(11)
    text = lambda: "".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 3, 5, 6, 6, 7, 7, 7, 8, 8, 9, 22, 24, 25, 27])))
    others, names = sorted({text() for _ in range(250)}), {text() for _ in range(120)}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    for floor in (0.0, 50.0, 90.0):
        found, rest = sm.near(frame([(n, n) for n in names], "name string, sorted string"), frame([(o, i, o) for i, o in enumerate(others)], "other string, idx long, sorted string"), 3, floor)
        got, unsure = {(r.name, r.idx): r.score for r in found.collect()}, {r.name for r in rest.collect()}
        want = {}
        for n in names - unsure:
            for score, i in [x for x in sorted((-sm._ratio(n, o), i) for i, o in enumerate(others)) if x[0] <= -floor][:3]:
                want[n, i] = -score
        assert got == want and len(unsure) < len(names)


def test_names_meet_blocks_within_reach():
    """A name goes to each block with a text that is similar enough, and names unlike all texts go to none."""
    import pyarrow as pa

    rng = random.Random(3)
    text = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(0, 9)))
    blocks = [[text("abc") for _ in range(4)] for _ in range(20)] + [[text("xyz0") for _ in range(4)] for _ in range(20)] + [[f"{i:09d} supplier" for i in range(500)]]
    names = [text("abcxyz") for _ in range(60)] + ["", *[f"qqq{i}" for i in range(1000, 1040)]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int64()), pa.array(blocks)], names=["block", "words"])
    hulls = [h for b in sm._hulls([batch]) for h in b.to_pylist()]
    pair = pa.RecordBatch.from_pylist([{"names": [{"name": n, "sorted": n} for n in names], "hulls": hulls}])
    met = {(n["name"], r["block"]) for b in sm._reachable([pair], 50.0) for r in b.to_pylist() for n in r["names"]}
    want = {(n, i) for n in names for i, block in enumerate(blocks) if any(sm._ratio(n, o) >= 50 for o in block)}
    assert want <= met and not any(n.startswith("qqq") and i == len(blocks) - 1 for n, i in met) and len(met) < len(set(names)) * len(blocks) / 2


@given(st.text("abcd", min_size=2, max_size=14), st.text("abcd", min_size=2, max_size=14))
def test_bound_of_shared_bigrams(a, b):
    from collections import Counter

    shared = sum((Counter(zip(a, a[1:])) & Counter(zip(b, b[1:]))).values())
    ratio = sm._ratio(a, b)
    n = len(a)
    assert shared >= math.ceil((n + n * ratio / (200 - ratio)) * (3 * ratio / 200 - 1) - 1 - 1e-9)


def test_pages_after_keys_equal_offsets(spark):
    cat = fixtures.Catalog(spark, "/root/testdata/sf0.01")
    df, order = cat.inst.select("state", "institute_code", "bond_years"), ["bond_years", "state", "institute_code"]
    every = [tuple(r) for r in df.orderBy(*[F.col(c).asc_nulls_first() for c in order]).collect()]
    last, got = None, []
    while True:
        page = ag.page_after(df, order, last, 9)
        assert page.total == len(every) and page.pages == -(-len(every) // 9)
        if not page.rows:
            break
        assert [tuple(r) for r in page.rows] == every[len(got) : len(got) + 9]
        got += page.rows
        last = page.last(order)
    assert len(got) == len(every)


def test_unknown_sort_keys_are_errors(spark):
    with pytest.raises(ValueError):
        grid.closing_ranks(fixtures.Catalog(spark, DATA), grid.RankFilters(), "no such column")


def test_grid_queries_shuffle_the_fact_once(spark):
    """The registered queries: one exchange of the fact by the grid's keys; the profiles' tables go to the groups."""
    for name in ("a1_closing_rank_pivot", "f6_search", "f10_fee_range"):
        plan = queries.queries()[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
        by_name = [x for x in plan.splitlines() if "Exchange hashpartitioning(institute_name" in x]
        assert not by_name and plan.count("Exchange hashpartitioning(year") == 1, name


def test_groups_of_a_rank_drop_rows_before_the_shuffle(spark):
    plan = queries.queries()["f12_my_rank"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi, BuildRight" in plan and plan.count("lineitem") >= 1 and plan.count("Exchange hashpartitioning(year") == 1


def test_all_names_are_mapped(spark):
    assert queries.queries()["o11_name_mapping"](spark, DATA).count() == fixtures.Catalog(spark, DATA).inst.count()


def test_token_set_ratio(spark):
    df = spark.createDataFrame([("a b", "b a c"), ("", "a"), ("x y", "x y"), ("abc d", "abd d")], "a string, b string")
    got = [r[0] for r in df.select(sm.token_set_ratio(F.col("a"), F.col("b"))).collect()]
    assert got[:3] == [100.0, 0.0, 100.0] and 50 < got[3] < 100


def test_profiles_are_loaded(spark):
    pages = spark.createDataFrame([("d", 1, "College Name: Grand College.\nUniversity: U\nAnnual Fee: ₹ 1,20,000"), ("d", 2, "Stipend: 1st Year: 45,000")], "doc string, page_num int, text string")
    inst = spark.createDataFrame([(7, "GRAND COLLEGE")], "institute_code long, institute_name string")
    (r,) = dims.load_profiles(pages, inst).collect()
    assert (r.institute_code, r.annual_fee, r.stipend_yr1) == (7, "120000", "45000")


def test_institutes_are_built(spark):
    base = "institute_code int, institute_name string, address string, state string, pincode string"
    matched = spark.createDataFrame([(1, "A Hospital", "A Hospital, Main Road, Pune", "Maharashtra", "411001", "a", "EXACT"), (2, "B Hospital", "B, Goa", "Goa", "403001", "b", "REVIEW")], base + ", profile_name string, match_status string")
    seats = spark.createDataFrame([(1, "A Hospital", "x", "Maharashtra", "411001"), (2, "B", "y", "Goa", "403001"), (3, "C", "C, Thane", "Maharashtra", "400601")], base)
    profiles = spark.createDataFrame([("B Hospital Goa", "B, Goa", "403001"), ("Other", "far", "403001")], "college_name string, address_profile string, pincode string")
    got = {r.institute_code: r for r in dims.build_institutes(matched, profiles, seats, spark.createDataFrame([(2,)], "institute_code int")).collect()}
    assert {k: r.match_status for k, r in got.items()} == {1: "EXACT", 2: "OK_REVIEW", 3: "UNMATCHED"}
    assert got[2].profile_name == "B Hospital Goa" and got[1].display_name == "A Hospital, Pune"


def test_best_text_and_legacy_addresses(spark):
    rows = [("N", "N, Kamothe, Navi Mumbai, Maharashtra 410209", 1), ("N", "zz", 2)]
    df = spark.createDataFrame(rows, "institute_name string, institute_raw string, round int")
    (r,) = dims.legacy_addresses(df).collect()
    assert r.address == "Kamothe, Navi Mumbai"
    assert ag.best_text(df, "institute_name", "institute_raw", longest=True).first().best == rows[0][1]
