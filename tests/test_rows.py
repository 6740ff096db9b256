"""Row assembly, outcomes, ingest and its idempotence."""

from __future__ import annotations

import itertools

import pytest

from pyspark.sql import functions as F

from rankloom.operators import aggregates as ag
from rankloom.operators import joins as jn
from rankloom.operators import outcome as oc
from rankloom.operators import rows as rw
from rankloom.sources import io
from rankloom.streaming import ingest


def raw(spark, *cells, page=2):
    return spark.createDataFrame([("f", page, 0, i, list(c)) for i, c in enumerate(cells)], rw.RAW)


def test_continuations_headers_and_orphans(spark):
    df = raw(spark, ["orphan", None], ["SNo", "Rank"], ["1", "10", "AI", "Inst A,", "M.D."], [None, None, None, "Delhi", "(Anatomy)"], ["Sl.No", "x"], [None, None, None, "110001"], ["2", "20", "AI", " Inst  B ", "MD"])
    got = rw.logical_rows(df, "r1").orderBy("row_idx").collect()
    assert [(r["sno"], r["rank"], r["institute"], r["course"]) for r in got] == [("1", "10", "Inst A, Delhi 110001", "M.D. (Anatomy)"), ("2", "20", "Inst B", "MD")]


def test_phantom_columns(spark):
    thirteen = [str(i) if i != 6 else None for i in range(13)]
    seventeen = ["0", "1", None, *[str(i) for i in range(3, 17)]]
    df = spark.createDataFrame([(thirteen, seventeen)], "a array<string>, b array<string>")
    r = df.select(rw.drop_phantom_r2(F.col("a")), rw.drop_phantom_r3(F.col("b"))).first()
    assert r[0] == [str(i) for i in range(13) if i != 6] and r[1] == [str(i) for i in range(17) if i != 2]
    same = [str(i) for i in range(18)]
    df = spark.createDataFrame([(same,)], "b array<string>")
    assert df.select(rw.drop_phantom_r3(F.col("b"))).first()[0] == same
    assert len(df.select(rw.fit_width(rw.drop_phantom_r3(F.col("b")), 16)).first()[0]) == 16


def test_lines_round_half_to_even(spark):
    df = spark.createDataFrame([(1, 5.0, 2.5, "b"), (1, 1.0, 1.0, "a"), (1, 0.0, 7.5, "c")], "page_num int, x0 double, top double, word string")
    assert {(r.line, r.text) for r in rw.assemble_lines(df, ["x0"]).collect()} == {(0, "a b"), (10, "c")}


R2 = [
    ("Reported", "Upgraded", "UPGRADED"), ("Reported", "No Upgradation", "RETAINED"), ("Reported", "", "RETAINED"), ("Not Reported", "Fresh Allotted in 2nd Round", "FRESH"),
    ("Not Reported", "Not Allotted", "NOT_ALLOTTED"), ("not reported", "Did not fill up fresh choices", "LOST"), ("Seat Surrendered", "", "LOST"), ("Seat Surrendered", "fresh allotted", "FRESH"),
    ("Seat Surrendered", "Not Allotted", "NOT_ALLOTTED"), ("-", "Not Allotted", "NOT_ALLOTTED"), (None, "Fresh Allotted", "FRESH"), ("-", "Upgraded", "UNKNOWN"), (None, None, "UNKNOWN"),
]


def test_outcomes_of_round_two(spark):
    df = spark.createDataFrame([(a, b, c) for a, b, c in R2], "s string, r string, want string")
    assert all(r.want == r.got for r in df.withColumn("got", oc.outcome_r2(F.col("s"), F.col("r"))).collect())


def test_outcomes_of_round_three(spark):
    rows = [
        ("Reported", "Upgraded", True, True, "UPGRADED"), (None, "Fresh Allotted", True, False, "FRESH"), (None, "?", True, False, "UPGRADED"), (None, "-", False, True, "RETAINED"),
        ("Reported", "-", False, False, "RETAINED"), ("Not Reported", "-", False, False, "NOT_ALLOTTED"), ("-", "-", False, False, "NOT_ALLOTTED"), ("else", "-", False, False, "UNKNOWN"),
    ]
    df = spark.createDataFrame(rows, "a string, c string, h3 boolean, h2 boolean, want string")
    assert all(r.want == r.got for r in df.withColumn("got", oc.outcome_r3(F.col("a"), F.col("c"), F.col("h3"), F.col("h2"))).collect())


def test_facts_of_each_layout(spark):
    r2 = ["12", "AI", "Old Hospital, Delhi", "MD X", "Reported", "AI", "New Hospital, Pune 411001", "M.S. (Ortho)", "UR", "UR", "3", "Upgraded"]
    kept = ["13", "AI", "Old Hospital, Delhi", "MD X", "Reported", "-", "-", "-", "-", "-", "-", "No Upgradation"]
    facts = {r["rank"]: r for r in ingest.facts(raw(spark, ["Rank", "x"], r2, kept), 2025, 2).collect()}
    assert facts[12]["seat_outcome"] == "UPGRADED" and facts[12]["institute_name"] == "New Hospital" and facts[12]["allotted_category_norm"] == "GEN" and facts[12]["option_code"] == "3"
    assert facts[13]["seat_outcome"] == "RETAINED" and facts[13]["institute_name"] == "Old Hospital" and facts[13]["allotted_category_norm"] is None and facts[13]["course_norm"] == "MD X"
    r3 = ["14", *["-"] * 15]
    (row,) = ingest.facts(raw(spark, r3, page=5), 2025, 3).collect()
    assert row["seat_outcome"] == "NOT_ALLOTTED" and row["institute_name"] is None and row["course_norm"] is None
    (one,) = ingest.facts(raw(spark, ["1", "1,500", "??", "X Institute, Goa", "MD Y", "??", "", "note"]), 2025, 1).collect()
    assert (one["sno"], one["rank"], one["quota_norm"], one["allotted_category_norm"], one["state"]) == (1, 1500, "UNKNOWN", "UNKNOWN", "Goa")


def test_page_range(spark, tmp_path):
    rows = spark.createDataFrame([("f", p, 0, 0, ["1"]) for p in range(1, 9)], rw.RAW)
    rows.write.parquet(str(tmp_path / "raw"))
    pages = lambda **k: sorted(r.page_num for r in io.read_raw(spark, str(tmp_path / "raw"), **k).collect())
    assert pages(layout="r1") == list(range(2, 9)) and pages(layout="r3") == list(range(4, 9))
    assert pages(layout="r1", start=3, test_pages=2) == [3, 4] and pages(layout="r1", end=5) == [2, 3, 4, 5]


def test_stream_resumes_and_replays_without_duplicates(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    make = lambda batch: ingest.facts(batch, 2025, 1).select(*ingest.FACT_KEY, "rank")
    def arrive(*ranks):
        raw(spark, *[[str(i + 1), str(r), "AI", "Inst", "MD", "UR", "UR", ""] for i, r in enumerate(ranks)]).write.mode("append").parquet(source)
    def run(name):
        ingest.ingest_stream(spark, source, rw.RAW, make, target, str(tmp_path / name), ingest.FACT_KEY, str(tmp_path / "progress")).awaitTermination()
        return sorted(r["rank"] for r in spark.read.parquet(target).collect())
    arrive(10, 20)
    assert run("c1") == [10, 20]
    arrive(10, 30)
    assert run("c1") == [10, 20, 30]
    assert run("c2") == [10, 20, 30]
    assert spark.read.parquet(str(tmp_path / "progress")).agg(F.sum("rows_read")).first()[0] == 8


def test_appending_treats_null_keys_as_equal(spark):
    target = spark.createDataFrame([(1, None), (2, "a")], "k int, s string")
    batch = spark.createDataFrame([(1, None), (2, None), (2, None), (2, "a")], "k int, s string")
    assert [tuple(r) for r in jn.anti_append(target, batch, ["k", "s"]).collect()] == [(2, None)]


def test_asof_backfill_takes_the_last_value_before(spark):
    rows = [(1, 1, "x", None), (1, 2, "", "RETAINED"), (1, 3, None, "RETAINED"), (1, 2, "y", "LOST"), (2, 3, None, "RETAINED")]
    df = spark.createDataFrame(rows, "rank int, round int, v string, seat_outcome string")
    got = jn.asof_backfill(df, ["rank"], "round", ["v"], F.coalesce(F.col("seat_outcome") == "RETAINED", F.lit(False))).collect()
    assert sorted((r["rank"], r["round"], r["v"] or "") for r in got) == [(1, 1, "x"), (1, 2, "x"), (1, 2, "y"), (1, 3, "y"), (2, 3, "")]


def test_fill_missing_takes_the_whole_last_row(spark):
    base = spark.createDataFrame([(1, None, "b0"), (2, "", None)], "k int, a string, b string")
    staging = spark.createDataFrame([(1, "a1", "b1", 1), (1, None, "b2", 2), (1, None, None, 3), (2, "a3", None, 1)], "k int, a string, b string, seq int")
    got = sorted(tuple(r) for r in jn.fill_missing(base, staging, "k", ["a", "b"], "seq").collect())
    assert got == [(1, None, "b0"), (2, "a3", None)]


def test_csv_json_and_schema(spark, tmp_path):
    df = spark.createDataFrame([('a "q"', None), ("b,c", 0)], "s string, n int")
    io.write_csv(df, str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in io.read_csv_table(spark, str(tmp_path / "csv"), "s string, n int").collect() if r.s) == [('a "q"', None), ("b,c", 0)]
    io.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    from pyspark.sql import types as T

    wide = io.conform(df, T.StructType([T.StructField("n", T.LongType()), T.StructField("new", T.StringType())]))
    assert wide.columns == ["n", "new"] and wide.schema["n"].dataType == T.LongType()


def test_copy_table_resumes(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    props = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "id int, name string")
    try:
        io.copy_table(spark, url, "t", rows.where("id < 3"), ["id"], "fresh", props)
    except Exception as e:  # the driver's database jar is optional
        pytest.skip(str(e)[:80])
    io.copy_table(spark, url, "t", rows, ["id"], "resume", props)
    assert sorted(r[0] for r in spark.read.jdbc(url, "t", properties=props).select("id").collect()) == list(itertools.chain(range(5)))


def test_backfill_takes_one_exchange(spark):
    """One shuffle on the candidate, the fact computed once, no join."""
    df = spark.range(10).selectExpr("id as rank", "id as round", "cast(id as string) as v", "'RETAINED' as seat_outcome")
    plan = jn.asof_backfill(df, ["rank"], "round", ["v"], F.lit(True))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_drill_down_pushes_its_filters(spark, tmp_path):
    """Filters on typed columns reach the scan of a fact table, which has only the columns of the key."""
    from types import SimpleNamespace

    from rankloom.plans import grid

    rows = [(1995, "AIQ", None, "X", "1", "C", "N", "O", 1, 7), (1995, "AIQ", "", "X", "1", "C", "N", "O", 1, 9), (1996, "AIQ", None, "X", "1", "C", "N", "O", 1, 8)]
    names = "year int, counselling_type string, counselling_state string, institute_name string, institute_pincode string, course_norm string, quota_norm string, allotted_category_norm string, round int, rank long"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "fact"))
    fact = spark.read.parquet(str(tmp_path / "fact"))
    key = {"y": "1995", "ct": "AIQ", "cs": "", "i": "X", "ip": "1", "c": "C", "q": "N", "a": "O", "r": "1"}
    got = grid.drill_down(SimpleNamespace(allot=fact), key)
    assert [(r["rank"], r["is_closing"]) for r in got.collect()] == [(7, False), (9, True)]
    assert "EqualTo(year,1995)" in spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")


def test_numbers_follow_the_order(spark):
    rows = [(None if k % 50 == 7 else "same" if k % 3 == 0 else f"n{k * 37 % 101:03d}", k) for k in range(400)]
    df = spark.createDataFrame(rows, "name string, k int")
    got = sorted(ag.numbered(df, [F.col("name")]).collect(), key=lambda r: r["no"])
    assert [r["no"] for r in got] == list(range(1, 401))
    assert [r["name"] for r in got] == sorted((r[0] for r in rows), key=lambda n: (n is not None, n or ""))
    assert sorted(r["k"] for r in got) == list(range(400))
    assert ag.numbered(df.where("k < 0"), [F.col("name")]).collect() == []


def test_a_batch_goes_in_slices(spark, tmp_path, monkeypatch):
    """A batch of many rows is ingested slice by slice: continuations stay with their rows, rows of other slices aren't added again, and nothing
    but the facts is left on the disk, neither of what was staged nor of what was shuffled."""
    from rankloom.sources import workspace

    def one(i):
        page = [f"f{i % 3}", 2 + i // 6, i % 2]
        cells = [str(i), str(100 + i // 2), "AI", f"Inst {i}", "M.D.", "UR", "UR", "-"]
        return [(*page, 10 * i, cells), (*page, 10 * i + 1, [None, None, None, "Goa", *[None] * 4]), ("again", *page[1:], 10 * i, cells)]

    rows = [r for i in range(120) for r in one(i)]
    source, target, shared = f"{tmp_path}/raw", f"{tmp_path}/facts", f"{tmp_path}/shared"
    spark.createDataFrame(rows, rw.RAW).write.parquet(source)
    monkeypatch.setattr(workspace, "shared_root", lambda spark: f"file://{shared}")
    monkeypatch.setattr(ingest, "SLICE", 130)
    sizes, key = [], "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def make(batch):
        sizes.append(batch.count())
        assert batch.sparkSession.conf.get(key) == "true"
        return ingest.facts(batch, 2025, 1, stage=True)

    kept = spark.conf.get(key, None)
    for name in ("first", "forced"):
        ingest.ingest_stream(spark, source, rw.RAW, make, target, f"{tmp_path}/{name}", ingest.FACT_KEY, apart=rw.TABLE).awaitTermination()
        got = spark.read.parquet(target).select("sno", "institute_raw").collect()
        assert sorted(map(tuple, got)) == sorted((i, f"Inst {i}{end}") for i in range(120) for end in ("", " Goa"))
    assert len(sizes) >= 4 and sum(sizes) == 2 * len(rows) and max(sizes) < len(rows)
    assert not list((tmp_path / "shared").rglob("*.parquet")) and spark.conf.get(key, None) == kept
