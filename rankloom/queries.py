"""Registered queries of the seat-allotment operators, each with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixtures
from .functions import format as fm
from .functions import text as t
from .operators import aggregates as ag
from .operators import filters as fl
from .operators import joins as jn
from .operators import outcome as oc
from .operators import rows as rw
from .operators import similarity as sm
from .plans import dims, grid
from .plans.grid import RankFilters
from .sources import io
from .sources.workspace import fresh_dir
from .streaming.ingest import FACT_KEY, facts, ingest_once, ingest_stream, progress_of

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
TIE = ["l_linenumber", "l_partkey", "l_suppkey"]
ROW = ["rank", *TIE]


def query(name: str, sql: str | None = None, steps: str = ""):
    """``steps``: common tables of the SQL, after the views."""
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(fixtures.catalog(spark, sf_dir))
        if sql:
            ORACLE[name] = fixtures.oracle(sql, steps)
        return f
    return add


# SQL pieces ---------------------------------------------------------------------------------------------------------
KEYS = ", ".join(ag.GRID)
PER_ROUND = ", ".join(f"max(CASE WHEN round = {r} THEN rank END) AS r{r}_closing_rank, count(CASE WHEN round = {r} THEN 1 END) AS r{r}_allotment_count" for r in (1, 2, 3, 4))
REAL = r"CASE WHEN {c} IS NOT NULL THEN coalesce(try_cast(nullif(regexp_extract({c}, '^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)', 1), '') AS DOUBLE), CAST(0 AS DOUBLE)) END"
PROFILE = f"""SELECT m.db_institute_name AS institute_name, CAST(CASE WHEN match_confidence IN ('EXACT', 'FUZZY') THEN 1 ELSE 0 END AS INT) AS inst_matched,
 i.address AS institute_address, i.display_name AS institute_address_verified, i.pincode AS inst_pincode, {REAL.format(c='i.annual_fee')} AS inst_fee_yr1, {', '.join(f'i.{x} AS inst_{x}' for x in jn.PROFILE_COLUMNS)}
 FROM mapping m LEFT JOIN inst i ON m.institute_code = i.institute_code"""
PROFILE_COLS = "inst_matched, institute_address, institute_address_verified, inst_pincode, inst_fee_yr1, " + ", ".join(f"inst_{x}" for x in jn.PROFILE_COLUMNS)


def grid_sql(where: str = "true", after: str = "true") -> str:
    return f"""SELECT {KEYS}, institute_city, {", ".join(f"r{r}_closing_rank, r{r}_allotment_count" for r in (1, 2, 3, 4))}, {PROFILE_COLS}, coalesce(institute_pincode, inst_pincode) AS pincode_resolved
 FROM (SELECT {KEYS}, min(institute_city) AS institute_city, {PER_ROUND} FROM allot WHERE institute_name IS NOT NULL AND allotted_category_norm IS NOT NULL AND ({where}) GROUP BY {KEYS}) g
 LEFT JOIN ({PROFILE}) p USING (institute_name) WHERE {after}"""


def of_grid(name: str, f: RankFilters, where: str = "true", after: str = "true") -> None:
    query(name, grid_sql(where, after))(lambda c: grid.closing_ranks(c, f, None))


# closing-rank grid: filters, pivot, profile --------------------------------------------------------------------------
of_grid("a1_closing_rank_pivot", RankFilters())
of_grid("f1_f2_dims_national", RankFilters(year=1995, counselling_type="AIQ", counselling_state=""), "year = 1995 AND counselling_type = 'AIQ' AND counselling_state IS NULL")
of_grid("f2_counselling_state", RankFilters(counselling_state="NATION_3"), "counselling_state = 'NATION_3'")
of_grid("f3_in_lists", RankFilters(quota_norm=["A", "R"], allotted_category_norm=["F"], state=["NATION_1", "NATION_12", "NATION_18"]), "quota_norm IN ('A', 'R') AND allotted_category_norm = 'F' AND state IN ('NATION_1', 'NATION_12', 'NATION_18')")
of_grid("f4_course_like", RankFilters(course_norm=["promo"]), "course_norm ILIKE '%promo%'")
of_grid("f4_course_in", RankFilters(course_norm=["PROMO", "STANDARD"]), "course_norm IN ('PROMO', 'STANDARD')")
of_grid("f5_rank_range", RankFilters(rank_min=100, rank_max=20000), "rank BETWEEN 100 AND 20000")
of_grid("f6_search", RankFilters(search="blue"), "institute_name ILIKE '%blue%' OR course_norm ILIKE '%blue%' OR course_raw ILIKE '%blue%'")
of_grid("f7_course_type", RankFilters(course_type=["Clinical", "Para-Clinical"]), "course_norm IN (SELECT course_norm FROM courses WHERE course_type IN ('Clinical', 'Para-Clinical'))")
of_grid("f9_round_present", RankFilters(rounds=[2, 3]), after="r2_allotment_count > 0 OR r3_allotment_count > 0")
of_grid("f10_fee_range", RankFilters(fee_min=1000, fee_max=6000), after="inst_fee_yr1 >= 1000 AND inst_fee_yr1 <= 6000")
of_grid("f11_bond_range", RankFilters(bond_min=0, bond_max=50000), after=f"({REAL.format(c='inst_bond_forfeit')}) BETWEEN 0 AND 50000")
MINE = "EXISTS (SELECT 1 FROM allot a2 WHERE a2.rank {test} AND a2.year = allot.year AND a2.counselling_type = allot.counselling_type AND a2.institute_name = allot.institute_name AND a2.course_norm = allot.course_norm AND a2.quota_norm = allot.quota_norm AND a2.allotted_category_norm = allot.allotted_category_norm{more})"
of_grid("f12_my_rank", RankFilters(my_rank=33), MINE.format(test="= 33", more=""))
of_grid("f12_my_rank_round", RankFilters(my_rank=33, rounds=[1]), MINE.format(test="= 33", more=" AND a2.round = 1"), "r1_allotment_count > 0")


@query("p2_group_ids", f"""SELECT {KEYS}, {", ".join(
    "CASE WHEN r%d_allotment_count > 0 THEN translate(rtrim(to_base64(encode(concat('{\"a\":\"', coalesce(allotted_category_norm, ''), '\",\"c\":\"', coalesce(course_norm, ''), '\",\"cs\":\"', coalesce(counselling_state, ''), '\",\"ct\":\"', counselling_type, '\",\"i\":\"', institute_name, '\",\"ip\":\"', coalesce(institute_pincode, ''), '\",\"q\":\"', quota_norm, '\",\"r\":\"%d\",\"y\":\"', CAST(year AS VARCHAR), '\"}'))), '='), '+/', '-_') END AS r%d_group_id" % (r, r, r) for r in (1, 2, 3, 4))}
 FROM ({grid_sql()})""")
def _(c):
    return grid.with_group_ids(grid.closing_ranks(c, RankFilters(), None)).select(*ag.GRID, *[f"r{r}_group_id" for r in (1, 2, 3, 4)])


@query("p3_group_id_decode", f"SELECT coalesce(allotted_category_norm, '') AS a, coalesce(course_norm, '') AS c, coalesce(counselling_state, '') AS cs, counselling_type AS ct, institute_name AS i, coalesce(institute_pincode, '') AS ip, quota_norm AS q, '1' AS r, CAST(year AS VARCHAR) AS y FROM ({grid_sql()}) WHERE r1_allotment_count > 0")
def _(c):
    ids = grid.with_group_ids(grid.closing_ranks(c, RankFilters(), None)).select(fm.decode_group_id(F.col("r1_group_id")).alias("k"))
    return ids.where("k is not null").select("k.*")


DRILL = "SELECT rank, l_linenumber, l_partkey, l_suppkey, closing_rank, rank = closing_rank AS is_closing FROM (SELECT *, max(rank) OVER () AS closing_rank FROM allot WHERE year = 1995 AND counselling_type = 'AIQ' AND counselling_state IS NULL AND round = 1 AND institute_name = 'Supplier#000000001' AND institute_pincode = '100001' AND quota_norm = 'N' AND allotted_category_norm = 'O' AND course_norm = (SELECT min(course_norm) FROM allot WHERE year = 1995 AND counselling_type = 'AIQ' AND round = 1 AND institute_name = 'Supplier#000000001' AND quota_norm = 'N' AND allotted_category_norm = 'O'))"


@query("p4_drill_down", DRILL)
def _(c):
    f = {"year": 1995, "counselling_type": "AIQ", "round": 1, "institute_name": "Supplier#000000001", "quota_norm": "N", "allotted_category_norm": "O"}
    course = c.allot.where(fl.dim_eq(**f)).agg(F.min("course_norm")).first()[0]
    key = {"y": "1995", "ct": "AIQ", "cs": "", "r": "1", "i": f["institute_name"], "ip": "100001", "q": "N", "a": "O", "c": course or "none"}
    return grid.drill_down(c, key, TIE).select(*ROW, "closing_rank", "is_closing")


@query("t1_t5_grid_page", f"SELECT * FROM ({grid_sql()}) ORDER BY r1_closing_rank DESC NULLS LAST, {', '.join(k + ' NULLS FIRST' for k in ag.GRID)} LIMIT 50 OFFSET 50")
def _(c):
    return ag.paginate(grid.closing_ranks(c, RankFilters(), "r1_closing_rank", "desc"), 2, 50)


@query("t2_money_sort_page", f"SELECT * FROM ({grid_sql()}) ORDER BY {REAL.format(c='inst_bond_forfeit')} ASC NULLS LAST, {', '.join(k + ' NULLS FIRST' for k in ag.GRID)} LIMIT 100")
def _(c):
    return ag.paginate(grid.closing_ranks(c, RankFilters(), "inst_bond_forfeit"), 1, 100)


@query("t1_stipend_sort_page", f"SELECT * FROM ({grid_sql()}) ORDER BY {REAL.format(c='inst_stipend_yr1')} DESC NULLS LAST, {', '.join(k + ' NULLS FIRST' for k in ag.GRID)} LIMIT 100")
def _(c):
    return ag.paginate(grid.closing_ranks(c, RankFilters(), "inst_stipend_yr1", "desc"), 1, 100)


@query("f6_allotment_search", "SELECT rank, l_linenumber, l_partkey, l_suppkey FROM allot WHERE institute_name ILIKE '%city1_,%' OR course_norm ILIKE '%city1_,%' OR course_raw ILIKE '%city1_,%' OR institute_raw ILIKE '%city1_,%'")
def _(c):
    return grid.allotments(c, fl.search("city1_,", grid.ALLOTMENT_SEARCH), sort_by=None).select(*ROW)


@query("f6_institute_search", "SELECT institute_code FROM inst WHERE display_name ILIKE '%university 1%' OR institute_name ILIKE '%university 1%' OR address ILIKE '%university 1%' OR state ILIKE '%university 1%' OR pincode ILIKE '%university 1%' OR university ILIKE '%university 1%'")
def _(c):
    return grid.institutes(c, "university 1").select("institute_code")


@query("a12_page_totals", f"SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM ({grid_sql()})")
def _(c):
    return ag.page_totals(grid.closing_ranks(c, RankFilters(), None))


# allotment list ------------------------------------------------------------------------------------------------------
VALID = "(seat_outcome IS NULL OR seat_outcome NOT IN ('LOST', 'NOT_ALLOTTED'))"
ROWS = ", ".join(ROW)


@query("w1_final_seat", f"SELECT {ROWS}, round, seat_outcome FROM allot a WHERE {VALID} AND round = (SELECT max(b.round) FROM allot b WHERE b.rank = a.rank AND b.year = a.year AND b.counselling_type = a.counselling_type AND (b.seat_outcome IS NULL OR b.seat_outcome NOT IN ('LOST', 'NOT_ALLOTTED')))")
def _(c):
    return grid.allotments(c, final_only=True, sort_by=None).select(*ROW, "round", "seat_outcome")


@query("f13_valid_seats", f"SELECT {ROWS} FROM allot WHERE {VALID}")
def _(c):
    return c.allot.where(fl.valid_seat(F.col("seat_outcome"))).select(*ROW)


@query("t3_allotment_page", f"SELECT {ROWS}, round, institute_pincode FROM allot ORDER BY institute_pincode ASC NULLS FIRST, round, rank, l_linenumber, l_partkey, l_suppkey LIMIT 100 OFFSET 100")
def _(c):
    return ag.paginate(grid.allotments(c, sort_by="institute_pincode", tie=["round", *ROW]), 2, 100).select(*ROW, "round", "institute_pincode")


@query("s7_export_grid", f"SELECT quota_norm AS \"Quota\", allotted_category_norm AS \"Category\", state AS \"State\", institute_name AS \"Institute\", institute_pincode AS \"Pincode\", course_norm AS \"Course\", inst_fee_yr1 AS \"Fee\", nullif(inst_stipend_yr1, '') AS \"Stipend Y1\", nullif(inst_bond_years, '') AS \"Bond Years\", nullif(inst_bond_forfeit, '') AS \"Bond Penalty\", nullif(inst_beds, '') AS \"Beds\", {', '.join(f'r{r}_closing_rank AS \"CR 2025 R{r}\", nullif(r{r}_allotment_count, 0) AS \"R{r} Seats\"' for r in (1, 2, 3, 4))} FROM ({grid_sql()})")
def _(c):
    return grid.export_closing_ranks(grid.closing_ranks(c, RankFilters(), None), 2025)


@query("s8_export_allotments", "SELECT rank AS \"Rank\", round AS \"Round\", institute_name AS \"Institute\", institute_city AS \"City\", institute_pincode AS \"Pincode\", state AS \"State\", coalesce(nullif(course_norm, ''), course_raw, '') AS \"Course\", quota_norm AS \"Quota\", allotted_category_norm AS \"Category\", seat_outcome AS \"Outcome\", year AS \"Year\", counselling_type AS \"Counselling Type\" FROM allot")
def _(c):
    return grid.export_allotments(c.allot)


@query("f14_null_safe_key", f"SELECT {ROWS} FROM allot WHERE counselling_state IS NULL AND institute_pincode IS NULL")
def _(c):
    return c.allot.where(fl.null_safe_eq(F.col("counselling_state"), None) & fl.null_safe_eq(F.col("institute_pincode"), None)).select(*ROW)


@query("p6_row_keys", f"SELECT DISTINCT concat_ws('|', {', '.join(f'coalesce(CAST({c} AS VARCHAR), {chr(39) * 2})' for c in fm.ROW_FIELDS)}) AS row_key FROM allot")
def _(c):
    return c.allot.select(fm.row_key().alias("row_key")).distinct()


@query("j18_saved_rows", f"SELECT {ROWS}, row_key FROM (SELECT *, concat_ws('|', {', '.join(f'coalesce(CAST({c} AS VARCHAR), {chr(39) * 2})' for c in fm.ROW_FIELDS)}) AS row_key FROM allot) WHERE row_key IN (SELECT concat_ws('|', {', '.join(f'coalesce(CAST({c} AS VARCHAR), {chr(39) * 2})' for c in fm.ROW_FIELDS)}) FROM allot WHERE rank % 10 = 0)")
def _(c):
    keys = c.allot.where("rank % 10 = 0").select(fm.row_key().alias("row_key"))
    return jn.saved_rows(c.allot, keys, fm.row_key()).select(*ROW, "row_key")


@query("p5_p9_p10_p12_labels", f"""SELECT {ROWS}, coalesce(nullif(institute_name, ''), nullif(course_raw, ''), '—') AS shown, concat_ws('|', CAST(year AS VARCHAR), counselling_type, coalesce(nullif(counselling_state, ''), 'AIQ'), CAST(round AS VARCHAR)) AS dataset_key,
 concat_ws(' ', nullif(institute_city, ''), nullif(institute_pincode, '')) AS place, CASE WHEN round > 1 THEN concat(CAST(rank AS VARCHAR), '(', CAST(round AS VARCHAR), ')') ELSE '—' END AS label FROM allot""")
def _(c):
    return c.allot.select(*ROW, fm.shown_name(F.col("institute_name"), F.col("course_raw")).alias("shown"), fm.dataset_key(F.col("year"), F.col("counselling_type"), F.col("counselling_state"), F.col("round")).alias("dataset_key"),
                          fm.location_label(F.col("institute_city"), F.col("institute_pincode")).alias("place"), fm.rank_label(F.col("rank"), F.when(F.col("round") > 1, F.col("round"))).alias("label"))


@query("p11_s13_quarantine", f"SELECT {ROWS}, CASE WHEN year <= 1996 THEN 'year' WHEN round < 1 THEN 'round' WHEN counselling_type = 'STATE' AND nullif(counselling_state, '') IS NULL THEN 'state' END AS reason FROM allot WHERE year <= 1996")
def _(c):
    moved = c.allot.withColumn("shifted", F.col("year") + 4)
    _, bad = oc.split_valid(moved, fm.invalid_dims(F.col("shifted"), F.col("counselling_type"), F.col("counselling_state"), F.col("round")))
    row = F.from_json("row_data", ", ".join(f"{k} bigint" for k in ROW))
    return bad.select(row.alias("r"), F.col("error_msg").alias("reason")).select("r.*", "reason")


# facets and institutes ----------------------------------------------------------------------------------------------
@query("a4_facets", " UNION ".join(f"SELECT '{f}' AS facet, CAST({f} AS VARCHAR) AS value FROM allot WHERE counselling_type = 'AIQ' AND {f} IS NOT NULL AND CAST({f} AS VARCHAR) <> ''" for f in grid.FACETS))
def _(c):
    return grid.facets(c, counselling_type="AIQ", year=0)


@query("f19_type_ahead", "SELECT DISTINCT course_norm FROM courses WHERE lower(course_norm) LIKE '%an%'")
def _(c):
    return c.courses.where(fl.type_ahead(F.col("course_norm"), "AN")).select("course_norm").distinct()


@query("f15_f6_t4_institutes", "SELECT institute_code, institute_name, annual_fee FROM inst WHERE match_status IN ('EXACT', 'OK_REVIEW') AND (institute_name ILIKE '%1%' OR display_name ILIKE '%1%' OR address ILIKE '%1%' OR state ILIKE '%1%' OR pincode ILIKE '%1%' OR university ILIKE '%1%') ORDER BY annual_fee ASC NULLS FIRST, institute_code LIMIT 50")
def _(c):
    return ag.paginate(grid.institutes(c, "1", match_status=["EXACT", "OK_REVIEW"], sort_by="annual_fee"), 1, 50).select("institute_code", "institute_name", "annual_fee")


@query("f16_institute", "SELECT * FROM inst WHERE institute_code = 7")
def _(c):
    return fl.by_code(c.inst, 7)


@query("f20_f21_missing", "SELECT institute_code, (bond_years IS NULL OR bond_years IN ('', 'nan')) AS no_years, (bond_forfeit IS NULL OR bond_forfeit IN ('', 'nan')) AS no_bond, match_status <> 'EXACT' AS unmatched FROM inst")
def _(c):
    return c.inst.select("institute_code", t.is_missing(F.col("bond_years")).alias("no_years"), t.is_missing(F.col("bond_forfeit")).alias("no_bond"), fl.is_unmatched(F.col("match_status") == "EXACT").alias("unmatched"))


@query("n25_p7_p8_money", f"SELECT institute_code, {REAL.format(c='annual_fee')} AS fee, {REAL.format(c='bond_forfeit')} AS bond, printf('₹%.1fL', floor({REAL.format(c='bond_forfeit')} / 10000 + 0.5) / 10) AS lakh FROM inst")
def _(c):
    bond = t.sqlite_real(F.col("bond_forfeit"))
    return c.inst.select("institute_code", t.sqlite_real(F.col("annual_fee")).alias("fee"), bond.alias("bond"), fm.format_lakh(bond).alias("lakh"))


@query("p7_rupees", "SELECT institute_code, coalesce('₹' || CASE WHEN length(v) <= 3 THEN v WHEN length(v) <= 5 THEN v[:-4] || ',' || v[-3:] WHEN length(v) <= 7 THEN v[:-6] || ',' || v[-5:-4] || ',' || v[-3:] END, '—') AS fee FROM (SELECT institute_code, CASE WHEN annual_fee <> 'NA' THEN annual_fee END AS v FROM inst)")
def _(c):
    return c.inst.select("institute_code", fm.format_inr(F.col("annual_fee")).alias("fee"))


@query("a6_match_status", "SELECT match_status, count(*) AS n FROM inst GROUP BY match_status")
def _(c):
    return ag.freq(c.inst, "match_status")


@query("a7_bond_histogram", "SELECT CASE WHEN bond_forfeit IS NULL OR bond_forfeit = '' THEN 'Missing' WHEN CAST(bond_forfeit AS DOUBLE) = 0 THEN 'Zero' ELSE 'Has penalty' END AS bucket, count(*) AS n FROM inst GROUP BY 1")
def _(c):
    b = F.col("bond_forfeit")
    return ag.bucket_hist(c.inst, F.when(t.is_missing(b), "Missing").when(t.sqlite_real(b) == 0, "Zero").otherwise("Has penalty"))


@query("a8_coverage", "SELECT state, count(*) AS total, count(nullif(bond_years, '')) AS filled, max(nullif(bond_years, '')) AS greatest FROM inst GROUP BY state")
def _(c):
    return ag.coverage(c.inst, "state", "bond_years")


@query("a9_non_missing", "SELECT count(nullif(annual_fee, '')) AS annual_fee, count(nullif(bond_forfeit, '')) AS bond_forfeit, count(nullif(bond_years, '')) AS bond_years FROM inst")
def _(c):
    return ag.non_missing(c.inst, ["annual_fee", "bond_forfeit", "bond_years"])


@query("a5_group_count", "SELECT count(*) AS n_groups FROM (SELECT DISTINCT year, counselling_state, institute_pincode, quota_norm FROM allot)")
def _(c):
    return ag.group_count(c.allot, ["year", "counselling_state", "institute_pincode", "quota_norm"])


@query("a10_best_text", "SELECT institute_name, CASE WHEN length(trim(max(CASE WHEN round = 1 THEN course_raw END))) > 20 THEN max(CASE WHEN round = 1 THEN course_raw END) ELSE max(course_raw) END AS best FROM allot GROUP BY institute_name")
def _(c):
    return ag.best_text(c.allot, "institute_name", "course_raw")


@query("a11_ambiguous_names", "SELECT institute_name, count(DISTINCT coalesce(institute_city, '')) AS n_values FROM allot GROUP BY institute_name HAVING count(DISTINCT coalesce(institute_city, '')) > 1")
def _(c):
    return ag.ambiguous(c.allot, "institute_name", "institute_city")


@query("a13_ingest_summary", "SELECT concat_ws('|', CAST(year AS VARCHAR), counselling_type, coalesce(counselling_state, 'AIQ'), CAST(round AS VARCHAR)) AS dataset_key, count(CASE WHEN l_partkey % 3 = 0 THEN 1 END) AS inserted, count(CASE WHEN l_partkey % 3 = 1 THEN 1 END) AS skipped, count(CASE WHEN l_partkey % 3 = 2 THEN 1 END) AS errored, count(DISTINCT l_suppkey) AS pages, max(l_suppkey) AS last_page FROM allot GROUP BY 1")
def _(c):
    status = F.when(F.col("l_partkey") % 3 == 0, "inserted").when(F.col("l_partkey") % 3 == 1, "skipped").otherwise("errored")
    key = fm.dataset_key(F.col("year"), F.col("counselling_type"), F.col("counselling_state"), F.col("round"))
    return ag.ingest_summary(c.allot.select(key.alias("dataset_key"), status.alias("status"), F.col("l_suppkey").alias("page_num")))


@query("a14_courses_per_type", "SELECT course_type, count(*) AS n FROM courses GROUP BY course_type")
def _(c):
    return ag.freq(c.courses, "course_type")


@query("a15_dictionary", "SELECT DISTINCT course_raw FROM allot WHERE course_raw IS NOT NULL")
def _(c):
    return ag.dictionary(c.allot, "course_raw")


# joins, back-filling, sets -------------------------------------------------------------------------------------------
@query("j1_j2_profiles", f"SELECT n.institute_name, {PROFILE_COLS} FROM (SELECT DISTINCT institute_name FROM allot) n LEFT JOIN ({PROFILE}) p USING (institute_name)")
def _(c):
    return jn.enrich_profile(c.allot.select("institute_name").distinct(), c.mapping, c.inst)


HOLES = "SELECT rank, l_linenumber, l_partkey, l_suppkey, year, counselling_type, round, seat_outcome, " + ", ".join(f"CASE WHEN seat_outcome = 'RETAINED' THEN NULL ELSE {c} END AS {c}" for c in ("institute_name", "course_norm", "quota_norm")) + " FROM allot"


def _holes(c) -> DataFrame:
    gone = F.col("seat_outcome") == "RETAINED"
    return c.allot.select(*ROW, "year", "counselling_type", "round", "seat_outcome", *[F.when(~F.coalesce(gone, F.lit(False)), F.col(x)).alias(x) for x in ("institute_name", "course_norm", "quota_norm")])


@query("j6_backfill_round", f"""SELECT h.rank, h.l_linenumber, h.l_partkey, h.l_suppkey, {", ".join(f"CASE WHEN h.round = 2 AND h.seat_outcome = 'RETAINED' THEN coalesce(nullif(h.{x}, ''), s.{x}) ELSE h.{x} END AS {x}" for x in ("institute_name", "course_norm", "quota_norm"))}
 FROM ({HOLES}) h LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY year, counselling_type, rank ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM ({HOLES}) WHERE round = 1) WHERE rn = 1) s
 ON h.year = s.year AND h.counselling_type = s.counselling_type AND h.rank = s.rank""")
def _(c):
    return jn.backfill_from_round(_holes(c), ["institute_name", "course_norm", "quota_norm"], TIE).select(*ROW, "institute_name", "course_norm", "quota_norm")


@query("j7_asof_backfill", f"""SELECT h.rank, h.l_linenumber, h.l_partkey, h.l_suppkey, {", ".join(f"CASE WHEN h.seat_outcome = 'RETAINED' THEN coalesce(nullif(h.{x}, ''), s.{x}) ELSE h.{x} END AS {x}" for x in ("institute_name", "course_norm", "quota_norm"))}
 FROM ({HOLES}) h LEFT JOIN (SELECT year, counselling_type, rank, round, {", ".join(f"last_value({x} IGNORE NULLS) OVER w AS {x}" for x in ("institute_name", "course_norm", "quota_norm"))}
  FROM (SELECT year, counselling_type, rank, round, {", ".join(f"min(nullif({x}, '')) AS {x}" for x in ("institute_name", "course_norm", "quota_norm"))} FROM ({HOLES}) GROUP BY year, counselling_type, rank, round)
  WINDOW w AS (PARTITION BY year, counselling_type, rank ORDER BY round RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) s
 ON h.year = s.year AND h.counselling_type = s.counselling_type AND h.rank = s.rank AND h.round = s.round""")
def _(c):
    cols = ["institute_name", "course_norm", "quota_norm"]
    return jn.asof_backfill(_holes(c), ["year", "counselling_type", "rank"], "round", cols, F.coalesce(F.col("seat_outcome") == "RETAINED", F.lit(False))).select(*ROW, *cols)


@query("j8_s10_append_new", "SELECT c_custkey AS k, min(c_acctbal) AS v FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0) GROUP BY c_custkey")
def _(c):
    batch = c.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return jn.anti_append(c.orders.where("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("k")), batch.unionByName(batch), ["k"], ["v"])


@query("j9_u2_missing_courses", "SELECT DISTINCT course_norm FROM courses WHERE course_norm NOT IN (SELECT course_norm FROM allot WHERE rank < 2)")
def _(c):
    return jn.key_difference(c.courses.select("course_norm"), c.allot.where("rank < 2"), ["course_norm"])


@query("j10_used_courses", "SELECT course_norm, course_type FROM courses WHERE course_norm IN (SELECT course_norm FROM allot WHERE round = 4 AND year = 1995)")
def _(c):
    return jn.keep_used(c.courses, c.allot.where("round = 4 and year = 1995"), ["course_norm"]).select("course_norm", "course_type")


@query("j12_exact_names", "SELECT DISTINCT n.name, i.institute_code, CAST(100 AS INT) AS score FROM (SELECT DISTINCT upper(institute_name) AS name FROM allot) n JOIN inst i ON lower(regexp_replace(n.name, '[^a-zA-Z0-9]+', ' ', 'g')) = lower(regexp_replace(i.institute_name, '[^a-zA-Z0-9]+', ' ', 'g'))")
def _(c):
    names = c.allot.select(F.upper("institute_name").alias("name")).distinct()
    return jn.exact_name(names, c.inst, lambda x: t.fold_norm(x, None), "institute_code")


@query("j14_priority_join", "SELECT name, institute_code, CAST(p AS INT) AS priority FROM (SELECT CASE WHEN institute_code % 2 = 0 THEN institute_name ELSE lower(institute_name) END AS name, institute_code, CASE WHEN institute_code % 2 = 0 THEN 0 ELSE 1 END AS p FROM inst)")
def _(c):
    names = c.inst.select(F.when(F.col("institute_code") % 2 == 0, F.col("institute_name")).otherwise(F.lower("institute_name")).alias("name"))
    return jn.priority_join(names, c.inst, [lambda x: x, F.upper, lambda x: F.upper(F.regexp_replace(x, "[,.]", ""))], "institute_code")


@query("j15_bond_years_policy", "SELECT institute_code, coalesce(nullif(bond_years, ''), CASE WHEN n_nationkey % 3 <> 0 THEN CAST(n_nationkey % 5 + 1 AS VARCHAR) END) AS bond_years FROM inst JOIN nation ON n_name = state")
def _(c):
    policy = c.nation.select(F.col("n_name").alias("state"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey") % 5 + 1).alias("years"))
    return dims.fill_bond_years(c.inst, policy).select("institute_code", "bond_years")


@query("j16_fill_missing", "SELECT i.institute_code, coalesce(nullif(i.bond_forfeit, ''), s.c) AS bond_forfeit FROM inst i LEFT JOIN (SELECT ps AS institute_code, arg_max(c, q) AS c FROM (SELECT l_suppkey AS ps, p_name AS c, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS q FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY ps) s ON i.institute_code = s.institute_code")
def _(c):
    li = c.lineitem.join(c.part, F.col("l_partkey") == F.col("p_partkey"))
    staging = li.select(F.col("l_suppkey").cast("long").alias("institute_code"), F.col("p_name").alias("bond_forfeit"), (F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("q"))
    return jn.fill_missing(c.inst, staging, "institute_code", ["bond_forfeit"], "q").select("institute_code", "bond_forfeit")


@query("j19_first_attributes", "SELECT institute_name, arg_min(state, concat(state, '|', coalesce(institute_pincode, ''))) AS state FROM allot GROUP BY institute_name")
def _(c):
    return jn.first_attrs(c.allot, "institute_name", ["state", "institute_pincode"], ["state", "institute_pincode"]).select("institute_name", "state")


@query("s11_upsert_last", "SELECT c_nationkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS rn FROM customer) WHERE rn = 1")
def _(c):
    return jn.upsert_last(c.customer.select("c_nationkey", "c_custkey", "c_name"), ["c_nationkey"], "c_custkey").select("c_nationkey", "c_name")


@query("w5_keep_first", "SELECT quota_norm, year, min(rank) AS rank FROM allot GROUP BY quota_norm, year")
def _(c):
    return jn.keep_first(c.allot.select("quota_norm", "year", "rank"), ["quota_norm", "year"], ["rank"])


@query("u1_precedence_union", "SELECT institute_code, min(p) AS priority FROM (SELECT institute_code, CASE match_status WHEN 'EXACT' THEN 0 WHEN 'OK_REVIEW' THEN 1 ELSE 2 END AS p FROM inst UNION ALL SELECT institute_code, 2 FROM inst) GROUP BY institute_code")
def _(c):
    parts = [c.inst.where(F.col("match_status") == s).select("institute_code") for s in ("EXACT", "OK_REVIEW")] + [c.inst.select("institute_code")]
    return jn.precedence_union(parts, "institute_code").select("institute_code", F.col("part").alias("priority"))


@query("s5_approved_codes", "SELECT DISTINCT CAST(institute_code AS INT) AS institute_code FROM inst WHERE match_status = 'OK_REVIEW'")
def _(c):
    review = c.inst.select(F.concat(F.col("institute_code").cast("string"), F.lit(".0")).alias("institute_code"), F.when(F.col("match_status") == "OK_REVIEW", " ok ").otherwise("no").alias("judgement"))
    return io.approved_codes(review)


@query("s9_unmatched_report", "SELECT m.institute_name, p.state, CAST(row_number() OVER (ORDER BY m.institute_name) AS INT) AS no FROM (SELECT db_institute_name AS institute_name FROM mapping WHERE match_confidence = 'UNKNOWN') m LEFT JOIN (SELECT institute_name, min(state) AS state FROM allot GROUP BY institute_name) p USING (institute_name)")
def _(c):
    return io.unmatched_report(c.mapping, c.allot).select("institute_name", "state", "no")


@query("w3_top_seats", "SELECT rank, l_linenumber, l_partkey, l_suppkey, institute_name FROM (SELECT *, row_number() OVER (PARTITION BY institute_name ORDER BY rank, l_linenumber, l_partkey, l_suppkey) AS rn FROM allot) WHERE rn <= 5")
def _(c):
    return ag.topk(c.allot, ["institute_name"], [F.asc(x) for x in ROW], 5).select(*ROW, "institute_name")


@query("w4_d4_continuations", "SELECT page_num, base_no, string_agg(cell, ' ' ORDER BY row_idx) AS cell FROM (SELECT *, CAST(sum(CAST(is_base AS INT)) OVER (PARTITION BY page_num ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS base_no FROM turn_rows) WHERE base_no > 0 GROUP BY page_num, base_no")
def _(c):
    run = ag.continuation_id(c.turn_rows.where("row_idx is not null"), ["page_num"], "row_idx", "is_base").where("base_no > 0")
    cells = F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "cell"))), lambda s: s["cell"])
    return run.groupBy("page_num", "base_no").agg(F.array_join(cells, " ").alias("cell"))


@query("w6_page_pairs", "SELECT page_id, sha256(concat_ws(chr(10), url, lead(url) OVER (PARTITION BY page_id // 16 ORDER BY page_id))) AS paired FROM pages")
def _(c):
    return ag.pair_pages(c.pages.withColumn("doc", F.expr("page_id div 16")), ["doc"], "page_id", "url").select("page_id", F.sha2("paired", 256).alias("paired"))


@query("d7_lines", "SELECT page_num, CAST(round_even(top / 5, 0) * 5 AS BIGINT) AS line, string_agg(word, ' ' ORDER BY x0, l_linenumber, l_partkey, l_suppkey, word) AS text FROM word_boxes GROUP BY 1, 2")
def _(c):
    return rw.assemble_lines(c.word_boxes, ["x0", *TIE])


# scalars and outcomes -----------------------------------------------------------------------------------------------
@query("n1_n3_n4_n5_codes", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE l_linenumber % 4 WHEN 0 THEN 1234 WHEN 1 THEN 77 END AS INT) AS rank, nullif(trim(regexp_replace(quota_raw, '\\s+', ' ', 'g')), '') AS quota_clean,
 coalesce(trim(quota_raw) IN ('-', ''), true) AS dash, CASE l_partkey % 8 WHEN 0 THEN 'AIQ' WHEN 1 THEN 'AIQ' WHEN 2 THEN 'NRI' WHEN 3 THEN 'DNB' WHEN 4 THEN 'MNG' ELSE 'UNKNOWN' END AS quota,
 CASE l_suppkey % 6 WHEN 0 THEN 'GEN' WHEN 1 THEN 'GEN-PwD' WHEN 2 THEN 'OBC' WHEN 3 THEN 'SC-PwD' ELSE 'UNKNOWN' END AS category FROM raw_alias""")
def _(c):
    q = F.col("quota_raw")
    rows = jn.with_category(jn.with_quota(c.raw_alias, "quota_raw", "quota"), "category_raw", "category")
    return rows.select("l_orderkey", *TIE, t.safe_int(F.col("rank_raw")).alias("rank"), t.clean_cell(q).alias("quota_clean"), t.is_dash(q).alias("dash"), "quota", "category")


@query("n4_n5_codes_of_columns", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 8 WHEN 0 THEN 'AIQ' WHEN 1 THEN 'AIQ' WHEN 2 THEN 'NRI' WHEN 3 THEN 'DNB' WHEN 4 THEN 'MNG' ELSE 'UNKNOWN' END AS quota, CASE l_suppkey % 6 WHEN 0 THEN 'GEN' WHEN 1 THEN 'GEN-PwD' WHEN 2 THEN 'OBC' WHEN 3 THEN 'SC-PwD' ELSE 'UNKNOWN' END AS category FROM raw_alias")
def _(c):
    return c.raw_alias.select("l_orderkey", *TIE, t.norm_quota(F.col("quota_raw")).alias("quota"), t.norm_category(F.col("category_raw")).alias("category"))


@query("n6_n7_n10_places", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 4 WHEN 0 THEN 'Delhi' WHEN 1 THEN 'Odisha' WHEN 2 THEN 'Maharashtra' END AS state, CASE l_partkey % 4 WHEN 2 THEN '411001' END AS pincode, concat('Inst ', CAST(l_suppkey AS VARCHAR)) AS name, CASE l_partkey % 4 WHEN 2 THEN 'Pune' WHEN 3 THEN 'Nowhere' END AS city FROM raw_alias")
def _(c):
    fs = {"state": t.state_of, "pincode": t.pincode_of, "name": t.clean_institute, "city": t.city_of}
    return jn.over_dictionary(c.raw_alias, "institute_raw", fs).select("l_orderkey", *TIE, *fs)


@query("n11_n12_n13_courses", "SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(upper(concat(p_type, ' (', p_name, ')')), '[()\\[\\]]', ' ', 'g'), '[.,;:!?]', ' ', 'g'), '\\s+', ' ', 'g')) AS course, CAST(NULL AS VARCHAR) AS degree, 'Clinical' AS course_type FROM part")
def _(c):
    own = c.part.select("p_partkey", t.norm_course(F.concat("p_type", F.lit(" ("), "p_name", F.lit(")"))).alias("course"))
    return own.select("p_partkey", "course", t.split_course(F.col("course"))["degree"].alias("degree"), t.course_type(F.col("course")).alias("course_type"))


@query("n14_fingerprint", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, substr(sha256(concat_ws('|', '2025', '1', '', CAST(l_orderkey AS VARCHAR), coalesce(quota_raw, ''), coalesce(institute_raw, ''), '', coalesce(category_raw, ''))), 1, 40) AS fingerprint FROM raw_alias WHERE l_orderkey <> 0")
def _(c):
    fp = t.fingerprint(F.lit(2025), F.lit(1), None, F.col("l_orderkey"), F.col("quota_raw"), F.col("institute_raw"), F.lit(None).cast("string"), F.col("category_raw"))
    return c.raw_alias.where("l_orderkey <> 0").select("l_orderkey", *TIE, fp.alias("fingerprint"))


@query("n15_n16_n19_names", "SELECT institute_code, trim(regexp_replace(regexp_replace(lower(display_name), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm, CASE WHEN contains(lower(display_name), lower(state)) THEN display_name ELSE display_name || ', ' || state END AS shown FROM inst")
def _(c):
    return c.inst.select("institute_code", t.fold_norm(F.col("display_name"), None).alias("norm"), t.display_name(F.col("display_name"), F.col("state")).alias("shown"))


@query("n17_n22_n23_n30_numbers", "SELECT institute_code, coalesce(nullif(regexp_extract(annual_fee, '^(\\d+)$', 1), ''), '') AS pin, try_cast(CASE WHEN annual_fee <> 'NA' THEN annual_fee END AS DOUBLE) AS num, coalesce(regexp_matches(annual_fee, '^\\d+$'), false) AS numeric_text, nullif(bond_forfeit, '') AS bond FROM inst")
def _(c):
    fee = F.col("annual_fee")
    return c.inst.select("institute_code", t.to_pin(fee).alias("pin"), t.clean_num(fee).alias("num"), t.is_numeric_text(fee).alias("numeric_text"), t.safe_str(F.col("bond_forfeit")).alias("bond"))


@query("n24_page_fields", "SELECT page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title, nullif(trim(regexp_extract(html, '<html lang=\"([^\"]*)\"', 1)), '') AS lang FROM pages")
def _(c):
    return c.pages.select("page_id", t.fields_of(F.col("html"), {"title": r"<title>([^<]*)</title>", "lang": r'<html lang="([^"]*)"'}).alias("f")).select("page_id", "f.*")


@query("n26_state_patterns", "SELECT institute_code, CASE WHEN regexp_matches(lower(display_name), 'nation_7$') THEN 'Paris' WHEN contains(lower(display_name), 'nation_1') OR contains(lower(display_name), 'nation_3') THEN 'East' END AS region FROM inst")
def _(c):
    return c.inst.select("institute_code", t.state_by_patterns(F.col("institute_name"), F.col("display_name"), {"Paris": ["nation_7$"], "East": ["nation_1", "nation_3"]}).alias("region"))


@query("n20_dedup_segments", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 4 = 0 THEN 'a b,c' ELSE 'a b,c,A-B,' || CAST(l_partkey % 4 AS VARCHAR) END AS segments FROM raw_alias")
def _(c):
    parts = F.array(F.lit("a b"), F.lit("c"), F.lit("A-B"), F.when(F.col("l_partkey") % 4 == 0, F.lit("C")).otherwise((F.col("l_partkey") % 4).cast("string")))
    return c.raw_alias.select("l_orderkey", *TIE, F.array_join(t.dedup_segments(parts), ",").alias("segments"))


STATUS = "upper(trim(coalesce(r1_status, '')))"
REMARK = "upper(trim(coalesce(r2_remarks, '')))"


@query("o1_outcome_r2", f"SELECT rank, l_linenumber, l_partkey, l_suppkey, CASE WHEN {STATUS} = 'REPORTED' THEN CASE WHEN {REMARK} = 'UPGRADED' THEN 'UPGRADED' ELSE 'RETAINED' END WHEN {REMARK} LIKE '%FRESH ALLOT%' THEN 'FRESH' WHEN {REMARK} LIKE '%NOT ALLOTTED%' THEN 'NOT_ALLOTTED' WHEN {STATUS} IN ('NOT REPORTED', 'SEAT SURRENDERED') THEN 'LOST' ELSE 'UNKNOWN' END AS outcome FROM r2_remarks")
def _(c):
    return c.r2_remarks.select(*ROW, oc.outcome_r2(F.col("r1_status"), F.col("r2_remarks")).alias("outcome"))


@query("o2_outcome_r3", f"SELECT rank, l_linenumber, l_partkey, l_suppkey, CASE WHEN r2_institute = 'Inst' THEN CASE WHEN {REMARK} LIKE '%FRESH ALLOT%' THEN 'FRESH' ELSE 'UPGRADED' END WHEN l_partkey % 2 = 0 OR {STATUS} = 'REPORTED' THEN 'RETAINED' ELSE 'NOT_ALLOTTED' END AS outcome FROM r2_remarks")
def _(c):
    return c.r2_remarks.select(*ROW, oc.outcome_r3(F.col("r1_status"), F.col("r2_remarks"), ~t.is_dash(F.col("r2_institute")), F.col("l_partkey") % 2 == 0).alias("outcome"))


@query("o3_effective_seat_r2", f"SELECT rank, l_linenumber, l_partkey, l_suppkey, CASE WHEN {STATUS} = 'REPORTED' AND {REMARK} <> 'UPGRADED' THEN r1_status WHEN ({STATUS} = 'REPORTED' OR {REMARK} LIKE '%FRESH ALLOT%') AND r2_institute = 'Inst' THEN r2_institute END AS institute_raw FROM r2_remarks")
def _(c):
    none = F.lit(None).cast("string")
    df = c.r2_remarks.withColumn("seat_outcome", oc.outcome_r2(F.col("r1_status"), F.col("r2_remarks"))).withColumns({"r1_quota": none, "r1_course": none, "r1_institute": F.col("r1_status"), "institute": F.col("r2_institute"), **{x: none for x in ("quota", "course", "allotted_category", "candidate_category")}})
    return oc.effective_seat_r2(df).select(*ROW, "institute_raw")


@query("o5_fact_8", "SELECT CAST(l_linenumber AS INT) AS sno, CAST(1234 AS INT) AS rank, quota_raw, CASE l_partkey % 8 WHEN 0 THEN 'AIQ' WHEN 1 THEN 'AIQ' WHEN 2 THEN 'NRI' WHEN 3 THEN 'DNB' WHEN 4 THEN 'MNG' ELSE 'UNKNOWN' END AS quota_norm, concat('Inst ', CAST(l_suppkey AS VARCHAR)) AS institute_name, CASE l_partkey % 4 WHEN 0 THEN 'Delhi' WHEN 1 THEN 'Odisha' WHEN 2 THEN 'Maharashtra' END AS state, CASE l_suppkey % 6 WHEN 0 THEN 'GEN' WHEN 1 THEN 'GEN-PwD' WHEN 2 THEN 'OBC' WHEN 3 THEN 'SC-PwD' ELSE 'UNKNOWN' END AS allotted_category_norm FROM raw_alias WHERE l_linenumber % 4 = 0")
def _(c):
    rows = c.raw_alias.select(F.col("l_linenumber").cast("string").alias("sno"), F.col("rank_raw").alias("rank"), F.col("quota_raw").alias("quota"), F.col("institute_raw").alias("institute"), F.lit("M.D. (General Medicine)").alias("course"), F.col("category_raw").alias("allotted_category"), F.col("category_raw").alias("candidate_category"), F.lit("").alias("remarks")).where("rank = '1,234' or rank = 'Rank'")
    return oc.fact_8(rows, 2025).select("sno", "rank", "quota_raw", "quota_norm", "institute_name", "state", "allotted_category_norm")


@query("o9_course_dim", "SELECT DISTINCT course_norm, CAST(NULL AS VARCHAR) AS degree, course_norm AS specialty, 'Clinical' AS course_type FROM allot WHERE course_norm <> ''")
def _(c):
    return dims.build_courses(c.allot)


@query("o11_name_mapping")
def _(c):
    names = c.inst.select(F.concat(F.substring("institute_name", 1, 12), F.substring("institute_name", 14, 99)).alias("name"), "state", "pincode")
    return sm.match_names(names.dropDuplicates(["name"]), c.inst)


@query("j11_n27_block_best", "SELECT l.pincode, l.text_l, r.text_r, CAST(100 AS DOUBLE) AS score FROM (SELECT DISTINCT p_type AS pincode, array_to_string(list_reverse(string_split(p_name, ' ')), ' ') AS text_l, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS k FROM part) l JOIN (SELECT p_type AS pincode, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS k, min(p_name) AS text_r FROM part GROUP BY p_type, array_to_string(list_sort(string_split(p_name, ' ')), ' ')) r ON l.pincode = r.pincode AND l.k = r.k")
def _(c):
    left = c.part.select(F.col("p_type").alias("pincode"), F.array_join(F.reverse(F.split("p_name", " ")), " ").alias("text_l")).distinct()
    right = c.part.select(F.col("p_type").alias("pincode"), F.col("p_name").alias("text_r")).distinct()
    return sm.block_best(left, right, "pincode", "text_l", "text_r", "text_r")


@query("x1_x2_incremental_events", "SELECT DISTINCT * FROM events")
def _(c):
    return ingest_once(c.spark, c.events)


@query("d1_d6_logical_rows", "SELECT CAST(page_num AS INT) AS page_num, sno, institute FROM (SELECT page_num, base_no, max(CASE WHEN is_base THEN CAST(row_idx AS VARCHAR) END) AS sno, string_agg(CASE WHEN is_base THEN 'Inst ' ELSE 'more ' END || CAST(row_idx AS VARCHAR), ' ' ORDER BY row_idx) AS institute FROM (SELECT *, sum(CAST(is_base AS INT)) OVER (PARTITION BY page_num ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS base_no FROM turn_rows) WHERE base_no > 0 GROUP BY page_num, base_no)")
def _(c):
    text = F.concat(F.when(F.col("is_base"), F.lit("Inst  ")).otherwise(F.lit(" more ")), F.col("row_idx").cast("string"))
    cells = F.array(F.when(F.col("is_base"), F.col("row_idx").cast("string")), F.lit(None), F.lit(None), text)
    header = F.array(F.lit("SNo."), F.lit("Rank"))
    raw = c.turn_rows.select(F.lit("f").alias("file"), F.col("page_num").cast("int").alias("page_num"), F.lit(0).alias("table_idx"), (F.col("row_idx") * 2).cast("int").alias("row_idx"), cells.alias("cells"))
    headers = raw.withColumns({"row_idx": F.col("row_idx") + 1, "cells": header})
    return rw.logical_rows(raw.unionByName(headers), "r1").select("page_num", "sno", "institute")


@query("s1_page_range", "SELECT count(*) AS n, min(page_num) AS first_page, max(page_num) AS last_page FROM turn_rows WHERE page_num BETWEEN 2 AND 11")
def _(c):
    path = fresh_dir(c.spark, "raw")
    c.turn_rows.select(F.lit("f").alias("file"), F.col("page_num").cast("int").alias("page_num"), F.lit(0).alias("table_idx"), F.col("row_idx").cast("int").alias("row_idx"), F.array("cell").alias("cells")).write.parquet(path)
    rows = io.read_raw(c.spark, path, "r1", test_pages=10)
    return rows.agg(F.count("*").alias("n"), F.min(F.col("page_num").cast("long")).alias("first_page"), F.max(F.col("page_num").cast("long")).alias("last_page"))


@query("s4_csv_round_trip", "SELECT institute_code, institute_name, state, pincode FROM inst")
def _(c):
    path = fresh_dir(c.spark, "csv")
    io.write_csv(c.inst.select("institute_code", "institute_name", "state", "pincode"), path)
    return io.read_csv_table(c.spark, path, "institute_code bigint, institute_name string, state string, pincode string")


@query("s14_json_round_trip", "SELECT institute_code, display_name FROM inst")
def _(c):
    path = fresh_dir(c.spark, "json")
    io.write_json(c.inst.select("institute_code", "display_name"), path)
    return c.spark.read.schema("institute_code bigint, display_name string").json(path)


@query("s15_conform", "SELECT CAST(institute_code AS INT) AS institute_code, CAST(NULL AS DOUBLE) AS fee_yr1, state FROM inst")
def _(c):
    return io.conform(c.inst, T.StructType([T.StructField("institute_code", T.IntegerType()), T.StructField("fee_yr1", T.DoubleType()), T.StructField("state", T.StringType())]))


@query("f18_degree_filter", "SELECT rank, l_linenumber, l_partkey, l_suppkey FROM allot WHERE course_norm LIKE 'S%'")
def _(c):
    degrees = c.courses.select("course_norm", F.when(F.col("course_norm").startswith("S"), "MD").otherwise("MS").alias("degree"))
    return fl.degree_filter(c.allot, degrees, ["MD"]).select(*ROW)


@query("f22_u3_distinct_cities", "SELECT DISTINCT institute_city FROM allot WHERE institute_city IS NOT NULL AND institute_city <> ''")
def _(c):
    return c.allot.select("institute_city").where(fl.facet_guard(F.col("institute_city"))).distinct()


@query("f12_my_rank_at_least", "SELECT rank, l_linenumber, l_partkey, l_suppkey FROM allot WHERE " + MINE.format(test=">= 900", more=""))
def _(c):
    return fl.has_rank(c.allot, c.allot, 900, mode="at_least").select(*ROW)


@query("a3_closing_of_groups", "SELECT institute_name, course_norm, year, max(rank) AS closing_rank, count(*) AS n FROM allot GROUP BY institute_name, course_norm, year")
def _(c):
    return ag.closing(c.allot, ["institute_name", "course_norm", "year"])


@query("j17_dictionary_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE category_raw WHEN 'UR' THEN 'GEN' WHEN 'x' THEN 'other' ELSE 'UNKNOWN' END AS value FROM raw_alias")
def _(c):
    table = c.spark.createDataFrame([("UR", "GEN"), ("x", "other")], "key string, value string")
    return jn.lookup(c.raw_alias, "category_raw", table, "UNKNOWN").select("l_orderkey", *TIE, "value")


@query("n18_n21_addresses", "SELECT institute_code, 'Town ' || state AS city, 'Town ' || state AS address FROM inst")
def _(c):
    name, raw = F.col("institute_name"), F.concat("institute_name", F.lit(", Town "), "state", F.lit(", Karnataka, 560001"))
    return c.inst.select("institute_code", t.city_from_address(name, raw).alias("city"), t.clean_address(name, raw).alias("address"))


@query("n29_composite", "SELECT institute_code, score, CASE WHEN core >= 90 THEN 'EXACT' WHEN core >= 85 AND score >= 90 THEN 'FUZZY' ELSE 'UNKNOWN' END AS confidence FROM (SELECT institute_code, core, core + CASE WHEN bond_years IS NULL THEN 0 WHEN bond_years = '2' THEN 10 ELSE -20 END + CASE WHEN pincode = '100007' THEN 15 ELSE -10 END AS score FROM (SELECT *, CAST(80 + institute_code % 20 AS DOUBLE) AS core FROM inst))")
def _(c):
    core = (F.col("institute_code") % 20 + 80).cast("double")
    score = sm.composite(core, F.col("bond_years"), F.lit("2"), F.col("pincode"), F.lit("100007"))
    return c.inst.select("institute_code", score.alias("score"), sm.confidence(core, score).alias("confidence"))


@query("n27_n28_ratios")
def _(c):
    names = c.part.select("p_name", F.reverse("p_name").alias("other")).distinct()
    return names.select("p_name", sm.token_sort_ratio(F.col("p_name"), F.col("other")).alias("sorted"), sm.token_set_ratio(F.col("p_name"), F.col("other")).alias("shared"))


@query("o4_effective_seat_r3", f"SELECT rank, l_linenumber, l_partkey, l_suppkey, CASE WHEN r2_institute = 'Inst' THEN r2_institute END AS institute_raw FROM r2_remarks")
def _(c):
    none = F.lit(None).cast("string")
    df = c.r2_remarks.withColumn("seat_outcome", oc.outcome_r3(F.col("r1_status"), F.col("r2_remarks"), ~t.is_dash(F.col("r2_institute")), F.lit(False)))
    df = df.withColumns({"institute": F.col("r2_institute"), **{x: none for x in ("quota", "course", "allotted_category", "candidate_category")}})
    return oc.effective_seat_r3(df).select(*ROW, "institute_raw")


@query("o6_fact_12", f"SELECT rank, seat_outcome, CASE WHEN seat_outcome = 'RETAINED' THEN 'Older' WHEN seat_outcome IN ('UPGRADED', 'FRESH') AND r2_institute = 'Inst' THEN 'Inst' END AS institute_name FROM (SELECT CAST(rank AS INT) AS rank, r2_institute, CASE WHEN {STATUS} = 'REPORTED' THEN CASE WHEN {REMARK} = 'UPGRADED' THEN 'UPGRADED' ELSE 'RETAINED' END WHEN {REMARK} LIKE '%FRESH ALLOT%' THEN 'FRESH' WHEN {REMARK} LIKE '%NOT ALLOTTED%' THEN 'NOT_ALLOTTED' WHEN {STATUS} IN ('NOT REPORTED', 'SEAT SURRENDERED') THEN 'LOST' ELSE 'UNKNOWN' END AS seat_outcome FROM r2_remarks)")
def _(c):
    cols = {"rank": F.col("rank").cast("string"), "r1_quota": F.lit("AI"), "r1_institute": F.lit("Older, Goa"), "r1_course": F.lit("MD"), "quota": F.lit("AI"), "institute": F.when(F.col("r2_institute") == "Inst", F.lit("Inst, Goa")).otherwise(F.col("r2_institute")), "course": F.lit("MS"), "allotted_category": F.lit("UR"), "candidate_category": F.lit("UR"), "option_no": F.lit("1"), "remarks": F.col("r2_remarks")}
    return oc.fact_12(c.r2_remarks.withColumns(cols), 2025).select("rank", "seat_outcome", "institute_name")


@query("o7_fact_16", "SELECT CAST(rank AS INT) AS rank, CASE WHEN r2_institute = 'Inst' THEN 'Inst' END AS institute_name, CASE WHEN r2_institute = 'Inst' THEN 'MS' END AS course_norm FROM r2_remarks")
def _(c):
    cols = {"rank": F.col("rank").cast("string"), "r2_institute": F.lit("-"), "institute": F.when(F.col("r2_institute") == "Inst", F.lit("Inst, Goa")).otherwise(F.col("r2_institute")), "quota": F.lit("AI"), "course": F.lit("M.S."), "allotted_category": F.lit("UR"), "candidate_category": F.lit("UR"), "option_no": F.lit("-"), "remarks": F.col("r2_remarks")}
    return oc.fact_16(c.r2_remarks.withColumns(cols), 2025).select("rank", "institute_name", "course_norm")


@query("o12_legacy_addresses", "SELECT institute_name, 'Area, ' || state AS address FROM (SELECT DISTINCT institute_name, state FROM allot)")
def _(c):
    raw = c.allot.withColumn("institute_raw", F.concat("institute_name", F.lit(", Area, "), "state", F.lit(", 560001.")))
    return dims.legacy_addresses(raw).select("institute_name", "address")


@query("t6_drill_order", "SELECT rank, l_linenumber, l_partkey, l_suppkey FROM allot WHERE year = 1996 ORDER BY rank, l_linenumber, l_partkey, l_suppkey LIMIT 200")
def _(c):
    return ag.paginate(ag.sort_rows(c.allot.where("year = 1996"), F.col("rank"), tie=TIE), 1, 200).select(*ROW)


@query("x3_ingest_progress", "SELECT 2 * (SELECT count(*) FROM events) AS rows_read, (SELECT count(*) FROM (SELECT DISTINCT * FROM events)) AS rows_kept")
def _(c):
    return progress_of(c.spark, c.events)


def _raw_of(c, layout: str, rows: DataFrame) -> DataFrame:
    """Rows (rank, line, cells) as a raw table on disk with a header after each row, read back as logical rows."""
    raw = rows.select(F.lit("f").alias("file"), F.col("rank").cast("int").alias("page_num"), F.col("l_partkey").cast("int").alias("table_idx"), (F.col("l_linenumber") * 2).cast("int").alias("row_idx"), "cells")
    headers = raw.withColumns({"row_idx": F.col("row_idx") + 1, "cells": F.array(F.lit("Rank"), F.lit("Quota"))})
    path = fresh_dir(c.spark, "raw")
    raw.unionByName(headers).write.parquet(path)
    return rw.logical_rows(io.read_raw(c.spark, path, layout), layout)


@query("s2_d2_rows_of_round_2", "SELECT CAST(rank AS INT) AS page_num, CAST(rank AS VARCHAR) AS rank, trim(r1_status) AS r1_status, r2_institute AS institute, r2_remarks AS remarks FROM r2_remarks WHERE rank >= 2")
def _(c):
    text = lambda *xs: [F.lit(x) for x in xs]
    before = [F.col("rank").cast("string"), *text("AI", "Old", "MD"), F.col("r1_status"), F.lit("AI")]
    after = [F.col("r2_institute"), *text("MS", "UR", "UR", "1"), F.col("r2_remarks")]
    phantom = F.array(*before, F.lit(None).cast("string"), *after)
    rows = c.r2_remarks.withColumn("cells", F.when(F.col("l_suppkey") % 2 == 0, phantom).otherwise(F.array(*before, *after)))
    return _raw_of(c, "r2", rows).select("page_num", "rank", "r1_status", "institute", "remarks")


@query("s3_d3_rows_of_round_3", "SELECT CAST(rank AS INT) AS page_num, CAST(rank AS VARCHAR) AS rank, trim(coalesce(r1_status, '-')) AS r1_status, r2_remarks, concat('Inst ', CAST(l_suppkey AS VARCHAR)) AS institute, 'ok' AS remarks FROM r2_remarks WHERE rank >= 4")
def _(c):
    text = lambda *xs: [F.lit(x) for x in xs]
    none = [F.lit(None).cast("string")]
    parts = [F.col("rank").cast("string"), F.lit("AI")], [*text("Old", "MD"), F.coalesce("r1_status", F.lit("-")), *text("AI", "Mid", "MD"), F.col("r2_remarks"), F.lit("AI")], [F.concat(F.lit("Inst "), F.col("l_suppkey").cast("string")), *text("MS", "UR", "UR", "1", "ok")]
    whole, one, two = F.array(*parts[0], *parts[1], *parts[2]), F.array(*parts[0], *none, *parts[1], *parts[2]), F.array(*parts[0], *none, *parts[1], *none, *parts[2])
    k = F.col("l_suppkey") % 3
    rows = c.r2_remarks.withColumn("cells", F.when(k == 0, whole).when(k == 1, one).otherwise(two))
    return _raw_of(c, "r3", rows).select("page_num", "rank", "r1_status", "r2_remarks", "institute", "remarks")


@query("s10_append_new", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE concat(s_name, '!') END AS s_name FROM supplier")
def _(c):
    path = fresh_dir(c.spark, "target")
    rows = c.supplier.select("s_suppkey", "s_name")
    rows.where("s_suppkey % 3 = 0").write.parquet(path)
    batch = rows.withColumn("s_name", F.concat("s_name", F.lit("!")))
    io.append_new(c.spark.read.parquet(path), batch.unionByName(batch), ["s_suppkey"], path)
    return c.spark.read.parquet(path)


@query("n15_n16_core_names", "SELECT institute_code, CASE institute_code % 3 WHEN 0 THEN 'the university of' ELSE trim(regexp_replace(lower(institute_name), '[^\\w\\s]', ' ', 'g')) END AS core FROM inst")
def _(c):
    k, name = F.col("institute_code") % 3, F.col("institute_name")
    text = F.when(k == 0, F.lit("The Univérsity of")).when(k == 1, F.concat(F.lit("The Collège of "), name, F.lit(" x y"))).otherwise(F.concat(name, F.lit(" (Pvt.) Ltd.")))
    return c.inst.select("institute_code", text.alias("text")).select("institute_code", t.strip_generic(t.fold_norm(F.col("text"))).alias("core"))


TELLS_LITTLE = "hospital medical college institute university govt government district general super speciality specialty centre center research national regional state pvt ltd private limited trust foundation society memorial of the and in at".split()


@query("n16_each_stop_word", "SELECT p_partkey, concat('dr ', trim(regexp_replace(regexp_replace(lower(p_name), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' sciences') AS core, list_value('" + "', '".join(TELLS_LITTLE) + "')[p_partkey % 31 + 1] AS word FROM part")
def _(c):
    word = F.element_at(F.array(*map(F.lit, TELLS_LITTLE)), (F.col("p_partkey") % 31 + 1).cast("int"))
    text = F.concat(F.lit("Dr. "), F.initcap(word), F.lit(" "), F.col("p_name"), F.lit(" x Sciences, "), F.upper(word))
    return c.part.select("p_partkey", t.strip_generic(t.fold_norm(text)).alias("core"), word.alias("word"))


@query("n9_areas", "SELECT institute_code, CASE institute_code % 4 WHEN 0 THEN 'Zorvale' WHEN 3 THEN NULL ELSE concat('Quibb', CASE WHEN n_nationkey % 2 = 0 THEN 'ton' ELSE 'ham' END) END AS area FROM inst JOIN nation ON n_name = state")
def _(c):
    k = F.col("institute_code") % 4
    place = F.concat(F.lit("Quibb"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("ton")).otherwise(F.lit("ham")))
    text = F.when(k == 0, F.concat(F.lit("at Zorvale near "), place)).when(k == 1, F.concat(F.lit("Zorvale at "), place)).when(k == 2, F.concat(F.lit("Zorvales, "), place)).otherwise(F.lit("at the old mill"))
    words = F.when(k == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("ZORVALE")))
    return c.inst.join(c.nation, F.col("n_name") == F.col("state")).select("institute_code", t.area_of(text, words).alias("area"))


def _page(*lines):
    """Lines (label, column or None); a line without value is absent."""
    return F.concat_ws("\n", *[F.when(F.col(v).isNotNull(), F.concat(F.lit(f"{label}: "), F.col(v))) for label, v in lines])


def _profiled(c) -> DataFrame:
    """Institutes with the texts of a profile of two pages; odd codes write their names in lower case."""
    rows = c.inst.select(
        F.col("institute_code").cast("string").alias("code"), F.when(F.col("institute_code") % 2 == 0, F.col("institute_name")).otherwise(F.lower("institute_name")).alias("college"), "university",
        "annual_fee", F.nullif("stipend_yr1", F.lit("")).alias("stipend_yr1"), F.nullif("bond_forfeit", F.lit("")).alias("bond_forfeit"), "bond_years",
        F.when(F.col("institute_code") % 3 == 0, F.concat(F.lit("http://c"), F.col("institute_code").cast("string"))).alias("website"),
    )
    first = _page(("Institute Code", "code"), ("College Name", "college"), ("University", "university"), ("Annual Fee", "annual_fee"))
    second = _page(("Stipend of the 1st Year", "stipend_yr1"), ("Bond Penalty", "bond_forfeit"), ("Bond Years", "bond_years"), ("Website", "website"))
    return rows.select("code", first.alias("first"), second.alias("second"))


COLLEGE = "CASE WHEN institute_code % 2 = 0 THEN institute_name ELSE lower(institute_name) END AS college"


@query("n24_profile_fields", f"SELECT CAST(institute_code AS VARCHAR) AS code, {COLLEGE}, university, annual_fee, nullif(stipend_yr1, '') AS stipend_yr1, nullif(bond_forfeit, '') AS bond_forfeit, bond_years, CASE WHEN institute_code % 3 = 0 THEN concat('http://c', CAST(institute_code AS VARCHAR)) END AS website FROM inst")
def _(c):
    return _profiled(c).select(t.fields_of(F.concat_ws("\n", "first", "second"), t.PROFILE).alias("f")).select("f.*")


@query("o13_load_profiles", f"SELECT institute_code, {COLLEGE}, CASE WHEN annual_fee <> 'NA' THEN annual_fee END AS annual_fee, nullif(stipend_yr1, '') AS stipend_yr1 FROM inst")
def _(c):
    pages = _profiled(c).select(F.col("code").alias("doc"), F.posexplode(F.array("first", "second")).alias("page_num", "text"))
    return dims.load_profiles(pages, c.inst)


@query("o10_build_institutes", "SELECT institute_code, status AS match_status, CASE WHEN status <> 'UNMATCHED' THEN concat(institute_name, ' P') END AS profile_name FROM (SELECT institute_code, institute_name, CASE WHEN match_status = 'EXACT' THEN 'EXACT' WHEN match_status = 'OK_REVIEW' AND institute_code % 3 = 0 THEN 'OK_REVIEW' ELSE 'UNMATCHED' END AS status FROM inst)")
def _(c):
    named = F.concat("institute_name", F.lit(" P"))
    matched = c.inst.where("match_status <> 'UNMATCHED'").withColumn("profile_name", F.when(F.col("match_status") == "EXACT", named).otherwise(F.lit("to be found")))
    profiles = c.inst.select("pincode", named.alias("college_name"), F.col("address").alias("address_profile"))
    approved = c.inst.where("match_status = 'OK_REVIEW' and institute_code % 3 = 0").select("institute_code")
    return dims.build_institutes(matched, profiles, c.inst, approved).select("institute_code", "match_status", "profile_name")


COURSES = {  # of the number of a part: its course, and the degree, specialty and type that are in it
    0: ("'M.D. (Anatomy)'", "'MD'", "'ANATOMY'", "Pre-Clinical"),
    1: ("concat('m.s. ortho ', p_type)", "'MS'", "concat('ORTHO ', upper(p_type))", "Clinical"),
    2: ("concat('Diploma in Public Health - ', p_type)", "'DIPLOMA'", "concat('PUBLIC HEALTH ', upper(p_type))", "Non-Clinical"),
    3: ("concat(p_type, ' Pathology')", "NULL", "concat(upper(p_type), ' PATHOLOGY')", "Para-Clinical"),
    4: ("'D.N.B.'", "'DNB'", "NULL", "Clinical"),
}


def _of_course(i: int, quote: str = "") -> str:
    return "CASE p_partkey % 5 " + " ".join(f"WHEN {k} THEN {quote}{row[i]}{quote}" for k, row in COURSES.items()) + " END"


@query("n12_n13_degrees_and_types", f"SELECT p_partkey, {_of_course(1)} AS degree, {_of_course(2)} AS specialty, {_of_course(3, chr(39))} AS course_type FROM part")
def _(c):
    own = c.part.select("p_partkey", t.norm_course(F.expr(_of_course(0))).alias("course"))
    return own.select("p_partkey", t.split_course(F.col("course")).alias("s"), t.course_type(F.col("course")).alias("course_type")).select("p_partkey", "s.*", "course_type")


@query("o9_course_dim_kept", "SELECT course_norm, CASE WHEN course_norm LIKE 'S%' THEN 'MD' END AS degree, CASE WHEN course_norm LIKE 'S%' THEN 'kept' ELSE course_norm END AS specialty, CASE WHEN course_norm LIKE 'S%' THEN 'Non-Clinical' ELSE 'Clinical' END AS course_type FROM (SELECT DISTINCT course_norm FROM allot WHERE course_norm <> '')")
def _(c):
    old = c.courses.where("course_norm like 'S%'").select("course_norm")
    unused = old.select(F.concat("course_norm", F.lit(" that nobody takes")).alias("course_norm"))
    existing = old.unionByName(unused).select("course_norm", F.lit("MD").alias("degree"), F.lit("kept").alias("specialty"), F.lit("Non-Clinical").alias("course_type"))
    return dims.build_courses(c.allot, existing)


@query("o8_x1_stream_of_facts", "SELECT CAST(l_orderkey * 10 + l_linenumber AS INT) AS rank, CASE quota_raw WHEN 'A.I.Q.' THEN 'AIQ' WHEN ' all  india ' THEN 'AIQ' WHEN 'N.R.I.' THEN 'NRI' WHEN 'dnb-post mbbs' THEN 'DNB' WHEN 'Management Quota' THEN 'MNG' ELSE 'UNKNOWN' END AS quota_norm, split_part(institute_raw, ',', 1) AS institute_name, CASE WHEN institute_raw LIKE '%Delhi' THEN 'Delhi' WHEN institute_raw LIKE '%Orissa' THEN 'Odisha' WHEN institute_raw LIKE '%Pune%' THEN 'Maharashtra' END AS state FROM (SELECT DISTINCT l_orderkey, l_linenumber, quota_raw, institute_raw, category_raw FROM raw_alias)")
def _(c):
    text = lambda x: F.col(x).cast("string")
    rank = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string")
    cells = F.array(text("l_linenumber"), rank, F.col("quota_raw"), F.col("institute_raw"), F.lit("M.D."), F.col("category_raw"), F.col("category_raw"), F.lit("-"))
    raw = c.raw_alias.select(F.lit("f").alias("file"), F.col("l_orderkey").cast("int").alias("page_num"), F.col("l_partkey").cast("int").alias("table_idx"), F.col("l_linenumber").cast("int").alias("row_idx"), cells.alias("cells"))
    source, target = fresh_dir(c.spark, "arrived"), fresh_dir(c.spark, "facts")
    raw.write.option("compression", "zstd").parquet(source)
    for own in ("first", "forced"):  # the second run reads all again and adds nothing
        ingest_stream(c.spark, source, rw.RAW, lambda batch: facts(batch, 2025, 1, stage=True), target, fresh_dir(c.spark, own), FACT_KEY, apart=rw.TABLE).awaitTermination()
    return c.spark.read.parquet(target).select("rank", "quota_norm", "institute_name", "state")


def queries() -> dict:
    from . import more_queries, round_queries  # noqa: F401  they register their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import more_queries, round_queries  # noqa: F401  they register their own

    return dict(ORACLE)
