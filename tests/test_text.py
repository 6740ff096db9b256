"""Golden cases of the text functions, and properties of keys."""

from __future__ import annotations

import base64
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from rankloom.functions import format as fm
from rankloom.functions import text as t


def each(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in df.select("i", f(F.col("v"))).orderBy("i").collect()]


CASES = [
    (t.safe_int, {"1,234": 1234, " 77 ": 77, "Rank": None, "": None, None: None, "-5": -5, "1.5": None}),
    (t.clean_cell, {"  a \n b ": "a b", "   ": None, None: None, "x": "x"}),
    (t.is_dash, {"-": True, "—": True, " NA ": True, "na": False, "": True, None: True, "x": False}),
    (t.norm_quota, {"A.I.": "AIQ", "Self-Financed Merit Seat/(Paid Seat Quota)": "SFS", "xyz": "UNKNOWN", "dnb-post\nmbbs": "DNB", "all india": "AIQ", None: "UNKNOWN", "N R I": "NRI"}),
    (t.norm_category, {"Open PwD": "GEN-PwD", "obc-ncl": "OBC", "UR": "GEN", "AFMS P3": "AFMS-Priority III", "x": "UNKNOWN", None: "UNKNOWN"}),
    (t.state_of, {"AIIMS, New Delhi, India": "Delhi", "x, tamilnadu": "Tamil Nadu", "y 560102": "Karnataka", "z 110029": "Delhi", "none 990000": None, None: None, "Daman and Diu": "Dadra and Nagar Haveli and Daman and Diu"}),
    (t.pincode_of, {"a 411001, b 560102": "411001", "1234567": None, None: None}),
    (t.city_of, {
        "Manipal Hospital, Karnataka, Survey NO 46 Ambalipura Sarjapur Road 560102": "Ambalipura", "MGM Medical College, Aurangabad, Maharashtra": "Aurangabad",
        "Care Hospital, Care Hospitals Road No1 Banjara Hills Hyderabad": "Banjara", "Some Place, #98, 560001": "560001", "Only Name": None, None: None,
    }),
    (t.clean_institute, {"AIIMS Hospital., New Delhi 110029 a@b.c": "AIIMS Hospital", "MGM, Pune": "MGM, Pune", "": None, None: None}),
    (t.norm_course, {
        "M.D. (General Medicine)": "MD GENERAL MEDICINE", "M.D. (DERMATOLOGY, VENEREOL OGY & LEPRO SY)": "MD DERMATOLOGY VENEREOLOGY & LEPROSY",
        "M.D. VENE REOLOGY": "MD VENEREOLOGY", "Master of Public Health (Epidemiology)": "MPH EPIDEMIOLOGY", "Dip. in E N T": "DIPLOMA ENT", "M.S. - Général/Surgery": "MS GENERAL SURGERY", None: "",
    }),
    (t.course_type, {"MPH EPIDEMIOLOGY": "Non-Clinical", "MD COMMUNITY HEALTH ADMINISTRATION": "Para-Clinical", "MD ANATOMY": "Pre-Clinical", "MD X": "Clinical", None: "Clinical"}),
    (t.sqlite_real, {"12abc": 12.0, " -3.5e2x": -350.0, "abc": 0.0, "": 0.0, None: None, ".5": 0.5}),
    (t.clean_num, {"₹ 1,20,000": 120000.0, "NA": None, "x": None, None: None}),
    (t.to_pin, {"411001.0": "411001", "nan": "", None: "", "411001": "411001"}),
    (t.safe_str, {"0": "0", "nan": None, "": None, " a ": "a", None: None}),
    (t.strip_generic, {"college of arts": "arts", "medical college": "medical college", "x city": "city"}),
    (lambda c: t.fold_norm(c), {"Éa-B  c": "ea b c", None: None}),
    (fm.format_inr, {"1234567": "₹12,34,567", "999": "₹999", "1000": "₹1,000", "abc": "—", None: "—", "12345678": "₹1,23,45,678"}),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_golden(spark, case):
    f, values = CASES[case]
    assert each(spark, f, list(values)) == list(values.values())


def test_split_course(spark):
    got = each(spark, t.split_course, ["MD GENERAL MEDICINE", "MCH", "XYZ", ""])
    assert [(r.degree, r.specialty) for r in got] == [("MD", "GENERAL MEDICINE"), ("MCH", None), (None, "XYZ"), (None, None)]


def test_dedup_segments_and_addresses(spark):
    f = lambda c: F.array_join(t.dedup_segments(F.split(c, ",")), ",")
    assert each(spark, f, ["a,b,A,B,c", "a,a", "a,b,c,d", "x y,z,xy,Z"]) == ["a,b", "a,a", "a,b,c,d", "x y,z"]
    df = spark.createDataFrame([("MGM College", "MGM College, Kamothe, Navi Mumbai, Maharashtra, 410209"), ("A", None)], "n string, a string")
    assert [tuple(r) for r in df.select(t.clean_address(F.col("n"), F.col("a")), t.city_from_address(F.col("n"), F.col("a"))).collect()] == [("Kamothe, Navi Mumbai", "Navi Mumbai"), (None, None)]


def test_display_names(spark):
    df = spark.createDataFrame([("A College", "Pune"), ("Pune College", "pune"), ("B", None), ("C", "")], "n string, c string")
    assert [r[0] for r in df.select(t.display_name(F.col("n"), F.col("c"))).collect()] == ["A College, Pune", "Pune College", "B", "C"]


KEY = st.fixed_dictionaries({name: st.one_of(st.none(), st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=8)) for name in fm.GROUP_FIELDS.values() if name != "round"})


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(key=KEY)
def test_group_id_round_trip(spark, key):
    df = spark.createDataFrame([tuple(key.values())], ", ".join(f"{k} string" for k in key))
    got = df.select(fm.encode_group_id({k: F.col(k) for k in key}, 2, F.lit(1)).alias("id")).select("id", fm.decode_group_id(F.col("id")).alias("k")).first()
    assert set(got.id) <= set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_")
    back = got.k.asDict()
    assert back.pop("r") == "2"
    assert back == {k: key[name] or "" for k, name in fm.GROUP_FIELDS.items() if name != "round"}
    assert json.loads(base64.urlsafe_b64decode(got.id + "=" * (-len(got.id) % 4)))["r"] == "2"


def test_malformed_group_ids(spark):
    assert each(spark, fm.decode_group_id, ["%%%", "abc", "", None, "e30"]) == [None] * 5


def test_fingerprint_is_stable_and_treats_empty_alike(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (1, "y", "x")], "a int, b string, c string")
    a, b, c = [r[0] for r in df.select(t.fingerprint(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert a == b != c and len(a) == 40


def test_quarantine_reasons(spark):
    rows = [(2025, "AIQ", None, 1), (1999, "AIQ", None, 1), (2025, "X", None, 1), (2025, "STATE", "", 1), (2025, "AIQ", None, 0), (None, None, None, None)]
    df = spark.createDataFrame(rows, "y int, t string, s string, r int")
    assert [r[0] for r in df.select(fm.invalid_dims(F.col("y"), F.col("t"), F.col("s"), F.col("r"))).collect()] == [None, "year", "type", "state", "round", "year"]
