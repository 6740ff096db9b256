"""Rule tables, the repair of bonds, and copies between databases that are cut off."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from rankloom.functions import tables
from rankloom.functions import text as t
from rankloom.plans import dims
from rankloom.sources import io

DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def test_first_state_whose_pattern_occurs(spark):
    rows = [("A.P. Medical College", "Hyderabad", "Andhra Pradesh"), ("X", "New DELHI, near Patna", "Bihar"), ("Y", "J & K", "Jammu and Kashmir"), ("Z", "T.N. road", "Tamil Nadu"), ("Goan", "nowhere", None), (None, "Leh", "Ladakh"), (None, None, None)]
    df = spark.createDataFrame([(n, a, w) for n, a, w in rows], "n string, a string, want string")
    got = df.select("want", t.state_by_patterns(F.col("n"), F.col("a")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_rules_can_be_a_table(spark):
    rules = [(i, s, p) for i, (s, p) in enumerate((s, p) for s, ps in tables.STATE_PATTERNS.items() for p in ps)]
    assert dims.state_rules(spark.createDataFrame(rules[::-1], "priority int, state string, pattern string")) == tables.STATE_PATTERNS
    swapped = dims.state_rules(spark.createDataFrame([(2, "A", "x"), (1, "B", "xy")], "priority int, state string, pattern string"))
    assert list(swapped) == ["B", "A"]


def test_policy_and_states_agree():
    assert len(tables.BOND_YEARS) == 33 and sum(v is None for v in tables.BOND_YEARS.values()) == 4
    assert set(tables.BOND_YEARS) <= set(tables.STATE_PATTERNS) and len(tables.STATE_PATTERNS) == 34
    assert len(tables.STOP_WORDS) == len(set(tables.STOP_WORDS)) == 31


def test_whole_row_of_a_profile_wins(spark):
    """The penalty is the last that is there; the other columns come from the last row that has any, even where an earlier one has more."""
    inst = spark.createDataFrame([(1, "H", "Pune", None, None, None, None, ""), (2, "G", "x", "Goa", "0", "kept", "5", "4")], "institute_code int, institute_name string, address string, state string, bond_forfeit string, university string, stipend_yr1 string, bond_years string")
    matched = spark.createDataFrame([(1, 1, "10", "U1", "11"), (1, 2, "20", None, "12"), (1, 3, None, None, None), (2, 4, "9", "new", "9"), (3, 5, "1", "1", "1")], "institute_code int, seq int, bond_forfeit string, university string, stipend_yr1 string")
    got = {r.institute_code: r for r in dims.repair_bonds(inst, matched, "seq").collect()}
    assert (got[1].bond_forfeit, got[1].university, got[1].stipend_yr1, got[1].state, got[1].bond_years) == ("20", None, "12", "Maharashtra", "1")
    assert (got[2].bond_forfeit, got[2].university, got[2].stipend_yr1, got[2].state, got[2].bond_years) == ("0", "kept", "5", "Goa", "4") and len(got) == 2


def test_a_copy_that_fails_is_completed(spark):
    source, target = (f"jdbc:derby:memory:{uuid.uuid4().hex};create=true" for _ in range(2))
    for name, n in (("one", 250), ("two", 30)):
        spark.range(n).select(F.col("id").alias("k"), F.concat(F.lit(name), "id").alias("v")).write.jdbc(source, name, "overwrite", DERBY)
    plan = [io.Copied("one", ("k",), "k"), io.Copied("missing", ("k",)), io.Copied("two", ("k",))]
    assert io.read_jdbc(spark, source, plan[0], DERBY, 40).rdd.getNumPartitions() == 7
    with pytest.raises(Exception):  # noqa: B017  the source has no such table
        io.copy_tables(spark, source, target, plan, "resume", DERBY, 40)
    assert io.copy_tables(spark, source, target, [plan[0], plan[2]], "resume", DERBY, 40) == [("one", 0), ("two", 30)]
    assert io.copy_tables(spark, source, target, [plan[0]], "fresh", DERBY) == [("one", 250)]
    assert spark.read.jdbc(target, "one", properties=DERBY).count() == 250 and spark.read.jdbc(target, "two", properties=DERBY).select("k").distinct().count() == 30
