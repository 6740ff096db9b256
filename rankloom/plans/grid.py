"""User-level queries over allotments and institutes. All return lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import format as fm
from ..functions.text import blank_to_null, sqlite_real
from ..operators import aggregates as ag
from ..operators import filters as fl
from ..operators import joins as jn


@dataclass
class RankFilters:
    """Filters of the closing-rank grid; None or empty: not filtered."""

    year: int | None = None
    counselling_type: str | None = None
    counselling_state: str | None = None
    quota_norm: list[str] = field(default_factory=list)
    allotted_category_norm: list[str] = field(default_factory=list)
    state: list[str] = field(default_factory=list)
    course_norm: list[str] = field(default_factory=list)
    course_type: list[str] = field(default_factory=list)
    rank_min: int | None = None
    rank_max: int | None = None
    search: str | None = None
    rounds: list[int] = field(default_factory=list)
    my_rank: int | None = None
    my_rank_mode: str = "exact"
    fee_min: float | None = None
    fee_max: float | None = None
    bond_min: float | None = None
    bond_max: float | None = None

    def predicate(self):
        return fl.all_of(
            fl.dim_eq(year=self.year, counselling_type=self.counselling_type or None), fl.counselling_state(self.counselling_state),
            fl.in_list("quota_norm", self.quota_norm), fl.in_list("allotted_category_norm", self.allotted_category_norm), fl.in_list("state", self.state),
            fl.course_filter(self.course_norm), fl.rank_between(self.rank_min, self.rank_max), fl.search(self.search, ["institute_name", "course_norm", "course_raw"]),
        )


SORT_KEYS = ["quota_norm", "allotted_category_norm", "state", "institute_name", "institute_pincode", "course_norm", "r1_closing_rank", "r2_closing_rank",
             "r3_closing_rank", "r4_closing_rank", "inst_fee_yr1", "inst_stipend_yr1", "inst_bond_forfeit"]


def closing_ranks(cat, f: RankFilters, sort_by: str | None = "institute_name", sort_order: str = "asc") -> DataFrame:
    """The grid: filter, aggregate once, join profiles to groups, filter on them, sort (``sort_by`` None: unsorted; an unknown key is an error)."""
    if sort_by is not None and sort_by not in SORT_KEYS:
        raise ValueError(f"no sort key: {sort_by}")
    fact = cat.allot
    df = fact.where(fl.group_guard() & f.predicate())
    df = fl.course_type_filter(df, cat.courses, f.course_type)
    if f.my_rank is not None:
        df = fl.has_rank(df, fact, f.my_rank, f.rounds, f.my_rank_mode)
    grid = ag.pivot_rounds(df)
    present = fl.round_present(f.rounds)
    grid = jn.enrich_profile(grid.where(present) if present is not None else grid, cat.mapping, cat.inst)
    grid = grid.where(fl.all_of(
        F.col("inst_fee_yr1") >= f.fee_min if f.fee_min is not None else None, F.col("inst_fee_yr1") <= f.fee_max if f.fee_max is not None else None,
        fl.money_between(F.col("inst_bond_forfeit"), f.bond_min, f.bond_max),
    ))
    if sort_by is None:
        return grid
    key = sort_by
    by = sqlite_real(F.col(key)) if key in ("inst_bond_forfeit", "inst_stipend_yr1") else F.col(key)
    return ag.sort_rows(grid, by, sort_order, "last", ag.GRID)


def with_group_ids(grid: DataFrame) -> DataFrame:
    """The grid's rows with an id for each round that has rows."""
    cols = {c: F.col(c) for c in ag.GRID}
    return grid.withColumns({f"r{r}_group_id": fm.encode_group_id(cols, r, F.col(f"r{r}_allotment_count")) for r in (1, 2, 3, 4)})


def _is_value(fact: DataFrame, name: str, value) -> Column:
    """The column, in its own type so that the scan can skip files, has the value; blank and null are one."""
    kind = fact.schema[name].dataType
    if value in (None, ""):
        return F.col(name).isNull() | (F.col(name) == "") if isinstance(kind, T.StringType) else F.col(name).isNull()
    return F.col(name) == F.lit(value).cast(kind)


def drill_down(cat, key: dict, tie=()) -> DataFrame:
    """Rows of a group (its id leaves out the state), by rank and then ``tie``, with the closing one marked."""
    fact = cat.allot
    rows = fact.where(fl.all_of(*[_is_value(fact, name, key.get(k)) for k, name in fm.GROUP_FIELDS.items()]))
    top = ag.closing(rows, []).select("closing_rank")
    return ag.sort_rows(rows.crossJoin(F.broadcast(top)).withColumn("is_closing", F.col("rank") == F.col("closing_rank")), F.col("rank"), tie=list(tie))


ALLOTMENT_SEARCH = ["institute_name", "course_norm", "course_raw", "institute_raw"]
INSTITUTE_SEARCH = ["display_name", "institute_name", "address", "state", "pincode", "university"]


def allotments(cat, where=None, final_only: bool = False, sort_by: str | None = "rank", sort_order: str = "asc", tie=("round",)) -> DataFrame:
    """The list of allotments; ``final_only`` keeps each candidate's last valid seat, found before other filters."""
    df = ag.last_valid_round(cat.allot) if final_only else cat.allot
    df = df.where(where) if where is not None else df
    return df if sort_by is None else ag.sort_rows(df, F.col(sort_by), sort_order, "first", list(tie))


def institutes(cat, search: str | None = None, state=None, match_status=None, sort_by: str = "institute_name", sort_order: str = "asc") -> DataFrame:
    keep = fl.all_of(fl.search(search, INSTITUTE_SEARCH), fl.in_list("state", state), fl.in_list("match_status", match_status))
    return ag.sort_rows(cat.inst.where(keep), F.col(sort_by), sort_order, "first", ["institute_code"])


FACETS = ["year", "round", "quota_norm", "allotted_category_norm", "state", "course_norm", "counselling_type", "counselling_state"]


def facets(cat, **scope) -> DataFrame:
    """Distinct values of each facet in a scope, as (facet, value)."""
    return ag.facets(cat.allot.where(fl.truthy_scope(**scope)), FACETS)


def export_closing_ranks(grid: DataFrame, year: int) -> DataFrame:
    """Columns of the export; counts of 0 are empty."""
    seats = lambda r: F.nullif(F.col(f"r{r}_allotment_count"), F.lit(0)).alias(f"R{r} Seats")
    ranks = [c for r in (1, 2, 3, 4) for c in (F.col(f"r{r}_closing_rank").alias(f"CR {year} R{r}"), seats(r))]
    profile = [blank_to_null(F.col(c)).alias(name) for c, name in (("inst_stipend_yr1", "Stipend Y1"), ("inst_bond_years", "Bond Years"), ("inst_bond_forfeit", "Bond Penalty"), ("inst_beds", "Beds"))]
    return grid.select(
        F.col("quota_norm").alias("Quota"), F.col("allotted_category_norm").alias("Category"), F.col("state").alias("State"), F.col("institute_name").alias("Institute"),
        F.col("institute_pincode").alias("Pincode"), F.col("course_norm").alias("Course"), F.col("inst_fee_yr1").alias("Fee"), *profile, *ranks,
    )


def export_allotments(df: DataFrame) -> DataFrame:
    """The course falls back to its raw form."""
    course = F.coalesce(blank_to_null(F.col("course_norm")), "course_raw", F.lit("")).alias("Course")
    named = {"rank": "Rank", "round": "Round", "institute_name": "Institute", "institute_city": "City", "institute_pincode": "Pincode", "state": "State", "course": course,
             "quota_norm": "Quota", "allotted_category_norm": "Category", "seat_outcome": "Outcome", "year": "Year", "counselling_type": "Counselling Type"}
    return df.select(*[F.col(c).alias(name) if isinstance(name, str) else name for c, name in named.items()])
