"""Predicates: Columns where possible, DataFrame to DataFrame where a join is needed."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_missing, sqlite_real
from ..sources.workspace import staged

GROUP = ["year", "counselling_type", "institute_name", "course_norm", "quota_norm", "allotted_category_norm"]


def all_of(*conditions: Column | None) -> Column:
    """The conditions that are given, together; none: true."""
    return reduce(and_, [c for c in conditions if c is not None], F.lit(True))


def dim_eq(**dims) -> Column:
    """equality on the fields that are given."""
    return all_of(*[F.col(k) == v for k, v in dims.items() if v is not None])


def truthy_scope(**dims) -> Column:
    """as F1, but 0 and '' filter nothing either."""
    return all_of(*[F.col(k) == v for k, v in dims.items() if v])


def counselling_state(v: str | None) -> Column | None:
    """None filters nothing, '' takes NULL, anything else equals."""
    c = F.col("counselling_state")
    return None if v is None else c.isNull() if v == "" else c == v


def in_list(name: str, values) -> Column | None:
    """F3, F15."""
    return F.col(name).isin(list(values)) if values else None


def _like(term: str, escape: bool) -> str:
    return "%" + (term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") if escape else term) + "%"


def course_filter(values, always_like: bool = False) -> Column | None:
    """one value is a substring in any case, several are exact."""
    if not values:
        return None
    values = [values] if isinstance(values, str) else list(values)
    return F.col("course_norm").ilike(_like(values[0], False)) if len(values) == 1 or always_like else F.col("course_norm").isin(values)


def rank_between(low: int | None, high: int | None) -> Column:
    """F5, before any aggregation."""
    return all_of(F.col("rank") >= low if low is not None else None, F.col("rank") <= high if high is not None else None)


def search(term: str | None, cols: list[str], escape: bool = False) -> Column | None:
    """the term in any of the columns, in any case; % and _ in it are wildcards unless ``escape``."""
    return reduce(or_, [F.coalesce(F.col(c).ilike(_like(term, escape)), F.lit(False)) for c in cols]) if term else None


def course_type_filter(df: DataFrame, courses: DataFrame, types) -> DataFrame:
    """Rows whose course has one of the types."""
    return df.join(courses.where(F.col("course_type").isin(list(types))).select("course_norm"), "course_norm", "left_semi") if types else df


def degree_filter(df: DataFrame, courses: DataFrame, degrees) -> DataFrame:
    """rows whose course has one of the degrees."""
    return df.join(courses.where(F.col("degree").isin(list(degrees))).select("course_norm"), "course_norm", "left_semi") if degrees else df


def degree_as_course(degrees) -> Column | None:
    """F18 as the interface sends it: a degree and a space in place of a course. One is found anywhere in a course; several, which are then
    compared as whole courses, find nothing."""
    return course_filter([f"{d} " for d in degrees])


def group_guard() -> Column:
    """F8."""
    return F.col("institute_name").isNotNull() & F.col("allotted_category_norm").isNotNull()


def round_present(rounds) -> Column | None:
    """at least one of the rounds has rows in the group."""
    return reduce(or_, [F.col(f"r{r}_allotment_count") > 0 for r in rounds]) if rounds else None


def money_between(c: Column, low, high) -> Column:
    """on the number that the text begins with."""
    value = sqlite_real(c)
    return all_of(value >= low if low is not None else None, value <= high if high is not None else None)


def has_rank(df: DataFrame, fact: DataFrame, my_rank: int, rounds=None, mode: str = "exact") -> DataFrame:
    """Rows of groups that contain the rank (``at_least``: whose closing rank it doesn't exceed).

    The groups with exactly the rank are found first, by a filter that the scan takes, and written: few as they are, their true size lets the
    optimizer drop the other rows before anything is shuffled."""
    hit = F.col("rank") == my_rank if mode == "exact" else F.col("rank") >= my_rank
    only = F.col("round") == list(rounds)[0] if rounds and len(rounds) == 1 else F.lit(True)
    groups = fact.where(hit & only).select(*GROUP)
    return df.join(staged(groups.distinct(), "groups") if mode == "exact" else groups, GROUP, "left_semi")


def valid_seat(c: Column) -> Column:
    """no outcome, or one that leaves a seat."""
    return F.coalesce(~c.isin("LOST", "NOT_ALLOTTED"), F.lit(True))


def null_safe_eq(c: Column, v) -> Column:
    """F14."""
    return c.eqNullSafe(F.lit(v))


def by_code(df: DataFrame, code: int) -> DataFrame:
    """F16."""
    return df.where(F.col("institute_code") == code).limit(1)


def type_ahead(c: Column, q: str) -> Column:
    """F19."""
    return F.lower(c).contains(q.lower())


def present(c: Column) -> Column:
    """F20, the other way round."""
    return ~is_missing(c)


def is_unmatched(c: Column) -> Column:
    """false or NULL."""
    return F.coalesce(c.cast("int") == 0, F.lit(True))


def facet_guard(c: Column) -> Column:
    """F22."""
    return c.isNotNull() & (c != "")
