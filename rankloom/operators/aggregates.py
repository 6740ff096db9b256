"""Aggregations, window-like computations and ordering."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, is_missing
from ..sources.workspace import staged

GRID = ["year", "counselling_type", "counselling_state", "institute_name", "institute_pincode", "state", "course_norm", "quota_norm", "allotted_category_norm"]


def pivot_rounds(df: DataFrame, keys: list[str] = GRID, rounds=(1, 2, 3, 4)) -> DataFrame:
    """A1, A2: closing rank and number of rows for each group and round, in one shuffle."""
    per = [a for r in rounds for a in (F.max(F.when(F.col("round") == r, F.col("rank"))).alias(f"r{r}_closing_rank"), F.count(F.when(F.col("round") == r, 1)).alias(f"r{r}_allotment_count"))]
    return df.groupBy(*keys).agg(F.min("institute_city").alias("institute_city"), *per)


def closing(df: DataFrame, keys: list[str]) -> DataFrame:
    """A3: closing rank and number of rows of each group, or of all rows; no ranks: NULL."""
    return df.groupBy(*keys).agg(F.max("rank").alias("closing_rank"), F.count("*").alias("n"))


def group_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """A5: number of distinct tuples, NULLs equal."""
    return df.select(*keys).distinct().agg(F.count("*").alias("n_groups"))


def freq(df: DataFrame, col: str) -> DataFrame:
    """A6, A14."""
    return df.groupBy(col).agg(F.count("*").alias("n"))


def bucket_hist(df: DataFrame, bucket: Column) -> DataFrame:
    """A7."""
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def coverage(df: DataFrame, by: str, col: str) -> DataFrame:
    """Rows, rows with the column, its greatest value."""
    has = ~is_missing(F.col(col))
    return df.groupBy(by).agg(F.count("*").alias("total"), F.count(F.when(has, 1)).alias("filled"), F.max(F.when(has, F.col(col))).alias("greatest"))


def non_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    """A9."""
    return df.agg(*[F.count(F.when(~is_missing(F.col(c)), 1)).alias(c) for c in cols])


def best_text(df: DataFrame, by: str, text: str, longest: bool = False) -> DataFrame:
    """A10: the greatest text of round 1 if it is long enough, else the greatest of all; or the longest."""
    if longest:
        return df.groupBy(by).agg(F.max_by(text, F.struct(F.length(text), text)).alias("best"))
    own = df.groupBy(by).agg(F.max(F.when(F.col("round") == 1, F.col(text))).alias("first"), F.max(text).alias("any"))
    return own.select(by, F.when(F.length(F.trim("first")) > 20, F.col("first")).otherwise(F.col("any")).alias("best"))


def ambiguous(df: DataFrame, by: str, col: str) -> DataFrame:
    """Groups with several values, NULL as ''."""
    return df.groupBy(by).agg(F.countDistinct(F.coalesce(col, F.lit(""))).alias("n_values")).where("n_values > 1")


def facets(df: DataFrame, cols: list[str]) -> DataFrame:
    """The distinct values of each column that aren't empty, long form: facet, value."""
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in cols]))
    return df.select(stack.alias("f")).select("f.*").where(F.col("value").isNotNull() & (F.col("value") != "")).distinct()


def ingest_summary(df: DataFrame) -> DataFrame:
    """Of rows tagged with dataset_key, status (inserted, skipped, errored) and page_num."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return df.groupBy("dataset_key").agg(n("inserted"), n("skipped"), n("errored"), F.countDistinct("page_num").alias("pages"), F.max("page_num").alias("last_page"))


def dictionary(df: DataFrame, col: str) -> DataFrame:
    """A15."""
    return df.select(col).where(F.col(col).isNotNull()).distinct()


def last_valid_round(df: DataFrame) -> DataFrame:
    """Rows of the candidate's latest round that left a seat; ties stay, rows without rank go."""
    valid = F.coalesce(~F.col("seat_outcome").isin("LOST", "NOT_ALLOTTED"), F.lit(True))
    last = F.max(F.when(valid, F.col("round"))).over(Window.partitionBy("rank", "year", "counselling_type"))
    return df.where("rank is not null").withColumn("last_round", last).where(valid & (F.col("round") == F.col("last_round"))).drop("last_round")


def topk(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; ``order`` must be total."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def continuation_id(df: DataFrame, part: list[str], order: str, is_base: str) -> DataFrame:
    """Number of the base row that a row belongs to; 0: before any."""
    run = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("base_no", F.sum(F.col(is_base).cast("long")).over(run))


def pair_pages(df: DataFrame, part: list[str], order: str, text: str) -> DataFrame:
    """A page's text and the next one's."""
    return df.withColumn("paired", F.concat_ws("\n", F.col(text), F.lead(text).over(Window.partitionBy(*part).orderBy(order))))


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows are numbered from 1 within ranges of the order, on top of the rows of the ranges before; of ties, by a hash of
    the row, so that many ties don't lie in one range. Only the counts of the ranges pass through one task."""
    key = [*order, F.xxhash64(*df.columns)]
    ranged = staged(df.repartitionByRange(*key).withColumn("_range", F.spark_partition_id()), "numbered")
    before = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    no = F.row_number().over(Window.partitionBy("_range").orderBy(*key)) + F.col("_before")
    return ranged.join(counts, "_range").withColumn("no", no.cast("int")).select(*df.columns, "no")


def sort_rows(df: DataFrame, key: Column, direction: str = "asc", nulls: str = "last", tie: list[str] = ()) -> DataFrame:
    """By a key with NULLs last (or ``first`` in ascending order), then by the tie columns."""
    first = key.desc_nulls_last() if direction == "desc" else key.asc_nulls_first() if nulls == "first" else key.asc_nulls_last()
    return df.orderBy(first, *[F.col(c).asc_nulls_first() for c in tie])


def paginate(df: DataFrame, page: int = 1, size: int = 50) -> DataFrame:
    """T5: one page of an ordered frame; size from 1 to 500."""
    size = max(1, min(500, size))
    return df.offset((max(1, page) - 1) * size).limit(size)


def page_totals(df: DataFrame, size: int = 50) -> DataFrame:
    """A12."""
    return df.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))


@dataclass(frozen=True)
class Page:
    """One page of rows, with the totals of all of them."""

    rows: list
    total: int
    page_size: int

    @property
    def pages(self) -> int:
        return -(-self.total // self.page_size)

    def last(self, order: list[str]) -> tuple | None:
        """The key that the next page comes after."""
        return tuple(self.rows[-1][c] for c in order) if self.rows else None


def _after(order: list[str], last: tuple) -> Column:
    """Rows that come after a key, in ascending order with NULLs first."""
    beyond, same = F.lit(False), F.lit(True)
    for name, value in zip(order, last):
        c = F.col(name)
        beyond = beyond | same & (c.isNotNull() if value is None else F.coalesce(c > F.lit(value), F.lit(False)))
        same = same & c.eqNullSafe(F.lit(value))
    return beyond


def page_after(df: DataFrame, order: list[str], last: tuple | None = None, size: int = 50) -> Page:
    """T5, A12 in one pass: the rows after the key of the page before, by ``order``, a total one (ascending, NULLs first); all rows are counted as
    they pass. A later page costs what the first does: nothing before it is sorted or skipped."""
    size, seen = max(1, min(500, size)), Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("total"))
    rows = rows if last is None else rows.where(_after(order, last))
    page = rows.orderBy(*[F.col(c).asc_nulls_first() for c in order]).limit(size).collect()
    return Page(page, seen.get["total"], size)


def filled(c: str) -> Column:
    return blank_to_null(F.col(c))
