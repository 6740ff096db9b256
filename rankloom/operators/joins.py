"""Joins and set operations of the domain. Sides are left to the optimizer: it broadcasts what is small by its statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.text import blank_to_null, collapsed, sqlite_real, squashed
from ..sources.workspace import staged


PROFILE_COLUMNS = ["fee_yr2", "fee_yr3", "stipend_yr1", "stipend_yr2", "stipend_yr3", "bond_forfeit", "university", "bond_years", "beds"]


def enrich_profile(df: DataFrame, mapping: DataFrame, inst: DataFrame) -> DataFrame:
    """The profile of each name's institute, and inst_matched: NULL without mapping, else 0 or 1. Both dimensions join to the groups
    one after the other, so that the optimizer knows the size of each and need not shuffle the groups for small ones."""
    m = mapping.groupBy("db_institute_name").agg(F.min_by(F.struct("institute_code", "match_confidence"), F.struct("institute_code", "match_confidence")).alias("m"))
    matched = F.when(F.col("m.match_confidence").isin("EXACT", "FUZZY"), 1).otherwise(0).alias("inst_matched")
    m = m.select(F.col("db_institute_name").alias("institute_name"), F.col("m.institute_code").alias("inst_code"), matched)
    i = inst.select(F.col("institute_code").alias("inst_code"), F.col("address").alias("institute_address"), F.col("display_name").alias("institute_address_verified"), F.col("pincode").alias("inst_pincode"),
                    sqlite_real(F.col("annual_fee")).alias("inst_fee_yr1"), *[F.col(c).alias(f"inst_{c}") for c in PROFILE_COLUMNS])
    out = df.join(m, "institute_name", "left").join(i, "inst_code", "left").select(*df.columns, "inst_matched", *i.columns[1:])
    return out.withColumn("pincode_resolved", F.coalesce("institute_pincode", "inst_pincode")) if "institute_pincode" in df.columns else out


def backfill_from_round(df: DataFrame, cols: list[str], order: list[str], src_round: int = 1, tgt_round: int = 2) -> DataFrame:
    """Retained rows of one round take missing columns from the candidate's first row of another."""
    key = ["year", "counselling_type", "rank"]
    src = df.where(F.col("round") == src_round).groupBy(*key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("src"))
    fill = (F.col("round") == tgt_round) & (F.col("seat_outcome") == "RETAINED")
    return df.join(src, key, "left").withColumns({c: F.when(fill, F.coalesce(blank_to_null(F.col(c)), F.col(f"src.{c}"))).otherwise(F.col(c)) for c in cols}).drop("src")


def asof_backfill(df: DataFrame, key: list[str], order: str, cols: list[str], only_when: Column) -> DataFrame:
    """Missing columns take the last value that isn't empty of an earlier ``order``; of several rows in one
    step the least value counts. One shuffle on the key serves all columns: rows are dealt by it first, which both windows accept."""
    step, before = Window.partitionBy(*key, order), Window.partitionBy(*key).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    own = df.repartition(*key).withColumns({f"own_{c}": F.min(blank_to_null(F.col(c))).over(step) for c in cols})
    out = own.withColumns({f"last_{c}": F.last(f"own_{c}", ignorenulls=True).over(before) for c in cols})
    return out.withColumns({c: F.when(only_when, F.coalesce(blank_to_null(F.col(c)), F.col(f"last_{c}"))).otherwise(F.col(c)) for c in cols}).drop(*[f"{x}_{c}" for c in cols for x in ("own", "last")])


def _same(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in key])


def anti_append(target: DataFrame, batch: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of the batch whose key is new, one for each key; NULL keys are equal."""
    return without_known(keep_first(batch, key, order or [c for c in batch.columns if c not in key]), target.select(*key).distinct(), key)


def without_known(rows: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key isn't among the known ones; NULL keys are equal."""
    return rows.join(known, _same(rows, known, key), "left_anti")


def key_difference(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """J9, U2."""
    return a.join(b.select(*key), key, "left_anti")


def keep_used(dim: DataFrame, fact: DataFrame, key: list[str]) -> DataFrame:
    """Without orphans."""
    return dim.join(fact.select(*key), key, "left_semi")


def exact_name(left: DataFrame, right: DataFrame, norm, order: str) -> DataFrame:
    """Names that are equal in normal form; of several, the first by ``order``."""
    dim = right.withColumn("norm_name", norm(F.col("institute_name"))).groupBy("norm_name").agg(F.min_by(F.struct("institute_code", "institute_name"), F.col(order)).alias("hit"))
    return left.withColumn("norm_name", norm(F.col("name"))).join(dim, "norm_name").select("name", F.col("hit.institute_code").alias("institute_code"), F.lit(100).alias("score"))


def priority_join(left: DataFrame, right: DataFrame, keys: list, value: str) -> DataFrame:
    """The first key function that finds a row of ``right``; each is (name, Column to Column)."""
    tried = [
        left.select("name", f(F.col("name")).alias("k")).join(right.groupBy(f(F.col("institute_name")).alias("k")).agg(F.min(value).alias(value)), "k").select("name", F.lit(p).alias("priority"), value)
        for p, f in enumerate(keys)
    ]
    return reduce(DataFrame.unionByName, tried).groupBy("name").agg(F.min_by(value, "priority").alias(value), F.min("priority").alias("priority"))


def fill_missing(df: DataFrame, staging: DataFrame, key: str, cols: list[str], seq: str) -> DataFrame:
    """Missing columns from staging; for a key, the last row that has any of the values counts."""
    some = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in cols])
    last = staging.where(some).groupBy(key).agg(F.max_by(F.struct(*cols), F.col(seq)).alias("new"))
    return df.join(last, key, "left").withColumns({c: F.coalesce(blank_to_null(F.col(c)), F.col(f"new.{c}")) for c in cols}).drop("new")


def lookup(df: DataFrame, col: str, dictionary: DataFrame, default: str) -> DataFrame:
    """The value of a small table (key, value) for a column."""
    return df.join(dictionary.select(F.col("key").alias(col), "value"), col, "left").withColumn("value", F.coalesce("value", F.lit(default)))


def _alias_table(df: DataFrame, table: dict[str, list[str]], key) -> DataFrame:
    pairs = {key(alias): code for code, aliases in table.items() for alias in aliases}
    return F.broadcast(df.sparkSession.createDataFrame(list(pairs.items()), "_alias string, _code string"))  # a table that the caller holds in memory


def with_quota(df: DataFrame, col: str, out: str, table: dict[str, list[str]] = tables.QUOTA) -> DataFrame:
    """N4 for each row by look-up (J17): the alias as it is, then without dots, hyphens and spaces; else UNKNOWN."""
    key = F.upper(collapsed(F.col(col)))
    keyed = df.withColumns({"_exact": key, "_squashed": F.regexp_replace(key, "[-. ]", "")})
    exact, loose = (_alias_table(df, table, f).withColumnsRenamed({"_alias": a, "_code": c}) for f, a, c in ((lambda x: x, "_exact", "_code_1"), (squashed, "_squashed", "_code_2")))
    return keyed.join(exact, "_exact", "left").join(loose, "_squashed", "left").withColumn(out, F.coalesce("_code_1", "_code_2", F.lit("UNKNOWN"))).drop("_exact", "_squashed", "_code_1", "_code_2")


def with_category(df: DataFrame, col: str, out: str, table: dict[str, list[str]] = tables.CATEGORY) -> DataFrame:
    """N5 for each row by look-up; else UNKNOWN."""
    keyed = df.withColumn("_alias", F.upper(collapsed(F.col(col))))
    return keyed.join(_alias_table(df, table, lambda x: x), "_alias", "left").withColumn(out, F.coalesce("_code", F.lit("UNKNOWN"))).drop("_alias", "_code")


def saved_rows(df: DataFrame, keys: DataFrame, key: Column) -> DataFrame:
    """Rows whose row key is in a table."""
    return df.withColumn("row_key", key).join(keys.select("row_key"), "row_key", "left_semi")


def first_attrs(df: DataFrame, by: str, cols: list[str], order: list[str]) -> DataFrame:
    """Of each group, the columns of its first row."""
    return df.groupBy(by).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("first")).select(by, "first.*")


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key, NULL keys equal."""
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*key, "row.*").select(df.columns)


def upsert_last(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row for each key."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("row")).select(*key, "row.*").select(df.columns)


def precedence_union(parts: list[DataFrame], key: str) -> DataFrame:
    """For a key in several parts, the row of the first part."""
    tagged = reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(k)) for k, p in enumerate(parts)])
    rest = [c for c in tagged.columns if c != key]
    return tagged.groupBy(key).agg(F.min_by(F.struct(*rest), F.col("part")).alias("row")).select(key, "row.*")


def over_dictionary(df: DataFrame, col: str, functions: dict, stage: bool = False) -> DataFrame:
    """Applies costly Column functions to the distinct values of a column and joins the results back. ``stage``: they are written first, so
    that the optimizer knows how few they are and need not shuffle the rows for them."""
    own = df.select(col).where(F.col(col).isNotNull()).distinct()
    known = own.select(col, *[f(F.col(col)).alias(name) for name, f in functions.items()])
    return df.join(staged(known, "dictionary") if stage else known, col, "left")
