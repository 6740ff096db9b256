"""Readers, writers and schema helpers."""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_to_null
from ..operators import joins as jn
from ..operators.aggregates import numbered
from ..operators.rows import LAYOUTS, RAW


def read_raw(spark: SparkSession, path: str, layout: str, start: int | None = None, end: int | None = None, test_pages: int | None = None, fmt: str = "parquet") -> DataFrame:
    """Raw rows of a page range; the layout says which first pages hold no data."""
    start = LAYOUTS[layout].start_page if start is None else start
    end = start + test_pages - 1 if test_pages else end
    rows = spark.read.schema(RAW).format(fmt).load(path).where(F.col("page_num") >= start)
    return rows if end is None else rows.where(F.col("page_num") <= end)


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """S4."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def approved_codes(review: DataFrame) -> DataFrame:
    """Codes of rows judged OK."""
    code = F.col("institute_code").cast("string").try_cast("double").cast("int")
    return review.where(F.upper(F.trim("judgement")) == "OK").select(code.alias("institute_code")).where("institute_code is not null").distinct()


def write_csv(df: DataFrame, path: str) -> None:
    """With header, empty for NULL, CRLF line ends; one file a partition."""
    df.write.option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"').option("lineSep", "\r\n").csv(path)


def unmatched_report(mapping: DataFrame, allotments: DataFrame) -> DataFrame:
    """Names without match, by name, numbered from 1, with a place."""
    place = jn.first_attrs(allotments.select("institute_name", "state", "institute_pincode"), "institute_name", ["state", "institute_pincode"], ["state", "institute_pincode"])
    names = mapping.where(F.col("match_confidence") == "UNKNOWN").select(F.col("db_institute_name").alias("institute_name"))
    return numbered(names.join(place, "institute_name", "left"), [F.col("institute_name")]).orderBy("no")


def append_new(target: DataFrame, batch: DataFrame, key: list[str], path: str) -> None:
    """Appends rows with new keys to the target's folder."""
    jn.anti_append(target, batch, key).write.mode("append").parquet(path)


def copy_table(spark: SparkSession, url: str, table: str, rows: DataFrame, pk: list[str], mode: str = "resume", properties: dict | None = None) -> DataFrame:
    """To a JDBC table: ``fresh`` overwrites, ``resume`` adds rows whose key isn't there yet. Returns what was written."""
    if mode == "fresh":
        new = rows
        new.write.jdbc(url, table, "overwrite", properties or {})
        return new
    there = spark.read.jdbc(url, table, properties=properties or {}).select(*pk)
    new = rows.join(there, pk, "left_anti")
    new.write.jdbc(url, table, "append", properties or {})
    return new


@dataclass(frozen=True)
class Copied:
    """A table to copy: its key, and a numeric column of it by which it is read in parallel."""

    name: str
    key: tuple[str, ...]
    split: str | None = None


def read_jdbc(spark: SparkSession, url: str, table: Copied, properties: dict, rows_each: int = 100_000, most: int = 64) -> DataFrame:
    """A table of a database, read in parts of about ``rows_each`` by ranges of its split column, ``most`` at a time."""
    if table.split is None:
        return spark.read.jdbc(url, table.name, properties=properties)
    column = f'"{table.split}"'
    low, high, n = spark.read.jdbc(url, f"(SELECT min({column}) AS lo, max({column}) AS hi, count(*) AS n FROM {table.name}) b", properties=properties).first()
    parts = max(1, min(most, -(-n // rows_each)))
    if low is None or parts == 1:
        return spark.read.jdbc(url, table.name, properties=properties)
    return spark.read.jdbc(url, table.name, column=column, lowerBound=int(low), upperBound=int(high) + 1, numPartitions=parts, properties=properties)


def copy_tables(spark: SparkSession, source: str, target: str, tables: list[Copied], mode: str = "resume", properties: dict | None = None, rows_each: int = 100_000) -> list[tuple[str, int]]:
    """Tables from one database to another, in the order given. ``fresh`` clears what is there; ``resume`` adds the rows whose key
    isn't there yet, so that a copy that was cut off anywhere is completed by another call and no key is written twice. Returns
    each table's name and number of rows written."""
    done = []
    for table in tables:
        rows = read_jdbc(spark, source, table, properties or {}, rows_each)
        if mode == "resume" and _has_table(spark, target, table.name, properties or {}):
            there = spark.read.jdbc(target, table.name, properties=properties or {}).select(*table.key)
            rows = jn.keep_first(rows, list(table.key), rows.columns).join(there, list(table.key), "left_anti")
            how = "append"
        else:
            how = "overwrite"
        written = Observation()
        rows.observe(written, F.count(F.lit(1)).alias("n")).write.option("truncate", True).jdbc(target, table.name, how, properties or {})
        done.append((table.name, written.get["n"]))
    return done


def _has_table(spark: SparkSession, url: str, table: str, properties: dict) -> bool:
    try:
        spark.read.jdbc(url, table, properties=properties).schema
        return True
    except Py4JJavaError:  # the database doesn't know it
        return False


def write_json(df: DataFrame, path: str) -> None:
    """S14."""
    df.write.json(path)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order and types; missing ones are NULL."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def missing_to_null(df: DataFrame) -> DataFrame:
    """Text columns with '' as NULL."""
    return df.select(*[blank_to_null(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema])
