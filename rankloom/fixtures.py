"""Views over the driver tables that stand for allotments, institutes, mapping and courses, in SQL that Spark and DuckDB
share. Unused columns of a view are pruned by either engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .sources.workspace import contents

VIEWS = {
    "allot": """
SELECT CAST(year(o_orderdate) AS INT) AS year,
       CASE WHEN o_orderstatus = 'P' THEN 'STATE' ELSE 'AIQ' END AS counselling_type,
       CASE WHEN o_orderstatus = 'P' THEN cn.n_name END AS counselling_state,
       CAST((l_linenumber - 1) % 4 + 1 AS INT) AS round,
       CAST(l_orderkey AS BIGINT) AS rank, s_name AS institute_name,
       CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE concat('City', CAST(s_nationkey AS STRING)) END AS institute_city,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST(100000 + s_suppkey AS STRING) END AS institute_pincode,
       sn.n_name AS state, p_type AS course_norm, p_name AS course_raw, concat(s_name, ', City', CAST(s_nationkey AS STRING), ', ', sn.n_name) AS institute_raw,
       l_returnflag AS quota_norm, l_linestatus AS allotted_category_norm,
       CASE WHEN (l_linenumber - 1) % 4 = 0 THEN NULL WHEN l_partkey % 5 = 0 THEN 'LOST'
            WHEN l_partkey % 5 = 1 THEN 'NOT_ALLOTTED' WHEN l_partkey % 5 = 2 THEN 'RETAINED'
            WHEN l_partkey % 5 = 3 THEN 'UPGRADED' ELSE 'FRESH' END AS seat_outcome,
       CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_partkey AS BIGINT) AS l_partkey, CAST(l_suppkey AS BIGINT) AS l_suppkey
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
     JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey
     JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey
     JOIN part ON l_partkey = p_partkey""",
    "inst": """
SELECT CAST(s_suppkey AS BIGINT) AS institute_code, s_name AS institute_name, concat(s_name, ', ', n_name) AS display_name,
       CASE WHEN s_suppkey % 8 <> 3 THEN concat(CAST(s_suppkey % 90 AS STRING), ' Park Road, ', n_name) END AS address,
       CASE WHEN s_suppkey % 10 <> 4 THEN concat('University ', CAST(s_nationkey AS STRING)) END AS university,
       CASE WHEN s_suppkey % 9 <> 2 THEN CAST(s_suppkey % 40 * 25 AS STRING) END AS beds,
       CASE WHEN s_suppkey % 11 > 1 THEN CAST(CAST(floor(abs(s_acctbal)) AS BIGINT) + 100 AS STRING) END AS fee_yr2,
       CASE WHEN s_suppkey % 11 > 1 THEN CAST(CAST(floor(abs(s_acctbal)) AS BIGINT) + 200 AS STRING) END AS fee_yr3,
       CASE WHEN s_suppkey % 7 = 0 THEN '' WHEN s_suppkey % 7 > 1 THEN CAST(s_suppkey % 50 * 1000 AS STRING) END AS stipend_yr1,
       CASE WHEN s_suppkey % 7 > 1 THEN CAST(s_suppkey % 50 * 1100 AS STRING) END AS stipend_yr2,
       CASE WHEN s_suppkey % 7 > 1 THEN CAST(s_suppkey % 50 * 1200 AS STRING) END AS stipend_yr3,
       n_name AS state, CAST(100000 + s_suppkey AS STRING) AS pincode,
       CASE WHEN s_suppkey % 11 = 0 THEN 'NA' WHEN s_suppkey % 11 = 1 THEN NULL
            ELSE CAST(CAST(floor(abs(s_acctbal)) AS BIGINT) AS STRING) END AS annual_fee,
       CASE WHEN s_suppkey % 6 = 0 THEN '0' WHEN s_suppkey % 6 = 1 THEN ''
            ELSE CAST(s_suppkey * 1000 AS STRING) END AS bond_forfeit,
       CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(s_suppkey % 3 + 1 AS STRING) END AS bond_years,
       CASE WHEN s_suppkey % 4 = 0 THEN 'UNMATCHED' WHEN s_suppkey % 4 = 1 THEN 'OK_REVIEW' ELSE 'EXACT' END AS match_status
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "mapping": """
SELECT s_name AS db_institute_name, CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE CAST(s_suppkey AS BIGINT) END AS institute_code,
       CASE WHEN s_suppkey % 13 = 0 THEN 'UNKNOWN' WHEN s_suppkey % 3 = 0 THEN 'FUZZY' ELSE 'EXACT' END AS match_confidence
FROM supplier WHERE s_suppkey % 17 <> 16""",
    "courses": """
SELECT DISTINCT p_type AS course_norm,
       CASE WHEN p_type LIKE 'S%' THEN 'Clinical' WHEN p_type LIKE 'E%' THEN 'Para-Clinical' ELSE 'Pre-Clinical' END AS course_type
FROM part""",
    "r2_remarks": """
SELECT CAST(l_orderkey AS BIGINT) AS rank, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_partkey AS BIGINT) AS l_partkey, CAST(l_suppkey AS BIGINT) AS l_suppkey,
       CASE l_suppkey % 5 WHEN 0 THEN 'Reported' WHEN 1 THEN 'Not Reported' WHEN 2 THEN ' seat surrendered ' WHEN 3 THEN '-' END AS r1_status,
       CASE l_partkey % 6 WHEN 0 THEN 'Upgraded' WHEN 1 THEN 'Fresh Allotted in 2nd Round' WHEN 2 THEN 'Not Allotted'
            WHEN 3 THEN 'Did not fill up fresh choices' WHEN 4 THEN 'No Upgradation' END AS r2_remarks,
       CASE l_linenumber % 3 WHEN 0 THEN '-' WHEN 1 THEN NULL ELSE 'Inst' END AS r2_institute
FROM lineitem""",
    "raw_alias": """
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_partkey AS BIGINT) AS l_partkey, CAST(l_suppkey AS BIGINT) AS l_suppkey,
       CASE l_partkey % 8 WHEN 0 THEN 'A.I.Q.' WHEN 1 THEN ' all  india ' WHEN 2 THEN 'N.R.I.' WHEN 3 THEN 'dnb-post mbbs'
            WHEN 4 THEN 'Management Quota' WHEN 5 THEN '' WHEN 6 THEN 'zzz' END AS quota_raw,
       CASE l_suppkey % 6 WHEN 0 THEN 'UR' WHEN 1 THEN 'Open PwD' WHEN 2 THEN 'obc-ncl' WHEN 3 THEN 'SC PH' WHEN 4 THEN 'x' END AS category_raw,
       CASE l_linenumber % 4 WHEN 0 THEN '1,234' WHEN 1 THEN ' 77 ' WHEN 2 THEN 'Rank' END AS rank_raw,
       concat('Inst ', CAST(l_suppkey AS STRING), ', ',
              CASE l_partkey % 4 WHEN 0 THEN 'New Delhi' WHEN 1 THEN 'Orissa' WHEN 2 THEN 'Pune 411001' ELSE 'Nowhere' END) AS institute_raw
FROM lineitem""",
    "ballots": """
SELECT cand, p, s,
       CASE p % 8 WHEN 0 THEN 'A.I.Q.' WHEN 1 THEN ' all  india ' WHEN 2 THEN 'N.R.I.' WHEN 3 THEN 'dnb-post mbbs' WHEN 4 THEN 'Management Quota' WHEN 5 THEN '' WHEN 6 THEN 'zzz' END AS quota_raw,
       CASE s % 6 WHEN 0 THEN 'UR' WHEN 1 THEN 'Open PwD' WHEN 2 THEN 'obc-ncl' WHEN 3 THEN 'SC PH' WHEN 4 THEN 'x' END AS category_raw,
       CASE p % 4 WHEN 0 THEN 'New Delhi' WHEN 1 THEN 'Orissa' WHEN 2 THEN 'Pune 411001' ELSE 'Nowhere' END AS place,
       CASE s % 5 WHEN 0 THEN 'Reported' WHEN 1 THEN 'Not Reported' WHEN 2 THEN ' seat surrendered ' WHEN 3 THEN '-' END AS r1_status,
       CASE p % 6 WHEN 0 THEN 'Upgraded' WHEN 1 THEN 'Fresh Allotted in 2nd Round' WHEN 2 THEN 'Not Allotted' WHEN 3 THEN 'Did not fill up fresh choices' WHEN 4 THEN 'No Upgradation' END AS remarks
FROM (SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS cand, CAST(min(l_partkey) AS BIGINT) AS p, CAST(min(l_suppkey) AS BIGINT) AS s FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
    "turn_rows": "SELECT CAST(conv_id AS BIGINT) AS page_num, CAST(turn AS BIGINT) AS row_idx, role = 'user' AS is_base, text AS cell FROM conversations",
    "word_boxes": """
SELECT CAST(l_orderkey AS BIGINT) AS page_num, CAST(l_extendedprice AS DOUBLE) AS x0, CAST(l_quantity AS DOUBLE) AS top, l_returnflag AS word,
       CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_partkey AS BIGINT) AS l_partkey, CAST(l_suppkey AS BIGINT) AS l_suppkey
FROM lineitem""",
}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Tables that facts are made of, and the key that they are dealt by where they need dealing.
FACTS = {"lineitem": "l_orderkey"}


def spread(table: DataFrame, key: str) -> DataFrame:
    """A table of fewer files than there are cores is dealt out by a key, as a file of one row group would be read, joined and
    aggregated by a single task. A table of many files is read as it lies."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores, key) if len(table.inputFiles()) < cores else table


class Catalog:
    """The views of one folder as lazy DataFrames: ``Catalog(spark, dir).allot``; driver tables likewise. Each is planned once, when it is
    first named, as reading the schema of a table takes a job; it stands for the files that the table had then."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._planned = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES and name not in VIEWS:
            raise AttributeError(name)
        if name not in self._planned:
            self._planned[name] = self._table(name) if name in TABLES else self._view(name)
        return self._planned[name]

    def _table(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(table, FACTS[name]) if name in FACTS else table

    def _view(self, name: str) -> DataFrame:
        words = set(VIEWS[name].replace("\n", " ").split())
        return self.spark.sql(_bound(VIEWS[name], words), **{t: getattr(self, t) for t in TABLES if t in words})


_LAST: list[tuple[Catalog, tuple]] = []


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The catalog of a folder: the one of the last call as long as it is for the same session and folder and no file has changed since."""
    files = contents(spark, sf_dir)
    if not (_LAST and _LAST[0][0].spark is spark and _LAST[0][0].sf_dir == sf_dir and _LAST[0][1] == files):
        _LAST[:] = [(Catalog(spark, sf_dir), files)]
    return _LAST[0][0]


def _bound(sql: str, words: set[str]) -> str:
    """Table names become references to the DataFrames handed over with the query: no temporary views are left behind."""
    for t in TABLES:
        if t in words:
            for before in ("FROM", "JOIN"):
                sql = sql.replace(f"{before} {t} ", f"{before} {{{t}}} ").replace(f"{before} {t}\n", f"{before} {{{t}}}\n")
            if sql.endswith(f"FROM {t}"):
                sql = sql[: -len(t)] + f"{{{t}}}"
    return sql


def oracle(sql: str, steps: str = "") -> str:
    """``sql`` for DuckDB with the views that it or its ``steps`` name in front."""
    words = f"{steps} {sql}".replace("(", " ").replace(")", " ").replace(",", " ").replace(".", " ").split()
    tables = [*[f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in set(words)], *([steps] if steps else [])]
    return "WITH " + ", ".join(tables) + " " + sql if tables else sql
