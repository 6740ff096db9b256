"""The driver's contract."""

from __future__ import annotations

import __spark_entry__
from rankloom import queries


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "r1_closing_rank" in df.columns


def test_every_query_of_the_library_is_registered():
    found = __spark_entry__.queries()
    assert set(queries.queries()) <= set(found)
    assert set(__spark_entry__.oracle_sql()) <= set(found)
