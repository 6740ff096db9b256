from __future__ import annotations

import pytest

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])

#: Names that clash with what operators make on the way.
CLASHING = ["node", "component", "n_shingles", "bucket", "lang_pred", "toxic", "ids", "text_", "found", "gaps", "attempts", "range", "k", "h"]


@pytest.fixture()
def docs(spark):
    """Documents from (doc_id, text[, lang]), with all columns and columns of clashing names."""

    def make(rows, clash: bool = False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        from pyspark.sql import functions as F

        return df.withColumns({c: F.lit("x") for c in CLASHING}) if clash else df

    return make


ODD = [
    (5, None), (3, ""), (4, "  \n\t "), (7, "word"), (None, "a row without id"), (9, "the same row twice here now"), (9, "the same row twice here now"),
    (11, "tie one two three four five"), (12, "tie one two three four five"), (13, "x " * 30_000), (14, "<|endoftext|> é日本 \x00 <|startoftext|>"),
]


@pytest.fixture()
def odd():
    return ODD
