"""The pipeline's stages on a small corpus, and the registered names."""

from __future__ import annotations

import __spark_entry__
import corpus_pipeline
from rankloom.llm import common

DATA = "/root/testdata/sf0.001"


def test_stages_follow_one_another(spark):
    docs = common.documents(spark, DATA)
    names, columns = {r.doc_id for r in docs.collect()}, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.staged(stage(spark, docs, DATA), name)
        kept = {r.doc_id for r in docs.collect()}
        assert docs.columns == columns and kept <= names and len(kept) > 0.6 * len(names)
        names = kept
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r.doc_id for r in pieces} == names
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()} == names


def test_registered_queries():
    found = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in found} and "pipeline" in found
    assert set(__spark_entry__.oracle_sql()) <= set(found)


def test_stages_on_odd_rows(spark, docs, odd):
    """Null, empty, repeated and long texts, null ids and columns of clashing names: what has no letter goes with language
    identification, of repeated rows one stays, the rest passes with all its columns. An empty table stays empty."""
    rows = docs(odd, clash=True)
    kept = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.staged(stage(spark, kept, DATA), name)
        assert kept.columns == rows.columns
    assert {r.doc_id for r in kept.collect()} <= {k for k, t in odd if t and t.strip()}
    assert kept.where("doc_id = 9").count() <= 1
    empty = docs([])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = common.staged(stage(spark, empty, DATA), name)
    assert empty.count() == 0 and corpus_pipeline.STAGES[-1][1](spark, empty, DATA).count() == 0
