"""Registered queries against their SQL, and the pipeline end to end."""

import collections

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quarry.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.cases import awkward, documents
from tools.compare import connect, differs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    assert differs(spark, connect(SF), name, SF) is None


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and all(any(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14))


def test_stages_keep_columns_and_take_effect(spark):
    rows = [(i, t) for i, t in awkward() if i is not None]
    docs = documents(spark, rows + [(100 + i, t) for i, t in rows if t and len(t) > 600])
    text = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, step) in enumerate(corpus_pipeline.STAGES[:-1]):
        kept = step(spark, docs, SF)
        assert kept.columns == docs.columns and kept.count() < docs.count()
        docs = spark.createDataFrame(kept.collect(), kept.schema)
    lower = collections.Counter(text[r.doc_id].lower() for r in docs.collect())
    assert max(lower.values()) == 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}


def test_pipeline_runs(spark):
    df = corpus_pipeline.run(spark, SF)
    assert df.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"] and df.count() > 0
