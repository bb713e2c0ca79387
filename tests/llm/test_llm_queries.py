"""Registered queries against their SQL, and the pipeline against what its operators say."""

import pytest
from oracle import compare

import corpus_pipeline
from risklattice.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, sf, duck, key):
    assert compare(QUERIES[key](spark, sf), duck, ORACLES[key]) == ""


def test_every_operator_has_a_query():
    assert {k.split("_")[0] for k in QUERIES} == {f"op{n}" for n in range(1, 14)} | {"pipeline"}


def test_each_stage_takes_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).checkpoint() if spark.sparkContext.getCheckpointDir() else stage(spark, docs, sf).persist()
        sizes.append(docs.count())
        assert docs.columns[: len(columns)] == columns
    toxic, lines, near, clean, mix = sizes[1:]
    assert toxic < sizes[0] and lines == toxic and near < lines and clean < near and 0 < mix <= clean
    rows = docs.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    assert all(r.taken in (r.size, 2 * r.size) for r in rows)
