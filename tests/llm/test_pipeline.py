"""The pipeline stage by stage, and the SQL of the queries that have it."""

import zlib

import oracle
import pytest

import corpus_pipeline
from inkgauge.llm import queries
from inkgauge.llm.common import read, stored


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, name):
    difference = oracle.difference(oracle.connect(sf_dir), queries.oracle_sql()[name], queries.queries()[name](spark, sf_dir))
    assert difference is None, difference


def test_stages(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    columns, seen = docs.columns, [{r[0] for r in docs.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        seen.append({r[0] for r in docs.select("doc_id").collect()})
        assert seen[-1] <= seen[-2]
    assert len(seen[2]) < len(seen[1]) and len(seen[3]) < len(seen[2]) and seen[4] == seen[3]
    packed = corpus_pipeline.run(spark, sf_dir)
    rows = packed.select("doc_id", "length", "ids", "ids_crc32").collect()
    assert {r.doc_id for r in rows} == seen[4]
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)


def test_empty_documents(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        assert docs.count() == 0
