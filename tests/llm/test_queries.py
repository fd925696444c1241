"""The thin queries and the pipeline over the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from quillmill.llm import queries

TABLES = ("documents", "pages", "benchmark", "labels")


@pytest.fixture(scope="module")
def duck(tables):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(name, spark, tables, duck):
    got = queries.QUERIES[name](spark, tables)
    rows = sorted(repr(tuple(r[c] for c in sorted(got.columns))) for r in got.collect())
    assert rows
    if name in queries.ORACLES:
        want = duck.sql(queries.ORACLES[name])
        at = [want.columns.index(c) for c in sorted(got.columns)]
        assert sorted(want.columns) == sorted(got.columns)
        assert rows == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_pipeline(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    ids, columns = {r.doc_id for r in docs.collect()}, docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, tables).cache()
        now = {r.doc_id for r in docs.collect()}
        assert now <= ids and now
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if k in (1, 4):
            assert now == ids
        ids = now
    assert corpus_pipeline.run(spark, tables).count() == len(ids)
