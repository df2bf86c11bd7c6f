"""Registered queries against their SQL, and the pipeline's stages, on the smallest tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from quern.llm import common, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plain(v):
    return round(v, 6) if isinstance(v, float) else v if isinstance(v, (int, bool, type(None))) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    sql = ", ".join(f'"{x}"' for x in cols)
    got = sorted((tuple(plain(r[x]) for x in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(map(plain, r)) for r in con.execute(f"SELECT {sql} FROM ({queries.ORACLES[name]})").fetchall()), key=repr)


def test_pipeline(spark):
    docs = common.read(spark, SF, "documents")
    first, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = common.cut(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns and 0 < docs.count() <= before
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count() <= first
