"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from quern.plans import catalog, joins, live, requests  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 6) if isinstance(v, float) else v if isinstance(v, (int, bool, type(None))) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = ", ".join(f'"{c}"' for c in cols)
    want = sorted((tuple(map(plain, r)) for r in duck.execute(f"SELECT {sql} FROM ({catalog.ORACLES[name]})").fetchall()), key=repr)
    assert got == want
