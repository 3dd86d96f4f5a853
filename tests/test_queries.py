"""Every graph query against its SQL on the smallest tables."""

import glob
import os

import pytest

from netlytics import queries as Q

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not glob.glob(f"{FOLDER}/*.parquet"), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    return round(v, 7) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_same_rows(spark, tables, name):
    df = Q.QUERIES[name](spark, FOLDER)
    found = tables.execute(Q.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=str)
    assert sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=str) == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
