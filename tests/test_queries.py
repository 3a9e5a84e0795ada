"""Every query of the core against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from loomline.plans import catalogue, external, formatting, intervals, signals, sourcing, state, text, timeline, vectors

BASE = os.environ.get("LOOMLINE_TESTDATA", "/root/testdata/sf0.001")
MODULES = (catalogue, external, formatting, intervals, signals, sourcing, state, text, timeline, vectors)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{BASE}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([plain(r[i]) for i in order]) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, BASE)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        cur = duck.execute(SQL[name])
        columns = [d[0] for d in cur.description]
        assert sorted(df.columns) == sorted(columns)
        assert got == rows(columns, cur.fetchall())
    else:
        assert df.columns


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
