"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math
import os

import pytest

import __spark_entry__ as entry

WHERE = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(WHERE), reason="no tables")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def connection():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(WHERE):
        path = os.path.join(WHERE, f)
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return repr(round(float(v), 9)) if isinstance(v, float) or hasattr(v, "as_tuple") else str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, connection, name):
    df = entry.queries()[name](spark, WHERE)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = connection.execute(entry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert got and got == want


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"p{n}_found" for n in (1, 5)} <= set(entry.queries())
