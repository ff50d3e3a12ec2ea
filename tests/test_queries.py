"""Every query with SQL gives the rows that DuckDB gives, over the smallest test tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def normal(rows):
    return sorted((tuple("nan" if isinstance(v, float) and v != v else 0.0 if isinstance(v, float) and v == 0 else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    want = db.sql(f"SELECT {', '.join(f'"{c}"' for c in cols)} FROM ({SQL[name]})").fetchall()
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.count() >= 0


def test_sql_is_for_queries():
    assert set(SQL) <= set(QUERIES)
