"""Every query with SQL against that SQL in DuckDB, order aside."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as driver

QUERIES, SQL = driver.queries(), driver.oracle_sql()
CORE = sorted(n for n in SQL if n in driver.queries() and not n.startswith(tuple(f"p{i}_" for i in range(1, 10))))


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return str(v)
    return f"{float(v):.4f}" if isinstance(v, (int, float)) else str(v)


def rows(table, columns, names):
    at = [columns.index(n) for n in names]
    return sorted(tuple(plain(r[i]) for i in at) for r in table)


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    con = duck.execute(SQL[name])
    columns = [c[0] for c in con.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(got, df.columns, sorted(columns)) == rows(con.fetchall(), columns, sorted(columns))


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SQL and n[:1] == "p" or n in ("admitted_load", "component_leads", "provision_matches") if not n[1:2].isdigit()))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert driver.entry(spark).count() == 12
