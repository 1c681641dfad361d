"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
import check

SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    c = duckdb.connect()
    for table in check.TABLES:
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return c


def test_every_sql_has_a_query():
    assert set(SQL) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, folder, con, name):
    df = contract.queries()[name](spark, folder)
    got = check._rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        assert got[1] > 0
        return
    cursor = con.execute(SQL[name])
    want = check._rows([d[0] for d in cursor.description], cursor.fetchall())
    assert got[:3] == want[:3]


def test_entry(spark):
    assert contract.entry(spark).count() > 0
