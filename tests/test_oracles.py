"""Every query that has SQL gives the same rows in DuckDB, on the smallest tables; those with structural ties also on larger ones."""

import decimal
import os

import duckdb
import pytest

from sequent.plans import catalog

DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TIES = ["w_posterior", "a_class_posterior", "a_posterior_vector", "a_param_posterior"]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


@pytest.fixture(scope="module")
def duck():
    return connected(DATA)


def plain(value):
    if value is None:
        return ""
    if isinstance(value, (int, float, decimal.Decimal)) and not isinstance(value, bool):
        return f"{float(value) + 0.0:.9f}"
    return str(value)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    compare(spark, duck, name, DATA)


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no tables")
@pytest.mark.parametrize("name", TIES)
def test_same_rows_of_larger_tables(spark, name):
    compare(spark, connected(LARGER), name, LARGER)


def compare(spark, con, name, folder):
    """The same rows, value for value to nine decimals: queries round what depends on the order of a sum."""
    df = catalog.queries()[name](spark, folder)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    result = con.execute(catalog.oracle_sql()[name])
    columns = [x[0] for x in result.description]
    want = sorted(tuple(plain(r[columns.index(c)]) for c in names) for r in result.fetchall())
    assert sorted(columns) == names
    assert got == want
