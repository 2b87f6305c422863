"""The driver's contract, and SQL for the registered queries."""

import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from vergraph.plans import catalog

SMALL = "/root/testdata/sf0.001"
NAMES = sorted(catalog.oracle_sql())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_need_no_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, tables, name):
    df = catalog.queries()[name](spark, SMALL)
    want = tables.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(want.fetchall(), columns)
