"""Every registered query against its DuckDB statement on sf0.001
(row count, columns and an order-insensitive value hash)."""
import os

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"
NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    s = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    d = rows_of(cols, cur.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert s == d


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "main_movement" in df.columns
