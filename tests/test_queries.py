import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = sorted(set(entry.oracle_sql()) & set(entry.queries()))


def view(con, name):
    path = f"{SF}/{name}.parquet"
    con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        view(c, f.removesuffix(".parquet"))
    return c


def plain(value):
    if isinstance(value, float):
        return f"{value:.6f}"
    return str(value)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    got = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    at = [want.columns.index(c) for c in cols]
    a = sorted([plain(r[c]) for c in cols] for r in got.collect())
    b = sorted([plain(r[i]) for i in at] for r in want.fetchall())
    assert a == b


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["intended", "observed", "count"]
