"""Every registered query of the engine against its SQL twin, at the smallest scale."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = entry.SMOKE_DIR
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{float(v):.3f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = df.collect()
    if name not in entry.oracle_sql():
        assert df.columns
        return
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert table(df.columns, got) == table(want.columns, want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
