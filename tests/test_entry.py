"""Every query with SQL gives the SQL's rows on the smallest sample tables."""

import datetime as dt
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are not here")
CORE = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(rows):
    def value(v):
        if isinstance(v, float):
            return round(v, 9) if math.isfinite(v) else str(v)
        return str(v) if isinstance(v, (dt.date, dt.datetime)) else v

    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.sql(sql)
    assert sorted(want.columns) == columns
    assert plain(rows) == plain(want.select(*(f'"{c}"' for c in columns)).fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
