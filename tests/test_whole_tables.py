"""Queries run over whole tables, which have more rows here than those of tests/test_entry.py."""

import datetime as dt
import os
from difflib import SequenceMatcher

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerline.operators import linkage
from ledgerline.plans import queries

from .test_entry import plain

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are not here")


@pytest.fixture(scope="module")
def duck(tmp_path_factory):
    """sf0.01 with events of 1,500 users in place of 150, in a folder of its own."""
    to = tmp_path_factory.mktemp("whole")
    c = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "events"):
        columns = "* REPLACE (user_id * 10 + event_id % 10 AS user_id)" if t == "events" else "*"
        c.sql(f"COPY (SELECT {columns} FROM '{SF}/{t}.parquet') TO '{to}/{t}.parquet' (FORMAT parquet)")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{to}/{t}.parquet'")
    return c, str(to)


def same_rows(spark, duck, name):
    """The query's rows, which equal those of its SQL."""
    c, folder = duck
    sql = entry.oracle_sql()[name]
    df = entry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    assert plain(map(tuple, rows)) == plain(c.sql(sql).select(*(f'"{x}"' for x in columns)).fetchall())
    return rows


@pytest.mark.parametrize("name", ["active_issue_quarters", "enriched_quarters", "reference_pick", "cut_events", "combine_middle", "default_episodes", "downgrade_panel"])
def test_all_bonds(spark, duck, name):
    rows = same_rows(spark, duck, name)
    assert rows
    if "issue_id" in rows[0]:
        assert max(r.issue_id for r in rows) > 1400


def test_all_people_and_firms(spark, duck):
    _, folder = duck
    n = spark.read.parquet(f"{folder}/customer.parquet").count()
    plain_, fuzzy = ({r.id: r for r in entry.queries()[q](spark, folder).collect()} for q in ("layered_link", "fuzzy_link"))
    assert len(plain_) == len(fuzzy) == n > 1400
    assert sum(r.n for r in entry.queries()["link_counts"](spark, folder).collect()) == n
    assert max(r.gvkey for r in plain_.values() if r.gvkey is not None) > 700
    people = {r.id: r.name_core for r in linkage.with_name_keys(queries._people(spark, folder), "name").collect()}
    blocks = {}
    for r in linkage.with_name_keys(queries._firms(spark, folder), "name").select("name_core").distinct().collect():
        blocks.setdefault(r.name_core[:4], []).append(r.name_core)
    near = lambda x: len(x) >= 6 and any(len(y) >= 6 and SequenceMatcher(None, y, x).ratio() >= 0.92 for y in blocks.get(x[:4], ()))
    open_ = [i for i, r in plain_.items() if r.match_type == "unmatched"]
    assert {i for i in open_ if fuzzy[i].match_type != "unmatched"} <= {i for i in open_ if near(people[i])}
    assert any(fuzzy[i].match_type == "fuzzy_name" for i in open_) and any(fuzzy[i].match_type == "unmatched" for i in open_)


@pytest.mark.parametrize("name", ["time_align", "span_expand", "valid_window_join", "window_grace_join", "latest_valid_left", "range_overlap"])
def test_all_orders_and_lines(spark, duck, name):
    assert same_rows(spark, duck, name)


def test_lines_that_repeat_a_number_count_as_they_stand_in_the_files(spark, tmp_path):
    columns = "l_orderkey bigint, l_linenumber int, l_quantity double, l_shipdate timestamp"
    folder = tmp_path / "lineitem.parquet"
    # Spark reads the larger file first; the lines of the smaller one stand first.
    for part, n in (("a", 40), ("b", 4000)):
        rows = [(k, 1, float(len(part) + n + i), dt.datetime(1995, 1, 1 + 9 * i)) for k in range(n) for i in (1, 0)]
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(str(tmp_path / part))
        folder.mkdir(exist_ok=True)
        next((tmp_path / part).glob("*.parquet")).rename(folder / f"{part}.parquet")
    spark.createDataFrame([(k, k, dt.datetime(1995, 1, 1)) for k in range(4000)], "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    got = {(r.tranche, r.start.day, r.amount) for r in entry.queries()["tranche_panel"](spark, str(tmp_path)).collect()}
    assert got == {(k, 10, 42.0 if k < 40 else 4002.0) for k in range(4000)}
