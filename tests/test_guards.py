"""Checks that raise where a join or a key would go wrong, and small helpers."""

import logging

import pytest

from ledgerline.functions.scalars import percent
from ledgerline.operators import profiles
from ledgerline.sources import tables


def test_joins_that_would_add_rows_raise(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, x string")
    right = spark.createDataFrame([(1, 10), (3, 30), (None, 1), (None, 2)], "k int, y int")
    got = sorted(map(tuple, profiles.join_once(left, right, ["k"]).collect()), key=str)
    assert got == sorted([(1, "a", 10), (2, "b", None), (None, "c", None)], key=str)
    with pytest.raises(ValueError, match=r"not unique: 1 keys, among them \[\(3,\)\]"):
        profiles.join_once(left, right.unionByName(right.filter("k = 3")), ["k"])


def test_ambiguous_keys_raise(spark):
    df = spark.createDataFrame([("a", "g1"), ("a", "g1"), ("b", "g2"), ("b", None), (None, "g1"), (None, "g2")], "cusip string, gvkey string")
    assert profiles.require_unambiguous(df, ["cusip"], "gvkey").count() == 6
    with pytest.raises(ValueError, match="several values of gvkey"):
        profiles.require_unambiguous(df.unionByName(spark.createDataFrame([("b", "g3")], df.schema)), ["cusip"], "gvkey")


def test_coverage_after_a_merge(spark):
    left = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (3, "y"), (None, "y")], "k int, g string")
    right = spark.createDataFrame([(1,), (3,), (None,)], "k int")
    assert {tuple(r) for r in profiles.key_coverage(left, right, ["k"], ["g"]).collect()} == {("x", 2, 1, 0.5), ("y", 2, 1, 0.5)}
    profiles.require_coverage(left, right, ["k"], 0.5)
    with pytest.raises(ValueError, match="2 of 4"):
        profiles.require_coverage(left, right, ["k"], 0.6)


def test_small_helpers(spark, caplog):
    assert tables.unique_columns(["B", "a", "b", "A", "c"]) == ["B", "a", "c"]
    assert [tables.sql_literal(x) for x in ("O'Neil", 7, None, True, 1.5)] == ["'O''Neil'", "7", "NULL", "TRUE", "1.5"]
    df = spark.createDataFrame([(2001, 0.125), (2003, None)], "year int, share double")
    with caplog.at_level(logging.WARNING):
        assert tables.log_missing_years(df, "year", 2000, 2003) == [2000, 2002]
    assert "[2000, 2002]" in caplog.text
    assert [r[0] for r in df.orderBy("year").select(percent("share")).collect()] == ["12.5%", None]
