import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import calendar as C
from ledgerline.functions import scalars as S
from ledgerline.operators import select


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


@pytest.mark.parametrize("day, end, q", [("2000-01-01", "2000-03-31", 8000), ("2010-12-31", "2010-12-31", 8043), ("2012-02-29", "2012-03-31", 8048), ("2024-11-30", "2024-12-31", 8099)])
def test_quarters(spark, day, end, q):
    d = F.lit(day).cast("date")
    assert one(spark, C.quarter_end(d), C.quarter_index(d), C.quarter_end_of(C.quarter_index(d))) == (dt.date.fromisoformat(end), q, dt.date.fromisoformat(end))


def test_grid_has_one_hundred_quarters(spark):
    rows = C.quarter_grid(spark, "2000-01-01", "2024-12-31").orderBy("q").collect()
    assert len(rows) == 100 and rows[0].quarter_end == dt.date(2000, 3, 31) and rows[-1].quarter_end == dt.date(2024, 12, 31)


def test_span_is_clipped_and_empty_spans_vanish(spark):
    df = spark.createDataFrame([(1, 3, 5), (2, 9, 4), (3, -5, 2), (4, None, 3)], "k long, s long, e long")
    out = C.expand_span(df, "s", "e", "q", 0, 4)
    assert sorted((r.k, r.q) for r in out.collect()) == [(1, 3), (1, 4), (3, 0), (3, 1), (3, 2)]


def test_guarded_ratio_and_log(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (1.0, -1.0), (None, 2.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in df.select(S.guarded_ratio("a", "b")).collect()] == [0.5, None, None, None, None]
    assert [r[0] is None for r in df.select(S.guarded_log("b")).collect()] == [False, True, True, False, True]


def test_known_sum_and_missing_flags(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (1.0, 2.0)], "a double, b double")
    assert [tuple(r) for r in df.select(S.sum_known("a", "b"), S.any_missing("a", "b")).collect()] == [(1.0, True), (None, True), (3.0, False)]


def test_numbers_that_cannot_be_read_are_null(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], "a string")
    assert [r[0] for r in df.select(S.number("a")).collect()] == [1.5, None, None, None]


@pytest.mark.parametrize("raw, norm, core", [("Acme Holdings, Incorporated", "ACME HLDGS INC", "ACME"), ("ACME HOLDINGS INC", "ACME HLDGS INC", "ACME"), ("Zinc", "ZINC", "ZINC"), ("Trust Co", "TRUST CO", ""), (None, "", ""), ("A and B", "A & B", "A&B")])
def test_name_keys(spark, raw, norm, core):
    n = S.name_norm(F.lit(raw).cast("string"))
    assert one(spark, n, S.name_core(n)) == (norm, core)


def test_first_and_last_disagree_on_where_nulls_go(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", None, 2), ("a", 3, 3)], "k string, v int, id int")
    assert select.first_by(df, ["k"], "v").first().id == 1
    assert select.first_by(df, ["k"], "-v").first().id == 3
    assert select.last_by(df, ["k"], "v").first().id == 2


@pytest.mark.parametrize("values, middle", [([5], 5), ([3, 9], 9), ([9, 1, 4], 4), ([1, 2, 3, 4], 3)])
def test_middle(spark, values, middle):
    df = spark.createDataFrame([("k", v) for v in values], "k string, v int")
    assert [r.v for r in select.middle_by(df, ["k"], "v").collect()] == [middle]


def test_hash_sample_repeats(spark):
    df = spark.range(500)
    a, b = (sorted(r.id for r in select.hash_sample(df.repartition(n), 40, "id").collect()) for n in (1, 3))
    assert a == b and len(a) == 40
