import datetime as dt

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerline.operators import accounting, equity, temporal

D = dt.date
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
pairs = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 12)), min_size=1, max_size=14)


@SETTINGS
@given(left=pairs, right=pairs, exact=st.booleans())
def test_asof_backward_is_the_latest_row(spark, left, right, exact):
    l = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(left)], "k int, t int, i int")
    r = spark.createDataFrame([(k, t, j, None if j % 3 == 0 else j) for j, (k, t) in enumerate(right)], "k int, u int, j int, v int")
    got = {x.i: (x.j, x.v) for x in temporal.asof_backward(l, r, ["k"], "t", "u", ties=["j"], exact=exact).collect()}
    for i, (k, t) in enumerate(left):
        fits = [(u, j) for j, (k2, u) in enumerate(right) if k2 == k and (u < t or exact and u == t)]
        j = max(fits)[1] if fits else None
        assert got[i] == (j, None if j is None or j % 3 == 0 else j)


@SETTINGS
@given(left=pairs, right=pairs)
def test_next_after_is_strict(spark, left, right):
    l = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(left)], "k int, t int, i int")
    r = spark.createDataFrame(right, "k int, t int")
    got = {x.i: x.n for x in temporal.next_after(l, r, ["k"], "t", "n").collect()}
    for i, (k, t) in enumerate(left):
        assert got[i] == min((u for k2, u in right if k2 == k and u > t), default=None)


def test_validity_window_is_inclusive_and_open_ends_hold(spark):
    l = spark.createDataFrame([(1, D(2000, 1, 1)), (1, D(2000, 6, 30)), (1, D(2000, 7, 1)), (2, D(2050, 1, 1))], "k int, d date")
    r = spark.createDataFrame([(1, D(2000, 1, 1), D(2000, 6, 30)), (2, D(1999, 1, 1), None)], "k int, s date, e date")
    assert temporal.valid_join(l, r, ["k"], "d", "s", "e").count() == 3
    assert temporal.valid_join(l, r, ["k"], "d", "s", "e", grace_days=1).count() == 4


def test_latest_valid_keeps_unmatched_rows(spark):
    l = spark.createDataFrame([(1, D(2000, 3, 1)), (1, D(2001, 3, 1)), (9, D(2000, 1, 1))], "k int, d date")
    r = spark.createDataFrame([(1, D(1999, 1, 1), None, "old"), (1, D(2000, 1, 1), D(2000, 12, 31), "new")], "k int, s date, e date, n string")
    got = {(x.k, x.d): x.n for x in temporal.latest_valid(l, r, ["k"], "d", "s", "e").collect()}
    assert got == {(1, D(2000, 3, 1)): "new", (1, D(2001, 3, 1)): None, (9, D(2000, 1, 1)): None}


def test_range_anti_keeps_both_ends(spark):
    rows = spark.createDataFrame([(1, q) for q in range(6)], "k int, q int")
    spells = spark.createDataFrame([(1, 1, 3), (1, 4, None)], "k int, s int, e int")
    assert sorted(x.q for x in temporal.range_anti(rows, spells, ["k"], "q", "s", "e").collect()) == [0, 1, 3, 4]
    assert temporal.range_anti(rows, spells.limit(0), ["k"], "q", "s", "e").count() == 6


def test_gap_lag(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 4, 7)], "k int, q int, v int")
    assert [x.p for x in df.withColumn("p", temporal.gap_lag("v", ["k"], "q")).orderBy("q").collect()] == [None, 5, None]


# Point-in-time alignment; the quarter looked at ends on 2010-12-31.
Q = 2010 * 4 + 3


def aligned(spark, filings, cap=270, last=Q):
    df = spark.createDataFrame([(*f, i, float(i + 1)) for i, f in enumerate(filings)], "gvkey string, datadate date, rdq date, label int, atq double")
    out = accounting.align_quarters(df, Q, last, ["atq"], cap).collect()
    return {x.gvkey: x for x in out if x.q == Q}


def test_fresh_filing_is_kept(spark):
    x = aligned(spark, [("a", D(2010, 9, 30), D(2010, 11, 1))])["a"]
    assert not x.is_stale and x.atq == 1.0 and x.age_days == 60


def test_stale_filing_keeps_row_and_labels(spark):
    x = aligned(spark, [("a", D(2009, 9, 30), D(2009, 11, 1))])["a"]
    assert x.is_stale and x.atq is None and x.label == 0 and x.datadate == D(2009, 9, 30)


def test_age_of_the_cap_is_fresh(spark):
    at = lambda n: aligned(spark, [("a", D(2010, 1, 1), D(2010, 12, 31) - dt.timedelta(days=n))])["a"].is_stale
    assert not at(270) and at(271)


def test_cap_is_a_parameter(spark):
    filing = [("a", D(2010, 3, 31), D(2010, 5, 1))]
    assert not aligned(spark, filing)["a"].is_stale and aligned(spark, filing, cap=100)["a"].is_stale


def test_firms_are_independent(spark):
    out = aligned(spark, [("a", D(2010, 9, 30), D(2010, 11, 1)), ("b", D(2009, 6, 30), D(2009, 8, 1))])
    assert not out["a"].is_stale and out["b"].is_stale


def test_later_filings_are_never_used(spark):
    out = aligned(spark, [("a", D(2010, 9, 30), D(2010, 11, 1)), ("a", D(2010, 12, 31), D(2011, 2, 1)), ("a", D(2011, 3, 31), D(2010, 12, 1))])
    assert out["a"].label == 0


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 900), st.integers(-40, 200)), min_size=1, max_size=12))
def test_alignment_equals_brute_force(spark, rows):
    base = D(2009, 1, 1)
    filings = [(k, base + dt.timedelta(days=p), base + dt.timedelta(days=p + lag), i) for i, (k, p, lag) in enumerate(rows)]
    df = spark.createDataFrame(filings, "gvkey int, datadate date, rdq date, id int")
    first, last = 2009 * 4, 2011 * 4 + 3
    got = {(x.gvkey, x.q): (x.rdq, x.datadate) for x in accounting.align_quarters(df, first, last, []).collect()}
    want = {}
    for q in range(first, last + 1):
        end = (pd.Period(year=q // 4, quarter=q % 4 + 1, freq="Q")).end_time.date()
        for k in {f[0] for f in filings}:
            fits = [(f[2], f[1]) for f in filings if f[0] == k and f[1] <= end and f[2] <= end]
            if fits:
                want[k, q] = max(fits)
    assert got == want


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.sampled_from([-1.0, -0.5, 0.0, 0.1, 0.25])), min_size=1, max_size=30))
def test_compound_return_equals_pandas(spark, values):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, t int, r double")
    got = [x.c for x in df.withColumn("c", equity.compound_return("r", ["k"], "t")).orderBy("t").collect()]
    want = pd.Series(values, dtype=float).rolling(12, min_periods=9).apply(lambda x: np.prod(1 + x) - 1, raw=True)
    for g, w, n in zip(got, want, range(1, 99)):
        window = values[max(0, n - 12) : n]
        if n < 9 or None in window:
            assert g is None
        else:
            assert abs(g - w) < 1e-9


def test_delistings(spark):
    m = spark.createDataFrame([(1, D(2000, 1, 31), D(2000, 1, 31), 0.1, 5.0), (2, D(2000, 1, 31), D(2000, 1, 31), None, 6.0), (3, D(2000, 1, 31), D(2000, 1, 31), 0.2, 7.0)], "permno int, month date, date date, ret double, prc double")
    d = spark.createDataFrame([(1, D(2000, 1, 10), -0.5, 1.0), (2, D(2000, 1, 12), -0.3, None), (4, D(2000, 2, 5), -1.0, 0.5)], "permno int, dlstdt date, dlret double, dlprc double")
    got = {x.permno: (x.date, round(x.ret, 6), x.prc, x.delisted) for x in equity.with_delistings(m, d).collect()}
    assert got == {1: (D(2000, 1, 31), -0.45, 5.0, True), 2: (D(2000, 1, 31), -0.3, 6.0, True), 3: (D(2000, 1, 31), 0.2, 7.0, False), 4: (D(2000, 2, 5), -1.0, 0.5, True)}


def test_standard_filings(spark):
    cols = "gvkey string, datadate date, rdq date, datafqtr string, datacqtr string, indfmt string, datafmt string, popsrc string, consol string, sic string, sich int, atq double, dlttq double, dlcq double, oibdpq double, xintq double, niq double, actq double, lctq double, cheq double"
    std = ("INDL", "STD", "D", "C")
    row = lambda g, rdq, sic, sich, atq, dl, dc: (g, D(2010, 9, 30), rdq, "2010Q3", "2010Q3", *std, sic, sich, atq, dl, dc, 1.0, 0.0, 1.0, 2.0, 1.0, 1.0)
    df = spark.createDataFrame([
        row("a", D(2010, 10, 1), "3000", None, 10.0, 2.0, None), row("a", D(2010, 11, 1), "3000", None, 20.0, None, None),
        row("bank", D(2010, 11, 1), "6020", None, 1.0, 1.0, 1.0), row("util", D(2010, 11, 1), None, 4911, 1.0, 1.0, 1.0),
        row("unknown", D(2010, 11, 1), None, None, -5.0, 1.0, 2.0), row("undated", None, "3000", None, 1.0, 1.0, 1.0),
    ], cols)
    got = {x.gvkey: x for x in accounting.standard_filings(df).collect()}
    assert set(got) == {"a", "unknown"}
    assert got["a"].rdq == D(2010, 11, 1) and got["a"].total_debt is None and got["a"].debt_component_missing
    assert got["unknown"].total_debt == 3.0 and got["unknown"].leverage is None and got["unknown"].log_assets is None and got["a"].coverage_missing
