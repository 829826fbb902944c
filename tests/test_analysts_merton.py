"""Analyst features and firm-month distances to default against plain Python."""

import datetime as dt
import math
import random

import numpy as np
import pytest

from ledgerline.operators import analysts, merton

D0 = dt.date(2010, 1, 1)


def day(n):
    return D0 + dt.timedelta(days=n)


def plain_features(grid, snaps, actuals, cap):
    first = {}
    for f, at, end, fpi, mean, dev, n in snaps:
        if at is None or end is None:
            continue
        key, row = (f, end, at), (fpi, mean, dev, n)
        first[key] = min(first.get(key, row), row, key=lambda r: tuple((x is not None, x) for x in r))
    out = {}
    for f, q in grid:
        able = [(at, -end.toordinal(), end) for (g, end, at), r in first.items() if g == f and at <= q and r[0] == "1"]
        held = (None,) * 7
        if able:
            at, _, end = max(able)
            _, mean, dev, n = first[f, end, at]
            before = [a for (g, e, a) in first if g == f and e == end and a < at]
            old = first[f, end, max(before)][1] if before else None
            if (q - at).days <= cap:
                rev = None if old is None or mean is None else mean - old
                held = (at, end, mean, n, rev, dev / abs(mean) if mean and dev is not None else None, None if rev is None else int(np.sign(rev)))
        told = []
        for g, end, ann, value in actuals:
            if g == f and ann is not None and end is not None and ann <= q:
                ex = [a for (h, e, a) in first if h == f and e == end and a < ann]
                want = first[f, end, max(ex)][1] if ex else None
                told.append((ann, end, None if want is None or value is None else value - want))
        told = max(told, key=lambda x: (x[0], x[1], x[2] is None, x[2] or 0)) if told else (None, None, None)
        out[f, q] = (*held, held[2] is None, *told[1:])
    return out


def test_features_use_only_what_was_known(spark):
    r = random.Random(7)
    snaps, actuals = [], []
    for f in ("a", "b", "c"):
        for _ in range(60):
            at = r.randrange(700)
            end = (at // 90 + r.choice([0, 1, 1, 2])) * 90 + 89
            snaps.append((f, day(at), day(end), str(end // 90 - at // 90 + 1), r.choice([None, 0.0, r.uniform(-2, 5)]), r.choice([None, 0.5]), r.randrange(1, 9)))
        actuals += [(f, day(q * 90 + 89), r.choice([None, day(q * 90 + 89 + r.randrange(-5, 200))]), r.uniform(-2, 5)) for q in range(7)]
    snaps += [("a", None, day(89), "1", 1.0, 1.0, 1), ("a", day(3), None, "1", 1.0, 1.0, 1), (snaps[0][0], *snaps[0][1:4], 9.0, 9.0, 9)]
    grid = [(f, day(q * 45)) for f in ("a", "b", "c", "none") for q in range(18)]
    got = analysts.analyst_features(
        spark.createDataFrame(grid, "firm string, at date"), spark.createDataFrame(snaps, "firm string, statpers date, fpedats date, fpi string, meanest double, stdev double, numest int"),
        spark.createDataFrame(actuals, "firm string, pends date, anndats date, value double"), "firm", "at", age_cap=60,
    )
    assert got.columns == ["firm", "at", "statpers", "fpedats", "meanest", "numest", "revision", "dispersion", "direction", "analyst_missing", "surprise_period", "surprise"]
    want = plain_features(grid, snaps, actuals, 60)
    rows = got.collect()
    assert len(rows) == len(grid)
    for x in rows:
        assert tuple(x[2:]) == pytest.approx(want[x.firm, x["at"]]), (x.firm, x["at"])


def test_a_revision_follows_its_period_over_the_roll(spark):
    """The period's consensus moves from horizon 2 to 1 as another period closes; only its own change counts."""
    snaps = [("a", day(80), day(89), "1", 1.0, 0.1, 5), ("a", day(80), day(179), "2", 3.0, 0.1, 5), ("a", day(100), day(179), "1", 3.5, 0.1, 5)]
    got = analysts.analyst_features(
        spark.createDataFrame([("a", day(101))], "firm string, at date"), spark.createDataFrame(snaps, "firm string, statpers date, fpedats date, fpi string, meanest double, stdev double, numest int"),
        spark.createDataFrame([("a", day(89), day(102), 1.4)], "firm string, pends date, anndats date, value double"), "firm", "at",
    ).first()
    assert (got.meanest, got.revision, got.direction, got.surprise) == (3.5, 0.5, 1, None)


# --- Merton -------------------------------------------------------------------------------


def cdf(x):
    return 0.5 * math.erfc(-x / math.sqrt(2))


def by_bisection(e, d, r, vol):
    lo, hi = e, e + 2 * d + 1
    for _ in range(200):
        v = (lo + hi) / 2
        d1 = (math.log(v / d) + r + vol**2 / 2) / vol
        lo, hi = (v, hi) if v * cdf(d1) - d * math.exp(-r) * cdf(d1 - vol) < e else (lo, v)
    return lo


def plain_month(days):
    e, d, r = (np.array(x, float) for x in zip(*days, strict=True))
    vol = np.diff(np.log(e)).std(ddof=1) * math.sqrt(252) * e[-1] / (e[-1] + d[-1])
    for k in range(1, 51):
        v = np.array([by_bisection(*x, vol) for x in days])
        new = np.diff(np.log(v)).std(ddof=1) * math.sqrt(252)
        vol, change = new, abs(new - vol)
        if change <= 1e-5:
            break
    v = np.array([by_bisection(*x, vol) for x in days])
    drift = np.diff(np.log(v)).mean() * 252
    distance = (math.log(v[-1] / d[-1]) + drift - vol**2 / 2) / vol
    return v[-1], vol, drift, distance, cdf(-distance), k


def test_normal_distribution():
    x = np.array([*np.linspace(-12, 12, 4001), np.nan])
    assert merton._cdf(x)[:-1] == pytest.approx([cdf(v) for v in x[:-1]], abs=1e-14)


def daily_rows(seed):
    r = random.Random(seed)
    rows = []
    for f in ("a", "b"):
        e = 100.0
        for n in range(0, 500, 3):
            e *= math.exp(r.gauss(0, 0.02))
            rows.append((f, day(n), e, 60.0 + n // 100, 0.02 + n / 20000))
    return rows


def test_months_equal_a_plain_solver_and_not_their_neighbours(spark):
    rows = daily_rows(8)
    bad = [("a", day(1), None, 1.0, 0.1), ("a", day(2), -5.0, 1.0, 0.1), (None, day(2), 5.0, 1.0, 0.1), ("b", None, 5.0, 1.0, 0.1), ("c", day(5), 5.0, 1.0, 0.1)]
    schema = "firm string, day date, equity double, debt double, rate double"
    df = spark.createDataFrame(rows + bad + rows[:40], schema).repartition(4)
    got = {(x.firm, x.month_end): x for x in merton.merton_months(df, "firm", "day", months=6, least=30).collect()}
    for (f, end), x in got.items():
        first = end.year * 12 + end.month - 6
        own = [r for r in rows if r[0] == f and first < r[1].year * 12 + r[1].month <= first + 6]
        assert x.n_days == (len(own) if f != "c" else 1)
        if x.n_days < 30:
            assert x.distance is None and x.rounds is None
        elif end.month % 4 == 0:
            want = plain_month([r[2:] for r in own])
            assert tuple(x)[3:8] == pytest.approx(want[:5], rel=1e-4, abs=1e-9)
            assert x.converged and x.rounds == want[5]
    one = merton.merton_months(spark.createDataFrame([r for r in rows if r[0] == "a"], schema), "firm", "day", months=6, least=30)
    assert {tuple(x) for x in one.collect()} == {tuple(x) for k, x in got.items() if k[0] == "a"}
    quarters = merton.merton_quarters(spark.createDataFrame([x for x in got.values() if x.firm != "c"]), "firm").collect()
    assert quarters and all(x.month_end <= x.quarter_end and (x.quarter_end - x.month_end).days < 92 for x in quarters)


def test_single_rows_do_not_depend_on_their_batch(spark):
    rows = [(i, 50.0 * 2.0 ** (i % 7), 0.05 + i % 9 / 8, 40.0 + i, 0.01 * (i % 5)) for i in range(60)] + [(99, None, 0.2, 1.0, 0.0), (98, 1.0, 0.0, 1.0, 0.0)]
    schema = "id int, equity double, equity_vol double, debt double, rate double"
    together = {r.id: tuple(r) for r in merton.merton(spark.createDataFrame(rows, schema).coalesce(1)).collect()}
    for k in (0, 13, 59, 98, 99):
        assert tuple(merton.merton(spark.createDataFrame([next(r for r in rows if r[0] == k)], schema)).first()) == together[k]
    assert together[98][5:] == (None,) * 3


def test_windows_side_by_side_are_solved_as_each_alone():
    draw = np.random.default_rng(4)
    e, d, r = 4e5 + draw.exponential(6e4, 400), 1.5e5 + draw.integers(1, 13, 400) * 5e3, np.full(400, 0.03)
    e[300:] = 5e5  # no moves at all: nothing to estimate
    low, high = np.array([0, 5, 60, 310, 100]), np.array([60, 90, 200, 390, 103])
    found = merton.month_estimates(e, d, r, low, high)
    for i, (a, b) in enumerate(zip(low, high, strict=True)):
        alone = merton.month_estimate(e[a:b], d[a:b], r[a:b])
        assert (alone[0] is None) == (i == 3) == bool(np.isnan(found[0][i]))
        for x, y in zip(alone, (c[i] for c in found), strict=True):
            assert x is None and np.isnan(y) or x == pytest.approx(y, rel=1e-9)
    # The call on the assets is worth the equity on the window's last day.
    v, s, due = found[0][2], found[1][2], d[199] * np.exp(-0.03)
    d1 = (np.log(v / due) + s * s / 2) / s
    assert v * merton._cdf(np.array([d1]))[0] - due * merton._cdf(np.array([d1 - s]))[0] == pytest.approx(e[199], rel=1e-8)
