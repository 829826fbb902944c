"""Panel regression and walk-forward classifiers against plain numpy."""

import math
import random

import numpy as np
import pytest

from ledgerline.operators import classifiers, regression


def panel(seed, firms=12, periods=15):
    r = random.Random(seed)
    rows = []
    for f in range(firms):
        carry = 0.0
        for q in range(periods):
            if r.random() < 0.25:
                continue
            carry = 0.7 * carry + r.gauss(0, 1)
            a, b = r.gauss(f / 4, 1), r.random()
            rows.append((f"f{f}", q, 3 + 0.5 * a - 2 * b + carry, a, b, "early" if q < 8 else None))
    return rows


def plain_hac(rows, xs, lags):
    x = np.array([[1.0, *(r[i] for i in xs)] for r in rows])
    y = np.array([r[2] for r in rows])
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    e = y - x @ beta
    s = np.zeros((x.shape[1],) * 2)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            gap = abs(a[1] - b[1])
            if a[0] == b[0] and gap <= lags:
                s += (1 - gap / (lags + 1)) * e[i] * e[j] * np.outer(x[i], x[j])
    return beta, np.sqrt(np.diag(inv @ s @ inv)), 1 - e @ e / ((y - y.mean()) ** 2).sum()


SCHEMA = "firm string, q long, y double, a double, b double, part string"


@pytest.mark.parametrize("xs, lags", [(["a"], 4), (["a", "b"], 4), (["b", "a"], 0)])
def test_regression_equals_the_sandwich_of_all_pairs(spark, xs, lags):
    rows = panel(1)
    noise = [(None, 3, 1.0, 1.0, 1.0, "early"), ("f1", None, 1.0, 1.0, 1.0, None), ("f1", 99, None, 1.0, 1.0, None), ("f2", 99, 5.0, None, None, "early")]
    df = spark.createDataFrame([*rows, *noise], SCHEMA).repartition(5)
    got = {r.term: r for r in regression.hac_regression(df, "y", xs, "firm", "q", lags=lags).collect()}
    beta, error, r2 = plain_hac(rows, [SCHEMA.split(", ").index(f"{x} double") for x in xs], lags)
    assert list(got) == ["const", *xs]
    for k, term in enumerate(["const", *xs]):
        assert got[term].coef == pytest.approx(beta[k], rel=1e-9)
        assert got[term].std_error == pytest.approx(error[k], rel=1e-9)
        assert got[term].t_stat == pytest.approx(beta[k] / error[k], rel=1e-9)
        assert (got[term].n, got[term].r2) == (len(rows), pytest.approx(r2))


def test_groups_are_fitted_apart_and_null_groups_too(spark):
    rows = panel(2)
    out = regression.nested_regressions(spark.createDataFrame(rows, SCHEMA), "y", {"one": ["a"], "both": ["a", "b"]}, "firm", "q", by=["part"])
    got = {(r.model, r.part, r.term): (r.coef, r.std_error) for r in out.collect()}
    assert len(got) == 2 * (2 + 3)
    for part in ("early", None):
        own = [r for r in rows if r[5] == part]
        for model, xs in (("one", [3]), ("both", [3, 4])):
            beta, error, _ = plain_hac(own, xs, 4)
            assert got[model, part, "a"] == (pytest.approx(beta[1]), pytest.approx(error[1]))


def test_rows_of_one_firm_and_period_add_up(spark):
    rows = panel(3, firms=4) * 2
    got = {r.term: r.std_error for r in regression.hac_regression(spark.createDataFrame(rows, SCHEMA), "y", ["a"], "firm", "q").collect()}
    assert got["a"] == pytest.approx(plain_hac(rows, [3], 4)[1][1])


def test_dependent_regressors_and_no_rows(spark):
    df = spark.createDataFrame([("f", q, float(q), 1.0, float(q), "x") for q in range(9)], SCHEMA)
    assert [(r.coef, r.std_error, r.n) for r in regression.hac_regression(df, "y", ["a"], "firm", "q").collect()] == [(None, None, 9)] * 2
    assert regression.hac_regression(df.filter("false"), "y", ["a"], "firm", "q").count() == 0


# --- classifiers --------------------------------------------------------------------------


def plain_newton(x, y, penalty):
    m, d = x.mean(axis=0), x.std(axis=0)
    d[d == 0] = 1
    z = np.column_stack([np.ones(len(x)), (x - m) / d])
    ridge = penalty * np.array([0.0] + [1.0] * x.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-z @ w))
        w += np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(ridge) + 1e-12 * np.eye(len(w)), z.T @ (y - p) - ridge * w)
    slopes = w[1:] / d
    return np.concatenate([[w[0] - slopes @ m], slopes])


def labelled(seed, n=600):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = r.gauss(0, 3), r.random() * 100
        p = 1 / (1 + math.exp(-(0.6 * a - 0.04 * b + 1)))
        rows.append((i, i % 12, int(r.random() < p), a, b))
    return [*rows, (n, 3, None, 1.0, 1.0), (n + 1, 3, 1, None, 1.0)]


def test_folds_equal_plain_newton(spark):
    rows = labelled(4)
    df = spark.createDataFrame(rows, "id long, q long, y int, a double, b double").repartition(5)
    trains, tests = [f"q < {t}" for t in (0, 5, 9)], ["q = -1", "q = 5", "q >= 9"]
    models = classifiers.fit_folds(df, "y", ["a", "b"], trains, penalty=0.5)
    assert models.weights[0] is None
    known = [r for r in rows if None not in r]
    for k, t in ((1, 5), (2, 9)):
        own = [r for r in known if r[1] < t]
        want = plain_newton(np.array([r[3:] for r in own]), np.array([r[2] for r in own], float), 0.5)
        assert models.weights[k] == pytest.approx(want, rel=1e-7)
    got = {r.id: (r.fold, r.score) for r in classifiers.score_folds(df, models, tests).collect()}
    assert len(got) == len(rows)
    for i, q, _, a, b in known:
        fold = 1 if q == 5 else 2 if q >= 9 else None
        w = models.weights[fold] if fold else None
        want = None if w is None else pytest.approx(1 / (1 + math.exp(-(w[0] + w[1] * a + w[2] * b))))
        assert got[i] == (fold, want)


def test_separable_and_constant_features_stay_finite(spark):
    df = spark.createDataFrame([(q, int(q > 5), float(q), 7.0) for q in range(12)], "q long, y int, a double, b double")
    models = classifiers.fit_folds(df, "y", ["a", "b"], ["true", "q < 3"], penalty=1e-3)
    assert np.isfinite(models.weights[0]).all()
    assert models.weights[1] is None
    assert models.steps < classifiers.STEPS
    scored = classifiers.score_folds(df, models, ["true"]).collect()
    assert all((r.score > 0.5) == bool(r.y) for r in scored)
