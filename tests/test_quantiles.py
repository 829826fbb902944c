"""Exact quantiles by passes, and metrics by slices."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import modelling, quantiles


@pytest.mark.parametrize("bins", [2048, 2])
def test_quantiles_equal_those_of_sorted_values(spark, monkeypatch, bins):
    monkeypatch.setattr(quantiles, "BINS", bins)
    r = random.Random(1)
    rows = [(r.gauss(0, 1e6), r.choice([1.0, 2.0, 2.0, 5.0, None]), float(i % 7) if i % 5 else math.nan, None) for i in range(301)]
    rows += [(1e300, 2.0, 3.0, None), (-1e300, 2.0, 3.0, None), (5e-324, 2.0, 3.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(4)
    shares = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = quantiles.exact_quantiles(df, ["a", "b", "c", "d"], shares)
    for i, c in enumerate("abc"):
        values = np.array([x[i] for x in rows if x[i] is not None and not math.isnan(x[i])])
        assert got[c] == pytest.approx(list(np.quantile(values, shares)), rel=1e-12)
    assert got["d"] == [None] * 6
    assert quantiles.exact_quantiles(df, ["b"], [0.3])["b"][0] == df.agg(F.percentile("b", F.lit(0.3))).first()[0]


def test_metrics_do_not_depend_on_slices(spark, monkeypatch):
    r = random.Random(2)
    rows = [(r.choice(["x", None]), r.choice([0, 1]), r.choice([r.random(), 0.5, 0.0, 1.0])) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, y int, score double")
    want = {}
    for slices in (1, 7, 4096):
        monkeypatch.setattr(modelling, "SLICES", slices)
        got = {x.g: tuple(x)[1:] for x in modelling.score_metrics(df, "y", "score", ["g"]).collect()}
        assert not want or all(got[k] == pytest.approx(v) for k, v in want.items())
        want = got
    for g, m in want.items():
        pos, neg = ([s for k, y, s in rows if k == g and y == c] for c in (1, 0))
        pairs = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
        assert m[2] == pytest.approx(pairs / len(pos) / len(neg))
