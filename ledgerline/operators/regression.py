"""Panel regression with errors that are robust to autocorrelation along each firm's time.

Everything that grows with the rows stays in Spark: means and co-moments of the variables are
one aggregate, and the lag-weighted products of scores another, behind a window by firm. A
group (a subperiod, an episode) is a key, so any number of them takes the same two passes, and
the solver sees one row of k x k numbers a group, in a task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import same_keys

_N, _B, _INV = "n__", "beta__", "inverse__"


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _square(flat: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((k, k))
    for x, (i, j) in zip(flat, _pairs(k), strict=True):
        out[i, j] = out[j, i] = x
    return out


def _solve(batches: Iterable[pd.DataFrame], k: int, by: list[str]) -> Iterator[pd.DataFrame]:
    """Slopes and the inverse of the centred moments of each group's row; null where they are singular."""
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            moments = _square(np.asarray(r.moments__, float), k + 1) * r.n__
            xx, xy = moments[1:, 1:], moments[1:, 0]
            scale = np.sqrt(np.diag(xx))
            inverse = None
            if r.n__ > k + 1 and np.all(scale > 0) and np.linalg.cond(xx / np.outer(scale, scale)) < 1e12:
                inverse = np.linalg.inv(xx / np.outer(scale, scale)) / np.outer(scale, scale)
            mean = np.asarray(r.means__, float)
            beta = None if inverse is None else inverse @ xy
            const = None if beta is None else mean[0] - mean[1:] @ beta
            rows.append((*(getattr(r, b) for b in by), r.n__, moments[0, 0], list(mean[1:]), None if beta is None else [const, *beta], None if inverse is None else list(inverse.ravel())))
        yield pd.DataFrame(rows, columns=[*by, _N, "spread__", "means__", _B, _INV])


def hac_regression(df: DataFrame, y: str, xs: list[str], firm: str, time: str, by: list[str] = (), lags: int = 4) -> DataFrame:
    """(by, term, coef, std_error, t_stat, n, r2) of the least-squares fit of ``y`` on a constant and ``xs``.

    Errors are Newey-West along each firm's time: products of scores up to ``lags`` periods apart
    count with weight 1 - distance / (lags + 1), whatever rows are missing in between.
    Rows with a null among the variables or keys don't count; rows of one firm and period
    add up their scores. A group with too few rows or dependent regressors has null results. ``by`` may
    not hold the names ``term``, ``coef``, ``std_error``, ``t_stat``, ``n`` and ``r2``.
    """
    by = list(by)
    k, names = len(xs), [y, *xs]
    number = lambda c: F.col(c).cast("double")
    known = df.select(*by, F.col(firm).alias("firm__"), F.col(time).alias("time__"), *(number(c).alias(f"v{i}__") for i, c in enumerate(names)))
    known = known.dropna(subset=["firm__", "time__", *(f"v{i}__" for i in range(k + 1))])
    moments = F.array(*(F.covar_pop(f"v{i}__", f"v{j}__") for i, j in _pairs(k + 1))).alias("moments__")
    sums = known.groupBy(*by).agg(F.count(F.lit(1)).alias(_N), F.array(*(F.avg(f"v{i}__") for i in range(k + 1))).alias("means__"), moments)
    keys = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema]
    fields = ", ".join([*keys, f"{_N} bigint", "spread__ double", "means__ array<double>", f"{_B} array<double>", f"{_INV} array<double>"])
    fits = sums.filter(F.col(_N) > 0).mapInPandas(lambda it: _solve(it, k, by), fields)

    solved = fits.filter(F.col(_B).isNotNull())
    held = known.join(solved.withColumnsRenamed({b: f"{b}__f" for b in by}), same_keys(by, "__f"))
    beta, inverse, mean = F.col(_B), F.col(_INV), F.col("means__")
    error = F.col("v0__") - beta[0] - sum((beta[i + 1] * F.col(f"v{i + 1}__") for i in range(k)), F.lit(0.0))
    centred = [F.col(f"v{i + 1}__") - mean[i] for i in range(k)]
    slopes = [sum((inverse[i * k + j] * centred[j] for j in range(k)), F.lit(0.0)) for i in range(k)]
    const = 1 / F.col(_N) - sum((mean[i] * slopes[i] for i in range(k)), F.lit(0.0))
    # The share of each row in each coefficient's error; rows of one firm and period add up.
    shares = held.select(*by, "firm__", "time__", error.alias("e__"), *(s.alias(f"w{i}__") for i, s in enumerate([const, *slopes])))
    scores = shares.groupBy(*by, "firm__", "time__").agg(F.sum(F.col("e__") * F.col("e__")).alias("ee__"), *(F.sum(F.col(f"w{i}__") * F.col("e__")).alias(f"s{i}__") for i in range(k + 1)))
    along = Window.partitionBy(*by, "firm__").orderBy("time__")

    def product(i: int) -> Column:
        s = F.col(f"s{i}__")
        out = s * s
        for back in range(1, lags + 1):
            gap = F.col("time__") - F.lag("time__", back).over(along)
            out = out + F.when(gap <= lags, 2 * (1 - gap / (lags + 1)) * s * F.lag(s, back).over(along)).otherwise(0.0)
        return out

    lagged = scores.select(*by, "ee__", *(product(i).alias(f"p{i}__") for i in range(k + 1)))
    spread = lagged.groupBy(*by).agg(F.sum("ee__").alias("rest__"), *(F.sum(f"p{i}__").alias(f"p{i}__") for i in range(k + 1)))
    both = fits.join(spread.withColumnsRenamed({b: f"{b}__f" for b in by}), same_keys(by, "__f"), "left")
    terms = F.explode(F.array(*(F.struct(F.lit(c).alias("term"), beta[i].alias("coef"), F.sqrt(F.when(F.col(f"p{i}__") < 0, 0.0).otherwise(F.col(f"p{i}__"))).alias("std_error")) for i, c in enumerate(["const", *xs]))))
    out = both.select(*by, F.col(_N).alias("n"), F.when(F.col("spread__") > 0, 1 - F.col("rest__") / F.col("spread__")).alias("r2"), terms.alias("t"))
    return out.select(*by, "t.*", F.try_divide(F.col("t.coef"), F.col("t.std_error")).alias("t_stat"), "n", "r2")


def nested_regressions(df: DataFrame, y: str, models: dict[str, list[str]], firm: str, time: str, by: list[str] = (), lags: int = 4) -> DataFrame:
    """The fits of several sets of regressors on the same rows: those that have all variables of all models."""
    used = list(dict.fromkeys(x for xs in models.values() for x in xs))
    same = df.dropna(subset=[y, *used])
    fits = [hac_regression(same, y, xs, firm, time, by, lags).select(F.lit(name).alias("model"), "*") for name, xs in models.items()]
    out = fits[0]
    for f in fits[1:]:
        out = out.unionByName(f)
    return out
