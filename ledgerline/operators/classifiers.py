"""Logistic classifiers over walk-forward folds, fitted by Newton steps that Spark sums up.

The fold is a key: a row is counted in every fold that trains on it, by an explode in front of
a partial aggregate, so rows are never shuffled and all folds take one pass a step. Of each
fold k + k (k + 1) / 2 sums reach the driver, which solves and sends k numbers back.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Newton steps at most, and the change of the log-odds' weights (in deviations) that ends them.
STEPS, SETTLED = 50, 1e-10


@dataclass(frozen=True)
class FoldModels:
    """Weights of each fold, the constant first, for features as they stand; None where a fold can't be fitted."""

    features: list[str]
    weights: list[np.ndarray | None]
    steps: int

    def logit(self, fold: int) -> Column:
        w = self.weights[fold]
        return sum((float(w[i + 1]) * F.col(c).cast("double") for i, c in enumerate(self.features)), F.lit(float(w[0])))


def _probability(logit: Column) -> Column:
    """1 / (1 + exp(-logit)) without overflow."""
    small = F.exp(-F.abs(logit))
    return F.when(logit >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def fit_folds(df: DataFrame, label: str, features: list[str], trains: list[str], penalty: float = 1e-6, steps: int = STEPS) -> FoldModels:
    """A logistic model for each condition of ``trains`` on the rows that satisfy it.

    ``penalty`` is the ridge on the weights of standardized features, not on the constant;
    it keeps separable folds finite. Rows with a null label or feature don't count. A fold without
    rows of both labels has no model. The rows are read once a step: persist them if they are dear.
    """
    known = df.dropna(subset=[label, *features])
    fold = F.explode(F.array_compact(F.array(*(F.when(F.expr(t), F.lit(i)) for i, t in enumerate(trains)))))
    rows = known.select(fold.alias("fold"), F.col(label).cast("double").alias("y"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)))
    k, n_folds = len(features), len(trains)
    stats = {r["fold"]: r for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"), *(F.avg(f"x{i}").alias(f"m{i}") for i in range(k)), *(F.stddev_pop(f"x{i}").alias(f"d{i}") for i in range(k))).collect()}
    mean, dev = np.zeros((n_folds, k)), np.ones((n_folds, k))
    able = [f for f in range(n_folds) if f in stats and 0 < stats[f]["pos"] < stats[f]["n"]]
    w = np.zeros((n_folds, k + 1))
    for f in able:
        mean[f] = [stats[f][f"m{i}"] for i in range(k)]
        dev[f] = [stats[f][f"d{i}"] or 1.0 for i in range(k)]
        w[f, 0] = np.log(stats[f]["pos"] / (stats[f]["n"] - stats[f]["pos"]))
    open_, done = set(able), 0
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    while open_ and done < steps:
        at = sorted(open_)
        table = lambda a: F.array(*(F.lit(float(x)) for x in a))
        known_ = F.create_map(*(x for f in at for x in (F.lit(f), F.struct(table(w[f]).alias("w"), table(mean[f]).alias("m"), table(dev[f]).alias("d")))))[F.col("fold")]
        placed = rows.filter(F.col("fold").isin(at)).withColumn("own", known_)
        z = [F.lit(1.0), *((F.col(f"x{i}") - F.col("own.m")[i]) / F.col("own.d")[i] for i in range(k))]
        p = _probability(sum((F.col("own.w")[i] * z[i] for i in range(k + 1)), F.lit(0.0)))
        flat = placed.select("fold", "y", p.alias("p"), *(z[i].alias(f"z{i}") for i in range(k + 1)))
        pq = F.col("p") * (1 - F.col("p"))
        sums = flat.groupBy("fold").agg(
            F.array(*(F.sum((F.col("y") - F.col("p")) * F.col(f"z{i}")) for i in range(k + 1))).alias("g"),
            F.array(*(F.sum(pq * F.col(f"z{i}") * F.col(f"z{j}")) for i, j in pairs)).alias("h"),
        )
        for r in sums.collect():
            f, ridge = r["fold"], penalty * np.array([0.0] + [1.0] * k)
            h = np.zeros((k + 1, k + 1))
            for x, (i, j) in zip(r["h"], pairs, strict=True):
                h[i, j] = h[j, i] = x
            step = np.linalg.lstsq(h + np.diag(ridge), np.array(r["g"]) - ridge * w[f], rcond=None)[0]
            step *= min(1.0, 4.0 / max(1e-300, np.abs(step).max()))  # far steps overshoot
            w[f] += step
            if np.abs(step).max() < SETTLED:
                open_.discard(f)
        done += 1
    out = []
    for f in range(n_folds):
        slopes = w[f, 1:] / dev[f]
        out.append(np.concatenate([[w[f, 0] - slopes @ mean[f]], slopes]) if f in able else None)
    return FoldModels(features, out, done)


def score_folds(df: DataFrame, models: FoldModels, tests: list[str], out: str = "score") -> DataFrame:
    """``df`` plus fold and ``out``: the probability by the first fold whose test condition a row satisfies.

    Rows of no test fold, of a fold without a model, or with a null feature have a null score.
    """
    fold = F.coalesce(*(F.when(F.expr(t), F.lit(i)) for i, t in enumerate(tests)))
    score = F.lit(None).cast("double")
    for i in reversed(range(len(tests))):
        if models.weights[i] is not None:
            score = F.when(F.col("fold") == i, _probability(models.logit(i))).otherwise(score)
    return df.withColumn("fold", fold).withColumn(out, score)
