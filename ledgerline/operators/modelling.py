"""Train-only statistics, scores and lead times for panels with a time split."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import same_keys

#: Slices of scores from 0 to 1 whose sums are added up before those of single scores.
SLICES = 4096


def winsorize(df: DataFrame, columns: list[str], train: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip columns to quantiles of the training rows; nulls stay. All bounds are one scalar, of one scan."""
    bounds = df.filter(train).agg(F.struct(*[F.percentile(c, F.array(F.lit(low), F.lit(high))).alias(c) for c in columns]).alias("b")).scalar()
    clip = lambda c: F.greatest(F.least(F.col(c), F.get(bounds[c], F.lit(1))), F.get(bounds[c], F.lit(0)))
    return df.withColumns({c: F.when(F.col(c).isNotNull(), clip(c)) for c in columns})


def z_scores(df: DataFrame, columns: list[str], train: str) -> DataFrame:
    """z_<column> by mean and deviation of the training rows, which are one scalar, of one scan."""
    stats = df.filter(train).agg(F.struct(*[F.struct(F.mean(c).alias("mean"), F.stddev_samp(c).alias("dev")).alias(c) for c in columns]).alias("s")).scalar()
    return df.withColumns({f"z_{c}": F.when(stats[c]["dev"] > 0, (F.col(c) - stats[c]["mean"]) / stats[c]["dev"]) for c in columns})


def pooled_rate(df: DataFrame, label: str, fine: list[str], coarse: list[str], least: int) -> DataFrame:
    """Mean label by fine cell, taken from the coarser cell where a fine one has under ``least`` rows."""
    both = df.filter(F.col(label).isNotNull()).groupBy(*fine).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("s"))
    w = Window.partitionBy(*coarse)
    pooled = F.sum("s").over(w) / F.sum("n").over(w)
    return both.select(*fine, "n", F.when(F.col("n") >= least, F.col("s") / F.col("n")).otherwise(pooled).alias("rate"))


def lead_time(df: DataFrame, events: DataFrame, key: str, at: str, signal: str, threshold: float, window: int) -> DataFrame:
    """(key, event, lead): periods from the first signal over the threshold, in the window before each event."""
    high = df.filter(F.col(signal) > threshold).select(F.col(key).alias("k__"), F.col(at).alias("at__"))
    match = (events[key] == F.col("k__")) & (F.col("at__") < events["event_at"]) & (F.col("at__") >= events["event_at"] - window)
    return events.join(high, match, "left").groupBy(events[key], "event_at").agg((F.col("event_at") - F.min("at__")).alias("lead"))


def lead_summary(leads: DataFrame, lead: str) -> DataFrame:
    """Events, those with a lead, mean, median and share over 0 of the leads, and the signed-rank statistic.

    Zeros are left out of the ranks, ties share the mean rank; ``w_plus`` is the sum of the
    ranks of positive leads and ``z`` its normal approximation, with the tie correction.
    Counts of each size are ranked, not rows, so the window holds as many rows as leads differ.
    """
    x = F.col(lead)
    stats = leads.agg(
        F.count(F.lit(1)).alias("n_events"), F.count(lead).alias("n_led"), F.avg(x.cast("double")).alias("mean_lead"),
        F.percentile(lead, F.lit(0.5)).alias("median_lead"), F.avg((x > 0).cast("double")).alias("share_positive"),
    )
    sizes = leads.filter(x != 0).groupBy(F.abs(x).alias("size")).agg(F.count(F.lit(1)).alias("t"), F.count_if(x > 0).alias("p"))
    rank = F.sum("t").over(Window.orderBy("size")) - (F.col("t") - 1) / 2
    ranked = sizes.select("t", "p", rank.alias("rank"))
    n, t = F.sum("t"), F.col("t").cast("double")
    spread = n * (n + 1) * (2 * n + 1) / 24.0 - F.sum(t * t * t - t) / 48.0
    w = F.coalesce(F.sum(F.col("p") * F.col("rank")), F.lit(0.0))
    tested = ranked.agg(w.alias("w_plus"), F.when(spread > 0, (w - n * (n + 1) / 4.0) / F.sqrt(spread)).alias("z"))
    return stats.withColumns({c: tested.select(c).scalar() for c in ("w_plus", "z")})


def _signed_rank_p(ts: pd.Series, ws: pd.Series, limit: pd.Series) -> pd.DataFrame:
    """P(W+ >= w) for counts ``t`` of ranks tied at each size, smallest first.

    The null distribution gives each rank either sign: it is the convolution of one
    two-point distribution a rank. Mean ranks of ties are halves, so ranks are doubled.
    """
    out = []
    for t, w, most in zip(ts, ws, limit, strict=True):
        t = np.asarray(t, np.int64)
        n = int(t.sum())
        doubled = np.repeat(2 * np.cumsum(t) - t + 1, t) if n <= most else None
        if n == 0:
            out.append((None, True))
        elif doubled is not None:
            chance = np.zeros(int(doubled.sum()) + 1)
            chance[0] = 1.0
            for r in doubled:
                chance[r:] += chance[: len(chance) - r].copy()
                chance /= 2
            out.append((min(1.0, float(chance[int(round(2 * w)) :].sum())), True))
        else:
            spread = n * (n + 1) * (2 * n + 1) / 24 - float((t.astype(float) ** 3 - t).sum()) / 48
            z = (w - n * (n + 1) / 4 - 0.5) / math.sqrt(spread)
            out.append((0.5 * math.erfc(z / math.sqrt(2)), False))
    return pd.DataFrame(out, columns=["p_value", "exact"])


def signed_rank_test(leads: DataFrame, lead: str, by: list[str] = (), exact_up_to: int = 200) -> DataFrame:
    """(by, n, w_plus, p_value, exact): whether leads tend to be positive, by Wilcoxon's signed ranks.

    One-sided: the chance of a rank sum of positive leads as large as ``w_plus`` or larger, with
    zeros left out and mean ranks for ties. Exact up to ``exact_up_to`` leads of a
    group; beyond that the normal form with corrections for ties and continuity. Leads are
    counted by size first, so a group is an array of as many entries as sizes differ.
    """
    by = list(by)
    x = F.col(lead)
    sizes = leads.filter(x != 0).groupBy(*by, F.abs(x).alias("size")).agg(F.count(F.lit(1)).alias("t"), F.count_if(x > 0).alias("p"))
    along = Window.partitionBy(*by).orderBy("size")
    ranked = sizes.withColumn("rank", F.sum("t").over(along) - (F.col("t") - 1) / 2)
    groups = ranked.groupBy(*by).agg(F.sum("t").alias("n"), F.sum(F.col("p") * F.col("rank")).alias("w_plus"), F.array_sort(F.collect_list(F.struct("size", "t"))).alias("sizes"))
    test = F.pandas_udf(_signed_rank_p, "struct<p_value double, exact boolean>")(F.col("sizes.t"), F.col("w_plus"), F.lit(exact_up_to))
    return groups.withColumn("test", test).select(*by, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"), "test.p_value", "test.exact")


def score_metrics(df: DataFrame, label: str, score: str, by: list[str], floor: float = 1e-15) -> DataFrame:
    """n, positives, AUC (ties count half), PR-AUC (average precision), Brier score and log loss by group.

    Rows without label or score don't count. Rows are summed by score first, and the running
    sums are made in two levels, over ``SLICES`` slices of the score and within each: no window holds
    all different scores of a group.
    """
    known = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    cells = known.groupBy(*by, score).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(label).cast("double")).alias("p"))
    cells = cells.withColumn("slice__", F.floor(F.col(score) * SLICES))
    higher = Window.partitionBy(*by).orderBy(F.desc("slice__")).rowsBetween(Window.unboundedPreceding, -1)
    whole = cells.groupBy(*by, "slice__").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    base = whole.select(*(F.col(b).alias(f"{b}__s") for b in by), F.col("slice__").alias("slice____s"), *(F.coalesce(F.sum(c).over(higher), F.lit(0.0)).alias(f"base_{c}") for c in ("p", "n")))
    down = Window.partitionBy(*by, "slice__").orderBy(F.desc(score))
    own = cells.withColumns({f"own_{c}": F.sum(c).over(down) for c in ("p", "n")})
    cells = own.join(base, same_keys([*by, "slice__"], "__s")).withColumns({f"above_{c}": F.col(f"own_{c}") + F.col(f"base_{c}") for c in ("p", "n")})
    s, p, q = F.col(score), F.col("p"), F.col("n") - F.col("p")
    sure = F.greatest(F.lit(floor), F.least(F.lit(1 - floor), s))
    out = cells.groupBy(*by).agg(
        F.sum("n").cast("bigint").alias("n"), F.sum("p").cast("bigint").alias("positives"),
        F.sum(q * (F.col("above_p") - p / 2)).alias("pairs"), F.sum(p * F.col("above_p") / F.col("above_n")).alias("precision"),
        F.sum(p * (1 - s) * (1 - s) + q * s * s).alias("squares"), F.sum(-p * F.ln(sure) - q * F.ln(1 - sure)).alias("loss"),
    )
    n, pos = F.col("n"), F.col("positives")
    return out.select(
        *by, "n", "positives", F.when((pos > 0) & (pos < n), F.col("pairs") / (pos * (n - pos))).alias("auc"),
        F.when(pos > 0, F.col("precision") / pos).alias("pr_auc"), (F.col("squares") / n).alias("brier"), (F.col("loss") / n).alias("log_loss"),
    )


def folds(first_test: int, last_test: int) -> list[tuple[str, str]]:
    """Expanding walk-forward splits as (train, test) conditions on q."""
    return [(f"q < {t}", f"q = {t}") for t in range(first_test, last_test + 1)]
