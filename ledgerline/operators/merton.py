"""Distance to default by Merton's model: of single rows, and of firm-months from daily equity.

Each row, or each month, is iterated until it settles by itself, so no result depends on what
stands in the same batch.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Trading days a year.
YEAR = 252


#: Half-width and steps of the grid between whose points the normal distribution is interpolated.
_REACH, _STEPS = 9.0, 1 << 14
_AT = np.linspace(-_REACH, _REACH, _STEPS + 1)
_PDF = np.exp(-_AT * _AT / 2) / math.sqrt(2 * math.pi)
_CDF = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in _AT])


def _cdf(x: np.ndarray) -> np.ndarray:
    """Normal distribution, by cubics through values and slopes (error under 1e-14)."""
    h = _AT[1] - _AT[0]
    place = np.clip((np.nan_to_num(x) + _REACH) / h, 0, _STEPS - 1e-9)
    k = place.astype(np.int64)
    t = place - k
    u = 1 - t
    return u * u * (1 + 2 * t) * _CDF[k] + t * t * (1 + 2 * u) * _CDF[k + 1] + h * t * u * (u * _PDF[k] - t * _PDF[k + 1])


def merton(df: DataFrame, rounds: int = 100, tolerance: float = 1e-8) -> DataFrame:
    """Asset value, asset volatility and distance to default of (equity, equity_vol, debt, rate), a horizon of one year.

    A fixed-point iteration on each row, vectorised over those of an Arrow batch that haven't
    settled; rows that lack an input or a positive value give nulls.
    """
    extra = "asset_value double, asset_vol double, distance double"

    def solve(batches):
        for pdf in batches:
            inputs = [pdf[c].to_numpy(dtype=float) for c in ("equity", "equity_vol", "debt", "rate")]
            e, s, d, r = inputs
            good = (e > 0) & (s > 0) & (d > 0) & np.isfinite(r)
            v, sv = np.full(len(pdf), np.nan), np.full(len(pdf), np.nan)
            v[good], sv[good] = e[good] + d[good], s[good] * e[good] / (e[good] + d[good])
            open_ = np.flatnonzero(good)
            for _ in range(rounds):
                if not len(open_):
                    break
                eo, so, do, ro = (x[open_] for x in inputs)
                d1 = (np.log(v[open_] / do) + ro + sv[open_] ** 2 / 2) / sv[open_]
                n1, n2 = _cdf(d1), _cdf(d1 - sv[open_])
                nv = (eo + do * np.exp(-ro) * n2) / n1
                ns = so * eo / (nv * n1)
                settled = (np.abs(nv - v[open_]) < tolerance * v[open_]) & (np.abs(ns - sv[open_]) < tolerance)
                v[open_], sv[open_] = nv, ns
                open_ = open_[~settled]
            out = pdf.assign(asset_value=v, asset_vol=sv, distance=(np.log(v / np.where(good, d, np.nan)) + r - sv**2 / 2) / sv)
            yield out.astype(object).where(pd.notna(out), None) if not good.all() else out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(solve, f"{fields}, {extra}")


def asset_values(equity: np.ndarray, debt: np.ndarray, rate: np.ndarray, vol: float | np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """The asset values at which a call on the assets is worth the equity, a horizon of one year.

    Newton's steps: the call's value is convex and rising in the assets', so from the second
    on they come from above and never overshoot. ``vol`` is one number, or one for each value.
    """
    v = equity + debt if start is None else start.copy()
    due = debt * np.exp(-rate)
    vol = np.broadcast_to(np.asarray(vol, float), v.shape)
    open_, left = np.arange(len(v)), (v, due, equity, vol)
    for _ in range(100):
        vo, do, eo, so = left
        d1 = (np.log(vo / do) + so**2 / 2) / so
        n1 = _cdf(d1)
        step = (vo * n1 - do * _cdf(d1 - so) - eo) / np.maximum(n1, 1e-12)
        vo = np.maximum(vo - step, eo)
        v[open_] = vo
        more = np.abs(step) > 1e-10 * vo
        if not more.any():
            break
        open_, left = open_[more], (vo[more], do[more], eo[more], so[more])
    return v


def month_estimate(equity: np.ndarray, debt: np.ndarray, rate: np.ndarray, tolerance: float = 1e-5, rounds: int = 50) -> tuple:
    """(asset_value, asset_vol, asset_return, distance, edf, rounds, converged) of one window of days; see :func:`month_estimates`."""
    found = month_estimates(equity, debt, rate, np.array([0]), np.array([len(equity)]), tolerance, rounds)
    return tuple(None if isinstance(x := c[0].item(), float) and math.isnan(x) else x for c in found)


def month_estimates(equity: np.ndarray, debt: np.ndarray, rate: np.ndarray, low: np.ndarray, high: np.ndarray, tolerance: float = 1e-5, rounds: int = 50) -> tuple[np.ndarray, ...]:
    """(asset_value, asset_vol, asset_return, distance, edf, rounds, converged), each an array over windows of days low <= i < high.

    The asset volatility starts from the equity's; with it the days' asset values are solved, their
    log returns give a new volatility, until it changes by no more than ``tolerance``. Windows are
    solved side by side, but each by itself. What can't be estimated is NaN.
    """
    n = len(low)
    value, vol, drift, distance, edf = (np.full(n, np.nan) for _ in range(5))
    k, settled = np.zeros(n, np.int64), np.zeros(n, bool)
    if not n:
        return value, vol, drift, distance, edf, k, settled

    def deviation(x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A year's deviation of the moves within each window, whose values stand one after another."""
        at, m = np.cumsum(size) - size, size - 1
        moves = np.diff(np.log(x), append=0.0)
        moves[at + m] = 0.0
        away = moves - np.repeat(np.add.reduceat(moves, at) / m, size)
        away[at + m] = 0.0
        return np.sqrt(np.add.reduceat(away * away, at) / (m - 1)) * math.sqrt(YEAR)

    def flat(which: np.ndarray) -> tuple:
        """Places in the days, and numbers of days, of some windows."""
        size = high[which] - low[which]
        return np.arange(size.sum()) + np.repeat(low[which] - (np.cumsum(size) - size), size), size

    open_ = np.arange(n)
    at, size = flat(open_)
    last = high - 1
    vol = deviation(equity[at], size) * equity[last] / (equity[last] + debt[last])
    open_ = np.flatnonzero(vol > 0)
    at, size = flat(open_)
    e, d, r, v = equity[at], debt[at], rate[at], None
    done, solved = open_[:0], np.empty(0)
    while len(open_):
        v = asset_values(e, d, r, np.repeat(vol[open_], size), v)
        new = deviation(v, size)
        near = np.abs(new - vol[open_]) <= tolerance
        vol[open_], k[open_] = new, k[open_] + 1
        good = new > 0
        settled[open_] = near & good
        stop = near | ~good | (k[open_] >= rounds)
        if stop.any():
            done, solved = np.concatenate([done, open_[stop & good]]), np.concatenate([solved, v[np.repeat(stop & good, size)]])
            keep = np.repeat(~stop, size)
            open_, size, e, d, r, v = open_[~stop], size[~stop], e[keep], d[keep], r[keep], v[keep]
    if len(done):
        at, size = flat(done)
        v = asset_values(equity[at], debt[at], rate[at], np.repeat(vol[done], size), solved)
        end = np.cumsum(size) - 1
        s = vol[done]
        value[done] = v[end]
        drift[done] = np.log(v[end] / v[end - size + 1]) / (size - 1) * YEAR
        distance[done] = (np.log(v[end] / debt[last[done]]) + drift[done] - s**2 / 2) / s
        edf[done] = [0.5 * math.erfc(x / math.sqrt(2)) for x in distance[done]]
    vol[np.isnan(value)] = np.nan
    return value, vol, drift, distance, edf, k, settled


def merton_months(daily: DataFrame, firm: str, day: str, months: int = 12, least: int = 60) -> DataFrame:
    """(firm, month_end, n_days, asset_value, asset_vol, asset_return, distance, edf, rounds, converged).

    ``daily``: equity, debt and rate of each firm and day, as known that day. A month's window is
    the days of the ``months`` months up to its end; a month with fewer than ``least`` usable days
    (all of equity, debt and rate there, the first two positive) has nulls in place of
    estimates. Of several rows a firm and day the greatest (equity, debt, rate) counts, so a
    firm's group is as long as the calendar, whatever the input repeats.
    """
    usable = (F.col("equity") > 0) & (F.col("debt") > 0) & F.col("rate").isNotNull()
    days = daily.filter(usable & F.col(firm).isNotNull() & F.col(day).isNotNull()).groupBy(firm, F.col(day).cast("date").alias("day__"))
    days = days.agg(F.max(F.struct(*(F.col(c).cast("double").alias(c) for c in ("equity", "debt", "rate")))).alias("s")).select(firm, "day__", "s.*")
    kind = daily.schema[firm].dataType.simpleString()
    fields = f"`{firm}` {kind}, month_end date, n_days bigint, asset_value double, asset_vol double, asset_return double, distance double, edf double, rounds int, converged boolean"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        when = pd.to_datetime(pdf["day__"]).to_numpy().astype("datetime64[M]").astype(np.int64)
        place = np.argsort(pd.to_datetime(pdf["day__"]).to_numpy(), kind="stable")
        period = when[place]
        e, d, r = (pdf[c].to_numpy(float)[place] for c in ("equity", "debt", "rate"))
        each = np.unique(period)
        low, high = np.searchsorted(period, each - months, "right"), np.searchsorted(period, each, "right")
        long = high - low >= max(3, least)
        found = month_estimates(e, d, r, low[long], high[long])
        out = {firm: [key[0]] * len(each), "month_end": ((each + 1).astype("datetime64[M]").astype("datetime64[D]") - 1).astype(object), "n_days": high - low}
        for name, x in zip(("asset_value", "asset_vol", "asset_return", "distance", "edf"), found[:5], strict=True):
            whole = np.full(len(each), np.nan)
            whole[long] = x
            out[name] = pd.array(whole, dtype="Float64")
            out[name][np.isnan(whole)] = pd.NA
        for name, x, kind in zip(("rounds", "converged"), found[5:], ("Int32", "boolean"), strict=True):
            whole = pd.array([None] * len(each), dtype=kind)
            whole[long] = x
            out[name] = whole
        return pd.DataFrame(out)

    # Few bytes and much work a firm: a fixed number of partitions, which isn't coalesced by size.
    tasks = int(daily.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return days.repartition(tasks, firm).groupBy(firm).applyInPandas(run, fields)


def merton_quarters(monthly: DataFrame, firm: str) -> DataFrame:
    """The last month with an estimate of each firm and quarter, so nothing later than a quarter's end is used."""
    known = monthly.filter(F.col("distance").isNotNull())
    columns = [c for c in monthly.columns if c != firm]
    quarter = F.last_day(F.add_months(F.trunc("month_end", "quarter"), 2)).alias("quarter_end")
    return known.groupBy(firm, quarter).agg(F.max_by(F.struct(*columns), "month_end").alias("s")).select(firm, "quarter_end", "s.*")
