"""Joins and lags along time, each with one exchange by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import open_end
from .select import order


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], on: str, right_on: str, ties: list[str] = (), exact: bool = True) -> DataFrame:
    """``left`` plus the columns of the latest row of ``right`` at or before ``on``.

    Both sides are put under each other and sorted once; the last right row so far is
    carried as a struct, so that a null field isn't skipped. Of rows at one time the last
    by ``ties`` wins. Unmatched left rows stay, with nulls.
    """
    payload = [c for c in right.columns if c not in by]
    struct = F.struct(*payload)
    under = left.select(*by, F.col(on).alias("at__"), F.lit(1 if exact else 0).alias("side__"), F.struct(*[c for c in left.columns]).alias("left__")).unionByName(
        right.select(*by, F.col(right_on).alias("at__"), F.lit(0 if exact else 1).alias("side__"), struct.alias("right__")), allowMissingColumns=True
    )
    rank = [F.col(f"right__.{t}").asc_nulls_last() for t in ties]
    w = Window.partitionBy(*by).orderBy("at__", "side__", *rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = under.withColumn("last__", F.last("right__", ignorenulls=True).over(w)).filter(F.col("left__").isNotNull())
    return held.select("left__.*", *[F.col(f"last__.{c}").alias(c) for c in payload])


def next_after(left: DataFrame, right: DataFrame, by: list[str], on: str, out: str) -> DataFrame:
    """``left`` plus the least ``on`` of ``right`` that is strictly greater, as ``out``."""
    events = right.select(*by, F.col(on).alias("at__"), F.lit(0).alias("side__"), F.col(on).alias("event__"))
    under = left.select(*by, F.col(on).alias("at__"), F.lit(1).alias("side__"), F.struct(*left.columns).alias("left__")).unionByName(events, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("at__", "side__").rowsBetween(1, Window.unboundedFollowing)
    held = under.withColumn("next__", F.first("event__", ignorenulls=True).over(w)).filter(F.col("left__").isNotNull())
    return held.select("left__.*", F.col("next__").alias(out))


def valid_join(left: DataFrame, right: DataFrame, by: list[str], on: str, start: str, end: str, grace_days: int = 0, how: str = "inner") -> DataFrame:
    """Rows of ``right`` whose validity, from ``start`` to ``end`` (null: open) plus grace, holds ``on``.

    The range stands in the join condition, so it is tested as rows meet and no
    many-to-many result is built first.
    """
    r = right.select(*[F.col(c).alias(f"{c}__r" if c in by else c) for c in right.columns])
    last = F.date_add(open_end(end), grace_days) if grace_days else open_end(end)
    match = (F.col(on) >= F.col(start)) & (F.col(on) <= last)
    for k in by:
        match = (F.col(k) == F.col(f"{k}__r")) & match
    return left.join(r, match, how).drop(*[f"{k}__r" for k in by])


def latest_valid(left: DataFrame, right: DataFrame, by: list[str], on: str, start: str, end: str, ties: list[str] = ()) -> DataFrame:
    """``left``, each row with the valid row of ``right`` that starts last, if there is one."""
    found = asof_backward(left, right.filter(F.col(start).isNotNull()), by, on, start, list(ties))
    payload = [c for c in right.columns if c not in by]
    holds = F.col(on) <= open_end(end)
    return found.withColumns({c: F.when(holds, F.col(c)) for c in payload if c != end} | {end: F.when(holds, F.col(end))})


def range_anti(left: DataFrame, spans: DataFrame, by: list[str], on: str, start: str, end: str) -> DataFrame:
    """Rows of ``left`` that lie in no open interval (start, end); a null end is open."""
    return left.join(spans, _inside(left, spans, by, on, start, end), "left_anti")


def range_semi(left: DataFrame, spans: DataFrame, by: list[str], on: str, start: str, end: str) -> DataFrame:
    return left.join(spans, _inside(left, spans, by, on, start, end), "left_semi")


def _inside(left: DataFrame, spans: DataFrame, by: list[str], on: str, start: str, end: str) -> Column:
    match = (left[on] > spans[start]) & (spans[end].isNull() | (left[on] < spans[end]))
    for k in by:
        match = (left[k] == spans[k]) & match
    return match


def gap_lag(value: str, by: list[str], at: str) -> Column:
    """The value one period earlier: that of the row before only if it is of period ``at`` - 1."""
    w = Window.partitionBy(*by).orderBy(at)
    return F.when(F.lag(at).over(w) == F.col(at) - 1, F.lag(value).over(w))


def point_in_time(filings: DataFrame, by: list[str], period: str, available: str, grid_first: int, grid_last: int, index: Column, ties: list[str] = ()) -> DataFrame:
    """For each key and grid period, the filing to go by: both its period and its availability
    date are past, and it is the last by (available, period).

    A filing counts from the later of its dates. Along that date the best filing so far is
    a running maximum of a struct; each winner is valid until the next date, and is spread
    over the grid periods in between. ``index`` maps the date ``eff`` to the first grid
    period at whose end it is known.
    """
    rank = F.struct(F.col(available), F.col(period), *ties)
    eff = filings.filter(F.col(available).isNotNull() & F.col(period).isNotNull()).withColumn("eff", F.greatest(period, available))
    w = Window.partitionBy(*by).orderBy("eff")
    best = eff.select(*by, "eff", F.max(F.struct(rank.alias("rank"), F.struct(*filings.columns).alias("row"))).over(w).alias("best"))
    # All rows of one date have the same running maximum; one of them is kept.
    steps = best.withColumn("first__", index).groupBy(*by, "first__").agg(F.max_by("best", "eff").alias("best"))
    after = F.lead("first__").over(Window.partitionBy(*by).orderBy("first__"))
    spans = steps.withColumn("last__", F.coalesce(after - 1, F.lit(grid_last)))
    first, last = F.greatest(F.col("first__"), F.lit(grid_first)), F.least(F.col("last__"), F.lit(grid_last))
    periods = spans.withColumn("q", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    return periods.select("q", "best.row.*")


__all__ = ["asof_backward", "gap_lag", "latest_valid", "next_after", "order", "point_in_time", "range_anti", "range_semi", "valid_join"]
