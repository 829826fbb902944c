"""Analyst features as they were known at a date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .temporal import asof_backward


def analyst_features(grid: DataFrame, snapshots: DataFrame, actuals: DataFrame, firm: str, on: str, horizon: str = "1", age_cap: int = 120) -> DataFrame:
    """``grid`` plus the consensus at ``on``, its revision, dispersion and count, and the last surprise.

    ``snapshots``: (firm, statpers, fpedats, fpi, meanest, stdev, numest), a consensus of the day
    ``statpers`` for the period that ends at ``fpedats``, ``fpi`` periods ahead. ``actuals``:
    (firm, pends, anndats, value), known from ``anndats`` on.

    A revision compares with the snapshot before of the *same* period end, whichever horizon
    it had then: as one period closes, the next one's consensus moves up to horizon ``horizon``,
    and no change between two different periods is taken for a revision. A surprise is an actual less
    the last consensus for its period from before the day of its announcement. Two clocks
    are kept apart: nothing dated ``statpers`` or announced after ``on`` is used, and a
    period that has ended may still be the newest one announced.

    Of several snapshots of one day the one for the nearest period counts. A consensus older
    than ``age_cap`` days is null; the grid row stays, with ``analyst_missing``.
    """
    known = snapshots.filter(F.col("statpers").isNotNull() & F.col("fpedats").isNotNull())
    along = Window.partitionBy(firm, "fpedats").orderBy("statpers")
    day = known.groupBy(firm, "fpedats", "statpers").agg(F.min_by(F.struct("fpi", "meanest", "stdev", "numest"), F.struct("fpi", "meanest", "stdev", "numest")).alias("s")).select(firm, "fpedats", "statpers", "s.*")
    chained = day.withColumn("revision", F.col("meanest") - F.lag("meanest").over(along))
    ahead = chained.filter(F.col("fpi") == horizon)
    held = asof_backward(grid, ahead.withColumn("nearest__", -F.unix_date("fpedats")), [firm], on, "statpers", ["nearest__"]).drop("nearest__")

    told = actuals.filter(F.col("anndats").isNotNull() & F.col("pends").isNotNull()).select(firm, F.col("pends").alias("fpedats"), "anndats", "value")
    before = asof_backward(told, day.select(firm, "fpedats", "statpers", F.col("meanest").alias("expected")), [firm, "fpedats"], "anndats", "statpers", exact=False)
    surprises = before.select(firm, "anndats", F.col("fpedats").alias("surprise_period"), (F.col("value") - F.col("expected")).alias("surprise"))
    held = asof_backward(held, surprises, [firm], on, "anndats", ["surprise_period", "surprise"])

    fresh = F.coalesce(F.datediff(on, "statpers") <= age_cap, F.lit(False))
    show = {c: F.when(fresh, F.col(c)) for c in ("statpers", "fpedats", "meanest", "numest", "revision")}
    show["dispersion"] = F.when(fresh & (F.abs("meanest") > 0), F.col("stdev") / F.abs("meanest"))
    show["direction"] = F.when(fresh, F.signum("revision").cast("int"))
    show["analyst_missing"] = ~fresh | F.col("meanest").isNull()
    out = held.withColumns({f"{c}__": v for c, v in show.items()})
    return out.select(*grid.columns, *(F.col(f"{c}__").alias(c) for c in show), "surprise_period", "surprise")
