"""Composed reports over panels of ratings, episodes and company ratings; one row or a few each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import quarter_index
from .profiles import agreement, event_match
from .select import hash_sample
from .temporal import valid_join

#: Grades from here on are near default (a fixed value of the scale).
NEAR_DEFAULT = 20


def default_checks(panel: DataFrame, episodes: DataFrame, delistings: DataFrame, links: DataFrame, first: str, last: str, code: int, grace_days: int = 365, near: int = 4) -> DataFrame:
    """One row of shares that tell whether defaults, downgrades and delistings agree.

    ``panel``: (gvkey, q, rating_ord, downgrade), unique by firm and quarter; ``episodes``: (gvkey, default_date,
    default_q); ``delistings``: (permno, dlstdt, dlstcd); ``links``: (gvkey, permno, linkdt,
    linkenddt). Episodes and delistings of ``code`` count from ``first`` to ``last``. A
    delisting belongs to the firms that its security was linked to then, or up to
    ``grace_days`` before, if the panel has them; it is matched by a default at most ``near``
    quarters away. An episode's prior event lies in the ``near`` quarters before it.
    """
    ep = episodes.filter(F.col("default_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    at = panel.select("gvkey", F.col("q").alias("default_q"), "rating_ord", F.lit(True).alias("rated"))
    events = panel.filter("downgrade = 1").select("gvkey", F.col("q").alias("event_q")).withColumnRenamed("gvkey", "g__")
    before = (F.col("gvkey") == F.col("g__")) & (F.col("event_q") < F.col("default_q")) & (F.col("event_q") >= F.col("default_q") - near)
    prior = ep.join(events, before, "left_semi").select("gvkey", "default_q").distinct().withColumn("prior", F.lit(True))
    marked = ep.join(at, ["gvkey", "default_q"], "left").join(prior, ["gvkey", "default_q"], "left")
    rated = F.col("rated").isNotNull()
    checks = marked.agg(
        F.count(F.lit(1)).alias("episodes"), F.count_distinct("gvkey").alias("issuers"), F.avg((~rated).cast("double")).alias("unrated_share"),
        F.avg(F.when(rated, F.coalesce(F.col("rating_ord") >= NEAR_DEFAULT, F.lit(False)).cast("double"))).alias("near_default_share"),
        F.avg(F.col("prior").isNotNull().cast("double")).alias("prior_event_share"),
    )
    gone = delistings.filter((F.col("dlstcd") == code) & F.col("dlstdt").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    owned = valid_join(gone, links, ["permno"], "dlstdt", "linkdt", "linkenddt", grace_days)
    known = owned.join(panel.select("gvkey").distinct(), "gvkey", "left_semi").select("gvkey", "dlstdt").distinct()
    close = episodes.select(F.col("gvkey").alias("g__"), "default_q")
    met = known.join(close, (F.col("gvkey") == F.col("g__")) & (F.abs(F.col("default_q") - quarter_index("dlstdt")) <= near), "left")
    per = met.groupBy("gvkey", "dlstdt").agg(F.bool_or(F.col("g__").isNotNull()).alias("near"))
    matched = per.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("near").cast("double")).alias("share"))
    return checks.withColumns({"delistings": matched.select("n").scalar(), "delistings_near_default": matched.select("share").scalar()})


def benchmark_comparison(ours: DataFrame, theirs: DataFrame, last: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(levels by source, event match, our unmatched events) of our ratings against a benchmark's.

    ``ours``: (gvkey, quarter_end, q, rating_ord, rating_source, downgrade); ``theirs``:
    (gvkey, quarter_end, their_ord), unique. Events are compared on quarters whose
    predecessor both have; a neighbour is the row before or after among these.
    """
    both = ours.join(theirs, ["gvkey", "quarter_end"]).filter(F.col("quarter_end") <= F.lit(last).cast("date"))
    levels = agreement(both, "rating_ord", "their_ord", "rating_source")
    along = Window.partitionBy("gvkey").orderBy("q")
    moved = both.withColumns({"follows": F.coalesce(F.lag("q").over(along) == F.col("q") - 1, F.lit(False)), "cut": F.coalesce(F.col("their_ord") > F.lag("their_ord").over(along), F.lit(False)), "own": F.coalesce(F.col("downgrade") == 1, F.lit(False))})
    pairs = moved.filter("follows")
    counts = event_match(pairs, "own", "cut", "gvkey", "q")
    share = lambda a, b: F.try_divide(F.col(a), F.col(b))
    events = counts.withColumns({
        "n_pairs": pairs.agg(F.count(F.lit(1))).scalar(), "caught_same": share("same", "n_theirs"), "caught_near": share("theirs_near_ours", "n_theirs"),
        "matched_same": share("same", "n_ours"), "matched_near": share("ours_near_theirs", "n_ours"),
    })
    close = F.coalesce(F.lag("cut").over(along), F.lit(False)) | F.col("cut") | F.coalesce(F.lead("cut").over(along), F.lit(False))
    missed = pairs.withColumn("close", close).filter("own AND NOT close").select("gvkey", "quarter_end", "rating_ord", "rating_source", "their_ord")
    return levels, events, missed


def unmatched_sample(missed: DataFrame, most: int = 40) -> DataFrame:
    """At most ``most`` of the unmatched events, drawn by a hash of firm and quarter: the report's sample."""
    return hash_sample(missed, most, "gvkey", "quarter_end")


def archive_reconciliation(requested: DataFrame, archived: DataFrame, key: str, most: int = 100) -> DataFrame:
    """One row: ids requested, archived, missing, unasked for, repeated, and the first ``most`` missing ones in order."""
    asked = requested.select(key).dropna().distinct().withColumn("asked", F.lit(True))
    got = archived.select(key).dropna().groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    both = asked.join(got, key, "full")
    missing = both.filter(F.col("n").isNull())
    first = missing.orderBy(key).limit(most).agg(F.array_sort(F.collect_list(key)).alias("x")).scalar()
    yes = lambda c: F.count_if(c)
    counts = both.agg(yes(F.col("asked").isNotNull()).alias("requested"), yes(F.col("n").isNotNull()).alias("archived"), yes(F.col("n").isNull()).alias("missing"), yes(F.col("asked").isNull()).alias("unasked"), yes(F.col("n") > 1).alias("repeated"))
    return counts.withColumn("missing_sample", F.array_join(first.cast("array<string>"), ","))
