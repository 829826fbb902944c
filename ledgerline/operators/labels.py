"""Default episodes, masks after default, and forward-looking labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import quarter_index
from .temporal import range_anti, range_semi

HORIZONS = (1, 4, 8)


def episodes(defaults: DataFrame, fresh: DataFrame, key: str = "gvkey") -> DataFrame:
    """(key, default_date, emerge_date, default_q, emerge_q), one row an episode.

    ``defaults``: (key, default_date, reinstated_date); ``fresh``: (key, offering_date,
    first_rating). An episode starts with a default and ends with the earlier of a
    reinstatement after its start, told by a default not before it, and the first rating
    after its start of debt offered after it. Defaults within an episode belong to it; the
    next starts after its end; one without an end is the last. A key's dates are folded in
    order inside one aggregate, so nothing is collected but a firm's own defaults.
    """
    per_key = defaults.filter(F.col("default_date").isNotNull()).groupBy(key).agg(
        F.array_sort(F.collect_set("default_date")).alias("starts"), F.collect_list(F.struct("default_date", "reinstated_date")).alias("recs")
    )
    debt = fresh.groupBy(key).agg(F.collect_list(F.struct("offering_date", "first_rating")).alias("debt"))
    rows = per_key.join(debt, key, "left")
    none = F.lit(None).cast("date")

    def emergence(start):
        back = F.transform(F.filter("recs", lambda r: (r["default_date"] >= start) & (r["reinstated_date"] > start)), lambda r: r["reinstated_date"])
        new = F.transform(F.filter(F.coalesce("debt", F.array().cast("array<struct<offering_date:date,first_rating:date>>")), lambda r: (r["offering_date"] > start) & (r["first_rating"] > start)), lambda r: r["first_rating"])
        return F.array_min(F.concat(back, new))

    episode = lambda s: F.struct(s.alias("default_date"), emergence(s).alias("emerge_date"))
    every = F.transform("starts", episode)
    kind = "array<struct<default_date:date,emerge_date:date>>"
    # A start counts if nothing is open: no episode yet, or the last one ended before it.
    folded = F.aggregate(
        every, F.array().cast(kind),
        lambda done, e: F.when((F.size(done) == 0) | F.coalesce(F.get(done, F.size(done) - 1)["emerge_date"] < e["default_date"], F.lit(False)), F.concat(done, F.array(e))).otherwise(done),
    )
    out = rows.select(key, F.explode(folded).alias("e")).select(key, "e.*")
    return out.select(key, "default_date", F.coalesce("emerge_date", none).alias("emerge_date"), quarter_index("default_date").alias("default_q"), quarter_index("emerge_date").alias("emerge_q"))


def mask_after_default(rows: DataFrame, spells: DataFrame, key: str = "gvkey") -> DataFrame:
    """Rows outside the quarters strictly between a default and its end; both of these stay."""
    return range_anti(rows, spells, [key], "q", "default_q", "emerge_q")


def masked_only(rows: DataFrame, spells: DataFrame, key: str = "gvkey") -> DataFrame:
    return range_semi(rows, spells, [key], "q", "default_q", "emerge_q")


def with_observable(rows: DataFrame, key: str = "gvkey") -> DataFrame:
    """Whether the key has a row for the quarter before; keys and quarters are unique."""
    w = Window.partitionBy(key).orderBy("q")
    return rows.withColumn("observable", F.coalesce(F.lag("q").over(w) == F.col("q") - 1, F.lit(False)))


def wide_events(families: dict[str, DataFrame], key: str = "gvkey") -> DataFrame:
    """One row for each key and quarter with an event, and a flag for each family."""
    tagged = reduce(DataFrame.unionByName, [e.select(key, "q", F.lit(n).alias("family__")) for n, e in families.items()])
    return tagged.groupBy(key, "q").agg(*[F.bool_or(F.col("family__") == n).alias(n) for n in families])


def forward_labels(rows: DataFrame, events: DataFrame, names: list[str], last_q: int, key: str = "gvkey", countdown: bool = False) -> DataFrame:
    """``rows`` (with ``observable``) plus, for each family, a flag and whether an event follows.

    ``events`` has one row for each key and quarter, as :func:`wide_events` makes it. The
    flag is 1 at an event, 0 if the quarter before was observed, else null. A horizon that
    runs past ``last_q`` is null even where an event has come already. Rows and events are
    put under each other and sorted once by key for all families and horizons.
    """
    flags = F.struct("q", *names)
    under = rows.select(key, "q", F.lit(1).alias("side__"), F.struct(*rows.columns).alias("row__")).unionByName(
        events.select(key, "q", F.lit(0).alias("side__"), flags.alias("event__")), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy("q", "side__")
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    columns = {"now__": F.last("event__", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))}
    for n in names:
        columns[f"next__{n}"] = F.first(F.when(F.col(f"event__.{n}"), F.col("event__.q")), ignorenulls=True).over(ahead)
    held = under.withColumns(columns).filter(F.col("row__").isNotNull())
    out = [F.col(f"row__.{c}").alias(c) for c in rows.columns]
    for n in names:
        gap = F.col(f"next__{n}") - F.col("q")
        hit = (F.col("now__.q") == F.col("q")) & F.col(f"now__.{n}")
        out.append(F.when(hit, 1.0).when(F.col("row__.observable"), 0.0).alias(n))
        out += [F.when(F.col("q") + h <= last_q, F.coalesce(gap <= h, F.lit(False)).cast("double")).alias(f"{n}_{h}q") for h in HORIZONS]
        if countdown:
            out.append(gap.alias(f"quarters_to_next_{n}"))
    return held.select(*out)


def label_panel(rows: DataFrame, events: DataFrame, names: list[str], spells: DataFrame, last_q: int, key: str = "gvkey") -> DataFrame:
    """Labels of each event family for ``rows``; masked events and rows are left out, but
    ``observable`` looks at all rows."""
    kept = mask_after_default(events, spells, key)
    return mask_after_default(forward_labels(with_observable(rows, key), kept, names, last_q, key), spells, key)


def downgrade_panel(cuts: DataFrame, combined: DataFrame, spells: DataFrame, last_q: int, agencies: dict[str, str]) -> DataFrame:
    """The firm-quarter panel with its families of labels; defaults count as events of each.

    Labels of an agency are null where it has no rating.
    """
    tests = {"downgrade": F.col("cut_primary"), "downgrade_strict": F.col("cut_strict"), "downgrade_anybond": F.col("cut_anybond")}
    tests |= {f"downgrade_{n}": F.col("cut_primary") & (F.col("rating_type") == code) for code, n in agencies.items()}
    cut = cuts.select("gvkey", "q", *[t.alias(n) for n, t in tests.items()])
    starts = spells.select("gvkey", F.col("default_q").alias("q"), *[F.lit(True).alias(n) for n in tests])
    events = cut.unionByName(starts).groupBy("gvkey", "q").agg(*[F.bool_or(n).alias(n) for n in tests])
    panel = label_panel(combined, events, list(tests), spells, last_q)
    blank = {c: F.when(F.col(f"has_{n}"), F.col(c)) for n in agencies.values() for c in panel.columns if c.startswith(f"downgrade_{n}")}
    return panel.withColumns(blank)
