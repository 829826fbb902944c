"""Profiles, invariants and agreement measures of panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_profile(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows, exact repeats beyond the first, rows of keys that occur more than once."""
    exact = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    per_key = exact.groupBy(*key).agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("extra"))
    return per_key.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("n_rows"), F.coalesce(F.sum("extra"), F.lit(0)).cast("bigint").alias("exact_duplicates"),
        F.coalesce(F.sum(F.when(F.col("rows") > 1, F.col("rows"))), F.lit(0)).cast("bigint").alias("key_duplicates"),
    )


def missing_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, missing_share), all from one pass."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return shares.unpivot([], columns, "column_name", "missing_share")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of each column; one pass, a row a column."""
    stats = F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.count(c).alias("n"), F.avg(F.col(c).cast("double")).alias("mean"), F.stddev_samp(c).alias("std"),
        F.min(F.col(c).cast("double")).alias("min"), *[F.percentile(c, F.lit(p)).alias(f"q{int(100 * p)}") for p in (0.25, 0.5, 0.75)], F.max(F.col(c).cast("double")).alias("max"),
    ) for c in columns])
    return df.agg(stats.alias("stats")).select(F.inline("stats"))


def range_profile(df: DataFrame, columns: list[str]) -> list[Column]:
    return [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]


def check_panel(df: DataFrame, key: list[str], not_null: list[str], date: str | None = None, first: str | None = None, last: str | None = None) -> dict[str, int]:
    """Counts of violations: nulls, repeated keys, dates out of range; one job."""
    out = F.lit(False) if date is None else (F.col(date) < F.lit(first).cast("date")) | (F.col(date) > F.lit(last).cast("date"))
    null = F.lit(False)
    for c in not_null:
        null = null | F.col(c).isNull()
    counted = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count_if(null).alias("nulls"), F.count_if(out).alias("outside"))
    row = counted.agg(F.sum("nulls"), F.count_if(F.col("n") > 1), F.sum("outside")).first()
    return {"nulls": row[0] or 0, "duplicate_keys": row[1] or 0, "outside": row[2] or 0}


def require(violations: dict[str, int]) -> None:
    if bad := {k: v for k, v in violations.items() if v}:
        raise ValueError(f"panel invariants violated: {bad}")


def agreement(df: DataFrame, a: str, b: str, group: str) -> DataFrame:
    """Exact, off by one, off by more, and mean difference, for each group and all together."""
    diff = F.col(a) - F.col(b)
    return df.filter(diff.isNotNull()).groupingSets([[F.col(group)], []], F.col(group)).agg(
        F.count(F.lit(1)).alias("n"), F.avg((diff == 0).cast("double")).alias("exact"), F.avg((F.abs(diff) == 1).cast("double")).alias("off_one"),
        F.avg((F.abs(diff) >= 2).cast("double")).alias("off_more"), F.avg(diff.cast("double")).alias("mean_diff"),
    )


def event_match(df: DataFrame, ours: str, theirs: str, by: str, at: str) -> DataFrame:
    """How many of each other's events fall in the same row or a neighbouring one."""
    w = Window.partitionBy(by).orderBy(at)
    near = lambda c: F.coalesce(F.lag(c).over(w), F.lit(False)) | F.col(c) | F.coalesce(F.lead(c).over(w), F.lit(False))
    d = df.withColumns({"near_ours": near(ours), "near_theirs": near(theirs)})
    o, t = F.col(ours), F.col(theirs)
    return d.agg(
        F.count_if(o).alias("n_ours"), F.count_if(t).alias("n_theirs"), F.count_if(o & t).alias("same"),
        F.count_if(t & F.col("near_ours")).alias("theirs_near_ours"), F.count_if(o & F.col("near_theirs")).alias("ours_near_theirs"),
    )


def dataset_metrics(df: DataFrame, key: str, date: str) -> DataFrame:
    """One row for a dataset's manifest: rows, columns, distinct keys, first and last date, status."""
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), F.count_distinct(key).alias("n_keys"), F.count_if(F.col(date).isNull()).alias("n_undated"),
        F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.when(n > 0, "success").otherwise("empty").alias("status"),
    )


def extraction_status(parts: DataFrame, by: str) -> DataFrame:
    """success if all parts succeeded, failed if none, else partial."""
    ok = F.count_if(F.col("ok"))
    return parts.groupBy(by).agg(F.count(F.lit(1)).alias("n_parts"), ok.alias("n_ok"), F.when(ok == F.count(F.lit(1)), "success").when(ok == 0, "failed").otherwise("partial").alias("status"))


def _offending(df: DataFrame, key: list[str], said: str) -> None:
    """Raises with the number of rows of ``df`` and some keys, if there are any; one small job."""
    some = df.select(*key).orderBy(*key).limit(5).collect()
    if some:
        raise ValueError(f"{said}: {df.count()} keys, among them {[tuple(r) for r in some]}")


def require_unique(df: DataFrame, key: list[str]) -> DataFrame:
    """``df``, if each non-null key stands once; else ValueError with some that don't."""
    counted = df.dropna(subset=key).groupBy(*key).agg(F.count(F.lit(1)).alias("n__"))
    _offending(counted.filter("n__ > 1"), key, f"{key} is not unique")
    return df


def require_unambiguous(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """``df``, if no key has two different non-null values; else ValueError with some that have."""
    counted = df.dropna(subset=[*key, value]).groupBy(*key).agg((F.min(value) != F.max(value)).alias("differ__"))
    _offending(counted.filter("differ__"), key, f"{key} has several values of {value}")
    return df


def join_once(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Left join by ``key`` that can't add rows: ``right`` must have each key once (ValueError)."""
    return left.join(require_unique(right, key), key, "left")


def key_coverage(left: DataFrame, right: DataFrame, key: list[str], by: list[str] = ()) -> DataFrame:
    """(by, n_keys, n_covered, share) of the keys of ``left`` that ``right`` has; nulls aren't covered."""
    mine = left.select(*by, *key).distinct()
    theirs = right.select(*key).dropna().distinct().withColumn("there__", F.lit(True))
    n, hit = F.count(F.lit(1)), F.count("there__")
    return mine.join(theirs, key, "left").groupBy(*by).agg(n.alias("n_keys"), hit.alias("n_covered"), F.try_divide(hit, n).alias("share"))


def require_coverage(left: DataFrame, right: DataFrame, key: list[str], least: float) -> None:
    """ValueError if ``right`` has less than the share ``least`` of the keys of ``left``."""
    row = key_coverage(left, right, key).first()
    if row["n_keys"] and row["share"] < least:
        raise ValueError(f"{row['n_covered']} of {row['n_keys']} keys are covered, under {least:.1%}")
