"""Month, quarter and span arithmetic on date columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN_END = "2099-12-31"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def month_end(d: str | Column) -> Column:
    return F.last_day(_c(d))


def quarter_end(d: str | Column) -> Column:
    return F.last_day(F.add_months(F.trunc(_c(d), "quarter"), 2))


def quarter_index(d: str | Column) -> Column:
    """Consecutive whole number of the calendar quarter: year * 4 + quarter - 1."""
    return (F.year(_c(d)).cast("bigint") * 4 + F.quarter(_c(d)) - 1).cast("bigint")


def quarter_end_of(q: str | Column) -> Column:
    """Last day of the quarter with index ``q``."""
    q = _c(q)
    return F.last_day(F.make_date((q / 4).cast("int"), (F.pmod(q, F.lit(4)) * 3 + 3).cast("int"), F.lit(1)))


def open_end(d: str | Column) -> Column:
    return F.coalesce(_c(d), F.lit(OPEN_END).cast("date"))


def quarter_grid(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(q, quarter_end) of all quarters from the one of ``first`` to the one of ``last``."""
    ends = spark.range(1).select(F.sequence(quarter_index(F.lit(first).cast("date")), quarter_index(F.lit(last).cast("date"))).alias("q"))
    return ends.select(F.explode("q").alias("q")).select("q", quarter_end_of("q").alias("quarter_end"))


def expand_span(df: DataFrame, start: str | Column, end: str | Column, out: str = "q", lower: int | None = None, upper: int | None = None) -> DataFrame:
    """One row for each whole number from ``start`` to ``end``, clipped; empty spans and unknown ends give no row."""
    first = F.greatest(_c(start), F.lit(lower)) if lower is not None else _c(start)
    last = F.least(_c(end), F.lit(upper)) if upper is not None else _c(end)
    known = _c(start).isNotNull() & _c(end).isNotNull()
    span = F.when(known & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, F.explode(span))
