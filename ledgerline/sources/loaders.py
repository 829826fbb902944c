"""Loaders that bring raw vendor tables into the library's shapes.

Each takes the raw rows in whatever types they came, and gives typed columns without NaN, dates
as days, and none of the rows whose key is unusable. They are plain projections and filters,
so pruning and pushdown pass through them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import month_end
from ..operators.select import last_by

#: Links that count, best first (fixed values of the vendor's codes).
LINK_TYPES, LINK_PRIMES = ("LC", "LU"), ("P", "C")


def _number(c: str) -> Column:
    x = F.col(c).try_cast("double")
    return F.when(~F.isnan(x), x).alias(c)


def _whole(c: str, name: str | None = None) -> Column:
    return F.col(c).try_cast("bigint").alias(name or c)


def _day(c: str, name: str | None = None) -> Column:
    return F.col(c).try_cast("timestamp").cast("date").alias(name or c)


def _text(c: str) -> Column:
    return F.trim(F.col(c).cast("string")).alias(c)


def monthly_stock(raw: DataFrame) -> DataFrame:
    """Security months on their month's last day; rows without security or date go."""
    rows = raw.select(_whole("permno"), _whole("permco"), _day("date"), *map(_number, ("ret", "retx", "prc", "altprc", "vol", "shrout")), _whole("hexcd"), _whole("hsiccd"))
    return rows.dropna(subset=["permno", "date"]).withColumn("month", month_end("date"))


def market(raw: DataFrame) -> DataFrame:
    """One row a month, the last by date."""
    rows = raw.select(_day("date"), *map(_number, ("vwretd", "vwretx", "ewretd", "ewretx", "sprtrn", "spindx"))).dropna(subset=["date"]).withColumn("month", month_end("date"))
    return last_by(rows, ["month"], "date", "vwretd")


def delistings(raw: DataFrame) -> DataFrame:
    rows = raw.select(_whole("permno"), _day("dlstdt"), *map(_number, ("dlret", "dlretx", "dlprc")), _whole("dlstcd"))
    return last_by(rows.dropna(subset=["permno", "dlstdt"]).withColumn("month", month_end("dlstdt")), ["permno", "month"], "dlstdt", "dlret", "dlstcd")


def names(raw: DataFrame) -> DataFrame:
    """Validity spans of security names; an open end is null."""
    rows = raw.select(_whole("permno"), _whole("permco"), _day("namedt"), _day("nameendt"), F.upper(F.trim("ticker")).alias("ticker"), _text("comnam"), *map(_whole, ("shrcd", "exchcd", "siccd")))
    return rows.dropna(subset=["permno", "namedt"])


def firm_links(raw: DataFrame) -> DataFrame:
    """Links of usable kinds with their ranks, 0 the best."""
    rows = raw.select(_text("gvkey"), _whole("lpermno", "permno"), _whole("lpermco", "permco"), _day("linkdt"), _day("linkenddt"), _text("linktype"), _text("linkprim"))
    rank = lambda c, codes: F.array_position(F.array(*map(F.lit, codes)), F.col(c)) - 1
    usable = rows.filter(F.col("linktype").isin(*LINK_TYPES) & F.col("linkprim").isin(*LINK_PRIMES)).dropna(subset=["gvkey", "permno", "linkdt"])
    return usable.withColumns({"type_rank": rank("linktype", LINK_TYPES).cast("int"), "prim_rank": rank("linkprim", LINK_PRIMES).cast("int")})


def assets(raw: DataFrame) -> DataFrame:
    """(gvkey, quarter_end, atq) of quarters with a positive total."""
    rows = raw.select(_text("gvkey"), _day("quarter_end"), _number("atq")).dropna(subset=["gvkey", "quarter_end"])
    return rows.filter("atq > 0")


def default_records(raw: DataFrame) -> DataFrame:
    rows = raw.select(_whole("issue_id"), _day("default_date"), _day("reinstated_date"))
    return rows.dropna(subset=["issue_id", "default_date"])


def raw_ratings(raw: DataFrame) -> DataFrame:
    rows = raw.select(_whole("issue_id"), _text("rating_type"), _day("rating_date"), _text("rating"))
    return rows.dropna(subset=["issue_id", "rating_type", "rating_date", "rating"])
