"""Security returns: compounding, delistings, links to firms, quarterly features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_end
from ..functions.scalars import guarded_ratio
from .select import first_by, last_by
from .temporal import valid_join


def compound_return(value: str, by: list[str], at: str, rows: int = 12, least: int = 9) -> Column:
    """Product of 1 + value over the last ``rows`` rows, less 1; null with fewer than
    ``least`` rows or a null among them. Rows count, not calendar months."""
    w = Window.partitionBy(*by).orderBy(at).rowsBetween(1 - rows, 0) if by else Window.orderBy(at).rowsBetween(1 - rows, 0)
    known, size = F.count(value).over(w), F.count(F.lit(1)).over(w)
    return F.when((known == size) & (size >= least), F.product(F.lit(1.0) + F.col(value)).over(w) - 1)


def with_delistings(monthly: DataFrame, delistings: DataFrame) -> DataFrame:
    """Monthly (permno, month, date, ret, prc) with delisting returns compounded in; a
    delisting without a monthly row adds one, dated by the delisting."""
    once = last_by(delistings.withColumn("month", month_end("dlstdt")), ["permno", "month"], "dlstdt", "dlret", "dlprc")
    both = monthly.join(once, ["permno", "month"], "full")
    ret = F.when(F.col("ret").isNotNull() & F.col("dlret").isNotNull(), (1 + F.col("ret")) * (1 + F.col("dlret")) - 1).otherwise(F.coalesce("ret", "dlret"))
    return both.select("permno", "month", F.coalesce("date", "dlstdt").alias("date"), F.coalesce("prc", "dlprc").alias("prc"), ret.alias("ret"), F.col("dlstdt").isNotNull().alias("delisted"))


def link_to_firms(monthly: DataFrame, links: DataFrame) -> DataFrame:
    """One security a firm and month: valid link, then largest value, primary, link type, permno."""
    usable = links.filter(F.col("linktype").isin("LC", "LU") & F.col("linkprim").isin("P", "C"))
    joined = valid_join(monthly, usable.withColumnRenamed("lpermno", "permno"), ["permno"], "date", "linkdt", "linkenddt")
    ranked = joined.withColumns({
        "mktcap": F.abs("prc") * F.col("shrout"),
        "prim__": F.when(F.col("linkprim") == "P", 0).otherwise(1),
        "type__": F.when(F.col("linktype") == "LC", 0).otherwise(1),
    })
    return first_by(ranked, ["gvkey", "month"], "-mktcap", "prim__", "type__", "permno").drop("prim__", "type__")


def quarterly_features(monthly: DataFrame, market: DataFrame, accounts: DataFrame) -> DataFrame:
    """Quarter-end months with market returns and assets joined, and market to book; one security a firm and quarter, the largest."""
    ends = monthly.filter(F.month("month").isin(3, 6, 9, 12))
    joined = ends.join(market, "month", "left").join(accounts, (ends["gvkey"] == accounts["gvkey"]) & (ends["month"] == accounts["quarter_end"]), "left").drop(accounts["gvkey"])
    valued = joined.withColumn("market_to_book", guarded_ratio(F.col("mktcap") / 1000, "atq"))
    return first_by(valued, ["gvkey", "month"], "-mktcap", "permno")


def single_security(matched: DataFrame) -> DataFrame:
    """One security a (gvkey, datadate): primary, then link type, newest link, permno; other codes come last."""
    ranked = matched.withColumns({
        "prim__": F.when(F.col("linkprim") == "P", 0).when(F.col("linkprim") == "C", 1).otherwise(9),
        "type__": F.when(F.col("linktype") == "LC", 0).when(F.col("linktype") == "LU", 1).otherwise(9),
    })
    return first_by(ranked, ["gvkey", "datadate"], "prim__", "type__", "-linkdt", "permno").drop("prim__", "type__")
