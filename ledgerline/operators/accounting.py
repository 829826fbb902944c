"""Company accounts: features, filters and point-in-time alignment to quarters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import quarter_end_of, quarter_index
from ..functions.scalars import any_missing, guarded_log, guarded_ratio, sum_known
from .select import first_by, last_by
from .temporal import point_in_time

STALENESS_CAP_DAYS = 270
# The standard statement format, and industries left out.
STANDARD_FORMAT = {"indfmt": "INDL", "datafmt": "STD", "popsrc": "D", "consol": "C"}
EXCLUDED_INDUSTRIES = ((6000, 6999), (4900, 4999))


def with_features(df: DataFrame) -> DataFrame:
    """Ratios and missingness flags from raw items; a ratio needs a positive denominator."""
    debt = sum_known("dlttq", "dlcq")
    return df.select(
        "*",
        debt.alias("total_debt"),
        guarded_ratio(debt, "atq").alias("leverage"),
        guarded_ratio("oibdpq", "xintq").alias("coverage"),
        guarded_ratio("niq", "atq").alias("profitability"),
        guarded_ratio("actq", "lctq").alias("liquidity"),
        guarded_log("atq").alias("log_assets"),
        guarded_ratio("cheq", "atq").alias("cash_ratio"),
        F.col("rdq").isNull().alias("rdq_missing"),
        any_missing("dlttq", "dlcq").alias("debt_component_missing"),
        guarded_ratio("oibdpq", "xintq").isNull().alias("coverage_missing"),
    )


def industry_kept(code: Column) -> Column:
    """False only for a known industry of an excluded range."""
    out = F.lit(True)
    for low, high in EXCLUDED_INDUSTRIES:
        out = out & ~F.coalesce(code.between(low, high), F.lit(False))
    return out


def _standard() -> Column:
    keep = F.lit(True)
    for c, v in STANDARD_FORMAT.items():
        keep = keep & (F.col(c) == v)
    return keep


def _industry() -> Column:
    return F.coalesce(F.col("sic").try_cast("int"), F.col("sich").try_cast("int"))


def standard_filings(df: DataFrame) -> DataFrame:
    """Standard-format filings of kept industries, with features, the last of each period."""
    rows = with_features(df.filter(_standard() & industry_kept(_industry()))).dropna(subset=["gvkey", "datadate", "rdq"])
    return last_by(rows, ["gvkey", "datadate"], "rdq", "datafqtr", "datacqtr")


MARKS = ("standard__", "kept__", "full__", "sic__", "sich__", "undated__")


def step_rows(df: DataFrame) -> DataFrame:
    """Different complete rows with their number (n__) and a flag for each step of :func:`filing_metrics`.

    Only rows that pass all steps are told apart; of the others the flags are all that counts, so
    they fall together before they are shuffled. The columns of the standard format are the same in all complete rows.
    """
    standard = F.coalesce(_standard(), F.lit(False))
    sic, sich = F.col("sic").try_cast("int"), F.col("sich").try_cast("int")
    kept = standard & industry_kept(_industry())
    dated = F.col("gvkey").isNotNull() & F.col("datadate").isNotNull() & F.col("rdq").isNotNull()
    flags = df.withColumns({
        "standard__": standard, "kept__": kept, "full__": kept & dated,
        "sic__": standard & sic.isNotNull(), "sich__": standard & sic.isNull() & sich.isNotNull(), "undated__": kept & F.col("rdq").isNull(),
    })
    told = flags.select(*(F.when(F.col("full__"), F.col(c)).alias(c) for c in sorted(set(df.columns) - set(STANDARD_FORMAT))), *MARKS)
    return told.groupBy(*told.columns).agg(F.count(F.lit(1)).alias("n__"))


def filing_metrics(df: DataFrame) -> DataFrame:
    """One row: what each step of :func:`standard_filings` leaves, and what it drops.

    One scan: complete rows are summed by their whole content, with a flag for each step,
    then by firm and period, so neither repeated rows nor repeated keys need a job of their own.
    """
    per_row, marks = step_rows(df), MARKS
    counts = [F.sum(F.when(F.col(m), F.col("n__")).otherwise(0)).alias(m) for m in marks]
    per_key = per_row.groupBy("gvkey", "datadate").agg(F.sum("n__").alias("n__"), F.sum(F.when(F.col("full__"), F.col("n__") - 1).otherwise(0)).alias("exact__"), *counts)
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    sums = per_key.agg(
        n("n__").alias("raw_rows"), n("standard__").alias("after_standard_filters"), n("kept__").alias("after_sic_exclusions"), n("full__").alias("after_required_dates"),
        n("undated__").alias("missing_rdq_rows"), n("exact__").alias("exact_duplicate_rows"), F.count_if(F.col("full__") > 1).alias("duplicate_gvkey_datadate_keys"),
        n(F.greatest(F.col("full__") - 1, F.lit(0))).alias("duplicate_observations_dropped"), n("sic__").alias("sic_rows_from_sic"), n("sich__").alias("sic_rows_from_sich"),
    )
    a, b = F.col("sic_rows_from_sic") > 0, F.col("sic_rows_from_sich") > 0
    share = F.when(F.col("after_sic_exclusions") > 0, F.col("missing_rdq_rows") / F.col("after_sic_exclusions") * 100).otherwise(0.0)
    source = F.when(a & b, "sic_with_sich_fallback").when(a, "sic").when(b, "sich")
    return sums.withColumns({"missing_rdq_percent": share, "sic_source": source, "sic_exclusion_applied": a | b})


def align_quarters(filings: DataFrame, first: int, last: int, values: list[str], cap_days: int = STALENESS_CAP_DAYS, key: str = "gvkey", period: str = "datadate", available: str = "rdq") -> DataFrame:
    """The filing in force at each quarter end, its age, and its values unless it is stale.

    Stale: more than ``cap_days`` days between availability and quarter end. Rows and
    identifiers stay; only ``values`` become null.
    """
    aligned = point_in_time(filings, [key], period, available, first, last, quarter_index("eff"))
    ended = aligned.withColumn("quarter_end", quarter_end_of("q"))
    aged = ended.withColumn("age_days", F.datediff("quarter_end", available))
    stale = F.col("age_days") > cap_days
    return aged.withColumns({"is_stale": stale} | {v: F.when(~stale, F.col(v)) for v in values})


def active_tranches(loans: DataFrame, tranche: list[str], order: list[str], start: str, maturity: str, first: int, last: int, key: str = "gvkey") -> DataFrame:
    """The newest tranche of each firm that is active at each quarter end of the grid.

    Rows that repeat a tranche count once, the first by ``order``. Active: started, and not
    matured, on the quarter end. Of the same start, the tranche that sorts first.
    """
    once = first_by(loans.dropna(subset=[*tranche, start, maturity]), tranche, *order)
    # A quarter counts if its last day is in the span: from that of the start to the one before the maturity's, unless they are the same day.
    low, ended = quarter_index(start), quarter_index(maturity)
    high = F.when(quarter_end_of(ended) == F.col(maturity), ended).otherwise(ended - 1)
    spans = once.withColumns({"low__": F.greatest(low, F.lit(first)), "high__": F.least(high, F.lit(last))}).filter("low__ <= high__")
    quarters = spans.withColumn("q", F.explode(F.sequence("low__", "high__"))).drop("low__", "high__")
    return first_by(quarters, [key, "q"], f"-{start}", *tranche)
