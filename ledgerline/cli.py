"""Command line: ``python -m ledgerline accounting|equity|link|extract ...``.

Each job reads raw tables, publishes its result as a snapshot (see :mod:`ledgerline.sources.snapshots`), and writes a
manifest beside it. A valid snapshot is kept unless ``--force`` is given. Exit states: 0 done or
kept, 1 the result breaks its invariants, 2 the arguments are wrong.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import accounting, equity, linkage, profiles
from .sources import loaders, sinks, snapshots, tables

FIRST_YEAR = 2000
#: Values that a stale filing loses.
_VALUES = ["atq", "total_debt", "leverage", "coverage", "profitability", "liquidity", "log_assets", "cash_ratio"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerline")
    jobs = p.add_subparsers(dest="job", required=True)

    def job(name: str, years: bool = True) -> argparse.ArgumentParser:
        j = jobs.add_parser(name)
        j.add_argument("--raw", help="folder of raw tables")
        j.add_argument("--out", required=True, help="folder of the published table")
        j.add_argument("--force", action="store_true", help="build anew even if a valid snapshot is there")
        if years:
            j.add_argument("--start-year", type=int, default=FIRST_YEAR)
            j.add_argument("--end-year", type=int, default=2024)
        return j

    job("accounting").add_argument("--staleness-cap-days", type=int, default=accounting.STALENESS_CAP_DAYS)
    job("equity")
    job("link", years=False).add_argument("--fuzzy", action="store_true")
    e = job("extract")
    e.add_argument("--url", required=True)
    e.add_argument("--driver")
    e.add_argument("--catalog", required=True, help="JSON file: {dataset: {table, date}}")
    e.add_argument("--only", nargs="+", default=[], help="datasets to extract")
    return p


def check(args: argparse.Namespace, known: set[str] = frozenset()) -> None:
    """Raises ValueError for years out of order or range, a negative cap, or datasets that aren't known."""
    if hasattr(args, "start_year") and not FIRST_YEAR <= args.start_year <= args.end_year:
        raise ValueError(f"years must satisfy {FIRST_YEAR} <= start <= end, got {args.start_year} and {args.end_year}")
    if getattr(args, "staleness_cap_days", 0) < 0:
        raise ValueError("the staleness cap may not be negative")
    if unknown := sorted(set(getattr(args, "only", ())) - known):
        raise ValueError(f"unknown datasets {unknown}; known are {sorted(known)}")
    if args.job != "extract" and not args.raw:
        raise ValueError("--raw is missing")


def _kept(spark: SparkSession, path: str, force: bool, key: list[str]) -> bool:
    """Whether a snapshot is there that may stay."""
    if force:
        return False
    try:
        profiles.require(profiles.check_panel(snapshots.current(spark, path), key, key))
    except (FileNotFoundError, ValueError):
        return False
    return True


def _done(df: DataFrame, path: str, key: list[str], date: str | None, more: dict) -> None:
    """Publishes ``df`` after its invariants hold on what was written aside; then its manifest."""
    spark = df.sparkSession
    name = f"{path}/_aside"
    df.write.mode("overwrite").parquet(name)
    aside = spark.read.parquet(name)
    profiles.require(profiles.check_panel(aside, key, key))
    snapshots.publish(aside, path)
    sinks.write_manifest(spark, f"{path}/_manifest.json", sinks.manifest(aside, key, date) | more)


def accounting_job(spark: SparkSession, args: argparse.Namespace) -> None:
    raw = spark.read.parquet(f"{args.raw}/filings")
    # A year more at the start: its filings may still be in force.
    rows = raw.filter(tables.in_years("datadate", args.start_year - 1, args.end_year))
    panel = accounting.align_quarters(accounting.standard_filings(rows), args.start_year * 4, args.end_year * 4 + 3, _VALUES, args.staleness_cap_days)
    metrics = accounting.filing_metrics(rows).first().asDict()
    _done(panel, args.out, ["gvkey", "quarter_end"], "quarter_end", {"staleness_cap_days": args.staleness_cap_days, "filters": metrics})


def equity_job(spark: SparkSession, args: argparse.Namespace) -> None:
    read = lambda name: spark.read.parquet(f"{args.raw}/{name}")
    monthly = loaders.monthly_stock(read("monthly"))
    whole = equity.with_delistings(monthly.select("permno", "month", "date", "ret", "prc"), loaders.delistings(read("delistings")).drop("month"))
    shares = monthly.select("permno", "month", "shrout")
    linked = equity.link_to_firms(whole.join(shares, ["permno", "month"], "left"), loaders.firm_links(read("links")))
    trailing = linked.withColumn("ret_12", equity.compound_return("ret", ["gvkey"], "month"))
    out = equity.quarterly_features(trailing, loaders.market(read("market")).select("month", "vwretd"), loaders.assets(read("assets")))
    out = out.filter(F.year("month").between(args.start_year, args.end_year)).select("gvkey", F.col("month").alias("quarter_end"), "permno", "mktcap", "ret_12", "vwretd", "market_to_book")
    _done(out, args.out, ["gvkey", "quarter_end"], "quarter_end", {})


def link_job(spark: SparkSession, args: argparse.Namespace) -> None:
    read = lambda name: spark.read.parquet(f"{args.raw}/{name}")
    people = linkage.borrower_universe(read("companies"), read("wide"))
    links = linkage.link_borrowers(people, linkage.firm_identities(read("firms")).withColumn("ticker", F.lit(None).cast("string")), args.fuzzy, linkage.ticker_firms(read("names"), read("links")))
    _done(links, args.out, ["id"], None, {"fuzzy": args.fuzzy})


def extract_job(spark: SparkSession, args: argparse.Namespace, catalog: dict) -> None:
    """Each dataset by years, undated rows in a part of their own."""
    for name in args.only or sorted(catalog):
        path, entry = f"{args.out}/{name}", catalog[name]
        if not args.force and snapshots.read_text(spark, f"{path}/{snapshots.POINTER}") is not None:
            print(f"{name}: kept")
            continue
        more = {"driver": args.driver} if args.driver else {}
        more |= {"day_literal": entry["day_literal"]} if "day_literal" in entry else {}
        df = tables.with_retry(lambda e=entry, m=more: tables.read_jdbc(spark, args.url, table=e["table"], date=e.get("date"), years=range(args.start_year, args.end_year + 1), undated=True, **m))
        snapshots.publish(df, path)
        print(f"{name}: done")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
        catalog = json.loads(open(args.catalog, encoding="utf-8").read()) if args.job == "extract" else {}
        check(args, set(catalog))
    except SystemExit as e:
        return 2 if e.code else 0
    except (ValueError, OSError) as e:
        print(f"ledgerline: {e}", file=sys.stderr)
        return 2
    if spark is None:
        from .plans.session import build_session

        spark = build_session()
    try:
        if args.job == "extract":
            extract_job(spark, args, catalog)
            return 0
        key = ["id"] if args.job == "link" else ["gvkey", "quarter_end"]
        if _kept(spark, args.out, args.force, key):
            print(f"{args.out}: kept")
            return 0
        {"accounting": accounting_job, "equity": equity_job, "link": link_job}[args.job](spark, args)
    except ValueError as e:
        print(f"ledgerline: {e}", file=sys.stderr)
        return 1
    print(f"{args.out}: done")
    return 0
