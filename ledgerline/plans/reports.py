"""Queries of filters with metrics, entity chains, loaders and composed reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import month_end, quarter_end
from ..operators import accounting, ratings, reports
from ..sources import footers, loaders, sinks
from .queries import QUERIES, _orders, _t

ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _raw_filings(spark, sf_dir):
    """Lines as filings in vendor form; lines of one quantity stand twice, as after a repeated extract."""
    li = _t(spark, sf_dir, "lineitem")
    day = F.col("l_shipdate").cast("date")
    rows = li.select(
        F.col("l_suppkey").alias("gvkey"), month_end(day).alias("datadate"), F.when(F.col("l_quantity") > 3, F.date_add(day, 20)).alias("rdq"),
        F.when(F.col("l_returnflag") != "A", "INDL").otherwise("FS").alias("indfmt"), F.lit("STD").alias("datafmt"), F.when(F.col("l_tax") < 0.08, "D").alias("popsrc"), F.lit("C").alias("consol"),
        F.when(F.col("l_linenumber") <= 3, (4800 + F.col("l_partkey") % 300).cast("string")).when(F.col("l_linenumber") == 4, "n/a").alias("sic"),
        F.when(F.col("l_linenumber") < 7, 5900 + F.col("l_partkey") % 200).alias("sich"), F.col("l_linestatus").alias("datafqtr"), F.col("l_orderkey").cast("string").alias("datacqtr"),
        F.col("l_quantity").alias("dlttq"), F.col("l_tax").alias("dlcq"), F.col("l_extendedprice").alias("atq"), F.col("l_discount").alias("oibdpq"), F.col("l_tax").alias("xintq"),
        F.col("l_discount").alias("niq"), F.col("l_quantity").alias("actq"), F.col("l_quantity").alias("lctq"), F.col("l_quantity").alias("cheq"),
    )
    return rows.unionByName(rows.filter("actq = 10"))


@query
def filing_metrics(spark, sf_dir):
    m = accounting.filing_metrics(_raw_filings(spark, sf_dir))
    return m.withColumn("missing_rdq_percent", F.round("missing_rdq_percent", 9))


@query
def standard_filings(spark, sf_dir):
    return accounting.standard_filings(_raw_filings(spark, sf_dir)).select("gvkey", "datadate", "rdq", "datafqtr", "datacqtr")


_FILINGS = """
  SELECT l_suppkey AS gvkey, last_day(CAST(l_shipdate AS DATE)) AS datadate, CASE WHEN l_quantity > 3 THEN CAST(l_shipdate AS DATE) + 20 END AS rdq, l_returnflag <> 'A' AND l_tax < 0.08 AS standard,
         CASE WHEN l_linenumber <= 3 THEN 4800 + l_partkey % 300 END AS sic, CASE WHEN l_linenumber < 7 THEN 5900 + l_partkey % 200 END AS sich,
         l_linestatus AS datafqtr, CAST(l_orderkey AS VARCHAR) AS datacqtr, l_returnflag, l_tax, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount
  FROM lineitem, range(CASE WHEN l_quantity = 10 THEN 2 ELSE 1 END)
"""
_KEPT = f"""raw AS ({_FILINGS}),
marked AS (SELECT *, standard AND NOT (coalesce(coalesce(sic, sich) BETWEEN 6000 AND 6999, false) OR coalesce(coalesce(sic, sich) BETWEEN 4900 AND 4999, false)) AS kept FROM raw),
done AS (SELECT * FROM marked WHERE kept AND rdq IS NOT NULL)"""
ORACLES["filing_metrics"] = f"""
WITH {_KEPT},
dup AS (
  SELECT sum(n - 1) AS exact FROM (
    SELECT count(*) AS n FROM done GROUP BY gvkey, datadate, rdq, sic, CASE WHEN l_linenumber = 4 THEN 'n/a' END, sich, l_returnflag, l_tax, datafqtr, datacqtr, l_quantity, l_extendedprice, l_discount)),
keys AS (SELECT count(*) FILTER (n > 1) AS k, sum(n - 1) AS dropped FROM (SELECT count(*) AS n FROM done GROUP BY gvkey, datadate))
SELECT CAST(count(*) AS BIGINT) AS raw_rows, count(*) FILTER (standard) AS after_standard_filters, count(*) FILTER (kept) AS after_sic_exclusions, count(*) FILTER (kept AND rdq IS NOT NULL) AS after_required_dates,
       count(*) FILTER (kept AND rdq IS NULL) AS missing_rdq_rows, CAST((SELECT exact FROM dup) AS BIGINT) AS exact_duplicate_rows, (SELECT k FROM keys) AS duplicate_gvkey_datadate_keys,
       CAST((SELECT dropped FROM keys) AS BIGINT) AS duplicate_observations_dropped, count(*) FILTER (standard AND sic IS NOT NULL) AS sic_rows_from_sic,
       count(*) FILTER (standard AND sic IS NULL AND sich IS NOT NULL) AS sic_rows_from_sich,
       round(count(*) FILTER (kept AND rdq IS NULL) / count(*) FILTER (kept) * 100, 9) AS missing_rdq_percent, 'sic_with_sich_fallback' AS sic_source, true AS sic_exclusion_applied
FROM marked"""
ORACLES["standard_filings"] = f"""
WITH {_KEPT}
SELECT gvkey, datadate, rdq, datafqtr, datacqtr FROM done
QUALIFY row_number() OVER (PARTITION BY gvkey, datadate ORDER BY rdq DESC NULLS FIRST, datafqtr DESC NULLS FIRST, datacqtr DESC NULLS FIRST) = 1"""


def _issues(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    issues = c.select(
        F.col("c_custkey").alias("issue_id"), F.when(F.col("c_mktsegment") == "BUILDING", "USNT").otherwise("CDEB").alias("bond_type"),
        F.when(F.col("c_acctbal") > 0, F.date_add(F.lit("1992-01-01").cast("date"), F.floor(F.col("c_acctbal") / 5).cast("int"))).alias("offering_date"),
        F.concat(F.lit(" "), F.lpad(F.col("c_nationkey").cast("string"), 6, "a")).alias("issuer_cusip"), F.lpad((F.col("c_custkey") % 700).cast("string"), 3, "b").alias("issue_cusip"),
    )
    kinds = F.when(F.col("o_totalprice") > 250000, "INS").when(F.col("o_totalprice") > 200000, "LOC").otherwise("COL")
    return ratings.issue_master(issues, _orders(spark, sf_dir).filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("issue_id"), kinds.alias("enh_type")))


@query
def issue_master(spark, sf_dir):
    return _issues(spark, sf_dir).select("issue_id", "offering_date", "cusip8", "cusip6")


@query
def issue_links(spark, sf_dir):
    """Issues to firms by a security link that is valid at the offering, or by a cusip6 of one firm alone."""
    s = _t(spark, sf_dir, "supplier")
    bonds = _t(spark, sf_dir, "customer").filter("c_acctbal > 1500").select(
        F.concat(F.lpad(F.col("c_nationkey").cast("string"), 6, "a"), F.lpad((F.col("c_custkey") % 700).cast("string"), 3, "b")).alias("cusip"), (F.col("c_custkey") % 10 + 1).alias("permno"),
        F.lit(None).cast("date").alias("link_startdt"), F.lit(None).cast("date").alias("link_enddt"),
    )
    start = F.date_add(F.lit("1991-06-01").cast("date"), F.floor(F.col("s_acctbal") / 10).cast("int"))
    firms = s.select(
        F.col("s_nationkey").cast("string").alias("gvkey"), F.col("s_suppkey").alias("lpermno"), start.alias("linkdt"), F.when(F.col("s_acctbal") > 4000, F.date_add(start, 900)).alias("linkenddt"),
        F.when(F.col("s_acctbal") > -500, "LC").otherwise("LX").alias("linktype"), F.lit("P").alias("linkprim"),
    )
    ids = s.select(F.col("s_nationkey").cast("string").alias("gvkey"), F.concat(F.lpad((F.col("s_suppkey") % 40).cast("string"), 6, "a"), F.lit("10")).alias("cusip"))
    return ratings.link_issues(_issues(spark, sf_dir), bonds, firms, ids)


_MASTER = """
  SELECT c_custkey AS issue_id, DATE '1992-01-01' + CAST(floor(c_acctbal / 5) AS INTEGER) AS offering_date,
         upper(lpad(CAST(c_nationkey AS VARCHAR), 6, 'a') || lpad(CAST(c_custkey % 700 AS VARCHAR), 3, 'b'))[1:8] AS cusip8, upper(lpad(CAST(c_nationkey AS VARCHAR), 6, 'a')) AS cusip6
  FROM customer
  WHERE c_mktsegment <> 'BUILDING' AND c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 200000)
"""
ORACLES["issue_master"] = _MASTER
ORACLES["issue_links"] = f"""
WITH m AS ({_MASTER}),
bonds AS (SELECT upper(lpad(CAST(c_nationkey AS VARCHAR), 6, 'a') || lpad(CAST(c_custkey % 700 AS VARCHAR), 3, 'b'))[1:8] AS cusip8, c_custkey % 10 + 1 AS permno FROM customer WHERE c_acctbal > 1500),
firms AS (SELECT CAST(s_nationkey AS VARCHAR) AS gvkey, s_suppkey AS permno, DATE '1991-06-01' + CAST(floor(s_acctbal / 10) AS INTEGER) AS linkdt, s_acctbal FROM supplier WHERE s_acctbal > -500),
a AS (
  SELECT issue_id, gvkey FROM m JOIN bonds USING (cusip8) JOIN firms USING (permno)
  WHERE offering_date >= linkdt AND offering_date <= CASE WHEN s_acctbal > 4000 THEN linkdt + 900 ELSE DATE '2099-12-31' END
  QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY linkdt DESC, gvkey) = 1),
sole AS (SELECT upper(lpad(CAST(s_suppkey % 40 AS VARCHAR), 6, 'a')) AS cusip6, min(CAST(s_nationkey AS VARCHAR)) AS gvkey FROM supplier GROUP BY 1 HAVING count(DISTINCT s_nationkey) = 1),
b AS (SELECT issue_id, gvkey FROM m JOIN sole USING (cusip6))
SELECT issue_id, coalesce(a.gvkey, b.gvkey) AS gvkey, CASE WHEN a.gvkey IS NULL THEN 'b' WHEN b.gvkey IS NULL THEN 'a' ELSE 'both' END AS link_route
FROM a FULL JOIN b USING (issue_id) WHERE a.gvkey IS NULL OR b.gvkey IS NULL OR a.gvkey = b.gvkey"""


def _rated(spark, sf_dir):
    """Customers and quarters as rated firms; a large order is a downgrade."""
    o = _orders(spark, sf_dir)
    q = (F.year("day") * 4 + F.quarter("day") - 1).cast("bigint")
    return o.groupBy(F.col("o_custkey").alias("gvkey"), q.alias("q"), quarter_end("day").alias("quarter_end")).agg(
        (F.floor(F.max("o_totalprice") / 20000) + 5).cast("double").alias("rating_ord"), F.max((F.col("o_totalprice") > 180000).cast("int")).alias("downgrade"), F.min("o_orderpriority").alias("rating_source"),
    )


@query
def default_report(spark, sf_dir):
    o = _orders(spark, sf_dir)
    spells = o.filter("o_orderstatus = 'P' AND o_totalprice > 120000").select(F.col("o_custkey").alias("gvkey"), F.date_add("day", 50).alias("default_date"))
    spells = spells.withColumn("default_q", (F.year("default_date") * 4 + F.quarter("default_date") - 1).cast("bigint"))
    li = _t(spark, sf_dir, "lineitem")
    gone = li.filter("l_quantity = 50").select(F.col("l_partkey").alias("permno"), F.col("l_shipdate").cast("date").alias("dlstdt"), F.when(F.col("l_returnflag") == "R", 574).otherwise(100).alias("dlstcd"))
    links = o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("gvkey"), (F.floor(F.col("o_totalprice") / 500) + 1).cast("bigint").alias("permno"), F.col("day").alias("linkdt"), F.when(F.col("o_orderstatus") != "O", F.date_add("day", 200)).alias("linkenddt"))
    out = reports.default_checks(_rated(spark, sf_dir), spells, gone, links, "1993-01-01", "1998-12-31", 574)
    return out.select(*(F.round(c, 9).alias(c) if c.endswith("share") or c.endswith("default") else c for c in out.columns))


_RATED = """
  SELECT o_custkey AS gvkey, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS q, CAST(last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS DATE) AS quarter_end,
         floor(max(o_totalprice) / 20000) + 5 AS rating_ord, max(CASE WHEN o_totalprice > 180000 THEN 1 ELSE 0 END) AS downgrade, min(o_orderpriority) AS rating_source
  FROM orders GROUP BY ALL
"""
ORACLES["default_report"] = f"""
WITH p AS ({_RATED}),
spells AS (SELECT o_custkey AS gvkey, CAST(o_orderdate AS DATE) + 50 AS default_date FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 120000),
e AS (SELECT *, year(default_date) * 4 + quarter(default_date) - 1 AS default_q FROM spells),
ep AS (SELECT * FROM e WHERE default_date BETWEEN DATE '1993-01-01' AND DATE '1998-12-31'),
m AS (
  SELECT ep.gvkey, p.rating_ord, EXISTS (SELECT 1 FROM p x WHERE x.gvkey = ep.gvkey AND x.downgrade = 1 AND x.q < ep.default_q AND x.q >= ep.default_q - 4) AS prior, p.q IS NOT NULL AS rated
  FROM ep LEFT JOIN p ON p.gvkey = ep.gvkey AND p.q = ep.default_q),
gone AS (SELECT l_partkey AS permno, CAST(l_shipdate AS DATE) AS dlstdt FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'R' AND CAST(l_shipdate AS DATE) BETWEEN DATE '1993-01-01' AND DATE '1998-12-31'),
links AS (SELECT o_custkey AS gvkey, CAST(floor(o_totalprice / 500) AS BIGINT) + 1 AS permno, CAST(o_orderdate AS DATE) AS linkdt, CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) + 200 ELSE DATE '2099-12-31' END AS linkenddt FROM orders WHERE o_orderpriority = '1-URGENT'),
d AS (SELECT DISTINCT l.gvkey, g.dlstdt FROM gone g JOIN links l ON g.permno = l.permno AND g.dlstdt BETWEEN l.linkdt AND l.linkenddt + 365 WHERE l.gvkey IN (SELECT gvkey FROM p)),
met AS (SELECT EXISTS (SELECT 1 FROM e WHERE e.gvkey = d.gvkey AND abs(e.default_q - (year(dlstdt) * 4 + quarter(dlstdt) - 1)) <= 4) AS near FROM d)
SELECT count(*) AS episodes, count(DISTINCT gvkey) AS issuers, round(avg(CASE WHEN rated THEN 0.0::DOUBLE ELSE 1 END), 9) AS unrated_share,
       round(avg(CASE WHEN rated THEN CASE WHEN rating_ord >= 20 THEN 1.0::DOUBLE ELSE 0 END END), 9) AS near_default_share, round(avg(CASE WHEN prior THEN 1.0::DOUBLE ELSE 0 END), 9) AS prior_event_share,
       (SELECT count(*) FROM met) AS delistings, round((SELECT avg(CASE WHEN near THEN 1.0::DOUBLE ELSE 0 END) FROM met), 9) AS delistings_near_default
FROM m"""


def _benchmark(spark, sf_dir):
    o = _orders(spark, sf_dir)
    theirs = o.groupBy(F.col("o_custkey").alias("gvkey"), quarter_end("day").alias("quarter_end")).agg((F.floor(F.avg("o_totalprice") / 20000) + 6).cast("double").alias("their_ord"))
    return reports.benchmark_comparison(_rated(spark, sf_dir), theirs, "1997-12-31")


@query
def benchmark_levels(spark, sf_dir):
    levels = _benchmark(spark, sf_dir)[0]
    return levels.select("rating_source", "n", *(F.round(c, 9).alias(c) for c in ("exact", "off_one", "off_more", "mean_diff")))


@query
def benchmark_events(spark, sf_dir):
    events = _benchmark(spark, sf_dir)[1]
    return events.select("n_pairs", "n_ours", "n_theirs", *(F.round(c, 9).alias(c) for c in ("caught_same", "caught_near", "matched_same", "matched_near")))


@query
def benchmark_unmatched(spark, sf_dir):
    return _benchmark(spark, sf_dir)[2]


_BOTH = f"""p AS ({_RATED}),
b AS (
  SELECT p.*, t.their_ord FROM p
  JOIN (SELECT o_custkey AS gvkey, CAST(last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS DATE) AS quarter_end, floor(avg(o_totalprice) / 20000) + 6 AS their_ord FROM orders GROUP BY ALL) t USING (gvkey, quarter_end)
  WHERE quarter_end <= DATE '1997-12-31'),
m AS (SELECT *, coalesce(lag(q) OVER w = q - 1, false) AS follows, coalesce(their_ord > lag(their_ord) OVER w, false) AS cut, downgrade = 1 AS own FROM b WINDOW w AS (PARTITION BY gvkey ORDER BY q)),
f AS (SELECT *, coalesce(lag(cut) OVER w, false) OR cut OR coalesce(lead(cut) OVER w, false) AS near_cut, coalesce(lag(own) OVER w, false) OR own OR coalesce(lead(own) OVER w, false) AS near_own FROM m WHERE follows WINDOW w AS (PARTITION BY gvkey ORDER BY q))"""
ORACLES["benchmark_levels"] = f"""
WITH {_BOTH}
SELECT rating_source, count(*) AS n, round(avg(CASE WHEN rating_ord = their_ord THEN 1.0::DOUBLE ELSE 0 END), 9) AS exact, round(avg(CASE WHEN abs(rating_ord - their_ord) = 1 THEN 1.0::DOUBLE ELSE 0 END), 9) AS off_one,
       round(avg(CASE WHEN abs(rating_ord - their_ord) >= 2 THEN 1.0::DOUBLE ELSE 0 END), 9) AS off_more, round(avg(rating_ord - their_ord), 9) AS mean_diff
FROM b GROUP BY GROUPING SETS ((rating_source), ())"""
ORACLES["benchmark_events"] = f"""
WITH {_BOTH}
SELECT count(*) AS n_pairs, count(*) FILTER (own) AS n_ours, count(*) FILTER (cut) AS n_theirs, round(count(*) FILTER (own AND cut) / count(*) FILTER (cut), 9) AS caught_same,
       round(count(*) FILTER (near_own AND cut) / count(*) FILTER (cut), 9) AS caught_near, round(count(*) FILTER (own AND cut) / count(*) FILTER (own), 9) AS matched_same,
       round(count(*) FILTER (own AND near_cut) / count(*) FILTER (own), 9) AS matched_near
FROM f"""
ORACLES["benchmark_unmatched"] = f"WITH {_BOTH} SELECT gvkey, quarter_end, rating_ord, rating_source, their_ord FROM f WHERE own AND NOT near_cut"


@query
def loaded_ratings(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(
        F.when(F.col("value") > 5, F.col("user_id").cast("string")).otherwise("?").alias("issue_id"), F.concat(F.lit(" "), F.substring("event_type", 1, 3)).alias("rating_type"),
        F.when(F.col("value") < 95, F.col("ts").cast("string")).otherwise("not a day").alias("rating_date"), F.concat(F.floor("value").cast("string"), F.lit(" ")).alias("rating"),
    )
    return loaders.raw_ratings(e)


ORACLES["loaded_ratings"] = """
SELECT user_id AS issue_id, event_type[1:3] AS rating_type, CAST(ts AS DATE) AS rating_date, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS rating FROM events WHERE value > 5 AND value < 95"""


@query
def loaded_links(spark, sf_dir):
    o = _orders(spark, sf_dir).select(
        F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("gvkey"), F.when(F.col("o_totalprice") > 20000, F.col("o_orderkey").cast("string")).otherwise("x").alias("lpermno"), F.col("o_orderkey").cast("double").alias("lpermco"),
        F.col("o_orderdate").cast("string").alias("linkdt"), F.when(F.col("o_orderstatus") == "F", "E").otherwise(F.date_add("day", 30).cast("string")).alias("linkenddt"),
        F.when(F.col("o_orderstatus") == "F", "LC").when(F.col("o_orderstatus") == "O", "LU ").otherwise("LX").alias("linktype"), F.when(F.col("o_orderpriority") < "4", "P").otherwise("C").alias("linkprim"),
    )
    return loaders.firm_links(o)


ORACLES["loaded_links"] = """
SELECT CAST(o_custkey AS VARCHAR) AS gvkey, o_orderkey AS permno, o_orderkey AS permco, CAST(o_orderdate AS DATE) AS linkdt, CASE WHEN o_orderstatus <> 'F' THEN CAST(o_orderdate AS DATE) + 30 END AS linkenddt,
       CASE WHEN o_orderstatus = 'F' THEN 'LC' ELSE 'LU' END AS linktype, CASE WHEN o_orderpriority < '4' THEN 'P' ELSE 'C' END AS linkprim,
       CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS type_rank, CASE WHEN o_orderpriority < '4' THEN 0 ELSE 1 END AS prim_rank
FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice > 20000"""


@query
def loaded_delistings(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("permno"), F.col("l_shipdate").alias("dlstdt"), F.when(F.col("l_quantity") > 9, -F.col("l_discount")).otherwise(F.lit("NaN").cast("double")).alias("dlret"),
        F.lit("C").alias("dlretx"), F.col("l_tax").alias("dlprc"), F.col("l_linenumber").alias("dlstcd"),
    )
    return loaders.delistings(li).select("permno", "month", "dlstdt", "dlret", "dlretx", "dlstcd")


ORACLES["loaded_delistings"] = """
SELECT l_suppkey AS permno, last_day(CAST(l_shipdate AS DATE)) AS month, CAST(l_shipdate AS DATE) AS dlstdt, CASE WHEN l_quantity > 9 THEN -l_discount END AS dlret, CAST(NULL AS DOUBLE) AS dlretx, CAST(l_linenumber AS BIGINT) AS dlstcd
FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey, last_day(CAST(l_shipdate AS DATE)) ORDER BY CAST(l_shipdate AS DATE) DESC NULLS FIRST, CASE WHEN l_quantity > 9 THEN -l_discount END DESC NULLS FIRST, l_linenumber DESC NULLS FIRST) = 1"""


@query
def archive_report(spark, sf_dir):
    asked = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    got = _orders(spark, sf_dir).filter("o_totalprice > 150000").select(F.col("o_custkey").alias("id"))
    return reports.archive_reconciliation(asked, got, "id")


ORACLES["archive_report"] = """
WITH g AS (SELECT o_custkey AS id, count(*) AS n FROM orders WHERE o_totalprice > 150000 GROUP BY 1),
b AS (SELECT c.c_custkey AS a, g.id AS g, coalesce(g.id, c.c_custkey) AS id, n FROM customer c FULL JOIN g ON c.c_custkey = g.id)
SELECT count(a) AS requested, count(g) AS archived, count(*) FILTER (g IS NULL) AS missing, count(*) FILTER (a IS NULL) AS unasked, count(*) FILTER (n > 1) AS repeated,
       coalesce((SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FROM (SELECT id FROM b WHERE g IS NULL ORDER BY id LIMIT 100)), '') AS missing_sample
FROM b"""


@query
def archive_counts(spark, sf_dir):
    """Window and undated rows against an archive that lacks returned lines of one mode and holds some twice."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag")
    window, undated = li.filter("l_quantity > 3"), li.filter("l_quantity <= 3")
    archived = li.filter("l_returnflag <> 'R' OR l_quantity <> 7").unionByName(li.filter("l_quantity = 11"))
    return sinks.reconcile(window, undated, archived, ["l_orderkey"])


ORACLES["archive_counts"] = """
WITH k AS (
  SELECT l_orderkey, count(*) AS s, count(*) FILTER (l_quantity > 3) AS w, count(*) FILTER (l_returnflag <> 'R' OR l_quantity <> 7) + count(*) FILTER (l_quantity = 11) AS a FROM lineitem GROUP BY 1)
SELECT CAST(sum(w) AS BIGINT) AS window_rows, CAST(sum(s - w) AS BIGINT) AS undated_rows, CAST(sum(a) AS BIGINT) AS archived_rows, CAST(sum(greatest(s - a, 0)) AS BIGINT) AS missing_rows,
       CAST(sum(greatest(a - s, 0)) AS BIGINT) AS surplus_rows, sum(abs(s - a)) = 0 AS reconciled
FROM k"""


@query
def footer_profile(spark, sf_dir):
    """Rows, columns and extremes of a table from its Parquet footers; bytes and files aren't SQL's to tell."""
    return footers.footer_metrics(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"]).drop("n_bytes", "n_files")


ORACLES["footer_profile"] = """
SELECT count(*) AS n_rows, min(l_orderkey) AS min_l_orderkey, max(l_orderkey) AS max_l_orderkey, min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity,
       CAST((SELECT count(*) FROM (DESCRIBE lineitem)) AS INTEGER) AS n_columns
FROM lineitem"""
