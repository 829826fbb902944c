"""Queries over the sample tables, one or more for each operator of the library.

The tables hold no accounts or ratings, so each query maps them onto the shapes that the
operators expect: orders stand for filings and bonds, events for ratings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import expand_span, month_end, quarter_end, quarter_end_of, quarter_grid, quarter_index
from ..functions.scalars import any_missing, guarded_log, guarded_ratio, lookup, number, security_key, sum_known
from ..operators import accounting, equity, labels, linkage, merton, modelling, profiles, ratings, select, temporal
from ..sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
GRID = (1992 * 4, 1998 * 4 + 3)


def query(f):
    QUERIES[f.__name__] = f
    return f


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def _total(c: str | Column, name: str) -> Column:
    """Sum of cents, exact in any order, as a double."""
    return F.sum(_money(c)).cast("double").alias(name)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    return o.select(
        F.col("o_custkey").alias("gvkey"), F.col("day").alias("datadate"), F.date_add("day", (F.col("o_orderkey") % 91 - 10).cast("int")).alias("rdq"),
        F.col("o_orderkey").alias("filing"), F.col("o_totalprice").alias("atq"),
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("d"))


@query
def pit_align(spark, sf_dir):
    out = accounting.align_quarters(_filings(spark, sf_dir), *GRID, values=["atq"], cap_days=270)
    return out.select("gvkey", "q", "quarter_end", "datadate", "rdq", "filing", "age_days", "is_stale", "atq")


@query
def guarded_ratios(spark, sf_dir):
    per = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(_total("l_extendedprice", "price"), _total(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")), "returned"), _total(F.col("l_quantity") - 25, "spare"))
    return per.select(
        "l_orderkey", guarded_ratio("returned", "price").alias("return_share"), guarded_ratio("price", "spare").alias("price_per_spare"),
        guarded_log("spare").alias("log_spare"), sum_known("returned", "spare").alias("known_sum"), any_missing("returned", "spare").alias("part_missing"),
    )


@query
def standard_filters(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.filter((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT") & F.year("o_orderdate").isin(1995, 1996) & (F.col("o_totalprice") > 1000)).select("o_orderkey", "o_custkey", "o_totalprice")


@query
def range_exclusion(spark, sf_dir):
    p = _t(spark, sf_dir, "part").withColumn("code", F.coalesce(F.nullif(F.col("p_size"), F.lit(7)), F.nullif((F.col("p_partkey") % 50).cast("int"), F.lit(3))))
    keep = ~F.coalesce(F.col("code").between(10, 20), F.lit(False)) & ~F.coalesce(F.col("code").between(30, 35), F.lit(False))
    return p.filter(keep & F.coalesce(~F.col("p_brand").isin("Brand#11", "Brand#12"), F.lit(True))).select("p_partkey", "code")


@query
def dedupe_last(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("v", F.nullif(F.floor("value").cast("bigint"), F.lit(5)))
    return select.last_by(e, ["user_id", "d"], "v", "event_id").select("user_id", "d", "event_id", "v")


@query
def dedupe_first_ranked(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").withColumn("q", F.nullif(F.col("l_quantity"), F.lit(50.0)))
    out = select.first_by(li, ["l_orderkey"], "-q", "l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "q")


@query
def semi_filter(spark, sf_dir):
    rich = _t(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return _t(spark, sf_dir, "orders").join(rich, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query
def anti_filter(spark, sf_dir):
    big = _t(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, sf_dir, "customer").join(big, "c_custkey", "left_anti").select("c_custkey", "c_name")


def _links(spark, sf_dir):
    """Validity intervals of firms: of every order of a customer, some open."""
    o = _orders(spark, sf_dir)
    end = F.when(F.col("o_orderkey") % 15 != 0, F.date_add("day", (F.col("o_orderkey") % 400).cast("int")))
    return o.select("o_custkey", F.col("o_orderkey").alias("link"), F.col("day").alias("linkdt"), end.alias("linkenddt"))


@query
def valid_window_join(spark, sf_dir):
    o = _orders(spark, sf_dir).select("o_custkey", "o_orderkey", "day")
    return temporal.valid_join(o, _links(spark, sf_dir), ["o_custkey"], "day", "linkdt", "linkenddt").select("o_orderkey", "link", "linkdt", "linkenddt")


@query
def window_grace_join(spark, sf_dir):
    o = _orders(spark, sf_dir).select("o_custkey", "o_orderkey", "day")
    links = _links(spark, sf_dir).filter(F.col("linkenddt").isNotNull())
    return temporal.valid_join(o, links, ["o_custkey"], "day", "linkdt", "linkenddt", grace_days=365).select("o_orderkey", "link")


@query
def latest_valid_left(spark, sf_dir):
    o = _orders(spark, sf_dir).select("o_custkey", "o_orderkey", "day")
    return temporal.latest_valid(o, _links(spark, sf_dir), ["o_custkey"], "day", "linkdt", "linkenddt", ties=["link"]).select("o_orderkey", "link", "linkdt", "linkenddt")


@query
def asof_backward(spark, sf_dir):
    e = _events(spark, sf_dir)
    bought = e.filter("event_type = 'purchase'").select("user_id", "event_id", "ts")
    seen = e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"), F.nullif(F.col("event_id") % 7, F.lit(0)).alias("mark"))
    return temporal.asof_backward(bought, seen, ["user_id"], "ts", "view_ts", ties=["view_id"]).select("event_id", "user_id", "view_id", "mark")


@query
def asof_forward_strict(spark, sf_dir):
    e = _events(spark, sf_dir)
    rows = e.filter("event_type = 'purchase'").select("user_id", "event_id", "d")
    return temporal.next_after(rows, e.filter("event_type = 'error'"), ["user_id"], "d", "next_error_d").select("event_id", "user_id", "d", "next_error_d")


@query
def route_union_conflict(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    a = c.filter("c_acctbal > 2500").select("c_custkey", F.col("c_nationkey").alias("nation_a"))
    shared = c.withColumn("k", F.floor(F.col("c_custkey") / 4))
    sole = shared.groupBy("k").agg(F.count_distinct(F.col("c_nationkey") % 4).alias("n"), F.min("c_nationkey").alias("nation_b")).filter("n <= 3")
    b = shared.filter("c_mktsegment <> 'BUILDING'").join(sole, "k").select("c_custkey", "nation_b")
    return ratings.route_union(a, b, "c_custkey", "nation")


def _monthly(spark, sf_dir):
    """Supplier months with a growth rate as the return; about one in seventeen is unknown."""
    li = _t(spark, sf_dir, "lineitem").withColumn("month", month_end(F.col("l_shipdate").cast("date")))
    rev = li.groupBy(F.col("l_suppkey").alias("permno"), "month").agg(_total("l_extendedprice", "revenue"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("permno").orderBy("month")
    growth = F.col("revenue") / F.lag("revenue").over(w) - 1
    return rev.withColumn("ret", F.when((F.col("permno") + F.month("month")) % 17 != 0, growth))


@query
def compound_return_12(spark, sf_dir):
    out = _monthly(spark, sf_dir).withColumn("ret_12", F.round(equity.compound_return("ret", ["permno"], "month"), 6))
    return out.select("permno", "month", F.round("ret", 6).alias("ret"), "ret_12")


@query
def market_trailing_quarter(spark, sf_dir):
    """Whole-market 12-month compounding, last month of each quarter; one row a month reaches the single window."""
    li = _t(spark, sf_dir, "lineitem").groupBy(month_end(F.col("l_shipdate").cast("date")).alias("month")).agg(_total("l_extendedprice", "revenue"))
    w = Window.orderBy("month")
    r = li.withColumn("ret", F.col("revenue") / F.lag("revenue").over(w) - 1)
    out = r.withColumn("ret_12", equity.compound_return("ret", [], "month", least=12)).groupBy(quarter_index("month").alias("q"))
    return out.agg(F.max("month").alias("month"), F.round(F.max_by("ret_12", "month"), 6).alias("ret_12"))


def _delisted(m):
    return m.filter("n <= 3").select("permno", F.date_sub("month", 3).alias("dlstdt"), F.lit(-0.5).alias("dlret"), F.lit(1.0).alias("dlprc"))


@query
def append_unmatched(spark, sf_dir):
    m = _monthly(spark, sf_dir).select("permno", "month", F.col("month").alias("date"), F.when(F.col("permno") % 2 == 0, F.lit(0.25)).alias("ret"), F.col("revenue").alias("prc"), "n")
    gone = _delisted(m)
    return equity.with_delistings(m.filter("n <> 2").drop("n"), gone).select("permno", "month", "date", "prc", "ret", "delisted")


@query
def equity_link(spark, sf_dir):
    """Security months linked to firms in their validity, the largest security a firm."""
    m = _monthly(spark, sf_dir).select("permno", "month", F.col("month").alias("date"), F.col("revenue").alias("prc"), F.when(F.col("n") % 5 != 0, F.col("n")).alias("shrout"))
    links = m.select("permno").distinct().select(
        (F.col("permno") % 20).alias("gvkey"), F.col("permno").alias("lpermno"), F.lit("1993-06-30").cast("date").alias("linkdt"),
        F.when(F.col("permno") % 4 != 0, F.lit("1996-03-31").cast("date")).alias("linkenddt"),
        F.when(F.col("permno") % 3 == 0, "LU").when(F.col("permno") % 11 == 0, "LX").otherwise("LC").alias("linktype"),
        F.when(F.col("permno") % 2 == 0, "P").otherwise("C").alias("linkprim"),
    )
    return equity.link_to_firms(m, links).select("gvkey", "month", "permno", F.round("mktcap", 2).alias("mktcap"))


def _spells(spark, sf_dir):
    """Episodes by user: from an error to the next purchase on a later day."""
    e = _events(spark, sf_dir)
    err = e.filter("event_type = 'error' AND value > 80").select("user_id", "d").distinct()
    out = temporal.next_after(err, e.filter("event_type = 'purchase' AND value > 50"), ["user_id"], "d", "emerge_q")
    return out.select("user_id", F.col("d").alias("default_q"), "emerge_q")


def _user_days(spark, sf_dir):
    return _events(spark, sf_dir).select("user_id", F.col("d").alias("q")).distinct()


@query
def range_anti_mask(spark, sf_dir):
    return temporal.range_anti(_user_days(spark, sf_dir), _spells(spark, sf_dir), ["user_id"], "q", "default_q", "emerge_q")


@query
def range_semi_mask(spark, sf_dir):
    return labels.masked_only(_user_days(spark, sf_dir), _spells(spark, sf_dir), "user_id")


@query
def gap_lag(spark, sf_dir):
    daily = _events(spark, sf_dir).filter("event_type IN ('view', 'click')").groupBy("user_id", F.col("d").alias("q")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("top"))
    return daily.withColumn("prev_n", temporal.gap_lag("n", ["user_id"], "q"))


def _raw_ratings(spark, sf_dir):
    """Events as ratings: the user is the issue, a grade by id, some withdrawals and odd codes."""
    e = _events(spark, sf_dir)
    k = F.col("event_id") % 23
    sp = F.array(*[F.lit(x) for x in ("AAA", "AA+", "A", "BBB-", "BB+", " B ", "CCC", "D")])
    md = F.array(*[F.lit(x) for x in ("Aaa", "Aa1", "A2", "Baa3", "Ba1", "B2", "Caa2", "C")])
    agency = F.when(F.col("event_type").isin("view", "click"), "SPR").when(F.col("event_type") == "signup", "FR").otherwise("MR")
    grade = F.when(k == 0, "NR").when(k == 1, "P-1").when(k == 2, "??").otherwise(F.when(agency == "MR", F.get(md, (k % 8).cast("int"))).otherwise(F.get(sp, (k % 8).cast("int"))))
    return e.select(F.col("user_id").alias("issue_id"), agency.alias("rating_type"), F.date_add(F.lit("1992-01-05").cast("date"), (F.col("d") * 80).cast("int")).alias("rating_date"), grade.alias("rating"))


@query
def affirmation_dedup(spark, sf_dir):
    return ratings.clean_ratings(_raw_ratings(spark, sf_dir).distinct()).select("issue_id", "rating_type", "rating_date", "ord", "is_terminator")


def _bonds(spark, sf_dir):
    """Customers as bonds; the day offsets wrap around, so that every bond lives in the grid."""
    c = _t(spark, sf_dir, "customer")
    levels = F.array(*[F.lit(x) for x in ("SEN", "SS", "SENS", "SUB", "JUN", "NON")])
    start = F.date_add(F.lit("1991-06-01").cast("date"), (F.col("c_custkey") * 11 % 1650).cast("int"))
    return c.select(
        F.col("c_custkey").alias("issue_id"), (F.col("c_custkey") % 40).alias("gvkey"), start.alias("offering_date"),
        F.when(F.col("c_custkey") % 6 != 0, F.date_add(start, (700 + F.col("c_custkey") * 13 % 1950).cast("int"))).alias("maturity"),
        F.get(levels, (F.col("c_custkey") % 6).cast("int")).alias("security_level"), F.floor(F.col("c_acctbal")).cast("double").alias("offering_amt"),
    )


def _defaults(spark, sf_dir):
    b = _bonds(spark, sf_dir).filter("offering_amt < 200")
    return b.select("issue_id", "gvkey", F.date_add("offering_date", (400 + F.col("issue_id") * 7 % 300).cast("int")).alias("default_date"), F.when(F.col("issue_id") % 2 == 0, F.date_add("offering_date", 900)).alias("reinstated_date"))


def _issue_quarters(spark, sf_dir):
    clean = ratings.clean_ratings(_raw_ratings(spark, sf_dir).distinct())
    master = _bonds(spark, sf_dir)
    return ratings.issue_quarters(clean, master, _defaults(spark, sf_dir), *GRID), master


@query
def active_issue_quarters(spark, sf_dir):
    return _issue_quarters(spark, sf_dir)[0].select("rating_type", "issue_id", "q", "quarter_end", "ord")


def _enriched(spark, sf_dir):
    iq, master = _issue_quarters(spark, sf_dir)
    return ratings.enrich(iq, master, master)


@query
def enriched_quarters(spark, sf_dir):
    return _enriched(spark, sf_dir).select("rating_type", "issue_id", "gvkey", "q", "ord", "prev_ord", "rating_source")


@query
def reference_pick(spark, sf_dir):
    return ratings.reference_ratings(_enriched(spark, sf_dir))


@query
def cut_events(spark, sf_dir):
    d = _enriched(spark, sf_dir).persist()
    return ratings.cut_events(d, ratings.reference_ratings(d))


@query
def combine_middle(spark, sf_dir):
    return ratings.combine_agencies(ratings.reference_ratings(_enriched(spark, sf_dir)).persist())


def _episodes(spark, sf_dir):
    bonds = _bonds(spark, sf_dir)
    first = ratings.clean_ratings(_raw_ratings(spark, sf_dir).distinct()).filter(F.col("ord").isNotNull()).groupBy("issue_id").agg(F.min("rating_date").alias("first_rating"))
    return labels.episodes(_defaults(spark, sf_dir), bonds.join(first, "issue_id").select("gvkey", "offering_date", F.greatest(F.col("first_rating"), F.date_add("offering_date", 30)).alias("first_rating")))


@query
def default_episodes(spark, sf_dir):
    return _episodes(spark, sf_dir)


@query
def forward_labels(spark, sf_dir):
    rows = labels.with_observable(_user_days(spark, sf_dir), "user_id")
    events = _events(spark, sf_dir).filter("event_type = 'error'").select("user_id", F.col("d").alias("q"))
    return labels.forward_labels(rows, labels.wide_events({"err": events}, "user_id"), ["err"], 29, "user_id", countdown=True)


@query
def label_panel(spark, sf_dir):
    e = _events(spark, sf_dir)
    family = lambda kind: e.filter(F.col("event_type") == kind).select("user_id", F.col("d").alias("q"))
    events = labels.wide_events({"err": family("error"), "buy": family("purchase")}, "user_id")
    return labels.label_panel(_user_days(spark, sf_dir), events, ["err", "buy"], _spells(spark, sf_dir), 29, "user_id")


@query
def downgrade_panel(spark, sf_dir):
    # Each is read by several branches: planned and worked out once, and spilled to disk where memory is short.
    d = _enriched(spark, sf_dir).persist()
    refs = ratings.reference_ratings(d).persist()
    panel = labels.downgrade_panel(ratings.cut_events(d, refs), ratings.combine_agencies(refs), _episodes(spark, sf_dir), GRID[1], ratings.AGENCY_NAMES)
    return panel.select("gvkey", "q", "rating_ord", "downgrade", "downgrade_4q", "downgrade_strict_8q", "downgrade_anybond_1q", "downgrade_sp_4q", "downgrade_moodys_4q", "downgrade_fitch_4q")


@query
def diff_pct_change(spark, sf_dir):
    o = _orders(spark, sf_dir).groupBy(month_end("day").alias("month")).agg(_total("o_totalprice", "total"))
    w = Window.orderBy("month")
    padded = F.last(F.when(F.month("month") != 5, F.col("total")), ignorenulls=True).over(w)
    p = o.withColumn("level", padded)
    return p.select("month", F.round(F.col("total") - F.lag("total").over(w), 4).alias("diff"), F.round(F.try_divide(F.col("level") - F.lag("level", 12).over(w), F.lag("level", 12).over(w)) * 100, 6).alias("pct_12"))


@query
def quarter_grid_days(spark, sf_dir):
    """Every quarter of nine years with its orders, also those that have none."""
    per = _orders(spark, sf_dir).groupBy(quarter_index("day").alias("q")).agg(F.count(F.lit(1)).alias("n"))
    return quarter_grid(spark, "1991-01-01", "1999-12-31").join(per, "q", "left").select("q", "quarter_end", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query
def span_expand(spark, sf_dir):
    o = _orders(spark, sf_dir).select("o_orderkey", quarter_index("day").alias("s"), quarter_index(F.date_add("day", (F.col("o_orderkey") % 900).cast("int"))).alias("e"))
    return expand_span(o, "s", "e", "q", GRID[0] + 4, GRID[1] - 4).select("o_orderkey", "q", quarter_end_of("q").alias("quarter_end"))


@query
def presence_crosstab(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.groupBy("user_id", "d").agg(*[F.bool_or(F.col("event_type") == k).alias(f"has_{k}") for k in ("view", "click", "purchase", "signup", "error")], F.count_distinct("event_type").alias("n_types"))


@query
def value_shares(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("p", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    return o.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


@query
def rates_by_year(spark, sf_dir):
    o = _orders(spark, sf_dir).groupBy(F.year("day").cast("bigint").alias("year")).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))
    grid = spark.range(1990, 2001).select(F.col("id").alias("year"))
    return grid.join(o, "year", "left").select("year", "rate", F.coalesce("n", F.lit(0)).alias("n"))


@query
def dup_profile(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return profiles.duplicate_profile(li, ["l_orderkey", "l_linenumber"])


@query
def missing_profile(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"), F.nullif(F.col("o_custkey") % 11, F.lit(0)).alias("cust"), "o_totalprice")
    return profiles.missing_profile(o, ["status", "cust", "o_totalprice"])


@query
def minmax_profile(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return o.groupBy(F.year("day").cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_custkey").alias("n_keys"), *profiles.range_profile(o, ["day", "o_totalprice"]))


@query
def partition_summary(spark, sf_dir):
    o = _orders(spark, sf_dir).groupBy(F.year("day").cast("bigint").alias("year"), "o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return o.groupBy("year").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("dup_rows"))


@query
def missing_years(spark, sf_dir):
    have = _orders(spark, sf_dir).filter("year(day) <> 1994").select(F.year("day").cast("bigint").alias("year")).distinct()
    return spark.range(1992, 1999).select(F.col("id").alias("year")).join(have, "year", "left_anti")


@query
def date_plausibility(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    gap = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    return li.agg(F.count_if(gap < 0).alias("inverted"), F.count_if(gap > 365).alias("far"), F.count_if(gap.between(0, 365)).alias("fine"))


@query
def range_overlap(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("linkdt", "link")
    l = _links(spark, sf_dir).withColumn("over", F.coalesce(F.lag(F.coalesce("linkenddt", F.lit("2099-12-31").cast("date"))).over(w) >= F.col("linkdt"), F.lit(False)))
    return l.groupBy("o_custkey").agg(F.count_if("over").alias("overlaps"), F.count(F.lit(1)).alias("n"))


@query
def attrition(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    steps = o.agg(F.count(F.lit(1)).alias("a"), F.count_if(F.expr("o_orderstatus <> 'P'")).alias("b"), F.count_if(F.expr("o_orderstatus <> 'P' AND o_totalprice > 100000")).alias("c"))
    long = steps.select(F.explode(F.array(F.struct(F.lit(1).alias("stage"), F.col("a").alias("n")), F.struct(F.lit(2).alias("stage"), F.col("b").alias("n")), F.struct(F.lit(3).alias("stage"), F.col("c").alias("n")))).alias("x")).select("x.*")
    return long.withColumn("ratio", F.col("n") / F.lag("n").over(Window.orderBy("stage")))


@query
def cond_distinct(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag").agg(F.count_distinct(F.when(F.col("l_linestatus") == "O", F.col("l_orderkey"))).alias("open_orders"), F.sum(F.when(F.col("l_quantity") > 30, 1).otherwise(0)).alias("large"), F.count("l_shipdate").alias("dated"))


@query
def percentile_cont(spark, sf_dir):
    return _t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(*[F.percentile("o_totalprice", p).alias(f"p{round(100 * p)}") for p in (0.25, 0.5, 0.75)])


@query
def nested_agg(spark, sf_dir):
    per = _t(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("o_orderstatus").agg(F.max("n").alias("most"), F.sum("n").alias("n"), F.count_if(F.expr("n > 5")).alias("busy"))


@query
def having_ambiguous(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").withColumn("k", F.col("s_suppkey") % 37)
    return s.groupBy("k").agg(F.count_distinct("s_nationkey").alias("n_nations")).filter("n_nations > 1")


@query
def group_measures(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    out = o.groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"), F.min("o_totalprice").alias("low"), (F.max("o_totalprice") - F.min("o_totalprice")).alias("spread"), F.count(F.lit(1)).alias("n"), F.count_if(F.expr("o_orderstatus = 'F'")).alias("n_f"), F.bool_or(F.col("o_orderstatus") == "P").alias("any_p"))
    return out.withColumn("mostly_f", ratings.majority("n_f", "n"))


@query
def group_floor(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("low", F.min("o_totalprice").over(Window.partitionBy("o_custkey")))
    return o.filter(F.col("o_totalprice") == F.col("low")).select("o_custkey", "o_orderkey", "low")


@query
def middle_rank(spark, sf_dir):
    return select.middle_by(_t(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query
def top_values(spark, sf_dir):
    return _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_custkey").limit(10)


@query
def crosstab_year_type(spark, sf_dir):
    return _orders(spark, sf_dir).groupBy(F.year("day").cast("bigint").alias("year")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


@query
def median_by_group(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.median("l_extendedprice").alias("median_price"), F.min("l_quantity").alias("min_qty"), F.max("l_quantity").alias("max_qty"))


@query
def agreement_matrix(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_type", (F.col("event_id") % 7).alias("a"), F.nullif(F.col("user_id") % 6, F.lit(0)).alias("b"))
    return profiles.agreement(e, "a", "b", "event_type")


def _marked_days(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("user_id", F.col("d").alias("q")).agg(F.bool_or(F.col("event_type") == "error").alias("ours"), F.bool_or(F.col("event_type") == "signup").alias("theirs"))


@query
def event_precision(spark, sf_dir):
    return profiles.event_match(_marked_days(spark, sf_dir), "ours", "theirs", "user_id", "q")


@query
def interval_join(spark, sf_dir):
    o = _orders(spark, sf_dir).select("o_custkey", "o_orderkey", "day", "o_totalprice")
    later = o.filter("o_totalprice > 150000").select(F.col("o_custkey").alias("k"), F.col("day").alias("later"))
    gap = temporal.next_after(o.withColumnRenamed("day", "at"), later.select(F.col("k").alias("o_custkey"), F.col("later").alias("at")), ["o_custkey"], "at", "next_big")
    return gap.select("o_orderkey", *[F.coalesce(F.col("next_big") <= F.add_months("at", m), F.lit(False)).alias(f"within_{m}m") for m in (3, 12, 24)])


@query
def trailing_event_join(spark, sf_dir):
    days = _marked_days(spark, sf_dir)
    hit, base = days.filter("ours").select("user_id", "q"), days.filter("theirs").select(F.col("user_id").alias("u"), F.col("q").alias("p"))
    return hit.join(base, (F.col("user_id") == F.col("u")) & F.col("p").between(F.col("q") - 4, F.col("q") - 1), "left_semi")


@query
def near_interval(spark, sf_dir):
    around = Window.partitionBy("user_id").orderBy("q").rangeBetween(-2, 2)
    near = F.coalesce(F.max("theirs").over(around), F.lit(False))
    return _marked_days(spark, sf_dir).select("user_id", "q", "ours", near.alias("near")).filter("ours").drop("ours")


@query
def prefix_join(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", F.substring("p_brand", 1, 7).alias("k"))
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Brand#"), (F.col("s_nationkey") % 5 + 1).cast("string")).alias("k"))
    by_key = s.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("s_suppkey").alias("first_supp"))
    return p.join(by_key, "k").select("p_partkey", "n", "first_supp")


@query
def shifted_self_join(spark, sf_dir):
    days = _marked_days(spark, sf_dir)
    prev = days.select("user_id", (F.col("q") + 1).alias("q"), F.col("ours").alias("ours_before"))
    return days.join(prev, ["user_id", "q"]).select("user_id", "q", "ours", "ours_before")


@query
def time_align(spark, sf_dir):
    o, li = _orders(spark, sf_dir), _t(spark, sf_dir, "lineitem")
    a = o.groupBy("day").agg(F.count(F.lit(1)).alias("n_orders"))
    b = li.groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n_lines"))
    return a.join(b, "day", "full")


@query
def union_distinct_all(spark, sf_dir):
    a = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    b = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    both = a.distinct().unionByName(b)
    return both.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query
def union_missing_columns(spark, sf_dir):
    a = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return tables.concat([a, _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))])


@query
def set_overlap(spark, sf_dir):
    a = _t(spark, sf_dir, "orders").filter("o_totalprice > 250000").select(F.col("o_custkey").alias("k"))
    b = _t(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    one = a.distinct().withColumn("x", F.lit(1)).join(b.distinct().withColumn("y", F.lit(1)), "k", "full")
    return one.agg(F.count_if(F.expr("x = 1 AND y = 1")).alias("in_both"), F.count_if(F.expr("x = 1 AND y IS NULL")).alias("only_a"), F.count_if(F.expr("x IS NULL")).alias("only_b"))


@query
def year_scan(spark, sf_dir):
    data = tables.Dataset("orders", f"{sf_dir}/orders.parquet", required=("o_orderkey", "o_orderdate", "o_totalprice"), date="o_orderdate")
    return tables.scan(spark, data, 1994, 1995).select("o_orderkey", "o_totalprice")


@query
def undated_rows(spark, sf_dir):
    o = _orders(spark, sf_dir).withColumn("shown", F.when(F.col("o_orderkey") % 19 != 0, F.col("day")))
    dated = o.filter(tables.in_years("shown", 1992, 1998))
    return tables.undated(o, "shown").agg(F.count(F.lit(1)).alias("undated")).withColumns({"dated": dated.agg(F.count(F.lit(1))).scalar(), "all_rows": o.agg(F.count(F.lit(1))).scalar()})


@query
def typed_columns(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", F.split("p_type", " ").getItem(0).alias("word"), F.when(F.col("p_size") % 3 == 0, "x").otherwise(F.col("p_size").cast("string")).alias("size_text"))
    day = F.concat(F.lit("1995-"), F.lpad((F.col("p_partkey") % 14).cast("string"), 2, "0"), F.lit("-10"))
    return p.select("p_partkey", number("size_text").alias("size_number"), F.col("size_text").try_cast("bigint").alias("size_long"), day.try_cast("date").alias("day"))


@query
def conditional_null(spark, sf_dir):
    e = _marked_days(spark, sf_dir).withColumns({"label_sp": (F.col("q") % 2).cast("double"), "label_fitch": (F.col("q") % 3).cast("double")})
    return e.select("user_id", "q", F.when(F.col("ours"), F.col("label_sp")).alias("label_sp"), F.when(F.col("theirs"), F.col("label_fitch")).alias("label_fitch"))


@query
def recode_case_clip(spark, sf_dir):
    o = _orders(spark, sf_dir)
    rank = lookup({"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2}, "o_orderpriority")
    route = F.when(F.col("o_orderstatus") == "F", "both").when(F.col("o_totalprice") > 150000, "a").otherwise("b")
    low, high = F.lit("1993-01-01").cast("date"), F.lit("1996-12-31").cast("date")
    return o.select("o_orderkey", rank.alias("prio_rank"), route.alias("route"), F.greatest(low, F.least(F.col("day"), high)).alias("clipped"), F.least(F.col("day"), F.date_add(low, (F.col("o_orderkey") % 2000).cast("int"))).alias("earlier"))


@query
def quarter_months(spark, sf_dir):
    o = _orders(spark, sf_dir).filter(F.month("day").isin(3, 6, 9, 12))
    return o.select("o_orderkey", "day", month_end("day").alias("m_end"), quarter_end("day").alias("q_end"), quarter_index("day").alias("q"))


@query
def neighbour_flags(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("q")
    side = lambda f: F.coalesce(f("ours").over(w), F.lit(False))
    return _marked_days(spark, sf_dir).select("user_id", "q", (side(F.lag) | side(F.lead)).alias("beside"))


@query
def yearly_change_share(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("day", "o_orderkey")
    o = _orders(spark, sf_dir).withColumn("prev", F.lag("o_orderpriority").over(w))
    return o.filter(F.col("prev").isNotNull()).groupBy(F.year("day").cast("bigint").alias("year")).agg(F.avg((F.col("prev") != F.col("o_orderpriority")).cast("double")).alias("changed"), F.count(F.lit(1)).alias("n"))


@query
def name_keys(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", _company("c_custkey").alias("name"))
    return linkage.with_name_keys(c, "name").select("c_custkey", "name_norm", "name_core")


def _company(key: str) -> Column:
    """A made-up company name, written in one of several ways."""
    stems = F.array(*[F.lit(x) for x in ("Acme", "Zinc Works", "Blue-River", "Delta & Sons", "north star", "O'Hara")])
    ends = F.array(*[F.lit(x) for x in (" Holdings, Inc.", " Incorporated", " Corp", "", " Trust Company", " Group Ltd")])
    k = F.col(key)
    return F.concat(F.get(stems, (k % 6).cast("int")), F.lit(" "), F.floor(k / 12).cast("string"), F.get(ends, (k % 7).cast("int")))


def _pairs(k: Column, n: int) -> Column:
    """A number that ``k`` shares with one other, ``n`` away, at any size of the table."""
    return (F.floor(k / (2 * n)) * n + k % n).cast("string")


def _name(key: str) -> Column:
    """The made-up name; where there is none, one that a few companies of the dozen share."""
    return F.coalesce(_company(key), F.concat(F.lit("Acme "), F.floor(F.col(key) / 12).cast("string")))


def _people(spark, sf_dir):
    k = F.col("c_custkey")
    return _t(spark, sf_dir, "customer").select(k.alias("id"), _name("c_custkey").alias("name"), F.when(k % 5 == 0, F.concat(F.lit(" t"), _pairs(k, 300))).alias("ticker"))


def _firms(spark, sf_dir):
    """All customers once more; those with debts are written with a slip, so that names differ."""
    k = F.col("c_custkey")
    name = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("Nu "), _name("c_custkey"))).when(F.col("c_acctbal") < 3000, F.regexp_replace(_name("c_custkey"), "([0-9]+)", "$1x")).otherwise(_name("c_custkey"))
    return _t(spark, sf_dir, "customer").select(_pairs(k, 400).cast("bigint").alias("gvkey"), name.alias("name"), F.when(k % 4 == 0, F.concat(F.lit("T"), _pairs(k, 300))).alias("ticker"))


@query
def layered_link(spark, sf_dir):
    return linkage.link_borrowers(_people(spark, sf_dir), _firms(spark, sf_dir))


@query
def fuzzy_link(spark, sf_dir):
    return linkage.link_borrowers(_people(spark, sf_dir), _firms(spark, sf_dir), fuzzy=True)


@query
def link_counts(spark, sf_dir):
    return linkage.link_summary(linkage.link_borrowers(_people(spark, sf_dir), _firms(spark, sf_dir)))


def _wide_loans(spark, sf_dir):
    """Every supplier as a row of the wide loan table; about half of its ids are customers too."""
    k = F.col("s_suppkey")
    return _t(spark, sf_dir, "supplier").select(F.when(k % 2 == 0, k).otherwise(-k).alias("id"), F.col("s_name").alias("name"), F.when(k % 3 == 0, F.concat(F.lit("W"), k.cast("string"))).alias("ticker"))


@query
def borrower_universe(spark, sf_dir):
    return linkage.borrower_universe(_people(spark, sf_dir), _wide_loans(spark, sf_dir))


@query
def firm_identities(spark, sf_dir):
    names = _orders(spark, sf_dir).select(F.col("o_custkey").alias("gvkey"), F.when(F.col("o_orderstatus") != "P", _company("o_custkey")).alias("name"))
    return linkage.firm_identities(names)


@query
def ticker_map(spark, sf_dir):
    k = F.col("l_suppkey")
    names = _t(spark, sf_dir, "lineitem").select(k.alias("permno"), F.when(k % 7 != 0, F.concat(F.lit(" x"), (k % 40).cast("string"), F.lit(" "))).alias("ticker"), F.concat(F.lit("Line "), F.col("l_returnflag")).alias("name"))
    links = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("permno"), F.when(F.col("s_acctbal") > 0, F.col("s_nationkey")).alias("gvkey"))
    return linkage.ticker_firms(names, links)


@query
def link_totals(spark, sf_dir):
    firm = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey"))
    links = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("id"), firm.alias("gvkey"), F.col("o_orderpriority").alias("match_type"), F.col("o_orderstatus").alias("source"))
    return linkage.link_totals(links)


@query
def security_keys(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" "), F.substring("p_type", 1, 5), F.lit("-"), F.col("p_partkey").cast("string")).alias("cusip"))
    return p.select("p_partkey", security_key("cusip", 8).alias("cusip8"), security_key("cusip", 6).alias("cusip6"))


@query
def link_priority(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 30).alias("firm"), "s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "P").otherwise("C").alias("prim"), F.when(F.col("s_suppkey") % 2 == 0, "LC").otherwise("LU").alias("kind"))
    ranked = s.withColumns({"a": lookup({"P": 0, "C": 1}, "prim"), "b": lookup({"LC": 0, "LU": 1}, "kind")})
    return select.first_by(ranked, ["firm"], "a", "b", "s_suppkey").select("firm", "s_suppkey", "prim", "kind")


@query
def extraction_status(spark, sf_dir):
    parts = _orders(spark, sf_dir).groupBy("o_orderstatus", F.year("day").alias("y")).agg((F.max("o_totalprice") > F.when(F.col("o_orderstatus") == "P", 1e9).otherwise(270000)).alias("ok"))
    return profiles.extraction_status(parts, "o_orderstatus")


@query
def requested_vs_archived(spark, sf_dir):
    asked = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    got = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return asked.join(got, "id", "left_anti").agg(F.count(F.lit(1)).alias("missing")).withColumns({"repeated": got.filter("n > 1").agg(F.count(F.lit(1))).scalar(), "universe": got.agg(F.count(F.lit(1))).scalar()})


@query
def master_panel(spark, sf_dir):
    base = _orders(spark, sf_dir).groupBy("o_custkey", quarter_index("day").alias("q")).agg(_total("o_totalprice", "total"))
    lines = _t(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").join(_orders(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
    back = lines.groupBy("o_custkey", quarter_index("day").alias("q")).agg(_total("l_extendedprice", "returned"))
    return base.join(back, ["o_custkey", "q"], "left").withColumns({"returned_missing": F.col("returned").isNull(), "is_train": F.col("q") <= 1996 * 4 + 3})


def _signals(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("user_id", F.col("d").alias("q")).agg(F.max(F.floor("value")).cast("double").alias("top"), F.count(F.lit(1)).cast("double").alias("n"))


@query
def winsorize_train(spark, sf_dir):
    return modelling.winsorize(_signals(spark, sf_dir), ["top", "n"], "q < 20").select("user_id", "q", F.round("top", 9).alias("top"), F.round("n", 9).alias("n"))


@query
def zscore_flag(spark, sf_dir):
    z = modelling.z_scores(_signals(spark, sf_dir), ["top", "n"], "q < 20")
    return z.select("user_id", "q", F.round("z_top", 6).alias("z_top"), F.round("z_n", 6).alias("z_n"), (F.col("z_n") > 2).alias("high"))


@query
def pool_signal(spark, sf_dir):
    s = _signals(spark, sf_dir)
    line = s.filter("q < 20").agg(F.percentile("top", F.lit(0.75))).scalar()
    return s.groupBy("q").agg((F.sum(F.col("top").cast("bigint")) / F.count(F.lit(1))).alias("mean_top"), F.count_if(F.col("top") > line).alias("n_high"))


@query
def top_contributors(spark, sf_dir):
    s = _signals(spark, sf_dir)
    w = Window.partitionBy("q").orderBy(F.desc("top"), "user_id")
    return s.withColumn("r", F.row_number().over(w)).filter("r <= 5").groupBy("q").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "user_id"))), lambda x: x["user_id"].cast("string")), ",").alias("top5"))


@query
def lead_time(spark, sf_dir):
    ev = _events(spark, sf_dir).filter("event_type = 'error' AND value > 70").select("user_id", F.col("d").alias("event_at")).distinct()
    return modelling.lead_time(_signals(spark, sf_dir), ev, "user_id", "q", "top", 60.0, 8).select("user_id", "event_at", "lead")


@query
def lead_summary(spark, sf_dir):
    ev = _events(spark, sf_dir).filter("event_type = 'error' AND value > 70").select("user_id", F.col("d").alias("event_at")).distinct()
    leads = modelling.lead_time(_signals(spark, sf_dir), ev, "user_id", "q", "top", 60.0, 8)
    return modelling.lead_summary(leads.withColumn("lead", F.col("lead") - 3), "lead")


@query
def auc_brier(spark, sf_dir):
    o = _orders(spark, sf_dir).select(F.year("day").cast("bigint").alias("year"), (F.col("o_orderkey") % 11 / 10).alias("score"), F.when(F.col("o_totalprice") > 30000, (F.col("o_orderstatus") == "F").cast("bigint")).alias("y"))
    m = modelling.score_metrics(o, "y", "score", ["year"])
    return m.select("year", "n", "positives", *[F.round(c, 9).alias(c) for c in ("auc", "pr_auc", "brier", "log_loss")])


@query
def account_features(spark, sf_dir):
    pick = lambda cond, c: F.when(F.expr(cond), F.col(c))
    items = _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", pick("l_quantity > 5", "l_quantity").alias("dlttq"), pick("l_linestatus = 'F'", "l_tax").alias("dlcq"), (F.col("l_extendedprice") - 20000).alias("atq"),
        F.col("l_discount").alias("oibdpq"), F.col("l_tax").alias("xintq"), (F.col("l_quantity") - 25).alias("niq"), F.col("l_quantity").alias("actq"), F.col("l_linenumber").alias("lctq"),
        pick("l_returnflag = 'R'", "l_quantity").alias("cheq"), pick("l_returnflag <> 'N'", "l_shipdate").alias("rdq"),
    )
    made = ["total_debt", "leverage", "coverage", "profitability", "liquidity", "cash_ratio", "rdq_missing", "debt_component_missing", "coverage_missing"]
    return accounting.with_features(items).select("l_orderkey", "l_linenumber", *made, F.round("log_assets", 9).alias("log_assets"))


@query
def quarterly_features(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("permno"), F.col("s_nationkey").alias("gvkey"))
    li = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("permno"), month_end(F.col("l_shipdate").cast("date")).alias("month")).agg(_total("l_extendedprice", "mktcap"))
    market = _orders(spark, sf_dir).groupBy(month_end("day").alias("month")).agg(F.count(F.lit(1)).alias("n_orders"))
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("gvkey"))
    accounts = _orders(spark, sf_dir).join(c, "o_custkey").groupBy("gvkey", quarter_end("day").alias("quarter_end")).agg(_total("o_totalprice", "total"))
    accounts = accounts.select("gvkey", "quarter_end", F.when(F.col("total") > 200000, F.col("total")).otherwise(0.0).alias("atq"))
    return equity.quarterly_features(li.join(s, "permno"), market, accounts).select("gvkey", "month", "permno", "mktcap", "n_orders", "market_to_book")


@query
def single_security(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    matched = li.select(
        F.col("l_suppkey").alias("gvkey"), month_end(F.col("l_shipdate").cast("date")).alias("datadate"), lookup({"A": "P", "N": "C", "R": "J"}, "l_returnflag").alias("linkprim"),
        F.when(F.col("l_linenumber") % 3 == 0, "LC").when(F.col("l_linenumber") % 3 == 1, "LU").alias("linktype"),
        F.when(F.col("l_quantity") < 50, F.col("l_shipdate").cast("date")).alias("linkdt"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("permno"),
    )
    return equity.single_security(matched)


@query
def dataset_metrics(spark, sf_dir):
    o = _orders(spark, sf_dir).select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("day")).alias("day"))
    return profiles.dataset_metrics(o, "o_custkey", "day")


@query
def describe_columns(spark, sf_dir):
    d = profiles.describe(_t(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("quantity"), F.nullif(F.col("l_linenumber"), F.lit(7)).alias("place")), ["quantity", "place"])
    return d.select("column_name", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


@query
def tranche_panel(spark, sf_dir):
    """Loans: lines of an order; one a tranche, the newest active one a firm and quarter.

    Lines repeat numbers within an order: of those the first as they stand in the files counts.
    """
    lines = _t(spark, sf_dir, "lineitem").select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    li = lines.join(_orders(spark, sf_dir).select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    start = F.col("l_shipdate").cast("date")
    loans = li.select(F.col("l_orderkey").alias("tranche"), F.col("o_custkey").alias("gvkey"), start.alias("start"), F.date_add(start, 200).alias("maturity"), F.col("l_linenumber").alias("line"), "file", "row", F.col("l_quantity").alias("amount"))
    return accounting.active_tranches(loans, ["tranche"], ["line", "file", "row"], "start", "maturity", *GRID).select("gvkey", "q", "tranche", "start", "amount")


@query
def static_rate_pooling(spark, sf_dir):
    o = _orders(spark, sf_dir).select("o_orderpriority", F.year("day").cast("bigint").alias("year"), F.when(F.col("o_totalprice") > 50000, (F.col("o_orderstatus") == "F").cast("bigint")).alias("y"))
    return modelling.pooled_rate(o, "y", ["o_orderpriority", "year"], ["o_orderpriority"], 30)


@query
def walk_forward(spark, sf_dir):
    s = _signals(spark, sf_dir)
    parts = []
    for k, (train, test) in enumerate(modelling.folds(20, 24)):
        parts.append(s.agg(F.count_if(F.expr(train)).alias("n_train"), F.count_if(F.expr(test)).alias("n_test")).withColumn("fold", F.lit(k)))
    return tables.concat(parts)


@query
def stratified_pick(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    w = Window.partitionBy("c_mktsegment").orderBy((F.col("c_custkey") * 7919) % 10007, "c_custkey")
    return c.withColumn("r", F.row_number().over(w)).filter("r <= 4").select("c_mktsegment", "c_custkey")


@query
def hash_sample(spark, sf_dir):
    return select.hash_sample(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 40, "o_orderkey")


@query
def merton_distance(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("equity"), (0.2 + F.col("c_custkey") % 10 / 20).alias("equity_vol"), F.lit(3000.0).alias("debt"), F.lit(0.03).alias("rate"))
    return merton.merton(c)
