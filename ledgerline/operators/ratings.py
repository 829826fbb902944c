"""Bond ratings: cleaning, quarters in force, reference issues, cuts, agencies combined.

The agency is a key column throughout, so all agencies are worked on in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import expand_span, open_end, quarter_end_of, quarter_index
from ..functions.scalars import in_set, lookup
from .select import first_by, last_by, middle_by
from .temporal import gap_lag, valid_join

# Agencies, notations, and codes with a role of their own.
AGENCY_NAMES = {"SPR": "sp", "MR": "moodys", "FR": "fitch"}
SP_FITCH_SCALE = {
    "AAA": 1, "AA+": 2, "AA": 3, "AA-": 4, "A+": 5, "A": 6, "A-": 7,
    "BBB+": 8, "BBB": 9, "BBB-": 10, "BB+": 11, "BB": 12, "BB-": 13,
    "B+": 14, "B": 15, "B-": 16, "CCC+": 17, "CCC": 18, "CCC-": 19,
    "CC": 20, "C": 21, "D": 22, "DD": 22, "DDD": 22, "RD": 22, "SD": 22,
}
MOODY_SCALE = {
    "Aaa": 1, "Aa1": 2, "Aa2": 3, "Aa3": 4, "A1": 5, "A2": 6, "A3": 7,
    "Baa1": 8, "Baa2": 9, "Baa3": 10, "Ba1": 11, "Ba2": 12, "Ba3": 13,
    "B1": 14, "B2": 15, "B3": 16, "Caa1": 17, "Caa2": 18, "Caa3": 19,
    "Ca": 20, "C": 21, "D": 22,
}
TERMINATOR_CODES = ("NR", "NR/NR", "SUSP", "NAV", "PIF")
EXCLUDED_CODES = ("P-1", "P-2", "P-3")
EXCLUDED_BOND_TYPES = ("FGOV", "PSTK", "PS", "TPCS", "ADEB", "AMTN", "ARNT", "USNT")
EXTERNAL_BACKING_TYPES = ("INS", "LOC")
SOURCE_OF_LEVEL = {
    "SEN": "senior_unsecured", "SS": "secured",
    "SENS": "subordinated", "SUB": "subordinated", "JUNS": "subordinated", "JUN": "subordinated",
}
TIER_RANK = {"senior_unsecured": 0, "secured": 1, "subordinated": 2}
LEVEL_RANK = {"SEN": 0, "SS": 0, "SENS": 0, "SUB": 1, "JUNS": 2, "JUN": 3}


def issue_master(issues: DataFrame, enhancements: DataFrame) -> DataFrame:
    """Issues with an offering date, of rated kinds, not backed by a third party."""
    backed = enhancements.filter(in_set("enh_type", EXTERNAL_BACKING_TYPES)).select("issue_id")
    rated = issues.filter(~in_set("bond_type", EXCLUDED_BOND_TYPES)).dropna(subset=["offering_date"])
    cusip = F.concat(F.upper(F.trim("issuer_cusip")), F.upper(F.trim("issue_cusip")))
    return rated.join(backed, "issue_id", "left_anti").withColumns({"cusip8": F.substring(cusip, 1, 8), "cusip6": F.substring(cusip, 1, 6)})


def link_issues(master: DataFrame, bond_links: DataFrame, firm_links: DataFrame, firm_ids: DataFrame, respect_bond_window: bool = False) -> DataFrame:
    """(issue_id, gvkey, link_route): by security and its firm link, or by a cusip6 that one
    firm alone has; issues for which the routes disagree are left out."""
    bonds = bond_links.withColumn("cusip8", F.substring(F.upper(F.trim("cusip")), 1, 8))
    hop = master.join(bonds.drop("cusip"), "cusip8")
    if respect_bond_window:
        hop = hop.filter((F.col("offering_date") >= F.col("link_startdt")) & (F.col("offering_date") <= open_end("link_enddt")))
    usable = firm_links.filter(in_set("linktype", ("LC", "LU")) & in_set("linkprim", ("P", "C")))
    valid = valid_join(hop, usable.withColumnRenamed("lpermno", "permno"), ["permno"], "offering_date", "linkdt", "linkenddt")
    a = first_by(valid, ["issue_id"], "-linkdt", "gvkey").select("issue_id", F.col("gvkey").alias("gvkey_a"))
    keys = firm_ids.select("gvkey", F.substring(F.upper(F.trim("cusip")), 1, 6).alias("cusip6")).dropna()
    sole = keys.groupBy("cusip6").agg(F.count_distinct("gvkey").alias("n"), F.min("gvkey").alias("gvkey_b")).filter("n = 1")
    b = master.join(sole, "cusip6").select("issue_id", "gvkey_b")
    return route_union(a, b, "issue_id", "gvkey")


def route_union(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Union of two routes (key, value_a) and (key, value_b) with where each came from; conflicts go."""
    left, right = F.col(f"{value}_a"), F.col(f"{value}_b")
    both = a.join(b, key, "full").filter(left.isNull() | right.isNull() | (left == right))
    route = F.when(left.isNotNull() & right.isNotNull(), "both").when(left.isNotNull(), "a").otherwise("b")
    return both.select(key, F.coalesce(left, right).alias(value), route.alias("link_route"))


def clean_ratings(ratings: DataFrame) -> DataFrame:
    """Ratings on one ordinal scale, one a day, without affirmations.

    A withdrawal ends a spell and beats any grade of its day, as unknown ordinals sort last.
    """
    code = F.trim("rating")
    ordinal = F.when(F.col("rating_type") == "MR", lookup(MOODY_SCALE, code)).otherwise(lookup(SP_FITCH_SCALE, code)).cast("double")
    graded = ratings.filter(~in_set(code, EXCLUDED_CODES)).withColumns({"ord": ordinal, "is_terminator": in_set(code, TERMINATOR_CODES)})
    daily = last_by(graded.filter(F.col("ord").isNotNull() | F.col("is_terminator")), ["issue_id", "rating_type", "rating_date"], "ord")
    return drop_repeats(daily, ["issue_id", "rating_type"], "rating_date", "ord", "is_terminator")


def drop_repeats(df: DataFrame, by: list[str], at: str, value: str, terminator: str) -> DataFrame:
    """Rows that change the state: ends of spells, first values, other values, and what follows an end."""
    w = Window.partitionBy(*by).orderBy(at)
    marked = df.withColumns({"prev__": F.lag(value).over(w), "ended__": F.coalesce(F.lag(terminator).over(w), F.lit(False))})
    changed = F.col(terminator) | F.col("prev__").isNull() | ~F.col("prev__").eqNullSafe(F.col(value)) | F.col("ended__")
    return marked.filter(changed).drop("prev__", "ended__")


def issue_quarters(ratings: DataFrame, master: DataFrame, defaults: DataFrame, first: int, last: int) -> DataFrame:
    """(rating_type, issue_id, q, quarter_end, ord): the rating in force at each quarter end of an issue's life.

    An issue lives from its offering quarter to that of its maturity or first default, both
    included. Quarters without a rating, or whose last record ends the spell, have no row.
    """
    first_default = defaults.groupBy("issue_id").agg(F.min("default_date").alias("default_date"))
    ends = F.least(open_end("maturity"), open_end("default_date"))
    lives = master.join(first_default, "issue_id", "left").select("issue_id", quarter_index("offering_date").alias("start_q"), quarter_index(ends).alias("end_q")).dropna()
    # A record holds from its own quarter to the one before the next record's, so quarters are made only after the sort.
    after = F.lead("rating_date").over(Window.partitionBy("rating_type", "issue_id").orderBy("rating_date"))
    held = ratings.filter(F.col("rating_date").isNotNull()).select(
        "rating_type", "issue_id", "ord", "is_terminator", quarter_index("rating_date").alias("from__"), F.coalesce(quarter_index(after) - 1, F.lit(last)).alias("to__")
    ).filter(~F.coalesce("is_terminator", F.lit(True)) & (F.col("from__") <= F.col("to__")))
    spans = held.join(lives, "issue_id").withColumns({"from__": F.greatest("from__", "start_q"), "to__": F.least("to__", "end_q")})
    return expand_span(spans, "from__", "to__", "q", first, last).select("rating_type", "issue_id", "q", quarter_end_of("q").alias("quarter_end"), "ord")


def enrich(quarters: DataFrame, master: DataFrame, links: DataFrame) -> DataFrame:
    """Seniority, firm, and the issue's own rating one quarter earlier."""
    # Quarters are many to each byte that was shuffled: a fixed number of partitions, which isn't coalesced by size.
    tasks = int(quarters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = quarters.repartition(tasks, "issue_id").withColumn("prev_ord", gap_lag("ord", ["rating_type", "issue_id"], "q"))
    rows = own.join(master.select("issue_id", "security_level", "offering_amt"), "issue_id").join(links.select("issue_id", "gvkey"), "issue_id")
    return rows.withColumn("rating_source", lookup(SOURCE_OF_LEVEL, "security_level")).filter(F.col("rating_source").isNotNull())


def reference_ratings(d: DataFrame) -> DataFrame:
    """One issue a firm, quarter and agency: most senior tier, level, largest offering; with the worst rating and the count of all."""
    by = ["rating_type", "gvkey", "quarter_end"]
    ranked = d.withColumns({
        "tier__": lookup(TIER_RANK, "rating_source"), "level__": lookup(LEVEL_RANK, "security_level"),
        "rating_worst": F.max("ord").over(Window.partitionBy(*by)), "n_active_issues": F.count(F.lit(1)).over(Window.partitionBy(*by)),
    })
    pick = first_by(ranked, by, "tier__", "level__", "-offering_amt", "issue_id")
    return pick.select(*by, "q", F.col("ord").alias("rating_ord"), "rating_source", F.col("issue_id").alias("ref_issue_id"), "rating_worst", "n_active_issues")


def cut_events(d: DataFrame, ref: DataFrame) -> DataFrame:
    """Per firm, quarter and agency: whether an issue of last quarter's tier was cut, its reference issue or most of that tier, any issue."""
    before = ref.select("rating_type", "gvkey", (F.col("q") + 1).alias("q"), F.col("rating_source").alias("prev_source"), F.col("ref_issue_id").alias("prev_ref"))
    b = d.filter(F.col("prev_ord").isNotNull()).join(before, ["rating_type", "gvkey", "q"])
    cut = F.col("ord") > F.col("prev_ord")
    eligible = F.col("rating_source") == F.col("prev_source")
    counted = b.groupBy("rating_type", "gvkey", "quarter_end", "q").agg(
        F.count_if(eligible).alias("n_eligible"), F.count_if(eligible & cut).alias("n_cut"),
        F.bool_or(cut & (F.col("issue_id") == F.col("prev_ref"))).alias("ref_cut"), F.bool_or(cut).alias("cut_anybond"),
    )
    return counted.select(
        "rating_type", "gvkey", "quarter_end", "q", (F.col("n_cut") > 0).alias("cut_primary"),
        (F.col("ref_cut") | majority("n_cut", "n_eligible")).alias("cut_strict"), "cut_anybond",
    )


def majority(part: str, whole: str) -> Column:
    return F.col(part) * 2 > F.col(whole)


def combine_agencies(refs: DataFrame) -> DataFrame:
    """Across agencies: the best tier that any has, the middle rating among those at it, spread, presence."""
    by = ["gvkey", "quarter_end"]
    tiered = refs.withColumn("tier", lookup(TIER_RANK, "rating_source")).withColumn("best__", F.min("tier").over(Window.partitionBy(*by)))
    at_best = tiered.filter(F.col("tier") == F.col("best__"))
    pick = middle_by(at_best, by, "rating_ord", "rating_type").select(*by, "q", "rating_ord", "rating_source")
    best = F.col("tier") == F.col("best__")
    extra = tiered.groupBy(*by).agg(
        (F.max(F.when(best, F.col("rating_ord"))) - F.min(F.when(best, F.col("rating_ord")))).alias("rating_dispersion"),
        F.max("rating_worst").alias("rating_worst"), F.max("n_active_issues").alias("n_active_issues"),
        F.count_distinct("rating_type").alias("n_agencies"),
        *[F.bool_or(F.col("rating_type") == a).alias(f"has_{n}") for a, n in AGENCY_NAMES.items()],
    )
    return pick.join(extra, by).withColumn("senior_unsecured_source", F.col("rating_source") == "senior_unsecured")
