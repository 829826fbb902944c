import datetime as dt
import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators import accounting, linkage, merton, modelling, profiles
from ledgerline.sources import sinks, tables
from ledgerline.streaming import ratings as stream

D = dt.date


def link(spark, people, firms, fuzzy=False):
    p = spark.createDataFrame(people, "id string, name string, ticker string")
    f = spark.createDataFrame(firms, "gvkey string, name string, ticker string")
    return {r.id: (r.gvkey, r.match_type) for r in linkage.link_borrowers(p, f, fuzzy).collect()}


FIRMS = [("1", "Acme Holdings Inc", "ACM"), ("2", "Zinc Works Corp", "ZNC"), ("3", "Twin Stars Ltd", None), ("4", "Twin Stars Inc", None), ("5", "Grand Meridian Foods Corp", None)]


def test_layers(spark):
    people = [("t", "whatever", " acm "), ("n", "ZINC WORKS CORPORATION", None), ("c", "Zinc Works", None), ("a", "Twin Stars", None), ("u", "Nobody", None), ("f", "Grand Meridan Foods", None), ("e", None, None)]
    want = {"t": ("1", "ticker_crsp"), "n": ("2", "exact_name"), "c": ("2", "core_name"), "a": (None, "ambiguous_needs_review"), "u": (None, "unmatched"), "f": (None, "unmatched"), "e": (None, "unmatched")}
    assert link(spark, people, FIRMS) == want
    assert link(spark, people, FIRMS, fuzzy=True)["f"] == ("5", "fuzzy_name")


def test_a_similar_name_of_two_firms_stays_unmatched(spark):
    firms = [("7", "Meridian Widgetri", None), ("8", "Meridian Widgetri", None)]
    assert link(spark, [("m", "Meridian Widgetry Inc", None)], firms, fuzzy=True) == {"m": (None, "unmatched")}


def test_universe_identities_and_ticker_map(spark):
    companies = spark.createDataFrame([(1, "B", "x"), (1, "A", "y"), (2, None, None)], "id long, name string, ticker string")
    wide = spark.createDataFrame([(2, "W", "w"), (3, "V", None), (3, "V", "v"), (None, "N", None)], "id long, name string, ticker string")
    got = {r.id: (r.name, r.ticker, r.source) for r in linkage.borrower_universe(companies, wide).collect()}
    assert got == {1: ("A", "y", "company"), 2: (None, None, "company"), 3: ("V", None, "wide")}
    names = spark.createDataFrame([("1", "Acme Inc"), ("1", "Acme Inc"), ("1", "Acme Corp"), (None, "x")], "gvkey string, name string")
    assert sorted((r.gvkey, r.name, r.name_core) for r in linkage.firm_identities(names).collect()) == [("1", "Acme Corp", "ACME"), ("1", "Acme Inc", "ACME")]
    held = spark.createDataFrame([(10, " ab ", "Acme"), (10, "ab", "Acme"), (11, None, "Zinc")], "permno long, ticker string, name string")
    links = spark.createDataFrame([(10, "1"), (11, "2"), (10, None)], "permno long, gvkey string")
    assert [tuple(r) for r in linkage.ticker_firms(held, links).collect()] == [("AB", "1", "Acme")]
    linked = linkage.link_borrowers(companies, names.filter("gvkey = '1'"), securities=linkage.ticker_firms(held, links))
    totals = {(r.kind, r.value): r.n for r in linkage.link_totals(linked.withColumn("source", F.lit("s"))).collect()}
    assert totals[("total", None)] == 2 and totals[("source", "s")] == 2 and totals[("match_type", "unmatched")] == totals[("total", None)] - totals[("linked", None)]


def test_similar_name_decides_between_firms_of_one_ticker(spark):
    firms = [("1", "Alpha Mining", "AM"), ("2", "Omega Retail", "AM")]
    assert link(spark, [("x", "Alpha Mining Inc", "AM")], firms) == {"x": ("1", "ticker_crsp_resolved")}


def test_ratio_is_not_symmetric(spark):
    df = spark.createDataFrame([("tide", "diet")], "a string, b string").select(linkage.similarity("a", "b").alias("x"), linkage.similarity("b", "a").alias("y"))
    assert tuple(df.first()) == (0.25, 0.5)


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None)], "k int, v string")
    assert tuple(profiles.duplicate_profile(df, ["k"]).first()) == (4, 1, 3)
    assert {r.column_name: r.missing_share for r in profiles.missing_profile(df, ["k", "v"]).collect()} == {"k": 0.0, "v": 0.25}
    bad = profiles.check_panel(df, ["k"], ["v"])
    assert bad == {"nulls": 1, "duplicate_keys": 1, "outside": 0}
    with pytest.raises(ValueError):
        profiles.require(bad)


def test_winsorize_uses_training_rows_only(spark):
    df = spark.createDataFrame([(float(i), True) for i in range(101)] + [(1e9, False), (None, False)], "x double, train boolean")
    out = [r.x for r in modelling.winsorize(df, ["x"], "train").filter("NOT train").collect()]
    assert out == [99.0, None]


def test_merton_solves_its_equations(spark):
    import math

    df = spark.createDataFrame([(50.0, 0.4, 40.0, 0.03), (None, 0.4, 40.0, 0.03)], "equity double, equity_vol double, debt double, rate double")
    good, bad = sorted(merton.merton(df).collect(), key=lambda r: r.equity is None)
    n = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
    d1 = (math.log(good.asset_value / 40) + 0.03 + good.asset_vol**2 / 2) / good.asset_vol
    assert abs(good.asset_value * n(d1) - 40 * math.exp(-0.03) * n(d1 - good.asset_vol) - 50) < 1e-5
    assert bad.asset_value is None or math.isnan(bad.asset_value)


def test_scan_checks_and_prunes(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, D(1999, 12, 31)), (2, D(2000, 1, 1)), (3, D(2001, 12, 31)), (4, None)], "k int, d date").write.parquet(path)
    data = tables.Dataset("t", path, required=("k", "d"), optional=("z",), date="d")
    assert sorted(r.k for r in tables.scan(spark, data, 2000, 2001).collect()) == [2, 3]
    assert tables.undated(tables.scan(spark, data), "d").count() == 1
    with pytest.raises(ValueError):
        tables.scan(spark, tables.Dataset("t", path, required=("nope",)))


def test_typed_and_dates(spark):
    schema = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.LongType()), T.StructField("c", T.StringType())])
    df = spark.createDataFrame([("1.5", "x"), ("NaN", "7")], "a string, b string")
    assert [tuple(r) for r in tables.typed(df, schema).collect()] == [(1.5, None, None), (None, 7, None)]
    assert tables.date_column(spark.createDataFrame([], "x int, rdq string").schema) == "rdq"
    assert tables.date_column(spark.createDataFrame([], "x int, when_seen date").schema) == "when_seen"
    assert tables.date_column(spark.createDataFrame([], "x int").schema) is None
    assert list(tables.clipped_years(1998, 2003, (2000, 2024))) == [2000, 2001, 2002, 2003]


def test_retry_and_cache(spark, tmp_path):
    calls = []

    def fetch():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return spark.range(3)

    path = str(tmp_path / "c")
    assert tables.with_retry(lambda: fetch() if len(calls) >= 2 else calls.append(1) or fetch(), wait=0).count() == 3
    calls[:] = [1, 1]
    assert tables.fetch_or_load(spark, path, fetch).count() == 3
    n = len(calls)
    assert tables.fetch_or_load(spark, path, fetch).count() == 3 and len(calls) == n


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, D(2000, 1, 1)), (2, D(2001, 1, 1))], "k int, d date")
    sinks.write_by_year(df, str(tmp_path / "y"), "d")
    back = spark.read.parquet(str(tmp_path / "y"))
    sinks.check_written(df, back, ["k", "d", "year"], "d", (2000, 2001))
    with pytest.raises(ValueError):
        sinks.check_written(df.limit(1), back, ["k"])
    m = sinks.manifest(df, ["k"], "d")
    sinks.write_manifest(spark, str(tmp_path / "m.json"), m)
    sinks.write_manifest(spark, str(tmp_path / "m.json"), m)
    assert json.loads((tmp_path / "m.json").read_text())["rows"] == 2
    assert sinks.markdown(df.orderBy("k")).splitlines()[2] == "| 1 | 2000-01-01 |"


def test_catalog_lookup(spark):
    spark.range(2).withColumn("day", F.lit(D(2000, 1, 1))).createOrReplaceTempView("known_table")
    assert tables.first_table(spark, ["absent", "known_table"], ["ID", "day"]) == "known_table"
    assert tables.first_table(spark, ["known_table"], ["other"]) is None


def test_stream_of_ratings(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    t = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, "SPR", "A", t(1)), (1, "SPR", "BB", t(2)), (1, "SPR", "NR", t(3)), (1, "MR", "P-1", t(3)), (2, "MR", "Baa3", t(30))]
    spark.createDataFrame(rows, stream.SCHEMA).write.parquet(src)
    q = stream.start(stream.worst_by_window(stream.read_stream(spark, src)), out, str(tmp_path / "cp"))
    q.awaitTermination()
    got = [(r.issue_id, r.worst, r.ended, r.n) for r in spark.read.parquet(out).collect()]
    assert (1, 12.0, True, 3) in got


def test_similar_names_of_one_block_meet_without_all_pairs(spark):
    draw = random.Random(3)
    names, firms = set(), set()
    for size in [6, 8, 11, 15, 19, 21, 26, 41] * 12:
        name = "ACME" + "".join(draw.choice("012X") for _ in range(size - 4))
        names.add(name)
        for _ in range(3):
            other = list(name)
            for _ in range(draw.randint(0, 1 + size // 12)):
                i = draw.randint(4, len(other) - 1)
                other[i:i + draw.randint(0, 1)] = draw.choice(["", "0", "X", "7Y"])
            firms.add("".join(other))
    names, firms = ({x for x in n if len(x) >= 6} for n in (names, firms))
    score = lambda x, y: (SequenceMatcher(None, y, x).ratio(), y)
    want = {x: best[1] for x in names if (best := max(score(x, y) for y in firms))[0] >= linkage.FUZZY_LEAST}
    left, right = (spark.createDataFrame([(x,) for x in sorted(n)], f"{c} string") for n, c in ((names, "name_core"), (firms, "other__")))
    assert dict(linkage.closest_names(left, right).collect()) == want and 50 < len(want)
    # Each name meets a few others, not its block, and every similar one is among them.
    near = {(x, y) for x in names for y in firms if score(x, y)[0] >= linkage.FUZZY_LEAST}
    met = {tuple(r) for r in linkage._pairs(left, right).collect()}
    assert near <= met and len(met) < len(names) * len(firms) / 4


def test_filings_that_some_step_drops_are_not_told_apart(spark):
    items = "indfmt datafmt popsrc consol sic sich gvkey datadate rdq atq".split()
    row = lambda i, **k: tuple((dict(zip(items, ("INDL", "STD", "D", "C", "2000", None, "g", "d", "r", i), strict=True)) | k).values())
    rows = [row(0), row(0), row(1)] + [row(i, indfmt="FS") for i in range(300)] + [row(i, rdq=None) for i in range(200)] + [row(i, sic="6100") for i in range(100)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'int' if c == 'atq' else 'string'}" for c in items))
    assert sorted(r.n__ for r in accounting.step_rows(df).collect()) == [1, 2, 100, 200, 300]
    m = accounting.filing_metrics(df).first()
    assert (m.raw_rows, m.after_standard_filters, m.after_sic_exclusions, m.after_required_dates) == (603, 303, 203, 3)
    assert (m.missing_rdq_rows, m.exact_duplicate_rows, m.duplicate_gvkey_datadate_keys, m.duplicate_observations_dropped, m.sic_rows_from_sic) == (200, 1, 1, 2, 303)


def test_keys_that_fill_their_frames_leave_no_empty_one(spark):
    names = spark.createDataFrame([("many",), ("none",)], "name string").coalesce(1)
    many = lambda x: {str(i) for i in range(100_000 if x == "many" else 0)}
    assert [tuple(r) for r in linkage._keyed(names, "name", many).groupBy("name").count().collect()] == [("many", 100_000)]
    assert linkage._keyed(names.filter("name = 'none'"), "name", many).count() == 0


def test_names_are_scored_after_they_met_and_keys_are_not_broadcast(spark):
    left, right = spark.createDataFrame([("ACME12",)], "name_core string"), spark.createDataFrame([("ACME13",)], "other__ string")
    less = linkage._keyed(left, "name_core", linkage._shorter).join(right, F.col("key__") == F.col("other__")).select("name_core", "other__")
    plan = linkage._best(less)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_ratio(") == 1 and "strategy=merge" in plan
