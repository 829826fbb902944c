import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.functions.scalars import lookup
from ledgerline.operators import labels, ratings

D = dt.date
Q0 = 2000 * 4


def clean(spark, rows):
    df = spark.createDataFrame([(1, a, d, r) for a, d, r in rows], "issue_id long, rating_type string, rating_date date, rating string")
    return [(x.rating_date, x.ord, x.is_terminator) for x in ratings.clean_ratings(df).orderBy("rating_type", "rating_date").collect()]


@pytest.mark.parametrize("agency, code, want", [("SPR", "AAA", 1), ("SPR", "BBB-", 10), ("FR", "RD", 22), ("MR", "Baa3", 10), ("MR", "Ca", 20), ("MR", "BBB", None), ("SPR", "Baa3", None)])
def test_scales(spark, agency, code, want):
    scale = ratings.MOODY_SCALE if agency == "MR" else ratings.SP_FITCH_SCALE
    assert spark.range(1).select(lookup(scale, F.lit(code))).first()[0] == want


def test_scales_agree_where_agencies_do():
    assert set(ratings.MOODY_SCALE.values()) == set(ratings.SP_FITCH_SCALE.values()) == set(range(1, 23))


def test_affirmations_go_and_changes_stay(spark):
    got = clean(spark, [("SPR", D(2000, 1, 1), "A"), ("SPR", D(2000, 2, 1), "A"), ("SPR", D(2000, 3, 1), "BBB"), ("SPR", D(2000, 4, 1), "A")])
    assert [o for _, o, _ in got] == [6, 9, 6]


def test_worst_of_a_day_wins_but_an_end_beats_it(spark):
    assert clean(spark, [("SPR", D(2000, 1, 1), "A"), ("SPR", D(2000, 1, 1), "BB")]) == [(D(2000, 1, 1), 12.0, False)]
    assert clean(spark, [("SPR", D(2000, 1, 1), "D"), ("SPR", D(2000, 1, 1), "NR")]) == [(D(2000, 1, 1), None, True)]


def test_rating_after_a_withdrawal_stays(spark):
    got = clean(spark, [("MR", D(2000, 1, 1), "A2"), ("MR", D(2000, 2, 1), "NR"), ("MR", D(2000, 3, 1), "A2")])
    assert [(o, t) for _, o, t in got] == [(6.0, False), (None, True), (6.0, False)]


def test_short_term_and_unknown_codes_go(spark):
    assert clean(spark, [("MR", D(2000, 1, 1), "P-1"), ("MR", D(2000, 2, 1), "??"), ("MR", D(2000, 3, 1), " A2 ")]) == [(D(2000, 3, 1), 6.0, False)]


def quarters(spark, offering, maturity, rated, defaults=()):
    r = spark.createDataFrame([(1, "SPR", d, o, o is None) for d, o in rated], "issue_id long, rating_type string, rating_date date, ord double, is_terminator boolean")
    m = spark.createDataFrame([(1, offering, maturity)], "issue_id long, offering_date date, maturity date")
    x = spark.createDataFrame([(1, d) for d in defaults], "issue_id long, default_date date")
    return {q.q - Q0: q.ord for q in ratings.issue_quarters(r, m, x, Q0, Q0 + 99).collect()}


def test_life_ends_with_the_maturity_quarter(spark):
    assert quarters(spark, D(2000, 2, 1), D(2000, 8, 15), [(D(2000, 1, 5), 6.0)]) == {0: 6.0, 1: 6.0, 2: 6.0}


def test_life_ends_with_the_first_default_quarter(spark):
    assert set(quarters(spark, D(2000, 1, 1), None, [(D(2000, 1, 5), 6.0)], [D(2000, 5, 1), D(2001, 5, 1)])) == {0, 1}


def test_life_starts_with_the_grid(spark):
    assert min(quarters(spark, D(1990, 1, 1), D(2000, 5, 1), [(D(1995, 1, 5), 6.0)])) == 0


def test_withdrawal_ends_a_spell_until_rated_again(spark):
    got = quarters(spark, D(2000, 1, 1), D(2001, 12, 31), [(D(2000, 1, 5), 6.0), (D(2000, 5, 1), None), (D(2001, 2, 1), 9.0)])
    assert got == {0: 6.0, 4: 9.0, 5: 9.0, 6: 9.0, 7: 9.0}


def test_no_rating_no_row_and_open_maturity(spark):
    assert quarters(spark, D(2000, 1, 1), D(2000, 12, 31), [(D(2000, 8, 5), 6.0)]) == {2: 6.0, 3: 6.0}
    assert len(quarters(spark, D(2000, 1, 1), None, [(D(2000, 1, 5), 6.0)])) == 100


def enriched(spark, rows):
    """rows: (issue, level, amount, q, ord)."""
    iq = spark.createDataFrame([("SPR", i, Q0 + q, D(2000, 3, 31) + dt.timedelta(days=91 * q), float(o)) for i, _, _, q, o in rows], "rating_type string, issue_id long, q long, quarter_end date, ord double")
    m = spark.createDataFrame(sorted({(i, l, float(a), "f") for i, l, a, _, _ in rows}), "issue_id long, security_level string, offering_amt double, gvkey string")
    return ratings.enrich(iq, m, m)


def test_reference_is_senior_then_largest(spark):
    d = enriched(spark, [(1, "SEN", 10, 0, 6), (2, "SEN", 50, 0, 7), (3, "SS", 90, 0, 5), (4, "SUB", 99, 0, 12)])
    r = ratings.reference_ratings(d).first()
    assert (r.ref_issue_id, r.rating_ord, r.rating_source, r.rating_worst, r.n_active_issues) == (2, 7.0, "senior_unsecured", 12.0, 4)


def test_secured_beats_subordinated_and_unclassified_is_never_used(spark):
    r = ratings.reference_ratings(enriched(spark, [(1, "SUB", 10, 0, 9), (2, "SS", 5, 0, 8), (3, "NON", 99, 0, 1)])).first()
    assert (r.ref_issue_id, r.n_active_issues) == (2, 2)


def test_ties_of_size_go_to_the_lower_id(spark):
    assert ratings.reference_ratings(enriched(spark, [(9, "SEN", 5, 0, 9), (2, "SEN", 5, 0, 8)])).first().ref_issue_id == 2


def cuts(spark, rows):
    d = enriched(spark, rows)
    return {x.q - Q0: (x.cut_primary, x.cut_strict, x.cut_anybond) for x in ratings.cut_events(d, ratings.reference_ratings(d)).collect()}


def test_cut_of_the_reference_issue(spark):
    assert cuts(spark, [(1, "SEN", 5, 0, 6), (1, "SEN", 5, 1, 7)]) == {1: (True, True, True)}


def test_upgrade_and_no_change_are_no_cuts(spark):
    assert cuts(spark, [(1, "SEN", 5, 0, 6), (1, "SEN", 5, 1, 5), (1, "SEN", 5, 2, 5)]) == {1: (False,) * 3, 2: (False,) * 3}


def test_cut_of_one_small_senior_issue_is_not_strict(spark):
    got = cuts(spark, [(1, "SEN", 9, 0, 6), (1, "SEN", 9, 1, 6), (2, "SEN", 5, 0, 6), (2, "SEN", 5, 1, 7)])
    assert got == {1: (True, False, True)}


def test_cut_of_most_issues_is_strict(spark):
    got = cuts(spark, [(i, "SEN", 9 - i, q, 6 + (q == 1 and i > 0)) for i in range(3) for q in (0, 1)])
    assert got == {1: (True, True, True)}


def test_cut_of_a_lower_tier_counts_for_any_bond_only(spark):
    got = cuts(spark, [(1, "SEN", 9, 0, 6), (1, "SEN", 9, 1, 6), (2, "SUB", 5, 0, 9), (2, "SUB", 5, 1, 10)])
    assert got == {1: (False, False, True)}


def test_a_gap_hides_a_cut_and_new_issues_are_no_cuts(spark):
    assert cuts(spark, [(1, "SEN", 9, 0, 6), (1, "SEN", 9, 2, 9), (2, "SEN", 9, 1, 20)]) == {}


def refs(spark, rows):
    """rows: (agency, ord, source)."""
    data = [("f", D(2000, 3, 31), a, float(o), s, Q0, float(o), 1) for a, o, s in rows]
    return spark.createDataFrame(data, "gvkey string, quarter_end date, rating_type string, rating_ord double, rating_source string, q long, rating_worst double, n_active_issues long")


@pytest.mark.parametrize("rows, ord_, spread", [
    ([("SPR", 6, "senior_unsecured"), ("MR", 9, "senior_unsecured"), ("FR", 7, "senior_unsecured")], 7.0, 3.0),
    ([("SPR", 6, "senior_unsecured"), ("MR", 9, "senior_unsecured")], 9.0, 3.0),
    ([("SPR", 6, "secured"), ("MR", 9, "senior_unsecured")], 9.0, 0.0),
])
def test_combination_of_agencies(spark, rows, ord_, spread):
    x = ratings.combine_agencies(refs(spark, rows)).first()
    assert (x.rating_ord, x.rating_dispersion, x.n_agencies, x.has_sp, x.has_fitch) == (ord_, spread, len(rows), True, len(rows) == 3)


def label(spark, have, events, last=Q0 + 99, spells=()):
    rows = spark.createDataFrame([("f", Q0 + q) for q in have], "gvkey string, q long")
    ev = spark.createDataFrame([("f", Q0 + q) for q in events], "gvkey string, q long")
    ep = spark.createDataFrame([("f", Q0 + a, None if b is None else Q0 + b) for a, b in spells], "gvkey string, default_q long, emerge_q long")
    out = labels.label_panel(rows, labels.wide_events({"d": ev}), ["d"], ep, last)
    return {x.q - Q0: (x.d, x.d_1q, x.d_4q, x.d_8q, x.observable) for x in out.collect()}


def test_flag_needs_the_quarter_before_or_an_event(spark):
    got = label(spark, [0, 1, 3, 5], [5])
    assert [got[q][0] for q in (0, 1, 3, 5)] == [None, 0.0, None, 1.0]


def test_horizons_exclude_the_quarter_itself(spark):
    got = label(spark, [0, 1, 2], [2])
    assert got[1][1:4] == (1.0, 1.0, 1.0) and got[2][1:4] == (0.0, 0.0, 0.0) and got[0][1:4] == (0.0, 1.0, 1.0)


def test_horizon_past_the_end_is_unknown_even_after_an_event(spark):
    got = label(spark, [97], [98])
    assert got[97][1:4] == (1.0, None, None)


def test_gaps_do_not_stretch_a_horizon(spark):
    assert label(spark, [0, 9], [9])[0][1:4] == (0.0, 0.0, 0.0)


def test_mask_drops_rows_and_events_but_not_its_ends(spark):
    got = label(spark, range(8), [2, 4, 6], spells=[(2, 6)])
    assert set(got) == {0, 1, 2, 6, 7}
    assert got[2][1] == 0.0 and got[2][2] == 1.0 and got[6][0] == 1.0 and got[6][4]


def test_open_spell_drops_all_that_follows_and_empty_spells_nothing(spark):
    assert set(label(spark, range(5), [], spells=[(1, None)])) == {0, 1}
    assert set(label(spark, range(5), [])) == set(range(5))


def test_countdown(spark):
    rows = labels.with_observable(spark.createDataFrame([("f", 1), ("f", 2)], "gvkey string, q long"))
    ev = labels.wide_events({"d": spark.createDataFrame([("f", 7)], "gvkey string, q long")})
    assert sorted(x.quarters_to_next_d for x in labels.forward_labels(rows, ev, ["d"], 99, countdown=True).collect()) == [5, 6]


def brute(defaults, fresh):
    out, dates, i = [], sorted({d for d, _ in defaults}), 0
    while i < len(dates):
        start = dates[i]
        ends = [r for d, r in defaults if r and d >= start and r > start] + [f for o, f in fresh if o > start and f > start]
        out.append((start, min(ends, default=None)))
        later = [k for k, d in enumerate(dates) if ends and d > min(ends)]
        if not later:
            break
        i = later[0]
    return out


days = st.integers(0, 40)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(days, st.one_of(st.none(), days)), min_size=1, max_size=6), st.lists(st.tuples(days, days), max_size=4))
def test_episodes_equal_the_sequential_rule(spark, defaults, fresh):
    day = lambda n: None if n is None else D(2000, 1, 1) + dt.timedelta(days=30 * n)
    d = spark.createDataFrame([("f", day(a), day(b)) for a, b in defaults], "gvkey string, default_date date, reinstated_date date")
    f = spark.createDataFrame([("f", day(a), day(b)) for a, b in fresh], "gvkey string, offering_date date, first_rating date")
    got = sorted((x.default_date, x.emerge_date) for x in labels.episodes(d, f).collect())
    assert got == [(day(a), day(b)) for a, b in brute(defaults, fresh)]


def test_issue_master_and_routes(spark):
    issues = spark.createDataFrame([(1, "123456", "AB1", "CDEB", D(2000, 1, 1)), (2, "123456", "AC1", "USNT", D(2000, 1, 1)), (3, "999999", "AD1", None, D(2000, 1, 1)), (4, "555555", "AE1", "CDEB", None)], "issue_id long, issuer_cusip string, issue_cusip string, bond_type string, offering_date date")
    backed = spark.createDataFrame([(3, "LOC")], "issue_id long, enh_type string")
    assert [r.issue_id for r in ratings.issue_master(issues, backed).collect()] == [1]
    m = ratings.issue_master(issues, backed.limit(0))
    bonds = spark.createDataFrame([("123456AB1", 77, None, None), ("999999AD1", 78, None, None)], "cusip string, permno long, link_startdt date, link_enddt date")
    firms = spark.createDataFrame([("g1", 77, D(1999, 1, 1), None, "LC", "P"), ("g2", 78, D(1999, 1, 1), D(1999, 6, 1), "LC", "P")], "gvkey string, lpermno long, linkdt date, linkenddt date, linktype string, linkprim string")
    ids = spark.createDataFrame([("g1", "123456789"), ("g3", "999999000"), ("g3", "999999111")], "gvkey string, cusip string")
    got = {r.issue_id: (r.gvkey, r.link_route) for r in ratings.link_issues(m, bonds, firms, ids).collect()}
    assert got == {1: ("g1", "both"), 3: ("g3", "b")}
    clash = spark.createDataFrame([("g9", "123456789")], "gvkey string, cusip string")
    assert ratings.link_issues(m, bonds, firms, clash).count() == 0


def test_quarters_are_made_after_the_ratings_are_sorted(spark):
    clean = spark.createDataFrame([(1, "SPR", D(1992, 2, 1), 5.0, False), (1, "SPR", D(1992, 3, 1), 6.0, False), (1, "SPR", D(1992, 8, 1), None, True), (1, "SPR", D(1993, 1, 1), 7.0, False)], "issue_id long, rating_type string, rating_date date, ord double, is_terminator boolean")
    master = spark.createDataFrame([(1, D(1991, 5, 1), None)], "issue_id long, offering_date date, maturity date")
    none = spark.createDataFrame([], "issue_id long, default_date date")
    out = ratings.issue_quarters(clean, master, none, 1992 * 4, 1993 * 4 + 1)
    assert sorted((r.q - 1992 * 4, r.ord) for r in out.collect()) == [(0, 6.0), (1, 6.0), (4, 7.0), (5, 7.0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Window")
