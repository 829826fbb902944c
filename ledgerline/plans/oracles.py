"""DuckDB SQL for the queries of :mod:`ledgerline.plans.queries`, written independently of them.

It uses what Spark's plans don't: ASOF JOIN, QUALIFY, recursive tables and set-returning
functions.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

QI = "CAST(year({0}) * 4 + quarter({0}) - 1 AS BIGINT)"
QE = "last_day(make_date(CAST({0} // 4 AS INT), CAST({0} % 4 * 3 + 3 AS INT), 1))"


def qi(x: str) -> str:
    return QI.format(x)


def qe(x: str) -> str:
    return QE.format(x)


def total(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"


ORD = "(SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders)"
EV = "(SELECT event_id, ts, user_id, event_type, value, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS d FROM events)"
LINKS = f"(SELECT o_custkey, o_orderkey AS link, day AS linkdt, CASE WHEN o_orderkey % 15 <> 0 THEN day + CAST(o_orderkey % 400 AS INT) END AS linkenddt FROM {ORD})"
MONTHLY = f"""(SELECT permno, month, revenue, n, CASE WHEN (permno + month(month)) % 17 <> 0 THEN revenue / lag(revenue) OVER (PARTITION BY permno ORDER BY month) - 1 END AS ret
  FROM (SELECT l_suppkey AS permno, last_day(CAST(l_shipdate AS DATE)) AS month, {total('l_extendedprice')} AS revenue, count(*) AS n FROM lineitem GROUP BY 1, 2))"""
DAYS = f"(SELECT DISTINCT user_id, d AS q FROM {EV})"
SPELLS = f"""(SELECT s.user_id, s.d AS default_q, min(p.d) AS emerge_q
  FROM (SELECT DISTINCT user_id, d FROM {EV} WHERE event_type = 'error' AND value > 80) s
  LEFT JOIN (SELECT user_id, d FROM {EV} WHERE event_type = 'purchase' AND value > 50) p ON p.user_id = s.user_id AND p.d > s.d GROUP BY 1, 2)"""
MARKED = f"(SELECT user_id, d AS q, bool_or(event_type = 'error') AS ours, bool_or(event_type = 'signup') AS theirs FROM {EV} GROUP BY 1, 2)"
SIGNALS = f"(SELECT user_id, d AS q, CAST(max(floor(value)) AS DOUBLE) AS top, CAST(count(*) AS DOUBLE) AS n FROM {EV} GROUP BY 1, 2)"

ORACLES["pit_align"] = f"""
WITH f AS (SELECT o_custkey AS gvkey, day AS datadate, day + CAST(o_orderkey % 91 - 10 AS INT) AS rdq, o_orderkey AS filing, o_totalprice AS atq FROM {ORD}),
g AS (SELECT q, {qe('q')} AS quarter_end FROM range(7968, 7996) t(q)),
best AS (
  SELECT f.*, g.q, g.quarter_end FROM f JOIN g ON f.rdq <= g.quarter_end AND f.datadate <= g.quarter_end
  QUALIFY row_number() OVER (PARTITION BY gvkey, q ORDER BY rdq DESC, datadate DESC, filing DESC) = 1)
SELECT gvkey, q, quarter_end, datadate, rdq, filing, CAST(date_diff('day', rdq, quarter_end) AS INT) AS age_days,
       date_diff('day', rdq, quarter_end) > 270 AS is_stale, CASE WHEN date_diff('day', rdq, quarter_end) <= 270 THEN atq END AS atq
FROM best"""

ORACLES["guarded_ratios"] = f"""
WITH p AS (SELECT l_orderkey, {total('l_extendedprice')} AS price, {total("CASE WHEN l_returnflag = 'R' THEN l_extendedprice END")} AS returned, {total('l_quantity - 25')} AS spare FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN price > 0 THEN returned / price END AS return_share, CASE WHEN spare > 0 THEN price / spare END AS price_per_spare,
       CASE WHEN spare > 0 THEN ln(spare) END AS log_spare,
       CASE WHEN returned IS NULL AND spare IS NULL THEN NULL ELSE coalesce(returned, 0) + coalesce(spare, 0) END AS known_sum,
       returned IS NULL OR spare IS NULL AS part_missing FROM p"""

ORACLES["standard_filters"] = """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND year(o_orderdate) IN (1995, 1996) AND o_totalprice > 1000"""

ORACLES["range_exclusion"] = """
SELECT p_partkey, code FROM (SELECT *, coalesce(nullif(p_size, 7), nullif(CAST(p_partkey % 50 AS INT), 3)) AS code FROM part)
WHERE (code IS NULL OR NOT (code BETWEEN 10 AND 20 OR code BETWEEN 30 AND 35)) AND (p_brand IS NULL OR p_brand NOT IN ('Brand#11', 'Brand#12'))"""

ORACLES["dedupe_last"] = f"""
SELECT user_id, d, event_id, v FROM (SELECT *, nullif(CAST(floor(value) AS BIGINT), 5) AS v FROM {EV})
QUALIFY row_number() OVER (PARTITION BY user_id, d ORDER BY v DESC NULLS FIRST, event_id DESC) = 1"""

ORACLES["dedupe_first_ranked"] = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, q FROM (SELECT *, nullif(l_quantity, 50.0) AS q FROM lineitem)
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY q DESC NULLS LAST, l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice) = 1"""

ORACLES["semi_filter"] = "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)"
ORACLES["anti_filter"] = "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 200000)"

ORACLES["valid_window_join"] = f"""
SELECT o_orderkey, link, linkdt, linkenddt FROM {ORD} o JOIN {LINKS} l ON o.o_custkey = l.o_custkey
WHERE o.day >= l.linkdt AND o.day <= coalesce(l.linkenddt, DATE '2099-12-31')"""
ORACLES["window_grace_join"] = f"""
SELECT o_orderkey, link FROM {ORD} o JOIN {LINKS} l ON o.o_custkey = l.o_custkey AND o.day BETWEEN l.linkdt AND l.linkenddt + 365"""
ORACLES["latest_valid_left"] = f"""
WITH r AS (SELECT o.o_orderkey, o.day, l.link, l.linkdt, l.linkenddt FROM {ORD} o LEFT JOIN {LINKS} l ON o.o_custkey = l.o_custkey AND l.linkdt <= o.day
  QUALIFY row_number() OVER (PARTITION BY o.o_orderkey ORDER BY l.linkdt DESC NULLS LAST, l.link DESC) = 1)
SELECT o_orderkey, CASE WHEN ok THEN link END AS link, CASE WHEN ok THEN linkdt END AS linkdt, CASE WHEN ok THEN linkenddt END AS linkenddt
FROM (SELECT *, day <= coalesce(linkenddt, DATE '2099-12-31') AS ok FROM r)"""

ORACLES["asof_backward"] = f"""
WITH b AS (SELECT user_id, event_id, ts FROM {EV} WHERE event_type = 'purchase'),
v AS (SELECT user_id, ts, event_id AS view_id, nullif(event_id % 7, 0) AS mark FROM {EV} WHERE event_type = 'view'
  QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1)
SELECT b.event_id, b.user_id, v.view_id, v.mark FROM b ASOF LEFT JOIN v ON b.user_id = v.user_id AND b.ts >= v.ts"""
ORACLES["asof_forward_strict"] = f"""
WITH b AS (SELECT user_id, event_id, d FROM {EV} WHERE event_type = 'purchase'), e AS (SELECT DISTINCT user_id, d FROM {EV} WHERE event_type = 'error')
SELECT b.event_id, b.user_id, b.d, e.d AS next_error_d FROM b ASOF LEFT JOIN e ON b.user_id = e.user_id AND b.d < e.d"""

ORACLES["route_union_conflict"] = """
WITH a AS (SELECT c_custkey, c_nationkey AS na FROM customer WHERE c_acctbal > 2500),
sole AS (SELECT c_custkey // 4 AS k, min(c_nationkey) AS nb FROM customer GROUP BY 1 HAVING count(DISTINCT c_nationkey % 4) <= 3),
b AS (SELECT c_custkey, nb FROM customer JOIN sole ON c_custkey // 4 = k WHERE c_mktsegment <> 'BUILDING')
SELECT c_custkey, coalesce(na, nb) AS nation, CASE WHEN na IS NULL THEN 'b' WHEN nb IS NULL THEN 'a' ELSE 'both' END AS link_route
FROM a FULL JOIN b USING (c_custkey) WHERE na IS NULL OR nb IS NULL OR na = nb"""

ORACLES["compound_return_12"] = f"""
SELECT permno, month, round(ret, 6) AS ret, CASE WHEN count(*) OVER w >= 9 AND count(*) OVER w = count(ret) OVER w THEN round(product(1 + ret) OVER w - 1, 6) END AS ret_12
FROM {MONTHLY} WINDOW w AS (PARTITION BY permno ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"""
ORACLES["market_trailing_quarter"] = f"""
WITH m AS (SELECT last_day(CAST(l_shipdate AS DATE)) AS month, {total('l_extendedprice')} AS revenue FROM lineitem GROUP BY 1),
r AS (SELECT month, revenue / lag(revenue) OVER (ORDER BY month) - 1 AS ret FROM m),
c AS (SELECT month, CASE WHEN count(ret) OVER w = 12 THEN product(1 + ret) OVER w - 1 END AS ret_12 FROM r WINDOW w AS (ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT {qi('month')} AS q, month, round(ret_12, 6) AS ret_12 FROM c QUALIFY row_number() OVER (PARTITION BY {qi('month')} ORDER BY month DESC) = 1"""

ORACLES["append_unmatched"] = f"""
WITH m AS (SELECT permno, month, CASE WHEN permno % 2 = 0 THEN 0.25::DOUBLE END AS ret, revenue AS prc, n FROM {MONTHLY}),
kept AS (SELECT * FROM m WHERE n <> 2),
gone AS (SELECT permno, month - 3 AS dlstdt, month FROM m WHERE n <= 3)
SELECT permno, month, month AS date, prc, CASE WHEN g.dlstdt IS NULL THEN ret WHEN ret IS NULL THEN -0.5::DOUBLE ELSE (1 + ret) * 0.5 - 1 END AS ret, g.dlstdt IS NOT NULL AS delisted
FROM kept LEFT JOIN gone g USING (permno, month)
UNION ALL
SELECT permno, month, dlstdt, 1.0::DOUBLE, -0.5::DOUBLE, true FROM gone ANTI JOIN kept USING (permno, month)"""

ORACLES["equity_link"] = f"""
WITH m AS (SELECT permno, month, revenue, CASE WHEN n % 5 <> 0 THEN n END AS shrout FROM {MONTHLY}),
l AS (SELECT DISTINCT permno, permno % 20 AS gvkey, DATE '1993-06-30' AS s, CASE WHEN permno % 4 <> 0 THEN DATE '1996-03-31' ELSE DATE '2099-12-31' END AS e,
  CASE WHEN permno % 3 = 0 THEN 'LU' WHEN permno % 11 = 0 THEN 'LX' ELSE 'LC' END AS kind, CASE WHEN permno % 2 = 0 THEN 0 ELSE 1 END AS prim FROM m)
SELECT gvkey, month, permno, round(abs(revenue) * shrout, 2) AS mktcap FROM m JOIN l USING (permno)
WHERE month BETWEEN s AND e AND kind IN ('LC', 'LU')
QUALIFY row_number() OVER (PARTITION BY gvkey, month ORDER BY abs(revenue) * shrout DESC NULLS LAST, prim, CASE WHEN kind = 'LC' THEN 0 ELSE 1 END, permno) = 1"""

ORACLES["range_anti_mask"] = f"SELECT user_id, q FROM {DAYS} r WHERE NOT EXISTS (SELECT 1 FROM {SPELLS} s WHERE s.user_id = r.user_id AND r.q > s.default_q AND (s.emerge_q IS NULL OR r.q < s.emerge_q))"
ORACLES["range_semi_mask"] = f"SELECT user_id, q FROM {DAYS} r WHERE EXISTS (SELECT 1 FROM {SPELLS} s WHERE s.user_id = r.user_id AND r.q > s.default_q AND (s.emerge_q IS NULL OR r.q < s.emerge_q))"
ORACLES["gap_lag"] = f"""
WITH x AS (SELECT user_id, d AS q, count(*) AS n, max(event_id) AS top FROM {EV} WHERE event_type IN ('view', 'click') GROUP BY 1, 2)
SELECT x.user_id, x.q, x.n, x.top, p.n AS prev_n FROM x LEFT JOIN x p ON p.user_id = x.user_id AND p.q = x.q - 1"""

RAW = f"""(SELECT DISTINCT user_id AS issue_id, agency AS rating_type, DATE '1992-01-05' + CAST(d * 80 AS INT) AS rating_date,
  CASE WHEN k = 0 THEN 'NR' WHEN k = 1 THEN 'P-1' WHEN k = 2 THEN '??' WHEN agency = 'MR' THEN ['Aaa','Aa1','A2','Baa3','Ba1','B2','Caa2','C'][k % 8 + 1] ELSE ['AAA','AA+','A','BBB-','BB+','B','CCC','D'][k % 8 + 1] END AS code
  FROM (SELECT *, event_id % 23 AS k, CASE WHEN event_type IN ('view','click') THEN 'SPR' WHEN event_type = 'signup' THEN 'FR' ELSE 'MR' END AS agency FROM {EV}))"""
SCALE = """CAST(CASE WHEN rating_type = 'MR' THEN CASE code WHEN 'Aaa' THEN 1 WHEN 'Aa1' THEN 2 WHEN 'A2' THEN 6 WHEN 'Baa3' THEN 10 WHEN 'Ba1' THEN 11 WHEN 'B2' THEN 15 WHEN 'Caa2' THEN 18 WHEN 'C' THEN 21 END
  ELSE CASE code WHEN 'AAA' THEN 1 WHEN 'AA+' THEN 2 WHEN 'A' THEN 6 WHEN 'BBB-' THEN 10 WHEN 'BB+' THEN 11 WHEN 'B' THEN 15 WHEN 'CCC' THEN 18 WHEN 'D' THEN 22 END END AS DOUBLE)"""
RATINGS = f"""
graded AS (SELECT *, {SCALE} AS ord, code = 'NR' AS is_terminator FROM {RAW} WHERE code <> 'P-1'),
daily AS (SELECT issue_id, rating_type, rating_date, CASE WHEN bool_or(is_terminator) THEN NULL ELSE max(ord) END AS ord, bool_or(is_terminator) AS is_terminator
  FROM graded WHERE ord IS NOT NULL OR is_terminator GROUP BY 1, 2, 3),
clean AS (SELECT * FROM daily WINDOW w AS (PARTITION BY issue_id, rating_type ORDER BY rating_date)
  QUALIFY is_terminator OR lag(ord) OVER w IS NULL OR lag(ord) OVER w <> ord OR lag(is_terminator) OVER w)"""
ORACLES["affirmation_dedup"] = f"WITH {RATINGS} SELECT issue_id, rating_type, rating_date, ord, is_terminator FROM clean"

BONDS = f"""{RATINGS},
bonds AS (SELECT c_custkey AS issue_id, c_custkey % 40 AS gvkey, DATE '1991-06-01' + CAST(c_custkey * 11 % 1650 AS INT) AS offering_date,
  CASE WHEN c_custkey % 6 <> 0 THEN DATE '1991-06-01' + CAST(c_custkey * 11 % 1650 + 700 + c_custkey * 13 % 1950 AS INT) END AS maturity,
  ['SEN','SS','SENS','SUB','JUN','NON'][c_custkey % 6 + 1] AS security_level, CAST(floor(c_acctbal) AS DOUBLE) AS offering_amt FROM customer),
defaults AS (SELECT issue_id, gvkey, offering_date + CAST(400 + issue_id * 7 % 300 AS INT) AS default_date, CASE WHEN issue_id % 2 = 0 THEN offering_date + 900 END AS reinstated_date FROM bonds WHERE offering_amt < 200),
grid AS (SELECT q, {qe('q')} AS quarter_end FROM range(7968, 7996) t(q)),
spans AS (SELECT b.issue_id, {qi('b.offering_date')} AS s, least({qi("coalesce(b.maturity, DATE '2099-12-31')")}, {qi("coalesce(d.default_date, DATE '2099-12-31')")}) AS e FROM bonds b LEFT JOIN defaults d USING (issue_id)),
cells AS (SELECT a.rating_type, s.issue_id, g.q, g.quarter_end FROM spans s JOIN grid g ON g.q BETWEEN s.s AND s.e JOIN (SELECT DISTINCT issue_id, rating_type FROM clean) a ON a.issue_id = s.issue_id),
iq AS (SELECT c.rating_type, c.issue_id, c.q, c.quarter_end, r.ord FROM cells c ASOF JOIN clean r ON c.issue_id = r.issue_id AND c.rating_type = r.rating_type AND c.quarter_end >= r.rating_date WHERE NOT r.is_terminator)"""
ORACLES["active_issue_quarters"] = f"WITH {BONDS} SELECT rating_type, issue_id, q, quarter_end, ord FROM iq"

ENRICHED = f"""{BONDS},
en AS (SELECT i.*, b.gvkey, b.security_level, b.offering_amt, p.ord AS prev_ord,
    CASE b.security_level WHEN 'SEN' THEN 'senior_unsecured' WHEN 'SS' THEN 'secured' ELSE 'subordinated' END AS rating_source,
    CASE b.security_level WHEN 'SEN' THEN 0 WHEN 'SS' THEN 1 ELSE 2 END AS tier, CASE b.security_level WHEN 'SUB' THEN 1 WHEN 'JUN' THEN 3 ELSE 0 END AS lvl
  FROM iq i JOIN bonds b USING (issue_id) LEFT JOIN iq p ON p.issue_id = i.issue_id AND p.rating_type = i.rating_type AND p.q = i.q - 1 WHERE b.security_level <> 'NON'),
refs AS (SELECT rating_type, gvkey, quarter_end, q, tier, ord AS rating_ord, rating_source, issue_id AS ref_issue_id, max(ord) OVER w AS rating_worst, count(*) OVER w AS n_active_issues
  FROM en WINDOW w AS (PARTITION BY rating_type, gvkey, quarter_end)
  QUALIFY row_number() OVER (PARTITION BY rating_type, gvkey, quarter_end ORDER BY tier, lvl, offering_amt DESC NULLS LAST, issue_id) = 1),
cuts AS (SELECT e.rating_type, e.gvkey, e.quarter_end, e.q,
    bool_or(e.ord > e.prev_ord AND e.rating_source = r.rating_source) AS cut_primary,
    bool_or(e.ord > e.prev_ord AND e.issue_id = r.ref_issue_id) OR 2 * count(*) FILTER (e.ord > e.prev_ord AND e.rating_source = r.rating_source) > count(*) FILTER (e.rating_source = r.rating_source) AS cut_strict,
    bool_or(e.ord > e.prev_ord) AS cut_anybond
  FROM en e JOIN refs r ON r.rating_type = e.rating_type AND r.gvkey = e.gvkey AND r.q = e.q - 1 WHERE e.prev_ord IS NOT NULL GROUP BY 1, 2, 3, 4)"""
ORACLES["enriched_quarters"] = f"WITH {ENRICHED} SELECT rating_type, issue_id, gvkey, q, ord, prev_ord, rating_source FROM en"
ORACLES["reference_pick"] = f"WITH {ENRICHED} SELECT rating_type, gvkey, quarter_end, q, rating_ord, rating_source, ref_issue_id, rating_worst, n_active_issues FROM refs"
ORACLES["cut_events"] = f"WITH {ENRICHED} SELECT * FROM cuts"

COMBINED = f"""{ENRICHED},
agg AS (SELECT gvkey, quarter_end, any_value(q) AS q, min(tier) AS best, max(rating_worst) AS rating_worst, max(n_active_issues) AS n_active_issues, count(DISTINCT rating_type) AS n_agencies,
    bool_or(rating_type = 'SPR') AS has_sp, bool_or(rating_type = 'MR') AS has_moodys, bool_or(rating_type = 'FR') AS has_fitch FROM refs GROUP BY 1, 2),
combined AS (SELECT a.gvkey, a.quarter_end, a.q, list_sort(list(r.rating_ord))[count(*) // 2 + 1] AS rating_ord, any_value(r.rating_source) AS rating_source,
    max(r.rating_ord) - min(r.rating_ord) AS rating_dispersion, any_value(a.rating_worst) AS rating_worst, any_value(a.n_active_issues) AS n_active_issues, any_value(a.n_agencies) AS n_agencies,
    any_value(has_sp) AS has_sp, any_value(has_moodys) AS has_moodys, any_value(has_fitch) AS has_fitch, any_value(r.rating_source) = 'senior_unsecured' AS senior_unsecured_source
  FROM agg a JOIN refs r ON r.gvkey = a.gvkey AND r.quarter_end = a.quarter_end AND r.tier = a.best GROUP BY 1, 2, 3)"""
ORACLES["combine_middle"] = f"WITH {COMBINED} SELECT * FROM combined"

# Episodes by recursion: from each start to the first default after its end.
EPISODES = """
fresh AS (SELECT gvkey, offering_date, greatest(first_rating, offering_date + 30) AS first_rating FROM bonds JOIN (SELECT issue_id, min(rating_date) AS first_rating FROM clean WHERE ord IS NOT NULL GROUP BY 1) USING (issue_id)),
ends AS (SELECT s.gvkey, s.default_date, least(
    (SELECT min(r.reinstated_date) FROM defaults r WHERE r.gvkey = s.gvkey AND r.default_date >= s.default_date AND r.reinstated_date > s.default_date),
    (SELECT min(f.first_rating) FROM fresh f WHERE f.gvkey = s.gvkey AND f.offering_date > s.default_date AND f.first_rating > s.default_date)) AS emerge_date
  FROM (SELECT DISTINCT gvkey, default_date FROM defaults) s),
ep AS (
  SELECT gvkey, default_date, emerge_date FROM ends QUALIFY row_number() OVER (PARTITION BY gvkey ORDER BY default_date) = 1
  UNION ALL
  SELECT e.gvkey, e.default_date, e.emerge_date FROM ep p JOIN ends e ON e.gvkey = p.gvkey
  WHERE e.default_date = (SELECT min(x.default_date) FROM ends x WHERE x.gvkey = p.gvkey AND x.default_date > p.emerge_date))"""
EP_OUT = f"SELECT gvkey, default_date, emerge_date, {qi('default_date')} AS default_q, {qi('emerge_date')} AS emerge_q FROM ep"
ORACLES["default_episodes"] = f"WITH RECURSIVE {BONDS}, {EPISODES} {EP_OUT}"


def flags(name: str, last: int, key: str = "user_id", rows: str = "rows_", events: str = "ev") -> str:
    nxt = f"(SELECT min(e.q) FROM {events} e WHERE e.k = '{name}' AND e.{key} = r.{key} AND e.q > r.q)"
    now = f"EXISTS (SELECT 1 FROM {events} e WHERE e.k = '{name}' AND e.{key} = r.{key} AND e.q = r.q)"
    seen = f"EXISTS (SELECT 1 FROM {rows} p WHERE p.{key} = r.{key} AND p.q = r.q - 1)"
    parts = [f"CASE WHEN {now} THEN 1.0::DOUBLE WHEN {seen} THEN 0.0::DOUBLE END AS {name}"]
    parts += [f"CASE WHEN r.q + {h} <= {last} THEN CASE WHEN {nxt} - r.q <= {h} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS {name}_{h}q" for h in (1, 4, 8)]
    return ", ".join(parts)


ORACLES["forward_labels"] = f"""
WITH rows_ AS (SELECT * FROM {DAYS}), ev AS (SELECT DISTINCT user_id, d AS q, 'err' AS k FROM {EV} WHERE event_type = 'error')
SELECT r.user_id, r.q, EXISTS (SELECT 1 FROM rows_ p WHERE p.user_id = r.user_id AND p.q = r.q - 1) AS observable, {flags('err', 29)},
       (SELECT min(e.q) FROM ev e WHERE e.user_id = r.user_id AND e.q > r.q) - r.q AS quarters_to_next_err FROM rows_ r"""
ORACLES["label_panel"] = f"""
WITH rows_ AS (SELECT * FROM {DAYS}), sp AS (SELECT * FROM {SPELLS}),
ev AS (SELECT DISTINCT user_id, d AS q, CASE event_type WHEN 'error' THEN 'err' ELSE 'buy' END AS k FROM {EV} x WHERE event_type IN ('error', 'purchase')
  AND NOT EXISTS (SELECT 1 FROM sp WHERE sp.user_id = x.user_id AND x.d > sp.default_q AND (sp.emerge_q IS NULL OR x.d < sp.emerge_q)))
SELECT r.user_id, r.q, EXISTS (SELECT 1 FROM rows_ p WHERE p.user_id = r.user_id AND p.q = r.q - 1) AS observable, {flags('err', 29)}, {flags('buy', 29)}
FROM rows_ r WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.user_id = r.user_id AND r.q > sp.default_q AND (sp.emerge_q IS NULL OR r.q < sp.emerge_q))"""

_KINDS = [("downgrade", "cut_primary", "true"), ("downgrade_strict", "cut_strict", "true"), ("downgrade_anybond", "cut_anybond", "true")]
_KINDS += [(f"downgrade_{n}", "cut_primary", f"rating_type = '{a}'") for a, n in (("SPR", "sp"), ("MR", "moodys"), ("FR", "fitch"))]
_FAMILIES = " UNION ".join(f"SELECT gvkey, q, '{n}' AS k FROM cuts WHERE {c} AND {w} UNION SELECT gvkey, default_q AS q, '{n}' AS k FROM epq" for n, c, w in _KINDS)




ORACLES["downgrade_panel"] = f"""
WITH RECURSIVE {COMBINED}, {EPISODES}, epq AS ({EP_OUT}),
ev AS (SELECT * FROM ({_FAMILIES}) x WHERE NOT EXISTS (SELECT 1 FROM epq WHERE epq.gvkey = x.gvkey AND x.q > epq.default_q AND (epq.emerge_q IS NULL OR x.q < epq.emerge_q))),
lab AS (SELECT r.gvkey, r.q, r.rating_ord, r.has_sp, r.has_moodys, r.has_fitch, {', '.join(flags(n, 7995, 'gvkey', 'combined') for n, _, _ in _KINDS)} FROM combined r
  WHERE NOT EXISTS (SELECT 1 FROM epq WHERE epq.gvkey = r.gvkey AND r.q > epq.default_q AND (epq.emerge_q IS NULL OR r.q < epq.emerge_q)))
SELECT gvkey, q, rating_ord, downgrade, downgrade_4q, downgrade_strict_8q, downgrade_anybond_1q, CASE WHEN has_sp THEN downgrade_sp_4q END AS downgrade_sp_4q,
       CASE WHEN has_moodys THEN downgrade_moodys_4q END AS downgrade_moodys_4q, CASE WHEN has_fitch THEN downgrade_fitch_4q END AS downgrade_fitch_4q FROM lab"""

ORACLES["diff_pct_change"] = f"""
WITH m AS (SELECT last_day(day) AS month, {total('o_totalprice')} AS total FROM {ORD} GROUP BY 1),
p AS (SELECT *, last_value(CASE WHEN month(month) <> 5 THEN total END IGNORE NULLS) OVER (ORDER BY month) AS level FROM m)
SELECT month, round(total - lag(total) OVER (ORDER BY month), 4) AS diff, round((level - lag(level, 12) OVER (ORDER BY month)) / lag(level, 12) OVER (ORDER BY month) * 100, 6) AS pct_12 FROM p"""
ORACLES["quarter_grid_days"] = f"""
SELECT q, {qe('q')} AS quarter_end, coalesce(n, 0) AS n_orders
FROM range(7964, 8000) t(q) LEFT JOIN (SELECT {qi('day')} AS q, count(*) AS n FROM {ORD} GROUP BY 1) o USING (q)"""
ORACLES["span_expand"] = f"""
WITH o AS (SELECT o_orderkey, {qi('day')} AS s, {qi('(day + CAST(o_orderkey % 900 AS INT))')} AS e FROM {ORD})
SELECT o_orderkey, q, {qe('q')} AS quarter_end FROM o JOIN range(7972, 7992) t(q) ON q BETWEEN s AND e"""
ORACLES["presence_crosstab"] = f"SELECT user_id, d, {', '.join(f'bool_or(event_type = {chr(39)}{k}{chr(39)}) AS has_{k}' for k in ('view', 'click', 'purchase', 'signup', 'error'))}, count(DISTINCT event_type) AS n_types FROM {EV} GROUP BY 1, 2"
ORACLES["value_shares"] = "SELECT nullif(o_orderpriority, '5-LOW') AS p, count(*) AS n, count(*) / (SELECT count(*) FROM orders) AS share FROM orders GROUP BY 1"
ORACLES["rates_by_year"] = f"""
SELECT y AS year, avg(CASE WHEN o_orderkey IS NOT NULL THEN CAST(o_orderstatus = 'F' AS INT) END) AS rate, count(o_orderkey) AS n
FROM range(1990, 2001) t(y) LEFT JOIN {ORD} o ON year(o.day) = y GROUP BY 1"""
ORACLES["dup_profile"] = """
SELECT (SELECT count(*) FROM lineitem) AS n_rows,
       (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem)) AS exact_duplicates,
       (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS key_duplicates"""
ORACLES["missing_profile"] = """
SELECT 'status' AS column_name, avg(CAST(o_orderstatus = 'P' AS INT)) AS missing_share FROM orders
UNION ALL SELECT 'cust', avg(CAST(o_custkey % 11 = 0 AS INT)) FROM orders UNION ALL SELECT 'o_totalprice', avg(CAST(o_totalprice IS NULL AS INT)) FROM orders"""
ORACLES["minmax_profile"] = f"SELECT CAST(year(day) AS BIGINT) AS year, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_keys, min(day) AS min_day, max(day) AS max_day, min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice FROM {ORD} GROUP BY 1"
ORACLES["partition_summary"] = f"""
SELECT CAST(year(day) AS BIGINT) AS year, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_keys, count(*) FILTER (c > 1) AS dup_rows
FROM (SELECT *, count(*) OVER (PARTITION BY year(day), o_custkey) AS c FROM {ORD}) GROUP BY 1"""
ORACLES["missing_years"] = f"SELECT y AS year FROM range(1992, 1999) t(y) WHERE y NOT IN (SELECT year(day) FROM {ORD} WHERE year(day) <> 1994)"
ORACLES["date_plausibility"] = f"""
SELECT count(*) FILTER (g < 0) AS inverted, count(*) FILTER (g > 365) AS far, count(*) FILTER (g BETWEEN 0 AND 365) AS fine
FROM (SELECT date_diff('day', day, CAST(l_shipdate AS DATE)) AS g FROM lineitem JOIN {ORD} ON l_orderkey = o_orderkey)"""
ORACLES["range_overlap"] = f"""
SELECT o_custkey, count(*) FILTER (prev >= linkdt) AS overlaps, count(*) AS n
FROM (SELECT *, lag(coalesce(linkenddt, DATE '2099-12-31')) OVER (PARTITION BY o_custkey ORDER BY linkdt, link) AS prev FROM {LINKS}) GROUP BY 1"""
ORACLES["attrition"] = """
WITH s AS (SELECT 1 AS stage, count(*) AS n FROM orders UNION ALL SELECT 2, count(*) FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 3, count(*) FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 100000)
SELECT stage, n, n / lag(n) OVER (ORDER BY stage) AS ratio FROM s"""
ORACLES["cond_distinct"] = "SELECT l_returnflag, count(DISTINCT CASE WHEN l_linestatus = 'O' THEN l_orderkey END) AS open_orders, CAST(sum(CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END) AS BIGINT) AS large, count(l_shipdate) AS dated FROM lineitem GROUP BY 1"
ORACLES["percentile_cont"] = "SELECT o_orderpriority, " + ", ".join(f"percentile_cont({p}) WITHIN GROUP (ORDER BY o_totalprice) AS p{round(100 * p)}" for p in (0.25, 0.5, 0.75)) + " FROM orders GROUP BY 1"
ORACLES["nested_agg"] = "SELECT o_orderstatus, max(n) AS most, CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (n > 5) AS busy FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1"
ORACLES["having_ambiguous"] = "SELECT s_suppkey % 37 AS k, count(DISTINCT s_nationkey) AS n_nations FROM supplier GROUP BY 1 HAVING count(DISTINCT s_nationkey) > 1"
ORACLES["group_measures"] = "SELECT o_custkey, max(o_totalprice) AS top, min(o_totalprice) AS low, max(o_totalprice) - min(o_totalprice) AS spread, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_f, bool_or(o_orderstatus = 'P') AS any_p, 2 * count(*) FILTER (o_orderstatus = 'F') > count(*) AS mostly_f FROM orders GROUP BY 1"
ORACLES["group_floor"] = "SELECT o_custkey, o_orderkey, o_totalprice AS low FROM orders o WHERE o_totalprice = (SELECT min(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)"
ORACLES["middle_rank"] = "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) - 1 = count(*) OVER (PARTITION BY o_custkey) // 2"
ORACLES["top_values"] = "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10"
ORACLES["crosstab_year_type"] = f"SELECT CAST(year(day) AS BIGINT) AS year, {', '.join(f'count(*) FILTER (o_orderstatus = {chr(39)}{s}{chr(39)}) AS {chr(34)}{s}{chr(34)}' for s in 'FOP')} FROM {ORD} GROUP BY 1"
ORACLES["median_by_group"] = "SELECT l_returnflag, median(l_extendedprice) AS median_price, min(l_quantity) AS min_qty, max(l_quantity) AS max_qty FROM lineitem GROUP BY 1"
ORACLES["agreement_matrix"] = f"""
SELECT event_type, count(*) AS n, avg(CAST(x = 0 AS INT)) AS exact, avg(CAST(abs(x) = 1 AS INT)) AS off_one, avg(CAST(abs(x) >= 2 AS INT)) AS off_more, avg(x) AS mean_diff
FROM (SELECT event_type, event_id % 7 - nullif(user_id % 6, 0) AS x FROM {EV}) WHERE x IS NOT NULL GROUP BY GROUPING SETS ((event_type), ())"""
ORACLES["event_precision"] = f"""
WITH n AS (SELECT ours, theirs, ours OR coalesce(lag(ours) OVER w, false) OR coalesce(lead(ours) OVER w, false) AS no, theirs OR coalesce(lag(theirs) OVER w, false) OR coalesce(lead(theirs) OVER w, false) AS nt
  FROM {MARKED} WINDOW w AS (PARTITION BY user_id ORDER BY q))
SELECT count(*) FILTER (ours) AS n_ours, count(*) FILTER (theirs) AS n_theirs, count(*) FILTER (ours AND theirs) AS same, count(*) FILTER (theirs AND no) AS theirs_near_ours, count(*) FILTER (ours AND nt) AS ours_near_theirs FROM n"""
ORACLES["interval_join"] = "SELECT o_orderkey, " + ", ".join(f"EXISTS (SELECT 1 FROM {ORD} l WHERE l.o_custkey = o.o_custkey AND l.o_totalprice > 150000 AND l.day > o.day AND l.day <= o.day + INTERVAL {m} MONTH) AS within_{m}m" for m in (3, 12, 24)) + f" FROM {ORD} o"
ORACLES["trailing_event_join"] = f"SELECT user_id, q FROM {MARKED} h WHERE ours AND EXISTS (SELECT 1 FROM {MARKED} b WHERE b.theirs AND b.user_id = h.user_id AND b.q BETWEEN h.q - 4 AND h.q - 1)"
ORACLES["near_interval"] = f"SELECT user_id, q, EXISTS (SELECT 1 FROM {MARKED} b WHERE b.theirs AND b.user_id = h.user_id AND abs(b.q - h.q) <= 2) AS near FROM {MARKED} h WHERE ours"
ORACLES["prefix_join"] = "SELECT p_partkey, count(*) AS n, min(s_suppkey) AS first_supp FROM part JOIN supplier ON left(p_brand, 7) = 'Brand#' || CAST(s_nationkey % 5 + 1 AS VARCHAR) GROUP BY 1"
ORACLES["shifted_self_join"] = f"SELECT d.user_id, d.q, d.ours, p.ours AS ours_before FROM {MARKED} d JOIN {MARKED} p ON p.user_id = d.user_id AND d.q = p.q + 1"
ORACLES["time_align"] = f"""
SELECT coalesce(a.day, b.day) AS day, n_orders, n_lines FROM (SELECT day, count(*) AS n_orders FROM {ORD} GROUP BY 1) a
FULL JOIN (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS n_lines FROM lineitem GROUP BY 1) b ON a.day = b.day"""
ORACLES["union_distinct_all"] = "SELECT k, count(*) AS n FROM (SELECT DISTINCT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer) GROUP BY 1"
ORACLES["union_missing_columns"] = "SELECT c_custkey AS id, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL BY NAME SELECT s_suppkey AS id, s_nationkey AS nation FROM supplier"
ORACLES["set_overlap"] = """
WITH a AS (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 250000), b AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0)
SELECT (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS in_both, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS only_a, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS only_b"""
ORACLES["year_scan"] = "SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1995"
ORACLES["undated_rows"] = f"SELECT count(*) FILTER (o_orderkey % 19 = 0) AS undated, count(*) FILTER (o_orderkey % 19 <> 0 AND year(day) BETWEEN 1992 AND 1998) AS dated, count(*) AS all_rows FROM {ORD}"
ORACLES["typed_columns"] = """
SELECT p_partkey, try_cast(t AS DOUBLE) AS size_number, try_cast(t AS BIGINT) AS size_long, try_cast('1995-' || lpad(CAST(p_partkey % 14 AS VARCHAR), 2, '0') || '-10' AS DATE) AS day
FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'x' ELSE CAST(p_size AS VARCHAR) END AS t FROM part)"""
ORACLES["conditional_null"] = f"SELECT user_id, q, CASE WHEN ours THEN CAST(q % 2 AS DOUBLE) END AS label_sp, CASE WHEN theirs THEN CAST(q % 3 AS DOUBLE) END AS label_fitch FROM {MARKED}"
ORACLES["recode_case_clip"] = f"""
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 END AS prio_rank, CASE WHEN o_orderstatus = 'F' THEN 'both' WHEN o_totalprice > 150000 THEN 'a' ELSE 'b' END AS route,
       greatest(DATE '1993-01-01', least(day, DATE '1996-12-31')) AS clipped, least(day, DATE '1993-01-01' + CAST(o_orderkey % 2000 AS INT)) AS earlier FROM {ORD}"""
ORACLES["quarter_months"] = f"SELECT o_orderkey, day, last_day(day) AS m_end, {qe(qi('day'))} AS q_end, {qi('day')} AS q FROM {ORD} WHERE month(day) % 3 = 0"
ORACLES["neighbour_flags"] = f"SELECT user_id, q, coalesce(lag(ours) OVER w, false) OR coalesce(lead(ours) OVER w, false) AS beside FROM {MARKED} WINDOW w AS (PARTITION BY user_id ORDER BY q)"
ORACLES["yearly_change_share"] = f"""
SELECT CAST(year(day) AS BIGINT) AS year, avg(CAST(prev <> o_orderpriority AS INT)) AS changed, count(*) AS n
FROM (SELECT *, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey) AS prev FROM {ORD}) WHERE prev IS NOT NULL GROUP BY 1"""

COMPANY = "['Acme', 'Zinc Works', 'Blue-River', 'Delta & Sons', 'north star', 'O''Hara'][{0} % 6 + 1] || ' ' || CAST({0} // 12 AS VARCHAR) || [' Holdings, Inc.', ' Incorporated', ' Corp', '', ' Trust Company', ' Group Ltd'][{0} % 7 + 1]"


def norm(x: str) -> str:
    """Name keys by plain replacement of the forms that the made-up names use."""
    words = f"list_filter(string_split(regexp_replace(upper(coalesce({x}, '')), '[^A-Z0-9& ]+', ' ', 'g'), ' '), lambda w: w <> '')"
    short = "CASE w WHEN 'INCORPORATED' THEN 'INC' WHEN 'HOLDINGS' THEN 'HLDGS' WHEN 'COMPANY' THEN 'CO' WHEN 'GROUP' THEN 'GRP' ELSE w END"
    return f"array_to_string(list_transform({words}, lambda w: {short}), ' ')"


def core(x: str) -> str:
    return f"replace(regexp_replace({x}, '( (HLDGS|INC|CORP|TRUST|CO|GRP|LTD))+$', ''), ' ', '')"


ORACLES["name_keys"] = f"SELECT c_custkey, name_norm, {core('name_norm')} AS name_core FROM (SELECT c_custkey, {norm(COMPANY.format('c_custkey'))} AS name_norm FROM customer)"
ORACLES["security_keys"] = """
SELECT p_partkey, CASE WHEN length(k) >= 8 THEN left(k, 8) END AS cusip8, CASE WHEN length(k) >= 6 THEN left(k, 6) END AS cusip6
FROM (SELECT p_partkey, upper(regexp_replace(left(p_type, 5) || CAST(p_partkey AS VARCHAR), '[^A-Za-z0-9]', '', 'g')) AS k FROM part)"""
ORACLES["link_priority"] = """
SELECT s_suppkey % 30 AS firm, s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'P' ELSE 'C' END AS prim, CASE WHEN s_suppkey % 2 = 0 THEN 'LC' ELSE 'LU' END AS kind FROM supplier
QUALIFY row_number() OVER (PARTITION BY s_suppkey % 30 ORDER BY s_suppkey % 3 <> 0, s_suppkey % 2 <> 0, s_suppkey) = 1"""
ORACLES["extraction_status"] = f"""
WITH p AS (SELECT o_orderstatus, year(day) AS y, max(o_totalprice) > CASE WHEN o_orderstatus = 'P' THEN 1e9 ELSE 270000 END AS ok FROM {ORD} GROUP BY 1, 2)
SELECT o_orderstatus, count(*) AS n_parts, count(*) FILTER (ok) AS n_ok, CASE WHEN bool_and(ok) THEN 'success' WHEN NOT bool_or(ok) THEN 'failed' ELSE 'partial' END AS status FROM p GROUP BY 1"""
ORACLES["requested_vs_archived"] = """
SELECT (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS missing,
       (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS repeated, (SELECT count(DISTINCT o_custkey) FROM orders) AS universe"""
ORACLES["master_panel"] = f"""
WITH b AS (SELECT o_custkey, {qi('day')} AS q, {total('o_totalprice')} AS total FROM {ORD} GROUP BY 1, 2),
r AS (SELECT o_custkey, {qi('day')} AS q, {total('l_extendedprice')} AS returned FROM lineitem JOIN {ORD} ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT o_custkey, q, total, returned, returned IS NULL AS returned_missing, q <= 7987 AS is_train FROM b LEFT JOIN r USING (o_custkey, q)"""
ORACLES["winsorize_train"] = f"""
WITH s AS (SELECT * FROM {SIGNALS}), b AS (SELECT quantile_cont(top, [0.01, 0.99]) AS t, quantile_cont(n, [0.01, 0.99]) AS m FROM s WHERE q < 20)
SELECT user_id, q, round(greatest(least(top, t[2]), t[1]), 9) AS top, round(greatest(least(n, m[2]), m[1]), 9) AS n FROM s, b"""
ORACLES["zscore_flag"] = f"""
WITH s AS (SELECT * FROM {SIGNALS}), b AS (SELECT avg(top) AS a, stddev_samp(top) AS sa, avg(n) AS m, stddev_samp(n) AS sm FROM s WHERE q < 20)
SELECT user_id, q, round((top - a) / sa, 6) AS z_top, round((n - m) / sm, 6) AS z_n, (n - m) / sm > 2 AS high FROM s, b"""
ORACLES["pool_signal"] = f"""
WITH s AS (SELECT * FROM {SIGNALS})
SELECT q, sum(CAST(top AS BIGINT)) / count(*) AS mean_top, count(*) FILTER (top > (SELECT quantile_cont(top, 0.75) FROM s WHERE q < 20)) AS n_high FROM s GROUP BY 1"""
ORACLES["top_contributors"] = f"""
SELECT q, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY r) AS top5 FROM (SELECT q, user_id, row_number() OVER (PARTITION BY q ORDER BY top DESC, user_id) AS r FROM {SIGNALS}) WHERE r <= 5 GROUP BY 1"""
ORACLES["lead_time"] = f"""
WITH s AS (SELECT * FROM {SIGNALS}), e AS (SELECT DISTINCT user_id, d AS event_at FROM {EV} WHERE event_type = 'error' AND value > 70)
SELECT user_id, event_at, event_at - (SELECT min(s.q) FROM s WHERE s.user_id = e.user_id AND s.top > 60 AND s.q < e.event_at AND s.q >= e.event_at - 8) AS lead FROM e"""
ORACLES["static_rate_pooling"] = f"""
WITH o AS (SELECT o_orderpriority, CAST(year(day) AS BIGINT) AS year, CAST(o_orderstatus = 'F' AS INT) AS y FROM {ORD} WHERE o_totalprice > 50000), c AS (SELECT o_orderpriority, avg(y) AS pooled FROM o GROUP BY 1)
SELECT o_orderpriority, year, count(*) AS n, CASE WHEN count(*) >= 30 THEN avg(y) ELSE any_value(pooled) END AS rate FROM o JOIN c USING (o_orderpriority) GROUP BY 1, 2"""
ORACLES["walk_forward"] = f"SELECT CAST(f AS INT) AS fold, count(*) FILTER (q < 20 + f) AS n_train, count(*) FILTER (q = 20 + f) AS n_test FROM {SIGNALS}, range(0, 5) t(f) GROUP BY 1"
ORACLES["stratified_pick"] = "SELECT c_mktsegment, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY (c_custkey * 7919) % 10007, c_custkey) <= 4"

PAIR300 = "CAST(c_custkey // 600 * 300 + c_custkey % 300 AS VARCHAR)"
ORACLES["borrower_universe"] = f"""
WITH c AS (SELECT c_custkey AS id, coalesce({COMPANY.format('c_custkey')}, 'Acme ' || CAST(c_custkey // 12 AS VARCHAR)) AS name, CASE WHEN c_custkey % 5 = 0 THEN ' t' || {PAIR300} END AS ticker FROM customer),
w AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE -s_suppkey END AS id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'W' || CAST(s_suppkey AS VARCHAR) END AS ticker FROM supplier)
SELECT *, 'company' AS source FROM c UNION ALL SELECT *, 'wide' FROM w WHERE id NOT IN (SELECT id FROM c)"""
ORACLES["firm_identities"] = f"""
SELECT *, {core('name_norm')} AS name_core FROM (SELECT gvkey, name, {norm('name')} AS name_norm FROM (
  SELECT DISTINCT o_custkey AS gvkey, {COMPANY.format('o_custkey')} AS name FROM orders WHERE o_orderstatus <> 'P') WHERE name IS NOT NULL)"""
ORACLES["ticker_map"] = """
SELECT DISTINCT 'X' || CAST(l_suppkey % 40 AS VARCHAR) AS ticker, s_nationkey AS gvkey, 'Line ' || l_returnflag AS name
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_suppkey % 7 <> 0 AND s_acctbal > 0"""
ORACLES["link_totals"] = """
SELECT 'total' AS kind, NULL AS value, count(*) AS n FROM orders UNION ALL SELECT 'linked', NULL, count(*) FILTER (o_orderstatus <> 'P') FROM orders
UNION ALL SELECT 'firms', NULL, count(DISTINCT o_custkey) FILTER (o_orderstatus <> 'P') FROM orders
UNION ALL SELECT 'match_type', o_orderpriority, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'source', o_orderstatus, count(*) FROM orders GROUP BY 2"""
ORACLES["lead_summary"] = f"""
WITH l AS (SELECT lead - 3 AS x FROM ({ORACLES['lead_time']})),
r AS (SELECT x, avg(i) OVER (PARTITION BY abs(x)) AS rank, count(*) OVER (PARTITION BY abs(x)) AS t FROM (SELECT x, row_number() OVER (ORDER BY abs(x)) AS i FROM l WHERE x <> 0)),
w AS (SELECT coalesce(sum(rank) FILTER (x > 0), 0.0) AS w_plus, CAST(count(*) AS DOUBLE) AS n, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r)
SELECT (SELECT count(*) FROM l) AS n_events, (SELECT count(x) FROM l) AS n_led, (SELECT avg(x) FROM l) AS mean_lead, (SELECT CAST(quantile_cont(x, 0.5) AS DOUBLE) FROM l) AS median_lead,
       (SELECT avg(CAST(x > 0 AS INT)) FROM l) AS share_positive, w_plus, (w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM w"""
ORACLES["auc_brier"] = f"""
WITH o AS (SELECT CAST(year(day) AS BIGINT) AS year, o_orderkey % 11 / 10 AS s, CAST(o_orderstatus = 'F' AS INT) AS y FROM {ORD} WHERE o_totalprice > 30000),
r AS (SELECT *, avg(i) OVER (PARTITION BY year, s) AS rank, sum(y) OVER d / count(*) OVER d AS precision FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY s) AS i FROM o) WINDOW d AS (PARTITION BY year ORDER BY s DESC)),
a AS (SELECT year, count(*) AS n, CAST(sum(y) AS BIGINT) AS p, sum(rank) FILTER (y = 1) AS ranks, sum(precision) FILTER (y = 1) AS precision, avg((s - y) * (s - y)) AS brier,
      avg(CASE y WHEN 1 THEN -ln(greatest(s, 1e-15)) ELSE -ln(1 - least(s, 1 - 1e-15)) END) AS log_loss FROM r GROUP BY 1)
SELECT year, n, p AS positives, CASE WHEN p > 0 AND p < n THEN round((ranks - p * (p + 1) / 2) / (p * (n - p)), 9) END AS auc, CASE WHEN p > 0 THEN round(precision / p, 9) END AS pr_auc, round(brier, 9) AS brier, round(log_loss, 9) AS log_loss FROM a"""
ORACLES["describe_columns"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({x}) AS n, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std, round(CAST(min({x}) AS DOUBLE), 6) AS min, "
    + ", ".join(f"round(CAST(quantile_cont({x}, {p / 100}) AS DOUBLE), 6) AS q{p}" for p in (25, 50, 75))
    + f", round(CAST(max({x}) AS DOUBLE), 6) AS max FROM lineitem"
    for c, x in (("quantity", "l_quantity"), ("place", "nullif(l_linenumber, 7)"))
)
ORACLES["tranche_panel"] = f"""
WITH t AS (SELECT l_orderkey AS tranche, o_custkey AS gvkey, CAST(l_shipdate AS DATE) AS start, l_quantity AS amount FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = 1),
g AS (SELECT CAST(q AS BIGINT) AS q, {qe('q')} AS e FROM range({1992 * 4}, {1999 * 4}) x(q))
SELECT gvkey, q, tranche, start, amount FROM t JOIN g ON start <= e AND e <= start + 200 QUALIFY row_number() OVER (PARTITION BY gvkey, q ORDER BY start DESC, tranche) = 1"""
ORACLES["account_features"] = """
WITH i AS (SELECT *, CASE WHEN l_quantity > 5 THEN l_quantity END AS d1, CASE WHEN l_linestatus = 'F' THEN l_tax END AS d2, l_extendedprice - 20000 AS atq FROM lineitem),
f AS (SELECT *, CASE WHEN d1 IS NOT NULL OR d2 IS NOT NULL THEN coalesce(d1, 0) + coalesce(d2, 0) END AS debt, CASE WHEN l_tax > 0 THEN l_discount / l_tax END AS cover FROM i)
SELECT l_orderkey, l_linenumber, debt AS total_debt, CASE WHEN atq > 0 THEN debt / atq END AS leverage, cover AS coverage, CASE WHEN atq > 0 THEN (l_quantity - 25) / atq END AS profitability,
       l_quantity / l_linenumber AS liquidity, CASE WHEN atq > 0 AND l_returnflag = 'R' THEN l_quantity / atq END AS cash_ratio, l_returnflag = 'N' AS rdq_missing,
       d1 IS NULL OR d2 IS NULL AS debt_component_missing, cover IS NULL AS coverage_missing, CASE WHEN atq > 0 THEN round(ln(atq), 9) END AS log_assets FROM f"""
ORACLES["quarterly_features"] = f"""
WITH m AS (SELECT s_nationkey AS gvkey, l_suppkey AS permno, last_day(CAST(l_shipdate AS DATE)) AS month, {total('l_extendedprice')} AS mktcap FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
  WHERE month(CAST(l_shipdate AS DATE)) % 3 = 0 GROUP BY 1, 2, 3),
k AS (SELECT last_day(day) AS month, count(*) AS n_orders FROM {ORD} GROUP BY 1),
a AS (SELECT c_nationkey AS gvkey, {qe(qi('day'))} AS month, {total('o_totalprice')} AS t FROM {ORD} JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
SELECT gvkey, month, permno, mktcap, n_orders, CASE WHEN t > 200000 THEN mktcap / 1000 / t END AS market_to_book FROM m LEFT JOIN k USING (month) LEFT JOIN a USING (gvkey, month)
QUALIFY row_number() OVER (PARTITION BY gvkey, month ORDER BY mktcap DESC, permno) = 1"""
ORACLES["single_security"] = """
WITH m AS (SELECT l_suppkey AS gvkey, last_day(CAST(l_shipdate AS DATE)) AS datadate, CASE l_returnflag WHEN 'A' THEN 'P' WHEN 'N' THEN 'C' WHEN 'R' THEN 'J' END AS linkprim,
  CASE l_linenumber % 3 WHEN 0 THEN 'LC' WHEN 1 THEN 'LU' END AS linktype, CASE WHEN l_quantity < 50 THEN CAST(l_shipdate AS DATE) END AS linkdt, l_orderkey * 10 + l_linenumber AS permno FROM lineitem)
SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY gvkey, datadate ORDER BY list_position(['P', 'C'], linkprim) NULLS LAST, list_position(['LC', 'LU'], linktype) NULLS LAST, linkdt DESC NULLS LAST, permno) = 1"""
ORACLES["dataset_metrics"] = f"""
SELECT count(*) AS n_rows, 3 AS n_columns, count(DISTINCT o_custkey) AS n_keys, count(*) FILTER (o_orderstatus = 'P') AS n_undated, min(day) FILTER (o_orderstatus <> 'P') AS first_date,
       max(day) FILTER (o_orderstatus <> 'P') AS last_date, CASE WHEN count(*) > 0 THEN 'success' ELSE 'empty' END AS status FROM {ORD}"""
