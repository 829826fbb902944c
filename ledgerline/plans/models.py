"""Queries of the modelling operators over the sample tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import quarter_end
from ..operators import analysts, classifiers, merton, modelling, quantiles, regression
from .queries import QUERIES, _events, _orders, _signals, _t, _total

NAMES: list[str] = []


def query(f):
    QUERIES[f.__name__] = f
    NAMES.append(f.__name__)
    return f


def _outcomes(spark, sf_dir):
    """Users and days with their signals, and whether the next day has an error."""
    errors = _events(spark, sf_dir).filter("event_type = 'error'").select("user_id", (F.col("d") - 1).alias("q"), F.lit(1.0).alias("hit")).distinct()
    return _signals(spark, sf_dir).join(errors, ["user_id", "q"], "left").withColumns({"y": F.coalesce("hit", F.lit(0.0)), "late": F.col("q") >= 15})


@query
def panel_regression(spark, sf_dir):
    """Three nested models of the next day's error, by half of the month."""
    models = {"count": ["n"], "level": ["top"], "both": ["n", "top"]}
    fits = regression.nested_regressions(_outcomes(spark, sf_dir), "y", models, "user_id", "q", by=["late"])
    return fits.select("model", "late", "term", *(F.round(c, 7).alias(c) for c in ("coef", "std_error", "r2")), F.round("t_stat", 4).alias("t_stat"), "n")


@query
def walk_forward_classifier(spark, sf_dir):
    """Out-of-fold metrics of a logistic model, fitted on all days before each fold's."""
    rows = _outcomes(spark, sf_dir)
    days = range(20, 25)
    models = classifiers.fit_folds(rows, "y", ["n"], [f"q < {d}" for d in days], penalty=0.0)
    scored = classifiers.score_folds(rows, models, [f"q = {d}" for d in days])
    m = modelling.score_metrics(scored.filter("fold is not null").withColumn("score", F.round("score", 9)), "y", "score", ["fold"])
    return m.select("fold", "n", "positives", *(F.round(c, 6).alias(c) for c in ("auc", "pr_auc", "brier", "log_loss")))


@query
def walk_forward_both(spark, sf_dir):
    """Out-of-fold scores of a model of two features with a ridge."""
    rows = _outcomes(spark, sf_dir)
    models = classifiers.fit_folds(rows, "y", ["n", "top"], ["q < 15", "q < 22"], penalty=1.0)
    return classifiers.score_folds(rows, models, ["q >= 15 AND q < 22", "q >= 22"]).filter("fold is not null").select("user_id", "q", "fold", "y", "score")


@query
def analyst_panel(spark, sf_dir):
    """Orders stand for consensus snapshots of this or the next quarter, shipped totals for actuals."""
    o = _orders(spark, sf_dir)
    snapshots = o.select(
        F.col("o_custkey").alias("firm"), F.col("day").alias("statpers"), quarter_end(F.date_add("day", (F.col("o_orderkey") % 150).cast("int"))).alias("fpedats"),
        F.col("o_totalprice").alias("meanest"), (F.col("o_totalprice") / 8).alias("stdev"), F.substring("o_orderpriority", 1, 1).cast("int").alias("numest"), "day",
    ).withColumn("fpi", F.when(F.col("fpedats") == quarter_end("day"), "1").otherwise("2")).drop("day")
    lines = _t(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    actuals = lines.groupBy(F.col("o_custkey").alias("firm"), quarter_end("day").alias("pends")).agg(F.max(F.col("l_shipdate").cast("date")).alias("anndats"), _total("l_extendedprice", "value"))
    grid = o.select(F.col("o_custkey").alias("firm"), quarter_end(F.add_months("day", 3)).alias("quarter_end")).distinct()
    out = analysts.analyst_features(grid, snapshots, actuals, "firm", "quarter_end", age_cap=200)
    return out.withColumns({c: F.round(c, 6) for c in ("revision", "dispersion", "surprise")})


@query
def merton_firm_months(spark, sf_dir):
    """Suppliers' daily sales over a base stand for equity; debt and rate follow the day."""
    li = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("firm"), F.col("l_shipdate").cast("date").alias("day")).agg(_total("l_extendedprice", "sold"))
    daily = li.select("firm", "day", (400000 + F.col("sold")).alias("equity"), (150000 + F.month("day") * 5000).alias("debt"), F.lit(0.03).alias("rate"))
    return merton.merton_quarters(merton.merton_months(daily, "firm", "day", least=20), "firm")


@query
def column_quantiles(spark, sf_dir):
    """Quantiles of the lines' prices and quantities, and the rows of both tails that clipping at them would change."""
    li = _t(spark, sf_dir, "lineitem")
    found = quantiles.exact_quantiles(li, ["l_extendedprice", "l_quantity"], [0.01, 0.5, 0.99])
    tails = li.agg(*(F.count_if((F.col(c) < q[0]) | (F.col(c) > q[2])).alias(c) for c, q in found.items())).first()
    rows = [(c, *(round(x, 6) for x in q), tails[c]) for c, q in found.items()]
    return spark.createDataFrame(rows, "column_name string, q01 double, q50 double, q99 double, n_tails bigint")


_OUTCOMES = """
  SELECT s.user_id, s.q, s.top, s.n, CASE WHEN e.user_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS y, s.q >= 15 AS late
  FROM (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS q, max(floor(value))::DOUBLE AS top, count(*)::DOUBLE AS n FROM events GROUP BY ALL) s
  LEFT JOIN (SELECT DISTINCT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) - 1 AS q FROM events WHERE event_type = 'error') e ON s.user_id = e.user_id AND s.q = e.q
"""

_ONE = """
SELECT '{x}' AS x, late, count(*) AS n, regr_slope(y, {x}) AS b, regr_intercept(y, {x}) AS a, avg({x}) AS m, regr_sxx(y, {x}) AS sxx FROM o GROUP BY late
"""

#: Coefficients in closed form; each row's share in a coefficient's error, then products of shares up to four days apart.
_PANEL = f"""
WITH o AS ({_OUTCOMES}),
one AS ({_ONE.format(x="n")} UNION ALL {_ONE.format(x="top")}),
mom AS (
  SELECT late, count(*) AS c, avg(n) AS mn, avg(top) AS mt, avg(y) AS my, regr_sxx(y, n) AS nn, regr_sxx(y, top) AS tt, covar_pop(n, top) * count(*) AS nt,
         covar_pop(n, y) * count(*) AS ny, covar_pop(top, y) * count(*) AS ty
  FROM o GROUP BY late),
two AS (
  SELECT *, (tt * ny - nt * ty) / (nn * tt - nt * nt) AS bn, (nn * ty - nt * ny) / (nn * tt - nt * nt) AS bt, tt / (nn * tt - nt * nt) AS inn, nn / (nn * tt - nt * nt) AS itt, -nt / (nn * tt - nt * nt) AS int_
  FROM mom),
shares AS (
  SELECT CASE x WHEN 'n' THEN 'count' ELSE 'level' END AS model, o.late, user_id, q, x AS term, f.n AS rows_, f.b AS coef, y - a - b * v AS e, (v - m) / sxx AS w
  FROM (SELECT o.*, 'n' AS x, n AS v FROM o UNION ALL SELECT o.*, 'top', top FROM o) o JOIN one f USING (late, x)
  UNION ALL
  SELECT CASE x WHEN 'n' THEN 'count' ELSE 'level' END, o.late, user_id, q, 'const', f.n, f.a, y - a - b * v, 1.0 / f.n - m * (v - m) / sxx
  FROM (SELECT o.*, 'n' AS x, n AS v FROM o UNION ALL SELECT o.*, 'top', top FROM o) o JOIN one f USING (late, x)
  UNION ALL
  SELECT 'both', o.late, user_id, q, t.term, c,
         CASE t.term WHEN 'n' THEN bn WHEN 'top' THEN bt ELSE my - bn * mn - bt * mt END,
         y - (my - bn * mn - bt * mt) - bn * n - bt * top,
         CASE t.term WHEN 'n' THEN inn * (n - mn) + int_ * (top - mt) WHEN 'top' THEN int_ * (n - mn) + itt * (top - mt)
           ELSE 1.0 / c - mn * (inn * (n - mn) + int_ * (top - mt)) - mt * (int_ * (n - mn) + itt * (top - mt)) END
  FROM o JOIN two USING (late), (VALUES ('const'), ('n'), ('top')) t(term)),
own AS (SELECT model, late, term, rows_, any_value(coef) AS coef, sum(w * e * w * e) AS v, sum(e * e) AS rest FROM shares GROUP BY ALL),
lagged AS (
  SELECT a.model, a.late, a.term, sum(2 * (1 - (a.q - b.q) / 5.0::DOUBLE) * a.w * a.e * b.w * b.e) AS v
  FROM shares a JOIN shares b ON a.model = b.model AND a.late = b.late AND a.term = b.term AND a.user_id = b.user_id AND a.q - b.q BETWEEN 1 AND 4 GROUP BY ALL),
total AS (SELECT late, regr_syy(y, n) AS yy FROM o GROUP BY late),
done AS (SELECT own.model, own.late, own.term, coef, sqrt(greatest(own.v + coalesce(lagged.v, 0), 0)) AS std_error, 1 - rest / yy AS r2, rows_ AS n FROM own LEFT JOIN lagged USING (model, late, term) JOIN total ON own.late = total.late)
SELECT model, late, term, round(coef, 7) AS coef, round(std_error, 7) AS std_error, round(r2, 7) AS r2, round(coef / std_error, 4) AS t_stat, n FROM done
"""

#: Newton's steps as a recursive query: the state of each fold is one row.
_FOLDS = f"""
WITH RECURSIVE o AS ({_OUTCOMES}),
cells AS (SELECT f AS fold, n AS x, count(*)::DOUBLE AS c, sum(y) AS p FROM o, (SELECT unnest(range(5)) AS f) WHERE q < 20 + f GROUP BY ALL),
newton(k, fold, a, b) AS (
  SELECT 0, fold, ln(sum(p) / (sum(c) - sum(p))), 0.0::DOUBLE FROM cells GROUP BY fold
  UNION ALL
  SELECT k + 1, fold, any_value(a) + (sum(w * x * x) * sum(g) - sum(w * x) * sum(g * x)) / (sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x)),
         any_value(b) + (sum(w) * sum(g * x) - sum(w * x) * sum(g)) / (sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x))
  FROM (SELECT k, n.fold, a, b, x, p - c / (1 + exp(-a - b * x)) AS g, c / (1 + exp(-a - b * x)) * (1 - 1 / (1 + exp(-a - b * x))) AS w FROM newton n JOIN cells USING (fold))
  WHERE k < 12 GROUP BY k, fold),
s AS (SELECT fold, y, round(1 / (1 + exp(-a - b * n)), 9) AS score FROM newton JOIN o ON q = 20 + fold WHERE k = 12),
at_ AS (SELECT fold, score, count(*)::DOUBLE AS c, sum(y) AS p FROM s GROUP BY ALL),
down AS (SELECT *, sum(p) OVER w AS ap, sum(c) OVER w AS ac FROM at_ WINDOW w AS (PARTITION BY fold ORDER BY score DESC))
SELECT fold, CAST(sum(c) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS positives,
       round(sum((c - p) * (ap - p / 2)) / (sum(p) * (sum(c) - sum(p))), 6) AS auc, round(sum(p * ap / ac) / sum(p), 6) AS pr_auc,
       round(sum(p * (1 - score) * (1 - score) + (c - p) * score * score) / sum(c), 6) AS brier,
       round(sum(-p * ln(score) - (c - p) * ln(1 - score)) / sum(c), 6) AS log_loss
FROM down GROUP BY fold
"""

_ANALYSTS = """
WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders),
quarters AS (SELECT *, CAST(last_day(date_trunc('quarter', day) + INTERVAL 2 MONTH) AS DATE) AS qe, last_day(date_trunc('quarter', day + CAST(o_orderkey % 150 AS INTEGER)) + INTERVAL 2 MONTH) AS fpe FROM o),
snap AS (
  SELECT o_custkey AS firm, fpe AS fpedats, day AS statpers, arg_min(o_totalprice, (o_totalprice, o_orderpriority[1])) AS meanest,
         CAST(arg_min(o_orderpriority[1], (o_totalprice, o_orderpriority[1])) AS INTEGER) AS numest, any_value(CASE WHEN fpe = qe THEN '1' ELSE '2' END) AS fpi
  FROM quarters GROUP BY ALL),
chained AS (SELECT *, meanest - lag(meanest) OVER (PARTITION BY firm, fpedats ORDER BY statpers) AS revision FROM snap),
actual AS (
  SELECT o_custkey AS firm, qe AS fpedats, max(CAST(l_shipdate AS DATE)) AS anndats, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM lineitem JOIN quarters ON l_orderkey = o_orderkey GROUP BY ALL),
surprises AS (
  SELECT a.firm, a.fpedats, a.anndats, a.value - arg_max(s.meanest, s.statpers) AS surprise
  FROM actual a LEFT JOIN snap s ON a.firm = s.firm AND a.fpedats = s.fpedats AND s.statpers < a.anndats GROUP BY a.firm, a.fpedats, a.anndats, a.value),
grid AS (SELECT DISTINCT o_custkey AS firm, last_day(date_trunc('quarter', day + INTERVAL 3 MONTH) + INTERVAL 2 MONTH) AS quarter_end FROM o),
held AS (
  SELECT g.firm, g.quarter_end, arg_min(struct_pack(statpers := c.statpers, fpedats := c.fpedats, meanest := c.meanest, numest := c.numest, revision := c.revision), (-epoch(c.statpers), c.fpedats)) AS c
  FROM grid g LEFT JOIN chained c ON g.firm = c.firm AND c.statpers <= g.quarter_end AND c.fpi = '1' GROUP BY ALL),
told AS (
  SELECT g.firm, g.quarter_end, arg_max(struct_pack(p := s.fpedats, x := s.surprise), (s.anndats, s.fpedats)) AS s
  FROM grid g LEFT JOIN surprises s ON g.firm = s.firm AND s.anndats <= g.quarter_end GROUP BY ALL),
fresh AS (SELECT h.firm, h.quarter_end, CASE WHEN h.quarter_end - h.c.statpers <= 200 THEN h.c END AS c, t.s FROM held h JOIN told t USING (firm, quarter_end))
SELECT firm, quarter_end, c.statpers AS statpers, c.fpedats AS fpedats, c.meanest AS meanest, c.numest AS numest, round(c.revision, 6) AS revision,
       CASE WHEN c.meanest > 0 THEN round(c.meanest / 8 / c.meanest, 6) END AS dispersion, CAST(sign(c.revision) AS INTEGER) AS direction,
       c.meanest IS NULL AS analyst_missing, s.p AS surprise_period, round(s.x, 6) AS surprise
FROM fresh
"""

_QUANTILES = " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, round(q[1], 6) AS q01, round(q[2], 6) AS q50, round(q[3], 6) AS q99, (SELECT count(*) FROM lineitem WHERE {c} < q[1] OR {c} > q[3]) AS n_tails
FROM (SELECT quantile_cont({c}, [0.01, 0.5, 0.99]) AS q FROM lineitem)""" for c in ("l_extendedprice", "l_quantity"))

ORACLES: dict[str, str] = {"column_quantiles": _QUANTILES, "panel_regression": _PANEL, "walk_forward_classifier": _FOLDS, "analyst_panel": _ANALYSTS}
