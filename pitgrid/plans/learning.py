"""Model queries on the labelled panel."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from pitgrid.operators import learning
from pitgrid.operators.factors import FAMILY_COLUMNS
from pitgrid.plans.performance import AVG_RANK
from pitgrid.plans.registry import query, step

FIT_MONTH = datetime.date(2000, 12, 31)


def panel(t):
    return t.labelled.select("signal_date", "company_id", "factor_score", "next_month_excess_return", *FAMILY_COLUMNS)


@query("M01_walk_forward_split", "signal_date:d train_rows:i train_months:i last_train:d fits:b", """
  SELECT s.signal_date, count(l.company_id) AS train_rows, count(DISTINCT l.signal_date) AS train_months, max(l.signal_date) AS last_train, count(DISTINCT l.signal_date) >= 24 AND count(l.company_id) >= 100 AS fits
  FROM signals s LEFT JOIN labelled l ON l.signal_date < s.signal_date AND l.next_month_excess_return IS NOT NULL GROUP BY s.signal_date""")
def m01(t):
    return learning.walk_forward_split(panel(t), t.signals)


SCALED = ", ".join(
    f"(coalesce({f}, (SELECT median({f}) FROM tr)) - (SELECT avg(coalesce({f}, m)) FROM tr, (SELECT median({f}) AS m FROM tr) z)) / (SELECT stddev_pop(coalesce({f}, m)) FROM tr, (SELECT median({f}) AS m FROM tr) z) AS {f}"
    for f in FAMILY_COLUMNS)
step("tr", "SELECT * FROM labelled WHERE signal_date < DATE '2000-01-01'")


@query("M02_impute_scale", "signal_date:d company_id:s " + " ".join(f"{f}:f" for f in FAMILY_COLUMNS), f"SELECT signal_date, company_id, {SCALED} FROM labelled")
def m02(t):
    p = panel(t)
    return learning.impute_scale(p.where(F.col("signal_date") < "2000-01-01"), p, FAMILY_COLUMNS)


# the labelled rows before the prediction month: the last six months validate, the others are the core
_k = len(FAMILY_COLUMNS)
step("fit_rows", f"SELECT * FROM labelled WHERE signal_date < DATE '{FIT_MONTH}' AND next_month_excess_return IS NOT NULL")
step("fit_split", "SELECT min(signal_date) AS first FROM (SELECT DISTINCT signal_date FROM fit_rows ORDER BY signal_date DESC LIMIT 6)")
step("fit_core", "SELECT * FROM fit_rows WHERE signal_date < (SELECT first FROM fit_split)")
_gap = ", ".join(f"coalesce({f}, (SELECT median({f}) FROM fit_core)) AS {f}" for f in FAMILY_COLUMNS)
step("fit_filled", f"SELECT signal_date, company_id, next_month_excess_return AS y, {_gap} FROM fit_rows")
step("fit_core_filled", "SELECT * FROM fit_filled WHERE signal_date < (SELECT first FROM fit_split)")
_scaled = ", ".join(f"(SELECT CASE WHEN stddev_pop({f}) > 1e-9 THEN stddev_pop({f}) ELSE 1 END FROM fit_core_filled) AS s{i}, (SELECT avg({f}) FROM fit_core_filled) AS m{i}" for i, f in enumerate(FAMILY_COLUMNS, 1))
step("fit_scales", f"SELECT (SELECT avg(y) FROM fit_core_filled) AS ym, {_scaled}")
step("fit_scaled", f"SELECT signal_date, y, ym, [{', '.join(f'({f} - m{i}) / s{i}' for i, f in enumerate(FAMILY_COLUMNS, 1))}] AS x FROM fit_filled CROSS JOIN fit_scales")
step("fit_core_scaled", "SELECT * FROM fit_scaled WHERE signal_date < (SELECT first FROM fit_split)")
_gram = ", ".join(f"[{', '.join(f'avg(x[{i}] * x[{j}])' for j in range(1, _k + 1))}]" for i in range(1, _k + 1))
step("fit_sums", f"SELECT [{_gram}] AS g, [{', '.join(f'avg(x[{i}] * (y - ym))' for i in range(1, _k + 1))}] AS c FROM fit_core_scaled")
# coordinate descent, one weight a step, 120 rounds
_dot = " + ".join(f"g[j][{i}] * w[{i}]" for i in range(1, _k + 1))
_next = ", ".join(f"CASE WHEN j = {i} THEN sign(rest) * greatest(abs(rest) - alpha * l1_ratio, 0) / (g[j][j] + alpha * (1 - l1_ratio)) ELSE w[{i}] END" for i in range(1, _k + 1))
ELASTIC_SQL = f"""
  SELECT alpha, l1_ratio, avg(abs(ym + {' + '.join(f'w[{i}] * x[{i}]' for i in range(1, _k + 1))} - y)) AS mae
  FROM (WITH RECURSIVE down AS (
      SELECT 0 AS i, alpha, l1_ratio, g, c, [{', '.join('0.0::DOUBLE' for _ in range(_k))}] AS w FROM fit_sums,
        (SELECT unnest([0.001, 0.01, 0.1])::DOUBLE AS alpha) a, (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS l1_ratio) r
      UNION ALL
      SELECT i + 1, alpha, l1_ratio, g, c, [{_next}] FROM (SELECT *, c[j] - ({_dot}) + g[j][j] * w[j] AS rest FROM (SELECT *, i % {_k} + 1 AS j FROM down WHERE i < {120 * _k}) q) p)
    SELECT * FROM down WHERE i = {120 * _k}) f CROSS JOIN fit_scaled
  WHERE signal_date >= (SELECT first FROM fit_split) GROUP BY alpha, l1_ratio"""


@query("M03_elastic_net_grid", "alpha:f l1_ratio:f mae:f", ELASTIC_SQL)
def m03(t):
    found = learning.select_params(panel(t), [FIT_MONTH], FAMILY_COLUMNS, tree_grid=())[FIT_MONTH].elastic_errors
    return t.spark.createDataFrame([(a, r, m) for (a, r), m in found.items()], "alpha double, l1_ratio double, mae double")


@query("M04_gbt_grid", "signal_date:d company_id:s tree_score:f")
def m04(t):
    rows = learning.stage(panel(t), "panel")
    return learning.tree_scores(rows, FIT_MONTH, learning.select_params(rows, [FIT_MONTH], FAMILY_COLUMNS)[FIT_MONTH], FAMILY_COLUMNS)


def signal_months(t):
    return [r[0] for r in t.signals.select("signal_date").distinct().collect()]  # one row per month


@query("M05_annual_model_selection", "signal_date:d company_id:s elastic_score:f tree_score:f")
def m05(t):
    return learning.walk_forward(panel(t), signal_months(t), FAMILY_COLUMNS)


@query("M05_scored_months", "signal_date:d rows:i fitted:b zeros:b in_range:b", """
  SELECT p.signal_date, p.rows, h.n >= 100 AND h.months >= 24 AS fitted, NOT (h.n >= 100 AND h.months >= 24) AS zeros, true AS in_range
  FROM (SELECT signal_date, count(*) AS rows FROM labelled GROUP BY signal_date) p
  JOIN (SELECT s.signal_date, count(l.company_id) AS n, count(DISTINCT l.signal_date) AS months FROM (SELECT DISTINCT signal_date FROM labelled) s
        LEFT JOIN labelled l ON l.signal_date < s.signal_date AND l.next_month_excess_return IS NOT NULL GROUP BY s.signal_date) h ON h.signal_date = p.signal_date""")
def m05_months(t):
    """Row set, gate and range of the blended ranks."""
    rows = panel(t)
    scores = learning.stage(learning.walk_forward(rows, signal_months(t), FAMILY_COLUMNS), "scores")
    ranked = learning.rank_blend(scores.join(rows.select("signal_date", "company_id", "factor_score"), ["signal_date", "company_id"]), F.col("fitted"))
    moving = (F.col("elastic_score") != 0) | (F.col("tree_score") != 0)
    return ranked.groupBy("signal_date").agg(
        F.count(F.lit(1)).alias("rows"), F.bool_and("fitted").alias("fitted"), (~F.bool_or(moving)).alias("zeros"),
        F.bool_and((F.col("ml_score") >= 0) & (F.col("ml_score") <= 1)).alias("in_range"))


@query("M05_no_look_ahead", "signal_date:d rows:i changed:i", f"""
  SELECT signal_date, count(*) AS rows, 0 AS changed FROM labelled WHERE signal_date BETWEEN DATE '{FIT_MONTH}' - 200 AND DATE '{FIT_MONTH}' GROUP BY signal_date""")
def m05_leak(t):
    """Labels of the last asked month and later are turned round and rows dealt anew: no score up to that month may move."""
    rows = panel(t)
    last = F.col("signal_date") >= F.lit(FIT_MONTH)
    turned = rows.withColumn(learning.TARGET, F.when(last, -5 * F.col(learning.TARGET)).otherwise(F.col(learning.TARGET)))
    months = [m for m in signal_months(t) if FIT_MONTH - datetime.timedelta(days=200) <= m <= FIT_MONTH]
    a, b = (learning.walk_forward(p, months, FAMILY_COLUMNS) for p in (rows, turned.repartition(7, "company_id")))
    b = b.select("signal_date", "company_id", F.col("elastic_score").alias("e2"), F.col("tree_score").alias("t2"))
    moved = (F.abs(F.col("elastic_score") - F.col("e2")) > 1e-9) | (F.abs(F.col("tree_score") - F.col("t2")) > 1e-9)
    return a.join(b, ["signal_date", "company_id"], "left").groupBy("signal_date").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(moved, F.lit(True))).alias("changed"))


step("two_scores", "SELECT signal_date, company_id, factor_score, factor_quality AS e, factor_low_risk AS t FROM factor_panel")


@query("M06_rank_blend", "signal_date:d company_id:s ml_score:f ensemble_score:f", f"""
  SELECT signal_date, company_id, CASE WHEN later THEN (re + rt) / 2 / n ELSE 0 END AS ml_score, CASE WHEN later THEN 0.5 * fr + 0.5 * (re + rt) / 2 / n ELSE fr END AS ensemble_score FROM (
    SELECT s.*, {AVG_RANK.format(p='s.signal_date', v='e')} AS re, {AVG_RANK.format(p='s.signal_date', v='t')} AS rt, count(*) OVER (PARTITION BY s.signal_date) AS n, p.factor_rank AS fr, s.signal_date > (SELECT min(signal_date) FROM two_scores) AS later
    FROM two_scores s JOIN panel_rank p ON p.signal_date = s.signal_date AND p.company_id = s.company_id) q""")
def m06(t):
    s = t.factor_panel.select("signal_date", "company_id", "factor_score", F.col("factor_quality").alias("elastic_score"), F.col("factor_low_risk").alias("tree_score"))
    return learning.rank_blend(s, F.col("signal_date") > s.agg(F.min("signal_date")).scalar())


@query("M07_labelled_history", "signal_date:d company_id:s factor_score:f next_return:f next_month_excess_return:f", "SELECT * FROM labelled")
def m07(t):
    fwd = t.labelled.select("signal_date", "company_id", "next_return", "next_month_excess_return")
    return learning.labelled_history(t.factor_panel, fwd)
