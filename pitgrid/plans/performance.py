"""Backtest queries over the labelled monthly panel."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from pitgrid.functions.groups import top_k
from pitgrid.operators import performance, portfolio
from pitgrid.operators.factors import FAMILY_COLUMNS
from pitgrid.plans.registry import query, step

day = lambda s: F.lit(s).cast("date")

step("books", """
  SELECT strategy, signal_date, company_id, sector, 0.05 AS weight FROM (
    SELECT 'factor_only' AS strategy, signal_date, company_id, sector, row_number() OVER (PARTITION BY signal_date ORDER BY factor_score DESC, company_id) AS r FROM factor_panel WHERE factor_score IS NOT NULL
    UNION ALL SELECT 'ml_only', signal_date, company_id, sector, row_number() OVER (PARTITION BY signal_date ORDER BY ml_score DESC, company_id) FROM factor_panel) q WHERE r <= 20""")
step("strategy_months", """
  SELECT b.strategy, l.signal_date AS date, sum(0.05 * l.next_return) AS ret, max(l.benchmark_return) AS bench, 0.1 + 0.01 * (month(l.signal_date) % 5) AS turnover
  FROM books b JOIN labelled l ON l.signal_date = b.signal_date AND l.company_id = b.company_id GROUP BY b.strategy, l.signal_date
  UNION ALL SELECT 'spy', signal_date, max(benchmark_return), max(benchmark_return), 0 FROM labelled GROUP BY signal_date""")


def books(t):
    p = t.factor_panel
    a = top_k(p.where("factor_score IS NOT NULL"), ["signal_date"], [F.col("factor_score").desc(), F.col("company_id")], 20).withColumn("strategy", F.lit("factor_only"))
    b = top_k(p, ["signal_date"], [F.col("ml_score").desc(), F.col("company_id")], 20).withColumn("strategy", F.lit("ml_only"))
    cols = ["strategy", "signal_date", "company_id", "sector"]
    return a.select(*cols).unionByName(b.select(*cols)).withColumn("weight", F.lit(0.05))


def strategy_months(t):
    j = t.labelled.join(books(t).select("strategy", "signal_date", "company_id", "weight"), ["signal_date", "company_id"])
    own = j.groupBy("strategy", F.col("signal_date").alias("date")).agg(F.sum(F.col("weight") * F.col("next_return")).alias("ret"), F.max("benchmark_return").alias("bench"))
    own = own.withColumn("turnover", 0.1 + 0.01 * (F.month("date") % 5))
    spy = t.labelled.groupBy(F.col("signal_date").alias("date")).agg(F.max("benchmark_return").alias("ret")).select(
        F.lit("spy").alias("strategy"), "date", "ret", F.col("ret").alias("bench"), F.lit(0.0).alias("turnover"))
    return own.unionByName(spy)


@query("B01_month_end_signals", "signal_date:d", "SELECT signal_date FROM signals WHERE signal_date BETWEEN CAST(DATE '1999-01-31' - INTERVAL 37 MONTH AS DATE) AND DATE '2001-06-30'")
def b01(t):
    return performance.month_end_signals(t.prices_best, day("1999-01-31"), day("2001-06-30"))


@query("B02_forward_returns", "signal_date:d company_id:s return_date:d next_return:f benchmark_return:f next_month_excess_return:f", "SELECT * FROM forward")
def b02(t):
    return performance.forward_returns(t.prices_best, t.signals)


@query("B03_apply_cost", "strategy:s date:d net:f", "SELECT strategy, date, ret - turnover * 10 / 10000 AS net FROM strategy_months")
def b03(t):
    return strategy_months(t).withColumn("net", performance.apply_cost(F.col("ret"), F.col("turnover"), 10.0))


step("eq_weights", "SELECT signal_date, company_id, next_return, 1.0 / count(*) OVER (PARTITION BY signal_date) AS weight FROM labelled")
TURNOVER_SQL = """
  SELECT n.strategy, n.signal_date, CASE WHEN n.prev IS NULL THEN 1.0 ELSE (SELECT sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) / 2
     FROM (SELECT * FROM {0} x WHERE x.strategy = n.strategy AND x.signal_date = n.signal_date) a
     FULL JOIN (SELECT * FROM {0} y WHERE y.strategy = n.strategy AND y.signal_date = n.prev) b ON a.company_id = b.company_id) END AS turnover
  FROM (SELECT strategy, signal_date, lag(signal_date) OVER (PARTITION BY strategy ORDER BY signal_date) AS prev FROM (SELECT DISTINCT strategy, signal_date FROM {0}) z) n"""
step("eq_books", "SELECT 'equal_weight_universe' AS strategy, signal_date, company_id, weight FROM eq_weights")


@query("B04_equal_weight_returns", "signal_date:d names:i gross:f turnover:f net:f", f"""
  SELECT g.*, t.turnover, g.gross - t.turnover * 10 / 10000 AS net FROM (SELECT signal_date, count(*) AS names, sum(weight * next_return) AS gross FROM eq_weights GROUP BY signal_date) g
  JOIN ({TURNOVER_SQL.format('eq_books')}) t ON t.signal_date = g.signal_date""")
def b04(t):
    return performance.equal_weight_returns(t.labelled, 10.0)


@query("B05_one_way_turnover", "strategy:s signal_date:d turnover:f", TURNOVER_SQL.format("books"))
def b05(t):
    return performance.one_way_turnover(books(t))


AVG_RANK = "rank() OVER (PARTITION BY {p} ORDER BY {v}) + (count(*) OVER (PARTITION BY {p}, {v}) - 1) / 2.0"
IC_FACTORS = ("factor_score", *FAMILY_COLUMNS)
step("ic_long", "SELECT signal_date, factor, value, next_month_excess_return AS y FROM labelled UNPIVOT (value FOR factor IN (" + ", ".join(IC_FACTORS) + ")) u WHERE next_month_excess_return IS NOT NULL")
step("ics", f"""
  SELECT signal_date, factor, count(*) AS n, CASE WHEN count(*) >= 5 AND count(DISTINCT value) > 1 AND count(DISTINCT y) > 1 THEN corr(rv, ry) END AS rank_ic FROM (
    SELECT *, {AVG_RANK.format(p='signal_date, factor', v='value')} AS rv, {AVG_RANK.format(p='signal_date, factor', v='y')} AS ry FROM ic_long) q GROUP BY signal_date, factor""")


@query("B06_rank_ic", "signal_date:d factor:s n:i rank_ic:f", "SELECT * FROM ics")
def b06(t):
    return performance.rank_ic(t.labelled, IC_FACTORS)


@query("B07_quantile_returns", "signal_date:d quantile:i mean_excess_return:f n:i", """
  SELECT signal_date, greatest(1, len(list_filter(edges, lambda e: e < factor_score))) AS quantile, avg(next_month_excess_return) AS mean_excess_return, count(*) AS n
  FROM (SELECT * FROM labelled WHERE factor_score IS NOT NULL AND next_month_excess_return IS NOT NULL) l
  JOIN (SELECT signal_date, list_distinct(quantile_cont(factor_score, [0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS edges, count(*) AS c
        FROM labelled WHERE factor_score IS NOT NULL AND next_month_excess_return IS NOT NULL GROUP BY signal_date) e USING (signal_date)
  WHERE c >= 10 AND len(edges) > 1 GROUP BY 1, 2""")
def b07(t):
    return performance.quantile_returns(t.labelled)


PAIR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, signal_date, {a} AS x, {b} AS y FROM labelled WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in combinations(sorted(FAMILY_COLUMNS), 2))


@query("B08_factor_correlation", "a:s b:s rho:f", f"""
  SELECT a, b, CASE WHEN count(rho) = (SELECT count(DISTINCT signal_date) FROM labelled) THEN avg(rho) END AS rho FROM (
    SELECT a, b, signal_date, CASE WHEN count(DISTINCT x) > 1 AND count(DISTINCT y) > 1 THEN corr(rx, ry) END AS rho FROM (
      SELECT *, {AVG_RANK.format(p='a, b, signal_date', v='x')} AS rx, {AVG_RANK.format(p='a, b, signal_date', v='y')} AS ry FROM ({PAIR_SQL}) p) q GROUP BY a, b, signal_date) z GROUP BY a, b""")
def b08(t):
    return performance.factor_correlation(t.labelled, FAMILY_COLUMNS)


@query("B09_sector_exposure", "signal_date:d strategy:s sector:s portfolio_weight:f benchmark_weight:f active_weight:f", """
  SELECT g.signal_date, g.strategy, g.sector, coalesce(p.w, 0) AS portfolio_weight, coalesce(b.w, 0) AS benchmark_weight, coalesce(p.w, 0) - coalesce(b.w, 0) AS active_weight
  FROM (SELECT DISTINCT k.signal_date, k.strategy, f.sector FROM books k JOIN factor_panel f ON f.signal_date = k.signal_date) g
  LEFT JOIN (SELECT signal_date, strategy, sector, sum(weight) AS w FROM books GROUP BY 1, 2, 3) p ON p.signal_date = g.signal_date AND p.strategy = g.strategy AND p.sector = g.sector
  LEFT JOIN (SELECT DISTINCT signal_date, sector, count(*) OVER (PARTITION BY signal_date, sector) / count(*) OVER (PARTITION BY signal_date) AS w FROM factor_panel) b
    ON b.signal_date = g.signal_date AND b.sector = g.sector""")
def b09(t):
    return performance.sector_exposure(books(t).drop("sector"), t.factor_panel)


step("cover", "SELECT k.strategy, k.signal_date, count(*) FILTER (WHERE month(f.signal_date) % 4 <> 1) AS n_scores FROM (SELECT DISTINCT strategy, signal_date FROM books) k JOIN factor_panel f ON f.signal_date = k.signal_date GROUP BY 1, 2")


@query("B10_hold_when_uncovered", "strategy:s signal_date:d n_scores:i held:b book_date:d gross:f", """
  SELECT m.*, coalesce((SELECT sum(b.weight * l.next_return) FROM books b JOIN labelled l ON l.company_id = b.company_id
         WHERE b.strategy = m.strategy AND b.signal_date = m.book_date AND l.signal_date = m.signal_date), 0) AS gross
  FROM (SELECT c.*, n_scores < 20 AS held, (SELECT max(x.signal_date) FROM cover x WHERE x.strategy = c.strategy AND x.signal_date <= c.signal_date AND x.n_scores >= 20) AS book_date FROM cover c) m""")
def b10(t):
    n = F.count_if(F.month("signal_date") % 4 != 1).alias("n_scores")
    cover = t.factor_panel.groupBy("signal_date").agg(n).join(books(t).select("strategy", "signal_date").distinct(), "signal_date")
    return performance.hold_when_uncovered(cover, books(t), t.labelled, 20)


step("targets", "SELECT DISTINCT signal_date, sector, count(*) OVER (PARTITION BY signal_date, sector) / count(*) OVER (PARTITION BY signal_date) AS target FROM factor_panel")
step("quota_picks", """
  SELECT * FROM (SELECT q.*, row_number() OVER (PARTITION BY signal_date ORDER BY quota DESC, factor_score DESC, company_id) AS pk FROM (
    SELECT f.signal_date, f.company_id, f.sector, f.factor_score, t.target,
           row_number() OVER (PARTITION BY f.signal_date, f.sector ORDER BY f.factor_score DESC, f.company_id) <= ceil(round(greatest(t.target - 0.08, 0) / 0.05, 9)) AS quota
    FROM factor_panel f JOIN targets t ON t.signal_date = f.signal_date AND t.sector = f.sector WHERE factor_score IS NOT NULL) q) z WHERE pk <= 30""")


def picks(t):
    c = t.factor_panel.select("signal_date", "company_id", "ticker", "sector", F.col("factor_score").alias("score"))
    return portfolio.select_sector_quota(c, portfolio.sector_targets(t.factor_panel))


@query("B11_select_sector_quota", "signal_date:d company_id:s sector:s score:f quota:b pick:i", """
  SELECT signal_date, company_id, sector, factor_score AS score, quota, row_number() OVER (PARTITION BY signal_date ORDER BY factor_score DESC, company_id) AS pick FROM quota_picks""")
def b11(t):
    return picks(t)


@query("B12_capped_score_weights", "signal_date:d company_id:s sector:s score:f pick:i weight:f")
def b12(t):
    return portfolio.capped_score_weights(picks(t))


@query("B12_weight_limits", "signal_date:d total:f widest:f sector_gap_ok:b", """
  SELECT signal_date, 1.0 AS total, 0.05 AS widest, true AS sector_gap_ok FROM (
    SELECT signal_date, sum(least(target + 0.08, 0.05 * n)) AS cap, sum(n) AS names FROM (
      SELECT signal_date, sector, max(target) AS target, count(*) AS n FROM quota_picks GROUP BY 1, 2) a GROUP BY 1) b WHERE names >= 20 AND cap >= 1 - 1e-9""")
def b12b(t):
    w = portfolio.capped_score_weights(picks(t))
    per_sector = w.groupBy("signal_date", "sector").agg(
        F.sum("weight").alias("s"), F.max("sector_target").alias("target"), F.max("weight").alias("widest"))
    ok = F.abs(F.col("s") - F.col("target")) <= portfolio.SECTOR_ACTIVE_LIMIT + 1e-9
    return per_sector.groupBy("signal_date").agg(
        F.sum("s").alias("total"), F.greatest(F.max("widest"), F.lit(0.05)).alias("widest"), F.every(ok).alias("sector_gap_ok"))


@query("B13_portfolio_risk", "strategy:s signal_date:d sessions:i variance:f expected_volatility:f", """
  SELECT strategy, signal_date, sessions, variance, sqrt(variance) AS expected_volatility FROM (
    SELECT b.strategy, b.signal_date, max(m.n) AS sessions,
           CASE WHEN max(m.n) >= 20 THEN max(v.var) * 252 ELSE 0.04 * max(b.ww) END + 1e-6 * max(b.ww) AS variance
    FROM (SELECT strategy, signal_date, sum(weight * weight) AS ww FROM books GROUP BY 1, 2) b
    JOIN (SELECT s.signal_date, least(252, count(DISTINCT c.price_date)) AS n FROM signals s JOIN calendar c ON c.price_date <= s.signal_date GROUP BY 1) m ON m.signal_date = b.signal_date
    JOIN (SELECT strategy, signal_date, var_samp(x) AS var FROM (
        SELECT d.strategy, d.signal_date, d.price_date, coalesce(sum(0.05 * r.ret), 0) AS x FROM (
          SELECT k.strategy, k.signal_date, c.price_date, row_number() OVER (PARTITION BY k.strategy, k.signal_date ORDER BY c.price_date DESC) AS back
          FROM (SELECT DISTINCT strategy, signal_date FROM books) k JOIN calendar c ON c.price_date <= k.signal_date) d
        JOIN books b ON b.strategy = d.strategy AND b.signal_date = d.signal_date
        LEFT JOIN (SELECT company_id, price_date, adjusted_close / lag(adjusted_close) OVER (PARTITION BY company_id ORDER BY price_date) - 1 AS ret FROM prices_best) r
          ON r.company_id = b.company_id AND r.price_date = d.price_date
        WHERE back <= 252 GROUP BY 1, 2, 3) x GROUP BY 1, 2) v ON v.strategy = b.strategy AND v.signal_date = b.signal_date
    GROUP BY 1, 2) q""")
def b13(t):
    return portfolio.portfolio_risk(books(t), t.prices_best.select("company_id", "price_date", "adjusted_close"))


METRICS = ("cagr", "annualized_volatility", "sharpe_zero_rf", "sortino_zero_rf", "max_drawdown", "beta", "information_ratio", "average_one_way_turnover", "monthly_hit_rate")


def metric_sql(src: str, keys: str = "strategy") -> str:
    return f"""
  SELECT {keys}, exp(sum(ln(1 + ret)) * 12 / count(*)) - 1 AS cagr, stddev_pop(ret) * sqrt(12) AS annualized_volatility,
         coalesce(avg(ret) * 12 / nullif(stddev_pop(ret) * sqrt(12), 0), 0) AS sharpe_zero_rf,
         coalesce(avg(ret) * 12 / nullif(stddev_pop(least(ret, 0)) * sqrt(12), 0), 0) AS sortino_zero_rf, min(wealth / peak - 1) AS max_drawdown,
         covar_pop(ret, bench) / var_pop(bench) AS beta, coalesce(avg(ret - bench) * 12 / nullif(stddev_pop(ret - bench) * sqrt(12), 0), 0) AS information_ratio,
         avg(turnover) AS average_one_way_turnover, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) AS monthly_hit_rate, count(*) AS observations,
         CASE WHEN abs(regr_intercept(ret, bench)) < 1e-12 THEN 0 ELSE regr_intercept(ret, bench) * 12 END AS annualized_alpha, max(wealth_end) AS ending_wealth
  FROM (SELECT *, max(wealth) OVER (PARTITION BY {keys} ORDER BY date) AS peak, last_value(wealth) OVER (PARTITION BY {keys} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS wealth_end
    FROM (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY {keys} ORDER BY date)) AS wealth FROM {src}) a) b GROUP BY {keys}"""


@query("B14_strategy_metrics", "strategy:s " + " ".join(f"{m}:f" for m in METRICS) + " observations:i", metric_sql("strategy_months"))
def b14(t):
    return performance.strategy_metrics(strategy_months(t))


@query("B15_alpha_test", "strategy:s annualized_alpha:f alpha_t_stat:f observations:i", """
  SELECT strategy, a * 12 AS annualized_alpha, CASE WHEN abs(a) < 1e-12 THEN 0 ELSE a / sqrt(rss / (n - 2) * (1.0 / n + mx * mx / sxx)) END AS alpha_t_stat, n AS observations FROM (
    SELECT m.strategy, max(c.a) AS a, max(c.mx) AS mx, max(c.sxx) AS sxx, count(*) AS n, sum((m.ret - c.a - c.b * m.bench) ** 2) AS rss
    FROM strategy_months m JOIN (SELECT strategy, regr_intercept(ret, bench) AS a, regr_slope(ret, bench) AS b, avg(bench) AS mx, regr_sxx(ret, bench) AS sxx FROM strategy_months GROUP BY 1) c
    ON c.strategy = m.strategy GROUP BY 1) q""")
def b15(t):
    return performance.alpha_test(strategy_months(t))


@query("B16_ic_summary", "factor:s mean_rank_ic:f ic_t_stat:f ic_positive_rate:f observations:i", """
  SELECT factor, avg(rank_ic) AS mean_rank_ic, avg(rank_ic) / (stddev_samp(rank_ic) / sqrt(count(rank_ic))) AS ic_t_stat,
         avg(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0 END) AS ic_positive_rate, count(*) AS observations FROM ics WHERE rank_ic IS NOT NULL GROUP BY factor""")
def b16(t):
    return performance.ic_summary(performance.rank_ic(t.labelled, IC_FACTORS))


@query("B17_cost_sensitivity", "strategy:s bps:f cagr:f sharpe_zero_rf:f max_drawdown:f annualized_alpha:f", metric_sql(
    "(SELECT m.* REPLACE (ret + turnover * (10 - bps) / 10000 AS ret), bps FROM strategy_months m, (SELECT unnest([5.0, 10.0, 25.0]) AS bps) c)", "strategy, bps"))
def b17(t):
    return performance.cost_sensitivity(strategy_months(t), 10.0, (5.0, 10.0, 25.0))


@query("B18_strategy_comparison", "strategy:s ending_wealth:f cagr:f cagr_vs_benchmark:f return_leader:b risk_leader:b drawdown_leader:b", f"""
  SELECT m.*, cagr - (SELECT cagr FROM ({metric_sql('strategy_months')}) x WHERE strategy = 'spy') AS cagr_vs_benchmark,
         strategy <> 'spy' AND ending_wealth = max(ending_wealth) FILTER (WHERE strategy <> 'spy') OVER () AS return_leader,
         strategy <> 'spy' AND sharpe_zero_rf = max(sharpe_zero_rf) FILTER (WHERE strategy <> 'spy') OVER () AS risk_leader,
         strategy <> 'spy' AND max_drawdown = max(max_drawdown) FILTER (WHERE strategy <> 'spy') OVER () AS drawdown_leader
  FROM ({metric_sql('strategy_months')}) m""")
def b18(t):
    return performance.strategy_comparison(strategy_months(t), "spy")


@query("B19_wealth_curve", "strategy:s date:d wealth:f", "SELECT strategy, date, exp(sum(ln(1 + ret)) OVER (PARTITION BY strategy ORDER BY date)) AS wealth FROM strategy_months")
def b19(t):
    return performance.wealth_curve(strategy_months(t))


step("agent_decisions", """
  SELECT signal_date, company_id, CASE WHEN k % 2 = 0 THEN 'with_debate' ELSE 'without_debate' END AS variant, (k % 9 - 4) * 0.05 AS adj FROM factor_panel WHERE k % 4 <> 3""")


def agent_decisions(t):
    adj = (F.col("k") % 9 - 4) * 0.05
    return t.factor_panel.where(F.col("k") % 4 != 3).select(
        "signal_date", "company_id", F.when(F.col("k") % 2 == 0, "with_debate").otherwise("without_debate").alias("variant"),
        F.to_json(F.struct(F.lit("Hold").alias("rating"), adj.alias("score_adjustment"))).alias("decision_json"))


@query("B20_agent_overlay_score", "signal_date:d company_id:s agent_adjusted_score:f", """
  SELECT p.signal_date, p.company_id, p.ml_score + CASE WHEN d.adj IS NULL THEN 0 ELSE greatest(-0.1, least(0.1, d.adj)) END AS agent_adjusted_score
  FROM factor_panel p LEFT JOIN agent_decisions d ON d.signal_date = p.signal_date AND d.company_id = p.company_id AND d.variant = 'with_debate'""")
def b20(t):
    return performance.agent_overlay_score(t.factor_panel.withColumn("ensemble_score", F.col("ml_score")), agent_decisions(t), "with_debate")


@query("B20_overlay_months", "variant:s months:i enough:b", "SELECT variant, count(DISTINCT signal_date) AS months, count(DISTINCT signal_date) >= 24 AS enough FROM agent_decisions GROUP BY variant")
def b20b(t):
    return performance.overlay_months(agent_decisions(t))


@query("B21_study_manifest_sources", "dataset:s original_name:s sha256:s row_count:i imported_at:t synthetic:b", "SELECT *, (SELECT bool_or(original_name LIKE 'synthetic_%') FROM source_files) AS synthetic FROM source_files")
def b21(t):
    return performance.study_sources(t.source_files)


@query("B21_model_fingerprints", "model:s effort:s calls:i cases:i", """
  SELECT concat('model-', role) AS model, CASE WHEN turn % 2 = 0 THEN 'low' ELSE 'high' END AS effort, count(*) AS calls, count(DISTINCT conv_id) AS cases FROM conversations GROUP BY 1, 2""")
def b21b(t):
    runs = t.conversations.select(F.concat(F.lit("model-"), "role").alias("model"), F.when(F.col("turn") % 2 == 0, "low").otherwise("high").alias("effort"), F.col("conv_id").alias("case_id"))
    return performance.model_fingerprints(runs)


@query("B22_unknown_sector_share", "unknown_share:f noted:b", "SELECT avg(CASE WHEN k % 3 = 0 THEN 1.0 ELSE 0 END) AS unknown_share, avg(CASE WHEN k % 3 = 0 THEN 1.0 ELSE 0 END) >= 0.5 AS noted FROM factor_panel")
def b22(t):
    return performance.unknown_sector_share(t.factor_panel.withColumn("sector", F.when(F.col("k") % 3 != 0, F.col("sector"))))
