"""Factor queries. Bars are sparse in the derived prices, so the look-back is 1600 days here."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitgrid.functions.columns import safe_divide
from pitgrid.functions.groups import with_average_ranks
from pitgrid.operators import asof, factors
from pitgrid.operators.factors import FACTOR_FAMILIES, FEATURES
from pitgrid.plans.bridge import FUNDAMENTAL_METRICS
from pitgrid.plans.registry import query, step
from pitgrid.plans.selection import observations

LOOKBACK = 1600


def div(n: str, d: str) -> str:
    return f"(CASE WHEN abs({d}) > 1e-12 THEN ({n}) / ({d}) END)"


def wide(t):
    facts = asof.latest_asof_facts(t.fundamentals, t.signals, "period_end")
    return asof.pivot_metrics(facts, FUNDAMENTAL_METRICS)


def wide_estimates(t):
    facts = asof.latest_asof_facts(t.estimates, t.signals, "fiscal_period")
    return asof.pivot_metrics(facts, factors.REVISION_INPUTS)


step("fund_wide", "SELECT signal_date, company_id, " + ", ".join(
    f"max(CASE WHEN metric = '{m}' THEN value END) AS {m}" for m in FUNDAMENTAL_METRICS) + " FROM visible_fund GROUP BY signal_date, company_id")
step("est_wide", "SELECT signal_date, company_id, " + ", ".join(
    f"max(CASE WHEN metric = '{m}' THEN value END) AS {m}" for m in factors.REVISION_INPUTS) + " FROM visible_est GROUP BY signal_date, company_id")


@query("F01_safe_divide", "signal_date:d company_id:s net_debt_ebitda:f flat:f",
       f"SELECT signal_date, company_id, {div('net_debt', 'ebitda')} AS net_debt_ebitda, {div('ebitda', 'net_debt - net_debt')} AS flat FROM fund_wide")
def f01(t):
    return wide(t).select(
        "signal_date", "company_id", safe_divide("net_debt", "ebitda").alias("net_debt_ebitda"),
        safe_divide("ebitda", F.col("net_debt") - F.col("net_debt")).alias("flat"),
    )


def inverse_sql(src: str, num: str, den: str, mult: str, out: str) -> str:
    return f"""
      SELECT w.*, coalesce(rep, raw / CASE WHEN n >= 3 AND scale > 10 THEN scale ELSE 1 END) AS {out} FROM (
        SELECT w.*, {div(num, den)} AS raw, {div('1.0', mult)} AS rep FROM {src} w) w
      LEFT JOIN (SELECT signal_date, count(*) AS n, quantile_cont(abs(raw / rep), 0.5) AS scale FROM (
        SELECT signal_date, {div(num, den)} AS raw, {div('1.0', mult)} AS rep FROM {src}) z
        WHERE raw IS NOT NULL AND abs(rep) > 1e-12 GROUP BY signal_date) s ON s.signal_date = w.signal_date"""


# market values are exported in thousands while earnings are not: the case calibration is for
step("fund_scaled", "SELECT signal_date, company_id, net_income, market_cap / 1000 AS market_cap, price_to_earnings FROM fund_wide")


@query("F02_calibrated_inverse_multiple", "signal_date:d company_id:s earnings_yield:f",
       "SELECT signal_date, company_id, earnings_yield FROM (" + inverse_sql("fund_scaled", "net_income", "market_cap", "price_to_earnings", "earnings_yield") + ") q")
def f02(t):
    df = wide(t).withColumn("market_cap", F.col("market_cap") / 1000)
    return factors.calibrated_inverse_multiples(df, ["signal_date"], {"earnings_yield": ("net_income", "market_cap", "price_to_earnings")})


step("inv_ey", inverse_sql("fund_wide", "net_income", "market_cap", "price_to_earnings", "ey"))
step("inv_ev", inverse_sql("fund_wide", "ebitda", "enterprise_value", "tev_ebitda", "ev"))
step("ratios", f"""
  SELECT a.signal_date, a.company_id, a.ey AS earnings_yield, {div('a.free_cash_flow', 'a.market_cap')} AS fcf_yield, b.ev AS ebitda_to_ev,
         {div('a.nopat', 'a.invested_capital')} AS roic, {div('a.gross_profit', 'a.total_assets')} AS gross_profitability,
         {div('a.net_income - a.operating_cash_flow', 'a.total_assets')} AS accruals, {div('a.net_debt', 'a.ebitda')} AS net_debt_ebitda,
         {div('a.revenue', 'a.revenue_prior_year')} - 1 AS revenue_growth, abs({div('a.eps', 'a.eps_prior_year')}) - 1 AS eps_growth,
         a.operating_margin - a.operating_margin_prior_year AS margin_change, a.price_to_earnings, a.tev_ebitda
  FROM inv_ey a JOIN inv_ev b ON b.signal_date = a.signal_date AND b.company_id = a.company_id""")
RATIOS = factors.EXPORTED_RATIOS


@query("F03_fundamental_ratios", "signal_date:d company_id:s " + " ".join(f"{r}:f" for r in RATIOS), "SELECT * FROM ratios")
def f03(t):
    return factors.fundamental_ratios(wide(t))


def breadth_sql(w: str, a: str = "") -> str:
    up, dn = f"{a}eps_up_revisions_{w}", f"{a}eps_down_revisions_{w}"
    return (f"CASE WHEN {up} + {dn} IS NOT NULL THEN least(1, greatest(-1, ({up} - {dn}) / nullif(greatest("
            f"CASE WHEN {a}eps_analyst_count_1m > 0 THEN {a}eps_analyst_count_1m ELSE 0 END, {up} + {dn}), 0))) END")


@query("F04_revision_breadth", "signal_date:d company_id:s eps_revision_1m:f eps_revision_3m:f",
       f"SELECT signal_date, company_id, {breadth_sql('1m')} AS eps_revision_1m, {breadth_sql('3m')} AS eps_revision_3m FROM est_wide")
def f04(t):
    return factors.revision_breadth(wide_estimates(t))


step("est_hist", """
  SELECT s.signal_date, e.company_id, e.fiscal_period, e.as_of_date, e.effective_at, e.ingested_at, e.value,
         row_number() OVER (PARTITION BY s.signal_date, e.company_id ORDER BY e.as_of_date DESC, e.effective_at DESC, e.ingested_at DESC, e.fiscal_period DESC) AS rn
  FROM signals s JOIN estimates e ON e.metric = 'eps_estimate' AND e.as_of_date <= s.signal_date
   AND e.as_of_date >= CAST(s.signal_date - INTERVAL 4 MONTH AS DATE) AND e.effective_at < s.signal_date + INTERVAL 1 DAY""")
step("est_change", f"""
  SELECT signal_date, company_id, {div('now - v1', 'abs(v1)')} AS change_1m, {div('now - v3', 'abs(v3)')} AS change_3m FROM (
    SELECT c.signal_date, c.company_id, max(c.value) AS now,
           max_by(p.value, p.as_of_date) FILTER (WHERE p.as_of_date <= last_day(CAST(c.signal_date - INTERVAL 1 MONTH AS DATE))) AS v1,
           max_by(p.value, p.as_of_date) FILTER (WHERE p.as_of_date <= last_day(CAST(c.signal_date - INTERVAL 3 MONTH AS DATE))) AS v3
    FROM est_hist c JOIN est_hist p ON p.signal_date = c.signal_date AND p.company_id = c.company_id AND p.fiscal_period = c.fiscal_period
    WHERE c.rn = 1 GROUP BY c.signal_date, c.company_id) q""")


@query("F05_estimate_change_asof", "signal_date:d company_id:s change_1m:f change_3m:f", "SELECT * FROM est_change")
def f05(t):
    return factors.estimate_change_asof(t.estimates, t.signals)


Z_SQL = """
  SELECT {keep}, CASE WHEN s.n >= 3 THEN CASE WHEN sd = 0 THEN 0.0 ELSE (least(greatest({v}, lo), hi) - mean) / sd END END AS {out}
  FROM {src} r LEFT JOIN (
    SELECT {k}, count({v}) AS n, max(lo) AS lo, max(hi) AS hi, avg(least(greatest({v}, lo), hi)) AS mean, stddev_pop(least(greatest({v}, lo), hi)) AS sd
    FROM (SELECT r.*, quantile_cont({v}, 0.025) OVER (PARTITION BY {k}) AS lo, quantile_cont({v}, 0.975) OVER (PARTITION BY {k}) AS hi FROM {src} r) c
    WHERE {v} IS NOT NULL GROUP BY {k}) s ON {on}"""


@query("F06_winsorized_zscore", "signal_date:d company_id:s z:f", "SELECT signal_date, company_id, CASE WHEN factor_value IS NOT NULL OR z = 0 THEN z END AS z FROM ("
       + Z_SQL.format(keep="r.signal_date, r.company_id, r.factor_value", v="factor_value", out="z", src="factor_panel", k="signal_date", on="s.signal_date = r.signal_date") + ") q")
def f06(t):
    return factors.winsorized_zscore(t.factor_panel, ["signal_date"], "factor_value", "z")


PANEL = ("factor_value", "factor_quality", "factor_growth")
step("panel_long", "SELECT signal_date, company_id, sector, feature, v FROM factor_panel UNPIVOT INCLUDE NULLS (v FOR feature IN (factor_value, factor_quality, factor_growth)) u")


def sector_z_sql(long: str) -> str:
    """z per (date, feature) with the small-sector rule, on a long table."""
    z = "CASE WHEN {p}n >= 3 THEN CASE WHEN {p}sd = 0 THEN 0.0 WHEN v IS NULL THEN NULL ELSE (least(greatest(v, {p}lo), {p}hi) - {p}mean) / {p}sd END END"
    stats = """SELECT {k}, count(v) AS n, max(lo) AS lo, max(hi) AS hi, avg(least(greatest(v, lo), hi)) AS mean, stddev_pop(least(greatest(v, lo), hi)) AS sd
      FROM (SELECT r.*, q.lo, q.hi FROM {long} r JOIN (SELECT {k}, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM {long} GROUP BY {k}) q
            USING ({k})) c WHERE v IS NOT NULL GROUP BY {k}"""
    return f"""
      SELECT r.signal_date, r.company_id, r.feature, CASE WHEN size >= 3 THEN {z.format(p='a.')} ELSE {z.format(p='b.')} END AS z
      FROM (SELECT r.*, count(*) OVER (PARTITION BY signal_date, feature, sector) AS size FROM {long} r) r
      LEFT JOIN ({stats.format(k='signal_date, feature, sector', long=long)}) a ON a.signal_date = r.signal_date AND a.feature = r.feature AND a.sector = r.sector
      LEFT JOIN ({stats.format(k='signal_date, feature', long=long)}) b ON b.signal_date = r.signal_date AND b.feature = r.feature"""


@query("F07_sector_neutral_zscore", "signal_date:d company_id:s z_factor_value:f z_factor_quality:f z_factor_growth:f",
       "SELECT signal_date, company_id, " + ", ".join(f"max(CASE WHEN feature = '{p}' THEN z END) AS z_{p}" for p in PANEL)
       + f" FROM ({sector_z_sql('panel_long')}) q GROUP BY signal_date, company_id")
def f07(t):
    return factors.sector_neutral_zscores(t.factor_panel, PANEL)


MEAN = "list_avg(list_filter([{0}], lambda x: x IS NOT NULL))"
Z_OF = {f: f"0.5 * factor_{['value', 'quality', 'growth', 'revisions', 'momentum', 'low_risk'][i % 6]} + {i} * 0.01" for i, f in enumerate(FEATURES)}


def fake_z(t):
    return t.factor_panel.select("signal_date", "company_id", *[F.expr(e).alias(f"z_{f}") for f, e in Z_OF.items()])


step("panel_z", "SELECT signal_date, company_id, " + ", ".join(f"{e} AS z_{f}" for f, e in Z_OF.items()) + " FROM factor_panel")
FAMILY_SQL = ", ".join(
    f"{MEAN.format(', '.join(f'z_{f} * {s}' for f, s in fs.items()))} AS factor_{fam}" for fam, fs in FACTOR_FAMILIES.items())
SCORE_SQL = """SELECT q.*, CASE WHEN factor_family_count >= 4 AND institutional_factor_family_count >= 2 THEN """ + MEAN.format(
    ", ".join(factors.FAMILY_COLUMNS)) + """ END AS factor_score FROM (
  SELECT p.*, """ + " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in factors.FAMILY_COLUMNS) + " AS factor_family_count, " + " + ".join(
    f"CAST(factor_{c} IS NOT NULL AS INT)" for c in factors.INSTITUTIONAL_FAMILIES) + " AS institutional_factor_family_count FROM {0} p) q"


@query("F08_factor_families", "signal_date:d company_id:s " + " ".join(f"{c}:f" for c in factors.FAMILY_COLUMNS),
       f"SELECT signal_date, company_id, {FAMILY_SQL} FROM panel_z")
def f08(t):
    return factors.factor_families(fake_z(t))


@query("F09_factor_score", "signal_date:d company_id:s factor_family_count:i institutional_factor_family_count:i factor_score:f",
       SCORE_SQL.format("(SELECT signal_date, company_id, factor_value, factor_quality, factor_growth, factor_revisions, factor_momentum, factor_low_risk FROM factor_panel)"))
def f09(t):
    return factors.factor_score(t.factor_panel.drop("factor_score"))


# a bar counts from the day it was published
step("asset_rows", f"""
  SELECT s.signal_date, p.company_id, p.ticker, p.price_date, p.adjusted_close, p.source_file_id, p.adjusted_close / lag(p.adjusted_close) OVER w - 1 AS ret,
         row_number() OVER (PARTITION BY s.signal_date, p.company_id ORDER BY p.price_date DESC) AS back, count(*) OVER (PARTITION BY s.signal_date, p.company_id) AS n
  FROM signals s JOIN prices_best p ON p.price_date BETWEEN s.signal_date - {LOOKBACK} AND s.signal_date AND p.effective_at < s.signal_date + INTERVAL 1 DAY
  WINDOW w AS (PARTITION BY s.signal_date, p.company_id ORDER BY p.price_date)""")
step("window_rows", "SELECT a.* FROM asset_rows a JOIN (SELECT DISTINCT signal_date, company_id FROM universe) u ON u.signal_date = a.signal_date AND u.company_id = a.company_id")
step("spy_rows", "SELECT signal_date, price_date, ret FROM asset_rows WHERE ticker = 'SPY'")
step("market", """
  SELECT a.*, CASE WHEN b.n >= 40 AND b.bvar > 0 THEN b.cov / b.bvar END AS beta_252d FROM (
    SELECT signal_date, company_id,
      CASE WHEN max(n) >= 253 AND max(CASE WHEN back = 253 THEN adjusted_close END) > 0
           THEN max(CASE WHEN back = 22 THEN adjusted_close END) / max(CASE WHEN back = 253 THEN adjusted_close END) - 1 END AS momentum_12_1,
      CASE WHEN max(n) >= 127 AND max(CASE WHEN back = 127 THEN adjusted_close END) > 0
           THEN max(CASE WHEN back = 22 THEN adjusted_close END) / max(CASE WHEN back = 127 THEN adjusted_close END) - 1 END AS momentum_6_1,
      CASE WHEN count(ret) >= 40 THEN stddev_pop(ret) FILTER (WHERE back <= 252) * sqrt(252) END AS volatility_252d
    FROM window_rows GROUP BY signal_date, company_id) a
  LEFT JOIN (SELECT w.signal_date, w.company_id, count(*) AS n, covar_pop(w.ret, s.ret) AS cov, var_pop(s.ret) AS bvar
    FROM window_rows w JOIN spy_rows s ON s.signal_date = w.signal_date AND s.price_date = w.price_date
    WHERE w.ret IS NOT NULL AND s.ret IS NOT NULL GROUP BY w.signal_date, w.company_id) b
  ON b.signal_date = a.signal_date AND b.company_id = a.company_id""")


def market(t):
    return factors.market_features(t.prices, asof.universe_asof(t.index_membership, t.instruments, t.signals), LOOKBACK)


for _name, _cols in (("F10_momentum", "momentum_12_1:f momentum_6_1:f"), ("F11_volatility_252d", "volatility_252d:f"), ("F12_beta_252d", "beta_252d:f")):
    query(_name, f"signal_date:d company_id:s {_cols}", "SELECT * FROM market")(market)


step("overlay", """
  SELECT r.signal_date, r.company_id, i.sector, (raw - avg(raw) OVER w) / CASE WHEN stddev_pop(raw) OVER w = 0 THEN 1 ELSE stddev_pop(raw) OVER w END AS short_horizon_score
  FROM (SELECT signal_date, company_id, list_avg(list_filter([return_1d / 100, return_1w / 100, return_1m / 100], lambda x: x IS NOT NULL)) AS raw FROM (
      SELECT s.signal_date, r.*, row_number() OVER (PARTITION BY s.signal_date, company_id ORDER BY as_of_date DESC, effective_at DESC, ingested_at DESC) AS rn
      FROM signals s JOIN market_returns r ON r.as_of_date <= s.signal_date AND r.effective_at < s.signal_date + INTERVAL 1 DAY) q WHERE rn = 1) r
  LEFT JOIN (SELECT s.signal_date, i.company_id, max_by(i.sector, i.effective_at) AS sector FROM signals s
      JOIN instruments i ON i.effective_at < s.signal_date + INTERVAL 1 DAY GROUP BY s.signal_date, i.company_id) i
  ON i.signal_date = r.signal_date AND i.company_id = r.company_id
  WINDOW w AS (PARTITION BY r.signal_date, i.sector)""")


@query("F13_short_horizon_overlay", "signal_date:d company_id:s sector:s short_horizon_score:f", "SELECT * FROM overlay")
def f13(t):
    return factors.short_horizon_overlay(t.market_returns, t.instruments, t.signals)


step("revised", f"""
  SELECT e.signal_date, e.company_id, coalesce(c.change_1m, {breadth_sql('1m', 'e.')}) AS eps_revision_1m, coalesce(c.change_3m, {breadth_sql('3m', 'e.')}) AS eps_revision_3m
  FROM est_wide e LEFT JOIN est_change c ON c.signal_date = e.signal_date AND c.company_id = e.company_id""")


@query("F14_revision_fallback_merge", "signal_date:d company_id:s eps_revision_1m:f eps_revision_3m:f", "SELECT * FROM revised")
def f14(t):
    df = wide_estimates(t).join(factors.estimate_change_asof(t.estimates, t.signals), ["signal_date", "company_id"], "left")
    return factors.revision_fallback(df)


def snapshot(t, daily=None):
    return factors.factor_snapshot(t.index_membership, t.instruments, t.fundamentals, t.estimates, t.prices, t.signals, LOOKBACK, daily)


step("features_all", """
  SELECT u.signal_date, u.company_id, u.ticker, u.sector, r.* EXCLUDE (signal_date, company_id), v.eps_revision_1m, v.eps_revision_3m, CAST(NULL AS DOUBLE) AS estimate_surprise,
         m.momentum_12_1, m.momentum_6_1, m.volatility_252d, m.beta_252d
  FROM universe u LEFT JOIN ratios r ON r.signal_date = u.signal_date AND r.company_id = u.company_id
  LEFT JOIN revised v ON v.signal_date = u.signal_date AND v.company_id = u.company_id
  LEFT JOIN market m ON m.signal_date = u.signal_date AND m.company_id = u.company_id""")
step("features_long", f"SELECT signal_date, company_id, sector, feature, v FROM features_all UNPIVOT INCLUDE NULLS (v FOR feature IN ({', '.join(FEATURES)})) u")
step("features_z", "SELECT signal_date, company_id, " + ", ".join(f"max(CASE WHEN feature = '{f}' THEN z END) AS z_{f}" for f in FEATURES)
     + f" FROM ({sector_z_sql('features_long')}) q GROUP BY signal_date, company_id")
step("families", f"SELECT signal_date, company_id, {FAMILY_SQL} FROM features_z")
step("scored", "SELECT f.ticker, f.sector, " + ", ".join(f"f.{x}" for x in FEATURES) + ", f.price_to_earnings, f.tev_ebitda, s.* FROM (" + SCORE_SQL.format("families")
     + ") s JOIN features_all f ON f.signal_date = s.signal_date AND f.company_id = s.company_id")


@query("F15_factor_snapshot", "signal_date:d company_id:s ticker:s sector:s " + " ".join(f"{c}:f" for c in (*FEATURES, *factors.FAMILY_COLUMNS, "factor_score"))
       + " factor_family_count:i", "SELECT * FROM scored")
def f15(t):
    return snapshot(t)


# the eight 32-bit words of the digests, each summed
DIGEST = " || '-' || ".join(f"CAST(CAST(sum(CAST(concat('0x', sha256({{0}})[{1 + 8 * i}:{8 + 8 * i}]) AS HUGEINT)) AS HUGEINT) AS VARCHAR)" for i in range(8))


step("read_sources", """
  SELECT signal_date, source_file_id FROM visible_fund UNION SELECT signal_date, source_file_id FROM visible_est
  UNION SELECT s.signal_date, e.source_file_id FROM signals s JOIN estimates e ON e.metric = 'eps_estimate' AND e.as_of_date BETWEEN s.signal_date - INTERVAL 4 MONTH AND s.signal_date
        AND e.effective_at < s.signal_date + INTERVAL 1 DAY
  UNION SELECT a.signal_date, a.source_file_id FROM asset_rows a JOIN universe u ON u.signal_date = a.signal_date AND (u.company_id = a.company_id OR a.ticker = 'SPY')""")
step("hashes", f"""
  SELECT a.signal_date, n_companies, n_sources, sha256(concat('{{"as_of_date":"', CAST(a.signal_date AS VARCHAR), '","companies":"', companies,
         '","families":"{factors.families_digest()}","n_companies":', n_companies, ',"n_sources":', n_sources, ',"sources":"', sources, '"}}')) AS source_snapshot_hash
  FROM (SELECT signal_date, count(*) AS n_companies, {DIGEST.format('company_id')} AS companies
        FROM (SELECT DISTINCT signal_date, company_id FROM universe) u GROUP BY signal_date) a
  JOIN (SELECT signal_date, count(*) AS n_sources, {DIGEST.format('source_file_id')} AS sources FROM read_sources GROUP BY signal_date) b ON b.signal_date = a.signal_date""")


def hashes(t, daily=None):
    cols = ["signal_date", "source_file_id"]
    members = asof.universe_asof(t.index_membership, t.instruments, t.signals)
    facts = asof.latest_asof_facts(t.fundamentals, t.signals, "period_end").select(*cols).unionByName(
        asof.latest_asof_facts(t.estimates, t.signals, "fiscal_period").select(*cols))
    read = facts.unionByName(factors.change_sources(t.estimates, t.signals)).unionByName(factors.price_sources(t.prices, members, LOOKBACK, daily))
    return factors.snapshot_hash(members, read)


@query("F16_snapshot_hash", "signal_date:d n_companies:i n_sources:i source_snapshot_hash:s", "SELECT * FROM hashes")
def f16(t):
    return hashes(t)


@query("F17_persist_observations", "as_of_date:d company_id:s ticker:s sector:s factor_score:f elastic_score:f tree_score:f ml_score:f ensemble_score:f next_month_excess_return:f source_snapshot_hash:s "
       "roic:f beta_252d:f n_features:i", f"""
  SELECT s.signal_date AS as_of_date, s.company_id, s.ticker, s.sector, s.factor_score, p.factor_quality AS elastic_score, p.factor_low_risk AS tree_score, NULL AS ml_score, NULL AS ensemble_score,
         p.next_month_excess_return, h.source_snapshot_hash, s.roic, s.beta_252d, {len(FEATURES)} AS n_features
  FROM scored s LEFT JOIN labelled p ON p.signal_date = s.signal_date AND p.company_id = s.company_id LEFT JOIN hashes h ON h.signal_date = s.signal_date WHERE s.factor_score IS NOT NULL""")
def f17(t):
    scored = t.labelled.select("signal_date", "company_id", F.col("factor_quality").alias("elastic_score"), F.col("factor_low_risk").alias("tree_score"), "next_month_excess_return")
    daily = factors.daily_bars(t.prices)  # of the features and of the files they read
    out = factors.persist_observations(snapshot(t, daily), hashes(t, daily), scored)
    return out.withColumns({
        "roic": F.get_json_object("feature_json", "$.roic").cast("double"),
        "beta_252d": F.get_json_object("feature_json", "$.beta_252d").cast("double"),
        "n_features": F.size(F.json_object_keys("feature_json")),
    })


step("panel_rank", """
  SELECT f.*, CASE WHEN factor_score IS NOT NULL THEN (rank() OVER (PARTITION BY signal_date ORDER BY factor_score NULLS LAST)
         + (count(*) OVER (PARTITION BY signal_date, factor_score) - 1) / 2.0) / count(factor_score) OVER (PARTITION BY signal_date) END AS factor_rank,
         (rank() OVER (PARTITION BY signal_date ORDER BY ml_score) + (count(*) OVER (PARTITION BY signal_date, ml_score) - 1) / 2.0) / count(ml_score) OVER (PARTITION BY signal_date) AS ml_rank
  FROM factor_panel f""")


@query("F18_operational_rank", "signal_date:d company_id:s ticker:s factor_rank:f ml_score:f ensemble_score:f operational_score:f", """
  SELECT p.signal_date, p.company_id, p.ticker, coalesce(factor_rank, 0) AS factor_rank, coalesce(o.ml_score, 0) AS ml_score,
         0.5 * coalesce(factor_rank, 0) + 0.5 * coalesce(o.ml_score, 0) AS ensemble_score,
         0.5 * coalesce(factor_rank, 0) + 0.5 * coalesce(o.ml_score, 0) + 0.1 * least(1, greatest(-1, coalesce(short_horizon_score, 0))) AS operational_score
  FROM panel_rank p LEFT JOIN (
    SELECT s.signal_date, f.company_id, f.ml_score FROM signals s JOIN factor_panel f
    ON f.signal_date = (SELECT max(x.signal_date) FROM factor_panel x WHERE x.signal_date <= s.signal_date AND month(x.signal_date) % 2 = 0)) o
  ON o.signal_date = p.signal_date AND o.company_id = p.company_id
  LEFT JOIN overlay v ON v.signal_date = p.signal_date AND v.company_id = p.company_id""")
def f18(t):
    return factors.operational_rank(t.factor_panel, observations(t), factors.short_horizon_overlay(t.market_returns, t.instruments, t.signals))


@query("F19_percent_rank_avg", "signal_date:d company_id:s factor_rank:f ml_rank:f", "SELECT * FROM panel_rank")
def f19(t):
    return with_average_ranks(t.factor_panel, ["signal_date"], ["company_id"], {"factor_score": "factor_rank", "ml_score": "ml_rank"})


@query("F20_top_n_factor", "signal_date:d rank:i company_id:s ticker:s sector:s factor_score:f", """
  SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY signal_date ORDER BY factor_score DESC, company_id) AS rank
  FROM factor_panel f WHERE factor_score IS NOT NULL) q WHERE rank <= 25""")
def f20(t):
    return factors.top_n_factor(t.factor_panel, 25)


@query("F20_family_coverage", "signal_date:d companies:i investable:i " + " ".join(f"{c}:i" for c in factors.FAMILY_COLUMNS),
       "SELECT signal_date, count(*) AS companies, count(factor_score) AS investable, " + ", ".join(f"count({c}) AS {c}" for c in factors.FAMILY_COLUMNS)
       + " FROM factor_panel GROUP BY signal_date")
def f20b(t):
    return factors.family_coverage(t.factor_panel)


@query("F21_feature_range_profile", "signal_date:d feature:s coverage:i p01:f median:f p99:f", """
  SELECT signal_date, feature, count(v) AS coverage, quantile_cont(v, 0.01) AS p01, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.99) AS p99
  FROM panel_long GROUP BY signal_date, feature""")
def f21(t):
    return factors.feature_range_profile(t.factor_panel, PANEL)
