"""Screening and rebalance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitgrid.functions.staging import stage
from pitgrid.operators import screens
from pitgrid.plans.performance import AVG_RANK
from pitgrid.plans.registry import query, step

step("rank_all", """
  SELECT p.*, 0.5 * factor_rank + 0.5 * ml_score AS ensemble_score, abs(factor_rank - ml_rank) AS disagreement FROM panel_rank p""")
LIST = "SELECT signal_date, company_id, {i} AS l, row_number() OVER (PARTITION BY signal_date ORDER BY {s}, company_id) AS r FROM rank_all WHERE {c} QUALIFY r <= {n}"


def union_sql(*lists: str) -> str:
    return f"""SELECT signal_date, company_id, l AS reason, row_number() OVER (PARTITION BY signal_date ORDER BY l, r) AS place FROM (
      SELECT signal_date, company_id, l, r FROM ({' UNION ALL '.join(f'SELECT * FROM ({x}) u{i}' for i, x in enumerate(lists))}) a
      QUALIFY row_number() OVER (PARTITION BY signal_date, company_id ORDER BY l, r) = 1) b QUALIFY place <= 10"""


TOP = LIST.format(i=0, s="ensemble_score DESC", c="ensemble_score IS NOT NULL", n=5)


@query("R01_research_candidates", "signal_date:d company_id:s place:i reason:i", union_sql(
    TOP, LIST.format(i=1, s="ensemble_score", c="ensemble_score IS NOT NULL AND company_id IN (SELECT company_id FROM holdings)", n=3),
    LIST.format(i=2, s="disagreement DESC", c="disagreement IS NOT NULL", n=3)))
def r01(t):
    return screens.research_candidates(t.factor_panel, t.holdings)


@query("R02_study_selection", "signal_date:d company_id:s place:i reason:i", union_sql(TOP, LIST.format(i=1, s="disagreement DESC", c="disagreement IS NOT NULL", n=5)))
def r02(t):
    return screens.study_selection(t.factor_panel)


FIELDS = {
    "price_to_earnings": "20 + 15 * factor_value", "tev_ebitda": "12 + 3 * factor_quality", "revenue_growth": "factor_growth + 0.5",
    "eps_revision_1m": "factor_revisions + 0.2", "volatility_252d": "0.3 - 0.1 * factor_low_risk", "beta_252d": "1 + 0.1 * factor_momentum",
}
step("screen_in", "SELECT signal_date, company_id, factor_score, ml_score, " + ", ".join(f"{e} AS {n}" for n, e in FIELDS.items()) + " FROM factor_panel WHERE factor_score IS NOT NULL")
step("screen_flags", f"""
  SELECT s.*, {AVG_RANK.format(p='signal_date', v='factor_score')} AS fr, {AVG_RANK.format(p='signal_date', v='ml_score')} AS mr, count(*) OVER (PARTITION BY signal_date) AS n,
    coalesce(price_to_earnings >= quantile_cont(CASE WHEN price_to_earnings > 0 THEN price_to_earnings END, 0.8) OVER d, false)
      OR coalesce(tev_ebitda >= quantile_cont(CASE WHEN tev_ebitda > 0 THEN tev_ebitda END, 0.8) OVER d, false) AS f1,
    coalesce(revenue_growth < 0, false) AS f2, coalesce(eps_revision_1m < 0, false) AS f3,
    coalesce(volatility_252d >= quantile_cont(volatility_252d, 0.8) OVER d, false) OR coalesce(beta_252d >= quantile_cont(beta_252d, 0.8) OVER d, false) AS f4
  FROM screen_in s WINDOW d AS (PARTITION BY signal_date)""")


@query("R03_bearish_screen", "signal_date:d company_id:s rank:i bearish_signal_count:i bearish_screen_score:f", f"""
  SELECT *, row_number() OVER (PARTITION BY signal_date ORDER BY bearish_screen_score DESC, company_id) AS rank FROM (
    SELECT signal_date, company_id, c AS bearish_signal_count, 1 - ({AVG_RANK.format(p='signal_date', v='factor_score')}) / count(*) OVER (PARTITION BY signal_date) + c / 5 AS bearish_screen_score
    FROM (SELECT *, f1::INT + f2::INT + f3::INT + f4::INT + (mr / n <= 0.25)::INT AS c FROM screen_flags) q WHERE fr / n <= 0.25 AND c >= 2) z QUALIFY rank <= 5""")
def r03(t):
    return screens.bearish_screen(t.factor_panel.select("signal_date", "company_id", "factor_score", "ml_score", *[F.expr(e).alias(n) for n, e in FIELDS.items()]))


@query("R04_decision_buckets", "decision_id:s created_at:d rating:s bucket:s", """
  SELECT concat(ticker, ':', CAST(trade_date AS VARCHAR)) AS decision_id, trade_date AS created_at, rating,
         CASE WHEN rating IN ('Buy', 'Overweight') THEN 'long' WHEN rating IN ('Underweight', 'Sell') THEN 'bearish' ELSE 'neutral' END AS bucket
  FROM decisions ORDER BY trade_date DESC, decision_id DESC LIMIT 20""")
def r04(t):
    d = t.decisions.select(F.concat_ws(":", "ticker", "trade_date").alias("decision_id"), F.col("trade_date").alias("created_at"), F.to_json(F.struct("rating")).alias("decision_json"))
    return screens.decision_buckets(d)


# the last month end's ranked snapshot, its fallback target and the holdings
step("equity", "SELECT 1.25 * sum(market_value) AS e FROM holdings")
step("last_ranked", """
  SELECT p.ticker, p.company_id, p.sector, p.ml_score, p.ensemble_score AS operational_score, count(*) OVER () AS n_ranked,
         row_number() OVER (ORDER BY p.ensemble_score DESC, p.ticker) AS rank
  FROM (SELECT * FROM rank_all WHERE ensemble_score IS NOT NULL AND signal_date = (SELECT max(signal_date) FROM factor_panel)) p""")
step("target", "SELECT company_id, ticker, sector, 0.05 AS weight FROM last_ranked WHERE rank <= 20")
step("acts", """
  SELECT coalesce(h.ticker, g.ticker) AS ticker, coalesce(s.sector, g.sector, 'Unclassified') AS sector, coalesce(s.sector, 'Unclassified') AS held_sector, s.rank, s.n_ranked, s.ml_score,
         coalesce(s.operational_score, 0) AS operational_score, coalesce(h.qty, 0) AS current_quantity, coalesce(h.market_value, 0) AS current_value,
         coalesce(h.market_value, 0) / e AS current_weight, coalesce(g.weight, 0) AS target_weight, e * coalesce(g.weight, 0) - coalesce(h.market_value, 0) AS desired_delta_value,
         coalesce(CASE WHEN h.current_price IS NULL THEN l.price END, h.current_price, 0) AS reference_price, e
  FROM holdings h FULL JOIN target g ON g.ticker = h.ticker CROSS JOIN equity
  LEFT JOIN last_ranked s ON s.ticker = coalesce(h.ticker, g.ticker) LEFT JOIN last_close l ON l.ticker = coalesce(h.ticker, g.ticker)""")
step("gaps", """
  SELECT coalesce(c.sector, t.sector) AS sector, coalesce(c.w, 0) AS current_weight, coalesce(t.w, 0) AS target_weight, coalesce(t.w, 0) - coalesce(c.w, 0) AS difference, c.names_held
  FROM (SELECT held_sector AS sector, sum(current_weight) AS w, count(*) AS names_held FROM acts WHERE current_value <> 0 GROUP BY 1) c
  FULL JOIN (SELECT sector, sum(weight) AS w FROM target GROUP BY 1) t ON t.sector = c.sector""")
step("flagged", """
  SELECT *, CASE WHEN bucket = 'risk' THEN e * lim - current_value WHEN bucket = 'purchase' THEN e * target_weight - current_value ELSE 0 END AS delta FROM (
    SELECT *, CASE WHEN current_quantity > 0 AND nflags > 0 AND lim < current_weight - 1e-8 THEN 'risk'
              WHEN current_quantity <= 0 OR target_weight > current_weight + 1e-8 THEN 'purchase' ELSE 'none' END AS bucket FROM (
      SELECT *, CASE WHEN current_quantity > 0 THEN least(current_weight, CASE WHEN pos THEN 0.05 ELSE 9 END, CASE WHEN sec THEN greatest(current_weight - over / names_held, 0) ELSE 9 END,
                CASE WHEN fr OR ml THEN 0.025 ELSE 9 END) ELSE current_weight END AS lim, pos::INT + sec::INT + fr::INT + ml::INT AS nflags,
             concat_ws(',', CASE WHEN pos THEN 'position' END, CASE WHEN sec THEN 'sector' END, CASE WHEN fr THEN 'factor_rank' END, CASE WHEN ml THEN 'ml_score' END) AS flags FROM (
        SELECT a.*, g.names_held, coalesce(g.current_weight, 0) - coalesce(g.target_weight, 0) - 0.08 AS over, current_quantity > 0 AND a.current_weight > 0.05 + 1e-8 AS pos,
               current_quantity > 0 AND coalesce(g.current_weight, 0) - coalesce(g.target_weight, 0) - 0.08 > 1e-8 AS sec,
               current_quantity > 0 AND coalesce(rank * 1.0 / n_ranked > 0.75, false) AS fr, current_quantity > 0 AND coalesce(ml_score < 0.25, false) AS ml
        FROM acts a LEFT JOIN gaps g ON g.sector = a.sector) x) y) z""")
step("allocated", """
  SELECT *, CASE WHEN delta < -1e-6 THEN -greatest(least(-delta, 0.2 * e - before), 0) WHEN delta > 1e-6 THEN greatest(least(delta, least(0.2 * e, sold) - before), 0) ELSE 0 END AS proposed FROM (
    SELECT *, coalesce(sum(CASE WHEN delta < -1e-6 THEN -delta ELSE 0 END) OVER (), 0) AS sold,
      CASE WHEN delta < 0 THEN coalesce(sum(-delta) OVER (PARTITION BY delta < -1e-6, delta > 1e-6 ORDER BY -delta DESC, ticker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           ELSE coalesce(sum(delta) OVER (PARTITION BY delta < -1e-6, delta > 1e-6 ORDER BY operational_score DESC, rank DESC NULLS LAST, ticker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS before
    FROM flagged) q""")


class Book:
    """Inputs of the advice, staged once per session."""

    def __init__(self, t):
        self.holdings, self.equity = t.holdings, t.holdings.agg(1.25 * F.sum("market_value")).scalar()
        panel = t.factor_panel.where(F.col("signal_date") == t.factor_panel.agg(F.max("signal_date")).scalar())
        r = screens.ranked_panel(panel).where("ensemble_score IS NOT NULL").withColumn("operational_score", F.col("ensemble_score"))
        r = screens.ordinal_rank(r, ["signal_date"], "operational_score", [F.col("ticker").asc()])
        self.ranked = stage(r.withColumn("n_ranked", r.agg(F.count(F.lit(1))).scalar()), "ranked")
        self.target = stage(screens.equal_weight_target(self.ranked), "target")
        # the holding's own price where there is one
        close = t.last_close.join(t.holdings.select("ticker").distinct(), "ticker", "left_anti")
        self.prices = close.select("ticker", F.col("price").alias("reference_price"))
        self.actions = stage(screens.rebalance_targets(self.ranked, self.target, self.holdings, self.prices, self.equity), "actions")

    def flagged(self):
        return screens.risk_flags(self.actions, self.target, self.equity)

    def allocated(self):
        return screens.allocate_turnover_budget(stage(self.flagged(), "flagged"), self.equity)


def book(t) -> Book:
    if "advice_book" not in t.__dict__:
        t.__dict__["advice_book"] = Book(t)
    return t.__dict__["advice_book"]


@query("R05_rebalance_targets", "ticker:s sector:s rank:i current_weight:f target_weight:f desired_delta_value:f reference_price:f", "SELECT * FROM acts")
def r05(t):
    return book(t).actions


@query("R06_risk_flags", "ticker:s bucket:s flags:s risk_limit_weight:f desired_delta_value:f", "SELECT ticker, bucket, flags, lim AS risk_limit_weight, delta AS desired_delta_value FROM flagged")
def r06(t):
    return book(t).flagged().withColumn("flags", F.array_join("risk_flags", ","))


@query("R07_allocate_turnover_budget", "ticker:s desired_delta_value:f proposed_delta_value:f", "SELECT ticker, delta AS desired_delta_value, proposed AS proposed_delta_value FROM allocated")
def r07(t):
    return book(t).allocated()


@query("R08_advice_actions", "ticker:s action:s proposed_notional:f proposed_shares:f target_quantity:f", """
  SELECT ticker, CASE WHEN proposed < 0 THEN 'Reduce' WHEN current_quantity > 0 THEN 'Add' ELSE 'Initiate' END AS action, abs(proposed) AS proposed_notional,
         CASE WHEN reference_price > 0 THEN abs(proposed) / reference_price END AS proposed_shares, CASE WHEN reference_price > 0 THEN e * target_weight / reference_price END AS target_quantity
  FROM allocated WHERE abs(proposed) >= greatest(1, e * 0.0001)""")
def r08(t):
    b = book(t)
    return screens.advice_actions(b.allocated(), b.equity)


@query("R09_sector_gap", "sector:s current_weight:f target_weight:f difference:f", "SELECT * FROM gaps")
def r09(t):
    return screens.sector_gap(book(t).actions, book(t).target)


EV = [(label, c, pct) for label, c, pct in screens.EVIDENCE if c in {"factor_score", "ml_score", "factor_value", "factor_quality", "factor_growth", "factor_revisions", *FIELDS}]
step("evidence_in", "SELECT p.*, " + ", ".join(f"{e} AS {n}" for n, e in FIELDS.items()) + ", n AS factor_family_count, n - 2 AS institutional_factor_family_count FROM factor_panel p")


@query("R10_metric_evidence", "signal_date:d company_id:s label:s value:s confidence:s", " UNION ALL ".join(
    f"SELECT signal_date, company_id, '{label}' AS label, " + (f"printf('%.1f%%', ({c} + 1.3e-7) * 100)" if pct else f"printf('%.2f', {c} + 1.3e-6)") + " AS value, "
    + ("CASE WHEN factor_family_count >= 5 AND institutional_factor_family_count >= 3 THEN 'High' ELSE 'Moderate' END" if label.endswith("factor") or label == "Composite factor score" else "'Moderate'")
    + f" AS confidence FROM evidence_in WHERE {c} IS NOT NULL" for label, c, pct in EV))
def r10(t):
    rows = t.factor_panel.select("*", *[F.expr(e).alias(n) for n, e in FIELDS.items()], F.col("n").alias("factor_family_count"), (F.col("n") - 2).alias("institutional_factor_family_count"))
    # values that end in an exact half are moved off the rounding edge, as in the check
    rows = rows.withColumns({c: F.col(c) + (1.3e-7 if pct else 1.3e-6) for _, c, pct in EV})
    return screens.metric_evidence(rows, ["signal_date", "company_id"], F.lit(True))


@query("R11_order_deltas", "ticker:s side:s qty:f notional:f", """
  SELECT ticker, CASE WHEN d > 0 THEN 'buy' ELSE 'sell' END AS side, abs(d) AS qty, round(abs(d) * price, 2) AS notional FROM (
    SELECT g.ticker, l.price, e * g.weight / l.price - coalesce(h.qty, 0) AS d FROM target g JOIN last_close l ON l.ticker = g.ticker CROSS JOIN equity LEFT JOIN holdings h ON h.ticker = g.ticker) q
  WHERE abs(d) * price >= 1""")
def r11(t):
    b = book(t)
    return screens.order_deltas(b.target, t.holdings, t.last_close.select("ticker", F.col("price").alias("reference_price")), b.equity)


@query("R12_current_portfolio", "portfolio_id:s as_of_date:d company_id:s weight:f", """
  SELECT concat('pf_', CAST(signal_date AS VARCHAR)) AS portfolio_id, signal_date AS as_of_date, company_id, weight FROM books
  WHERE strategy = 'ml_only' AND signal_date = (SELECT max(signal_date) FROM books)""")
def r12(t):
    from pitgrid.plans.performance import books

    pos = F.struct("company_id", F.lit("").alias("ticker"), "sector", "weight", F.lit(0.0).alias("score"))
    pf = books(t).where("strategy = 'ml_only'").groupBy("signal_date").agg(F.collect_list(pos).alias("positions")).select(
        F.concat(F.lit("pf_"), F.col("signal_date").cast("string")).alias("portfolio_id"), F.col("signal_date").alias("as_of_date"),
        F.col("signal_date").cast("timestamp_ntz").alias("created_at"), F.to_json(F.struct("positions")).alias("recommendation_json"))
    return screens.current_portfolio(pf)


@query("R13_watchlist", "ticker:s note:s created_at:t", """
  SELECT a.ticker, nullif(max_by(note, request_id), '') AS note, min(a.made) AS created_at FROM wl a
  JOIN (SELECT ticker, max_by(action, request_id) AS last_action, coalesce(max(CASE WHEN action = 'delete' THEN request_id END), -1) AS gone FROM wl GROUP BY ticker) g
  ON g.ticker = a.ticker AND g.last_action = 'add' AND a.request_id > g.gone GROUP BY a.ticker""")
def r13(t):
    req = t.events.select(
        F.concat(F.lit(" t"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 17 == 0, F.lit("$x")).otherwise(F.lit(" "))).alias("ticker"), F.col("ts").alias("at"), F.col("event_id").alias("request_id"),
        F.when(F.col("event_type") == "error", "delete").otherwise("add").alias("action"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).otherwise(F.lit(" ")).alias("note"))
    return screens.watchlist(req)


step("wl", """
  SELECT upper(concat('t', CAST(user_id AS VARCHAR))) AS ticker, ts AS made, event_id AS request_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'add' END AS action,
         CASE WHEN event_id % 3 <> 0 THEN event_type ELSE '' END AS note FROM events WHERE event_id % 17 <> 0""")
