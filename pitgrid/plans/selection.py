"""Point-in-time selections over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitgrid.operators import asof, membership
from pitgrid.plans.bridge import ESTIMATE_METRICS, FUNDAMENTAL_METRICS
from pitgrid.plans.registry import query, step

step("visible_fund", """
  SELECT * FROM (
    SELECT s.signal_date, f.*, row_number() OVER (PARTITION BY s.signal_date, company_id, metric
           ORDER BY period_end DESC, effective_at DESC, as_of_date DESC, ingested_at DESC) AS rn
    FROM signals s JOIN fundamentals f ON f.effective_at < s.signal_date + INTERVAL 1 DAY AND f.as_of_date <= s.signal_date) q
  WHERE rn = 1""")
step("visible_est", """
  SELECT * FROM (
    SELECT s.signal_date, f.*, row_number() OVER (PARTITION BY s.signal_date, company_id, metric
           ORDER BY fiscal_period DESC, effective_at DESC, as_of_date DESC, ingested_at DESC) AS rn
    FROM signals s JOIN estimates f ON f.effective_at < s.signal_date + INTERVAL 1 DAY AND f.as_of_date <= s.signal_date) q
  WHERE rn = 1""")
step("universe", """
  SELECT s.signal_date, m.company_id, m.ticker, coalesce(i.sector, 'Unknown') AS sector, coalesce(i.company_name, m.ticker) AS company_name
  FROM signals s JOIN index_membership m ON m.index_code = 'SP500' AND m.member_from <= s.signal_date
   AND (m.member_to IS NULL OR m.member_to >= s.signal_date) AND m.effective_at < s.signal_date + INTERVAL 1 DAY
  LEFT JOIN (
    SELECT s.signal_date, i.company_id, i.company_name, i.sector,
           row_number() OVER (PARTITION BY s.signal_date, company_id ORDER BY effective_at DESC) AS rn
    FROM signals s JOIN instruments i ON i.effective_at < s.signal_date + INTERVAL 1 DAY) i
  ON i.signal_date = s.signal_date AND i.company_id = m.company_id AND i.rn = 1""")


@query("P01_latest_asof_facts", "signal_date:d company_id:s metric:s value:f source_file_id:s effective_at:t",
       "SELECT * FROM visible_fund")
def p01(t):
    return asof.latest_asof_facts(t.fundamentals, t.signals, "period_end")


@query("P02_pivot_metrics", "signal_date:d company_id:s revenue:f net_income:f market_cap:f price_to_earnings:f eps_prior_year:f",
       "SELECT signal_date, company_id, " + ", ".join(
           f"max(CASE WHEN metric = '{m}' THEN value END) AS {m}"
           for m in ("revenue", "net_income", "market_cap", "price_to_earnings", "eps_prior_year"))
       + " FROM visible_fund GROUP BY signal_date, company_id")
def p02(t):
    facts = asof.latest_asof_facts(t.fundamentals, t.signals, "period_end")
    return asof.pivot_metrics(facts, FUNDAMENTAL_METRICS)


@query("P03_universe_asof", "signal_date:d company_id:s ticker:s sector:s company_name:s", "SELECT * FROM universe")
def p03(t):
    return asof.universe_asof(t.index_membership, t.instruments, t.signals)


@query("P04_price_precedence", "company_id:s ticker:s price_date:d open:f high:f low:f close:f volume:f source:s source_file_id:s",
       "SELECT * FROM prices_best")
def p04(t):
    return asof.price_precedence(t.prices)


@query("P05_latest_returns_asof", "signal_date:d company_id:s return_1d:f return_1w:f return_1m:f", """
  SELECT * FROM (
    SELECT s.signal_date, r.*, row_number() OVER (PARTITION BY s.signal_date, company_id ORDER BY as_of_date DESC, effective_at DESC, ingested_at DESC) AS rn
    FROM signals s JOIN market_returns r ON r.as_of_date <= s.signal_date AND r.effective_at < s.signal_date + INTERVAL 1 DAY) q
  WHERE rn = 1""")
def p05(t):
    return asof.latest_returns_asof(t.market_returns, t.signals)


# observations exist for every second month end, so later dates must look back
OBS = "SELECT company_id, signal_date AS as_of_date, ml_score FROM factor_panel WHERE month(signal_date) % 2 = 0"


def observations(t):
    return t.factor_panel.where(F.month("signal_date") % 2 == 0).select("company_id", F.col("signal_date").alias("as_of_date"), "ml_score")


@query("P06_latest_score_asof", "signal_date:d score_date:d company_id:s ml_score:f", f"""
  SELECT s.signal_date, o.as_of_date AS score_date, o.company_id, o.ml_score
  FROM signals s JOIN ({OBS}) o ON o.as_of_date = (SELECT max(as_of_date) FROM ({OBS}) x WHERE x.as_of_date <= s.signal_date)""")
def p06(t):
    return asof.latest_score_asof(observations(t), t.signals)


@query("P07_evidence_asof", "signal_date:d company_id:s evidence_id:s label:s value:f unit:s effective_at:t", """
  SELECT signal_date, company_id, concat(source_file_id, ':', metric) AS evidence_id,
         list_aggregate(list_transform(string_split(metric, '_'), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS label,
         value, unit, effective_at
  FROM (SELECT signal_date, company_id, source_file_id, metric, value, unit, effective_at FROM visible_fund
        UNION ALL SELECT signal_date, company_id, source_file_id, metric, value, unit, effective_at FROM visible_est) u""")
def p07(t):
    return asof.evidence_asof(t.fundamentals, t.estimates, t.signals)


@query("P08_default_cutoff", "cutoff:d", """
  SELECT least(greatest((SELECT max(as_of_date) FROM fundamentals), (SELECT max(as_of_date) FROM estimates),
         (SELECT max(as_of_date) FROM market_returns)), DATE '2002-01-15') AS cutoff""")
def p08(t):
    return asof.default_cutoff(t.fundamentals, t.estimates, t.market_returns, t.prices, F.lit("2002-01-15").cast("date"))


@query("P09_content_window", "message_id:i ticker:s created_at:t", """
  SELECT * FROM messages WHERE CASE WHEN created_at IS NOT NULL
    THEN created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-12'
    ELSE TIMESTAMP '2024-01-11' >= TIMESTAMP '2024-01-11 12:00:00' - INTERVAL 1 DAY END""")
def p09(t):
    day = lambda s: F.lit(s).cast("date")
    return asof.content_window(t.messages, "created_at", day("2024-01-05"), day("2024-01-11"), F.lit("2024-01-11 12:00:00").cast("timestamp_ntz"))


@query("P10_vintage_asof", "signal_date:d series:s obs_date:d vintage:d value:f", """
  SELECT * FROM (
    SELECT s.signal_date, m.*, row_number() OVER (PARTITION BY s.signal_date, series, obs_date ORDER BY vintage DESC) AS rn
    FROM signals s JOIN macro m ON m.vintage <= s.signal_date AND m.obs_date BETWEEN s.signal_date - 365 AND s.signal_date) q
  WHERE rn = 1""")
def p10(t):
    return asof.vintage_asof(t.macro, t.signals, 365)


@query("P11_ticker_asof", "company_id:s ticker:s price_date:d ticker_at_date:s", """
  SELECT p.company_id, p.ticker, p.price_date,
    CASE WHEN p.ticker = 'SPY' THEN 'SPY'
         WHEN NOT EXISTS (SELECT 1 FROM index_membership m WHERE m.company_id = p.company_id AND m.ticker = p.ticker) THEN p.ticker
         WHEN NOT EXISTS (SELECT 1 FROM index_membership m WHERE m.company_id = p.company_id AND m.ticker = p.ticker
              AND m.member_from - 430 <= p.price_date AND (m.member_to IS NULL OR p.price_date <= m.member_to)) THEN NULL
         ELSE coalesce((SELECT min(m.ticker) FROM index_membership m WHERE m.company_id = p.company_id
              AND m.member_from <= p.price_date AND (m.member_to IS NULL OR p.price_date <= m.member_to)), p.ticker) END AS ticker_at_date
  FROM prices_best p""")
def p11(t):
    return asof.ticker_asof(asof.price_precedence(t.prices), t.index_membership)


@query("P12_symbol_company_map", "ticker:s company_id:s", """
  SELECT ticker, max_by(company_id, row(p, d)) AS company_id FROM (
    SELECT upper(ticker) AS ticker, company_id, 1 AS p, CAST(effective_at AS DATE) AS d FROM instruments
    UNION ALL SELECT upper(ticker), company_id, 0, member_from FROM index_membership
    WHERE member_from <= DATE '2001-12-31' AND (member_to IS NULL OR member_to >= DATE '1995-01-01')) u GROUP BY ticker
  UNION ALL SELECT 'SPY', 'BENCHMARK:SPY'""")
def p12(t):
    day = lambda s: F.lit(s).cast("date")
    return asof.symbol_company_map(t.instruments, t.index_membership, day("1995-01-01"), day("2001-12-31"))


SEED_DAY = "2023-12-31"
step("share_classes", """
  SELECT DISTINCT concat('T', CAST(user_id AS STRING)) AS ticker, concat('T', CAST(user_id - user_id % 10 AS STRING)) AS canonical
  FROM events WHERE user_id % 10 < 3""")
step("ident", """
  SELECT t.ticker, coalesce(s.canonical, t.ticker) AS canonical,
         coalesce(c.company_id, o.company_id, g.company_id, concat('PUBLICSP500:', coalesce(s.canonical, t.ticker))) AS company_id
  FROM (SELECT DISTINCT ticker FROM membership_events UNION SELECT ticker FROM membership_seed) t
  LEFT JOIN share_classes s ON s.ticker = t.ticker
  LEFT JOIN (SELECT ticker, min(company_id) AS company_id FROM instruments GROUP BY ticker) c ON c.ticker = coalesce(s.canonical, t.ticker)
  LEFT JOIN (SELECT ticker, min(company_id) AS company_id FROM instruments GROUP BY ticker) o ON o.ticker = t.ticker
  LEFT JOIN (SELECT x.canonical, min(i.company_id) AS company_id FROM share_classes x JOIN instruments i ON i.ticker = x.ticker GROUP BY x.canonical) g ON g.canonical = coalesce(s.canonical, t.ticker)""")
step("event_days", f"""
  SELECT i.company_id, i.ticker, i.canonical, d.day,
         coalesce((SELECT max_by(e.action, e.day) FROM membership_events e WHERE e.ticker = i.ticker AND e.day <= d.day) = 'added',
                  i.ticker IN (SELECT ticker FROM membership_seed)
                  AND NOT EXISTS (SELECT 1 FROM membership_events e WHERE e.ticker = i.ticker AND e.day <= d.day), false) AS present
  FROM ident i JOIN (
     SELECT DISTINCT i.company_id, e.day FROM membership_events e JOIN ident i ON i.ticker = e.ticker
     UNION SELECT company_id, DATE '{SEED_DAY}' FROM ident) d ON d.company_id = i.company_id""")


def share_classes(t):
    return t.events.where(F.col("user_id") % 10 < 3).select(
        F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("ticker"),
        F.concat(F.lit("T"), (F.col("user_id") - F.col("user_id") % 10).cast("string")).alias("canonical"),
    ).distinct()


def seed_day():
    return F.lit(SEED_DAY).cast("date")


@query("P13_membership_intervals", "company_id:s ticker:s member_from:d member_to:d", """
  SELECT company_id, rep AS ticker, day AS member_from, next_day - 1 AS member_to FROM (
    SELECT company_id, day, rep, lead(day) OVER (PARTITION BY company_id ORDER BY day) AS next_day FROM (
      SELECT company_id, day, rep, lag(rep) OVER (PARTITION BY company_id ORDER BY day) AS prev_rep FROM (
        SELECT company_id, day, coalesce(min(CASE WHEN present AND ticker = canonical THEN ticker END), min(CASE WHEN present THEN ticker END)) AS rep
        FROM event_days GROUP BY company_id, day) a) b
    WHERE rep IS DISTINCT FROM prev_rep) c
  WHERE rep IS NOT NULL""")
def p13(t):
    return membership.membership_intervals(
        t.membership_seed, t.membership_events, seed_day(), membership.ticker_company_map(t.instruments), share_classes(t)
    )


@query("P14_collapse_share_classes", "company_id:s ticker:s n_classes:i", """
  SELECT company_id, coalesce(min(CASE WHEN ticker = canonical THEN ticker END), min(ticker)) AS ticker, count(*) AS n_classes
  FROM ident WHERE ticker IN (SELECT DISTINCT ticker FROM membership_events) GROUP BY company_id""")
def p14(t):
    roster = t.membership_events.select("ticker").distinct()
    return membership.collapse_share_classes(roster, membership.ticker_company_map(t.instruments), share_classes(t))


@query("P15_membership_noops", "ticker:s day:d action:s n_noops:i", """
  SELECT ticker, day, action, 1 AS n_noops FROM (
    SELECT e.*, coalesce(lag(action) OVER (PARTITION BY ticker ORDER BY day),
           CASE WHEN ticker IN (SELECT ticker FROM membership_seed) THEN 'added' ELSE 'removed' END) AS before
    FROM membership_events e) q WHERE before = action""")
def p15(t):
    return membership.membership_noops(t.membership_seed, t.membership_events)


@query("P16_roster_reconcile", "ticker:s in_rebuilt:b in_published:b", """
  SELECT coalesce(a.ticker, b.ticker) AS ticker, a.ticker IS NOT NULL AS in_rebuilt, b.ticker IS NOT NULL AS in_published
  FROM (SELECT ticker FROM ident i WHERE coalesce((SELECT max_by(action, day) FROM membership_events e WHERE e.ticker = i.ticker),
          CASE WHEN ticker IN (SELECT ticker FROM membership_seed) THEN 'added' END) = 'added') a
  FULL JOIN (SELECT ticker FROM membership_seed) b ON a.ticker = b.ticker
  WHERE a.ticker IS NULL OR b.ticker IS NULL""")
def p16(t):
    return membership.roster_reconcile(t.membership_seed, t.membership_events, seed_day(), t.membership_seed)


@query("P16_roster_band", "min_size:i max_size:i in_band:b", f"""
  SELECT min(size) AS min_size, max(size) AS max_size, min(size) >= 10 AND max(size) <= 400 AS in_band FROM (
    SELECT day, sum(net) OVER (ORDER BY day) AS size FROM (
      SELECT day, sum(CASE WHEN action = 'added' THEN 1 ELSE -1 END) AS net FROM (
        SELECT e.*, coalesce(lag(action) OVER (PARTITION BY ticker ORDER BY day),
               CASE WHEN ticker IN (SELECT ticker FROM membership_seed) THEN 'added' ELSE 'removed' END) AS before
        FROM membership_events e) q WHERE before <> action GROUP BY day
      UNION ALL SELECT DATE '{SEED_DAY}', count(*) FROM membership_seed) d) z""")
def p16b(t):
    return membership.roster_band(t.membership_seed, t.membership_events, seed_day(), (10, 400))


@query("P17_staleness_check", "ticker:s latest_date:d age_days:i is_stale:b", """
  SELECT ticker, max(price_date) AS latest_date, date_diff('day', max(price_date), DATE '2001-11-10') AS age_days,
         date_diff('day', max(price_date), DATE '2001-11-10') > 10 AS is_stale
  FROM prices WHERE price_date <= DATE '2001-11-10' GROUP BY ticker""")
def p17(t):
    return asof.staleness_check(t.prices, "ticker", "price_date", F.lit("2001-11-10").cast("date"))


@query("P18_unsettled_last_bar", "ticker:s last_date:d is_unsettled:b", """
  SELECT ticker, max(price_date) AS last_date, max_by(volume > 40, price_date) AS is_unsettled
  FROM prices_best WHERE price_date BETWEEN DATE '1996-01-01' AND DATE '2001-06-30' GROUP BY ticker""")
def p18(t):
    # a bar with heavy volume counts as not settled yet: its close is blank
    bars = asof.price_precedence(t.prices).withColumn("close", F.when(F.col("volume") <= 40, F.col("close")))
    return asof.unsettled_last_bar(bars, "ticker", "price_date", "close", F.lit("1996-01-01").cast("date"), F.lit("2001-06-30").cast("date"))


step("resolved_decisions", """
  SELECT d.ticker, d.trade_date, d.rating, (SELECT min(s.signal_date) FROM signals s WHERE s.signal_date > d.trade_date + 40) AS resolved
  FROM decisions d""")


def resolved_decisions(t):
    """Each decision is known to have worked out at the first month end more than 40 days later."""
    neg = lambda c: -F.datediff(c, F.lit("1970-01-01"))  # noqa: E731  next date = as-of join in reversed time
    s = t.signals.select("signal_date", F.lit(1).alias("_k"), neg(F.date_sub("signal_date", 41)).alias("_neg"))
    days = t.decisions.select("trade_date", F.lit(1).alias("_k"), neg("trade_date").alias("_neg")).distinct()
    known = asof.asof_join(days, s, ["_k"], "_neg", "_neg", ["signal_date"]).select("trade_date", F.col("signal_date").alias("resolved"))
    return t.decisions.join(known, "trade_date").select("ticker", "trade_date", "rating", "resolved")


@query("P19_lessons_asof", "ask_ticker:s as_of:d kind:s rank:i ticker:s trade_date:d resolved:d rating:s", """
  SELECT * FROM (
    SELECT a.ask_ticker, a.as_of, r.*, CASE WHEN r.ticker = a.ask_ticker THEN 'same' ELSE 'cross' END AS kind,
           row_number() OVER (PARTITION BY a.ask_ticker, a.as_of, r.ticker = a.ask_ticker ORDER BY r.trade_date DESC, r.ticker DESC) AS rank
    FROM (SELECT DISTINCT ticker AS ask_ticker, trade_date AS as_of FROM decisions) a
    JOIN resolved_decisions r ON r.resolved <= a.as_of) q
  WHERE rank <= CASE kind WHEN 'same' THEN 5 ELSE 3 END""")
def p19(t):
    asks = t.decisions.select(F.col("ticker").alias("ask_ticker"), F.col("trade_date").alias("as_of"))
    return asof.lessons_asof(resolved_decisions(t), asks)


# all sources, and as a benchmark the lowest close of each day
step("raw_bench", """
  SELECT company_id, ticker, price_date, adjusted_close, source, ingested_at, source_file_id FROM raw_prices
  UNION ALL SELECT 'BENCHMARK:SPY', 'SPY', price_date, min(adjusted_close), 'yahoo_adjusted', max(ingested_at), 'src_spy' FROM raw_prices GROUP BY price_date""")


@query("P20_extreme_return_in_membership", "company_id:s ticker:s price_date:d prev_close:f adjusted_close:f move:f", """
  SELECT * FROM (
    SELECT company_id, ticker, price_date, adjusted_close, lag(adjusted_close) OVER (PARTITION BY company_id, ticker ORDER BY price_date) AS prev_close,
           adjusted_close / lag(adjusted_close) OVER (PARTITION BY company_id, ticker ORDER BY price_date) - 1 AS move
    FROM (SELECT *, row_number() OVER (PARTITION BY company_id, price_date ORDER BY
               CASE source WHEN 'capital_iq' THEN 0 WHEN 'yahoo_adjusted' THEN 1 WHEN 'alpaca_iex_adjusted' THEN 2 ELSE 3 END, ingested_at DESC, source_file_id DESC) AS rn FROM raw_bench) r WHERE rn = 1) q
  WHERE abs(move) > 3.0 AND (ticker = 'SPY' OR EXISTS (SELECT 1 FROM index_membership m WHERE m.company_id = q.company_id
        AND m.member_from <= q.price_date AND (m.member_to IS NULL OR m.member_to >= q.price_date)))""")
def p20(t):
    cols = ["company_id", "ticker", "price_date", "adjusted_close", "source", "ingested_at", "source_file_id"]
    bench = t.raw_prices.groupBy("price_date").agg(F.min("adjusted_close").alias("adjusted_close"), F.max("ingested_at").alias("ingested_at")).withColumns(
        {"company_id": F.lit("BENCHMARK:SPY"), "ticker": F.lit("SPY"), "source": F.lit("yahoo_adjusted"), "source_file_id": F.lit("src_spy")})
    every = t.raw_prices.select(*cols).unionByName(bench.select(*cols))
    return asof.extreme_return_in_membership(asof.price_precedence(every), t.index_membership)


@query("P21_monthly_latest_snapshot_best", "period:d snapshot_date:d covered:i active_count:i ratio:f", """
  SELECT period, snapshot_date, covered, active_count, ratio FROM (
    SELECT q.*, row_number() OVER (PARTITION BY period ORDER BY ratio DESC, snapshot_date) AS rn FROM (
      SELECT price_date AS snapshot_date, date_trunc('quarter', price_date) AS period, count(*) AS active_count,
             count(*) FILTER (WHERE volume > 30) AS covered, count(*) FILTER (WHERE volume > 30) / count(*) AS ratio
      FROM prices_best GROUP BY price_date) q) z WHERE rn = 1""")
def p21(t):
    cov = asof.price_precedence(t.prices).groupBy(F.col("price_date").alias("snapshot_date")).agg(
        F.count(F.lit(1)).alias("active_count"), F.count_if(F.col("volume") > 30).alias("covered")
    )
    return asof.best_snapshot_per_period(cov, "quarter")


@query("P02_pivot_estimates", "signal_date:d company_id:s eps_estimate:f eps_analyst_count_1m:f eps_up_revisions_3m:f",
       "SELECT signal_date, company_id, " + ", ".join(
           f"max(CASE WHEN metric = '{m}' THEN value END) AS {m}" for m in ("eps_estimate", "eps_analyst_count_1m", "eps_up_revisions_3m"))
       + " FROM visible_est GROUP BY signal_date, company_id")
def p02b(t):
    return asof.pivot_metrics(asof.latest_asof_facts(t.estimates, t.signals, "fiscal_period"), ESTIMATE_METRICS)
