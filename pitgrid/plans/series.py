"""Series queries; the instrument is the company, so a rename does not break a series."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitgrid.operators import series
from pitgrid.plans.registry import query, step

W = "OVER (PARTITION BY company_id ORDER BY price_date ROWS BETWEEN {0} PRECEDING AND CURRENT ROW)"
K = "company_id:s price_date:d "


def day(s):
    return F.lit(s).cast("date")


def bars(t):
    return t.prices_best.select("company_id", "ticker", "price_date", "open", "high", "low", "close", "adjusted_close", "volume")


step("gappy", """
  SELECT company_id, price_date, CASE WHEN volume > 3 THEN open END AS open, high, low, CASE WHEN volume <= 48 THEN close END AS close,
         CASE WHEN volume > 5 THEN volume END AS volume FROM prices_best""")


def gappy(t):
    return t.prices_best.select(
        "company_id", "price_date", F.when(F.col("volume") > 3, F.col("open")).alias("open"), "high", "low",
        F.when(F.col("volume") <= 48, F.col("close")).alias("close"), F.when(F.col("volume") > 5, F.col("volume")).alias("volume"),
    )


@query("T01_clean_ohlcv", "company_id:s date:d open:f close:f volume:f", """
  SELECT company_id, price_date AS date, open, CASE WHEN volume <= 48 THEN close END AS close, volume FROM prices_best WHERE company_id <> '7'""")
def t01(t):
    text = t.prices_best.select(
        "company_id",
        F.when(F.col("company_id") == "7", F.lit("not a date")).otherwise(F.concat(F.col("price_date").cast("string"), F.lit("T23:30:00+09:00"))).alias("date"),
        F.col("open").cast("string").alias("open"),
        F.when(F.col("volume") <= 48, F.col("close").cast("string")).otherwise("n/a").alias("close"), F.col("volume").cast("string").alias("volume"),
    )
    return series.clean_ohlcv(text)


@query("T02_fill_price_gaps", K + "open:f close:f volume:f", """
  SELECT company_id, price_date, close,
         coalesce(last_value(open IGNORE NULLS) OVER a, first_value(open IGNORE NULLS) OVER b) AS open,
         coalesce(last_value(volume IGNORE NULLS) OVER a, first_value(volume IGNORE NULLS) OVER b) AS volume
  FROM (SELECT * FROM gappy WHERE close IS NOT NULL) g
  WINDOW a AS (PARTITION BY company_id ORDER BY price_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         b AS (PARTITION BY company_id ORDER BY price_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def t02(t):
    return series.fill_price_gaps(gappy(t), "company_id", "price_date")


@query("T03_sma", K + "sma50:f sma200:f", f"SELECT company_id, price_date, avg(close) {W.format(49)} AS sma50, avg(close) {W.format(199)} AS sma200 FROM prices_best")
def t03(t):
    return series.sma(series.sma(bars(t), "company_id", "price_date", "close", 50, "sma50"), "company_id", "price_date", "close", 200, "sma200")


def ewm_sql(src: str, x: str, alpha: str, out: str) -> str:
    """Adjusted exponential mean by walking the rows of every series."""
    return f"""(WITH RECURSIVE src_rows AS (SELECT company_id, price_date, {x} AS x, row_number() OVER (PARTITION BY company_id ORDER BY price_date) AS i FROM {src}),
      walk AS (SELECT company_id, price_date, i, coalesce(x, 0e0) AS num, CASE WHEN x IS NULL THEN 0e0 ELSE 1e0 END AS den FROM src_rows WHERE i = 1
        UNION ALL SELECT s.company_id, s.price_date, s.i, coalesce(s.x, 0e0) + (1 - {alpha}) * w.num, CASE WHEN s.x IS NULL THEN 0e0 ELSE 1e0 END + (1 - {alpha}) * w.den
        FROM walk w JOIN src_rows s ON s.company_id = w.company_id AND s.i = w.i + 1)
      SELECT company_id, price_date, CASE WHEN den > 0 THEN num / den END AS {out} FROM walk)"""


D = "CAST({0} AS DOUBLE) / {1}"
step("moves", """
  SELECT company_id, price_date, close, close - lag(close) OVER w AS chg,
         greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr
  FROM prices_best WINDOW w AS (PARTITION BY company_id ORDER BY price_date)""")
step("macd_base", f"SELECT a.*, a.e12 - b.e26 AS macd FROM {ewm_sql('prices_best', 'close', D.format(2, 13), 'e12')} a JOIN {ewm_sql('prices_best', 'close', D.format(2, 27), 'e26')} b USING (company_id, price_date)")
step("ema10", f"SELECT * FROM {ewm_sql('prices_best', 'close', D.format(2, 11), 'close_10_ema')} q")
step("macd_all", f"SELECT company_id, price_date, m.macd, s.macds, m.macd - s.macds AS macdh FROM macd_base m JOIN {ewm_sql('macd_base', 'macd', '0.2', 'macds')} s USING (company_id, price_date)")
step("rsi_all", f"""SELECT company_id, price_date, CASE WHEN dn > 0 THEN 100 - 100 / (1 + up / dn) WHEN up > 0 THEN 100 END AS rsi
  FROM {ewm_sql('moves', 'CASE WHEN chg > 0 THEN chg WHEN chg <= 0 THEN 0 END', D.format(1, 14), 'up')} a
  JOIN {ewm_sql('moves', 'CASE WHEN chg < 0 THEN -chg WHEN chg >= 0 THEN 0 END', D.format(1, 14), 'dn')} b USING (company_id, price_date)""")
step("atr_all", f"SELECT * FROM {ewm_sql('moves', 'tr', D.format(1, 14), 'atr')} q")


@query("T04_ema", K + "close_10_ema:f", "SELECT * FROM ema10")
def t04(t):
    return series.ema(bars(t), "company_id", "price_date", "close", 10, "close_10_ema")


@query("T05_macd", K + "macd:f macds:f macdh:f", "SELECT * FROM macd_all")
def t05(t):
    return series.macd(bars(t), "company_id", "price_date")


@query("T06_rsi", K + "rsi:f", "SELECT * FROM rsi_all")
def t06(t):
    return series.rsi(bars(t), "company_id", "price_date")


step("boll_all", f"""SELECT company_id, price_date, avg(close) {W.format(19)} AS boll, avg(close) {W.format(19)} + 2 * stddev_samp(close) {W.format(19)} AS boll_ub,
  avg(close) {W.format(19)} - 2 * stddev_samp(close) {W.format(19)} AS boll_lb FROM prices_best""")


@query("T07_bollinger", K + "boll:f boll_ub:f boll_lb:f", "SELECT * FROM boll_all")
def t07(t):
    return series.bollinger(bars(t), "company_id", "price_date")


@query("T08_atr", K + "atr:f", "SELECT * FROM atr_all")
def t08(t):
    return series.atr(bars(t), "company_id", "price_date")


@query("T09_vwma", K + "vwma:f", f"SELECT company_id, price_date, sum((high + low + close) / 3 * volume) {W.format(13)} / sum(volume) {W.format(13)} AS vwma FROM prices_best")
def t09(t):
    return series.vwma(bars(t), "company_id", "price_date")


@query("T10_mfi", K + "mfi:f", f"""
  SELECT company_id, price_date, CASE WHEN sum(pos + neg) {W.format(13)} > 0 THEN sum(pos) {W.format(13)} / sum(pos + neg) {W.format(13)} END AS mfi FROM (
    SELECT *, CASE WHEN tp > ptp THEN tp * volume ELSE 0 END AS pos, CASE WHEN tp < ptp THEN tp * volume ELSE 0 END AS neg FROM (
      SELECT *, lag(tp) OVER (PARTITION BY company_id ORDER BY price_date) AS ptp FROM (SELECT *, (high + low + close) / 3 AS tp FROM prices_best) a) b) c""")
def t10(t):
    return series.mfi(bars(t), "company_id", "price_date")


@query("T11_indicator_calendar", "company_id:s day:d value:f status:s", f"""
  SELECT c.company_id, c.day, s.sma50 AS value, CASE WHEN s.company_id IS NULL THEN 'N/A: Not a trading day (weekend or holiday)' ELSE 'value' END AS status
  FROM (SELECT company_id, CAST(unnest(generate_series(DATE '2001-06-30' - 120, DATE '2001-06-30', INTERVAL 1 DAY)) AS DATE) AS day
        FROM (SELECT DISTINCT company_id FROM prices_best WHERE price_date <= DATE '2001-06-30') d) c
  LEFT JOIN (SELECT company_id, price_date, avg(close) {W.format(49)} AS sma50 FROM prices_best) s ON s.company_id = c.company_id AND s.price_date = c.day""")
def t11(t):
    return series.indicator_calendar(series.sma(bars(t), "company_id", "price_date", "close", 50, "sma50"), "company_id", "price_date", "sma50", day("2001-06-30"), 120)


@query("T12_verified_snapshot", K + "close:f volume:f close_50_sma:f close_200_sma:f close_10_ema:f rsi:f boll_ub:f macd:f macds:f atr:f n_closes:i sum_closes:f", f"""
  SELECT p.company_id, p.price_date, p.close, p.volume, p.close_50_sma, p.close_200_sma, e.close_10_ema, r.rsi, b.boll_ub, m.macd, m.macds, a.atr, c.n_closes, c.sum_closes
  FROM (SELECT *, avg(close) {W.format(49)} AS close_50_sma, avg(close) {W.format(199)} AS close_200_sma,
          row_number() OVER (PARTITION BY company_id ORDER BY price_date DESC) AS back FROM (SELECT * EXCLUDE (rn) FROM prices_best WHERE price_date <= DATE '2001-06-30') z) p
  JOIN ema10 e USING (company_id, price_date) JOIN rsi_all r USING (company_id, price_date) JOIN boll_all b USING (company_id, price_date)
  JOIN macd_all m USING (company_id, price_date) JOIN atr_all a USING (company_id, price_date)
  JOIN (SELECT company_id, count(*) AS n_closes, sum(close) AS sum_closes FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY price_date DESC) AS k
        FROM prices_best WHERE price_date <= DATE '2001-06-30') y WHERE k <= 30 GROUP BY company_id) c USING (company_id)
  WHERE back = 1""")
def t12(t):
    out = series.verified_snapshot(bars(t), "company_id", "price_date", day("2001-06-30"))
    return out.withColumn("n_closes", F.size("recent_closes")).withColumn("sum_closes", F.aggregate("recent_closes", F.lit(0.0), lambda a, x: a + x))


step("ranked_bars", "SELECT ticker, price_date, close, row_number() OVER (PARTITION BY ticker ORDER BY price_date) AS i FROM prices_best")
step("outcomes", """
  SELECT d.ticker, d.trade_date, d.rating, CASE WHEN x.c5 IS NOT NULL AND y.c5 IS NOT NULL THEN x.c5 / x.c0 - 1 END AS raw_return,
         CASE WHEN x.c5 IS NOT NULL AND y.c5 IS NOT NULL THEN x.c5 / x.c0 - y.c5 / y.c0 END AS alpha_return,
         CASE WHEN x.c5 IS NOT NULL AND y.c5 IS NOT NULL THEN x.d5 END AS resolution_date
  FROM decisions d
  LEFT JOIN (SELECT d.ticker, d.trade_date, max(b.close) FILTER (WHERE b.i = f.i0) AS c0, max(b.close) FILTER (WHERE b.i = f.i0 + 5) AS c5, max(b.price_date) FILTER (WHERE b.i = f.i0 + 5) AS d5
    FROM decisions d JOIN (SELECT d.ticker, d.trade_date, min(b.i) AS i0 FROM decisions d JOIN ranked_bars b ON b.ticker = d.ticker AND b.price_date >= d.trade_date GROUP BY 1, 2) f
      ON f.ticker = d.ticker AND f.trade_date = d.trade_date
    JOIN ranked_bars b ON b.ticker = d.ticker GROUP BY 1, 2) x ON x.ticker = d.ticker AND x.trade_date = d.trade_date
  LEFT JOIN (SELECT f.trade_date, max(b.close) FILTER (WHERE b.i = f.i0) AS c0, max(b.close) FILTER (WHERE b.i = f.i0 + 5) AS c5
    FROM (SELECT d.trade_date, min(b.i) AS i0 FROM (SELECT DISTINCT trade_date FROM decisions) d JOIN ranked_bars b ON b.ticker = 'SPY' AND b.price_date >= d.trade_date GROUP BY 1) f
    JOIN ranked_bars b ON b.ticker = 'SPY' GROUP BY 1) y ON y.trade_date = d.trade_date""")


def outcomes(t):
    d = t.decisions.select("ticker", "trade_date", "rating").withColumn("benchmark", series.benchmark_by_suffix(F.col("ticker")))
    return series.holding_outcome(d, bars(t), max_days=None)  # bars are days apart in these tables


@query("T13_holding_outcome", "ticker:s trade_date:d rating:s raw_return:f alpha_return:f resolution_date:d", "SELECT * FROM outcomes")
def t13(t):
    return outcomes(t)


@query("T14_resolve_pending", "ticker:s trade_date:d rating:s pending:b resolved_on:d raw_return:f", """
  SELECT ticker, trade_date, rating, resolution_date IS NULL AS pending, resolution_date AS resolved_on, raw_return FROM outcomes WHERE resolution_date IS NULL
  UNION ALL SELECT * FROM (SELECT ticker, trade_date, rating, false, resolution_date, raw_return FROM outcomes WHERE resolution_date IS NOT NULL
  ORDER BY trade_date DESC, ticker DESC LIMIT 500) q""")
def t14(t):
    log = t.decisions.select("ticker", "trade_date", "rating", F.lit(True).alias("pending"), F.lit(None).cast("date").alias("resolved_on"))
    return series.resolve_pending(log, outcomes(t), max_resolved=500)


@query("T15_benchmark_by_suffix", "symbol:s benchmark:s", """
  SELECT symbol, CASE WHEN symbol LIKE '%.NS' THEN '^NSEI' WHEN symbol LIKE '%.BO' THEN '^BSESN' WHEN symbol LIKE '%.T' THEN '^N225' WHEN symbol LIKE '%.HK' THEN '^HSI'
    WHEN symbol LIKE '%.L' THEN '^FTSE' WHEN symbol LIKE '%.TO' THEN '^GSPTSE' WHEN symbol LIKE '%.AX' THEN '^AXJO' WHEN symbol LIKE '%.SS' THEN '000001.SS'
    WHEN symbol LIKE '%.SZ' THEN '399001.SZ' ELSE 'SPY' END AS benchmark
  FROM (SELECT concat('P', CAST(p_partkey AS STRING), CASE p_partkey % 11 WHEN 0 THEN '.NS' WHEN 1 THEN '.BO' WHEN 2 THEN '.T' WHEN 3 THEN '.HK' WHEN 4 THEN '.L'
        WHEN 5 THEN '.TO' WHEN 6 THEN '.AX' WHEN 7 THEN '.SS' WHEN 8 THEN '.SZ' WHEN 9 THEN '.B' ELSE '' END) AS symbol FROM part) p""")
def t15(t):
    suffixes = F.array(*[F.lit(s) for s in [".NS", ".BO", ".T", ".HK", ".L", ".TO", ".AX", ".SS", ".SZ", ".B", ""]])
    s = t.part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string"), F.get(suffixes, (F.col("p_partkey") % 11).cast("int"))).alias("symbol"))
    return s.withColumn("benchmark", series.benchmark_by_suffix(F.col("symbol")))


@query("T16_returns_history", K + "ret:f", """
  SELECT company_id, price_date, coalesce(adjusted_close / lag(adjusted_close) OVER (PARTITION BY company_id ORDER BY price_date) - 1, 0) AS ret
  FROM prices_best WHERE price_date <= DATE '2001-06-30'
  QUALIFY price_date IN (SELECT DISTINCT price_date FROM prices_best WHERE price_date <= DATE '2001-06-30' ORDER BY 1 DESC LIMIT 252)""")
def t16(t):
    return series.returns_history(bars(t), day("2001-06-30"))


@query("T17_latest_reference_price", "ticker:s price_date:d reference_price:f overall_date:d", """
  SELECT ticker, max(price_date) AS price_date, max_by(adjusted_close, price_date) AS reference_price, max(max(price_date)) OVER () AS overall_date
  FROM prices_best WHERE price_date BETWEEN DATE '2001-06-30' - 430 AND DATE '2001-06-30' AND adjusted_close > 0 GROUP BY ticker""")
def t17(t):
    return series.latest_reference_price(bars(t), day("2001-06-30"))


@query("T18_round_prices", K + "open:f high:f low:f close:f", """
  SELECT company_id, price_date, round(open, 2) AS open, round(high, 2) AS high, round(low, 2) AS low, round(close, 2) AS close
  FROM (SELECT company_id, price_date, open + 0.00001 AS open, high + 0.00001 AS high, low + 0.00001 AS low, close + 0.00001 AS close FROM prices_best) q
  WHERE price_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""")
def t18(t):
    # the shift keeps benchmark averages that end in an exact half off the rounding edge
    b = bars(t).withColumns({c: F.col(c) + 0.00001 for c in ("open", "high", "low", "close")})
    return series.round_prices(b, day("1996-01-01"), day("2000-12-31"))
