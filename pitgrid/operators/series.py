"""Price series: cleaning, technical indicators, outcomes. One row per symbol and day is assumed,
so a window per symbol is bounded by the trading calendar."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pitgrid.functions.groups import top_k
from pitgrid.operators.asof import asof_join

PRICE_FIELDS = ("open", "high", "low", "close", "volume")
BLOCK = 256

# Exchange suffix to benchmark index.
BENCHMARK_BY_SUFFIX = {
    ".NS": "^NSEI", ".BO": "^BSESN", ".T": "^N225", ".HK": "^HSI", ".L": "^FTSE",
    ".TO": "^GSPTSE", ".AX": "^AXJO", ".SS": "000001.SS", ".SZ": "399001.SZ",
}
DEFAULT_BENCHMARK = "SPY"

# Indicators of the verified snapshot.
SNAPSHOT_INDICATORS = (
    "close_10_ema", "close_50_sma", "close_200_sma", "rsi", "boll", "boll_ub", "boll_lb", "macd", "macds", "macdh", "atr",
)


def clean_ohlcv(df: DataFrame, date: str = "date") -> DataFrame:
    """The bar's own local date (offset dropped, not shifted); bad dates go, bad numbers become NULL."""
    out = df.withColumn(date, F.try_to_date(F.substring(F.trim(F.col(date).cast("string")), 1, 10), "yyyy-MM-dd"))
    return out.where(F.col(date).isNotNull()).withColumns(
        {c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in PRICE_FIELDS if c in df.columns}
    )


def fill_price_gaps(df: DataFrame, symbol: str, date: str) -> DataFrame:
    """Rows without close go; other fields are filled forward, then backward."""
    w = W.partitionBy(symbol).orderBy(date)
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    kept = df.where(F.col("close").isNotNull())
    return kept.withColumns({
        c: F.coalesce(F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(ahead)) for c in PRICE_FIELDS if c in df.columns
    })


def _last(symbol: str, date: str, n: int):
    return W.partitionBy(symbol).orderBy(date).rowsBetween(-(n - 1), 0)


def sma(df: DataFrame, symbol: str, date: str, value: str, n: int, out: str) -> DataFrame:
    """Mean of the last n rows, fewer at the start.

    A frame of n rows is added up anew for every row, so a long one is put together from short ones: sums of m rows, taken m rows apart
    by ``lag``, and one of the rest. Only rows of the window enter its sum, and all passes share one sort.
    """
    w = W.partitionBy(symbol).orderBy(date)
    m = math.ceil(math.sqrt(2 * n))
    if n <= 2 * m:
        return df.withColumn(out, F.avg(value).over(_last(symbol, date, n)))
    part = lambda k: F.struct(F.sum(F.col(value).cast("double")).over(_last(symbol, date, k)).alias("s"), F.count(value).over(_last(symbol, date, k)).alias("n"))
    parts, rest = n // m, n % m
    columns = {"_m": part(m)} | ({"_rest": part(rest)} if rest else {})
    late = {f"_m{i}": F.lag("_m", i * m).over(w) for i in range(1, parts)} | ({f"_m{parts}": F.lag("_rest", parts * m).over(w)} if rest else {})
    names = ["_m", *late]
    total = reduce(add, [F.coalesce(F.col(f"{c}.s"), F.lit(0.0)) for c in names])
    known = reduce(add, [F.coalesce(F.col(f"{c}.n"), F.lit(0)) for c in names])
    mean = F.when(known > 0, total / known)
    return df.withColumns(columns).withColumns(late).withColumn(out, mean).drop(*columns, *late)


def ewm(df: DataFrame, symbol: str, date: str, values: dict[str, tuple[Column, float]]) -> DataFrame:
    """Exponentially weighted means with adjusted weights: out name -> (input, alpha).

    Rows are numbered and cut into blocks of 256. Inside a block the weighted sum is a plain
    running sum of x / q^pos rescaled by q^pos; what all earlier blocks add is folded from the sums at
    their last rows, one per 256 rows of the calendar. All passes are windows of one symbol, so rows are shuffled once and joined with nothing.
    Leading NULLs (no change on a first day) get no weight. With alpha = 1 only the row itself has weight. Rows of no symbol start anew with each block.
    """
    out = _ewm(_blocks(df, symbol, date), symbol, values)
    return out.select(*[c for c in out.columns if not c.startswith("_")])


def _blocks(df: DataFrame, symbol: str, date: str) -> DataFrame:
    """Rows with their block and their place in it."""
    df = df.withColumn("_i", F.row_number().over(W.partitionBy(symbol).orderBy(date)) - 1)
    return df.withColumn("_blk", F.floor(F.col("_i") / BLOCK)).withColumn("_pos", F.col("_i") % BLOCK).drop("_i")


def _ewm(df: DataFrame, symbol: str, values: dict[str, tuple[Column, float]]) -> DataFrame:
    """``ewm`` of rows with ``_blk`` and ``_pos``, which stay."""
    whole = {o: x for o, (x, a) in values.items() if a >= 1}
    values = {o: v for o, v in values.items() if o not in whole}
    if whole:
        df = df.withColumns({o: x.cast("double") for o, x in whole.items()})
    if not values:
        return df
    given = df.columns
    inside = W.partitionBy(symbol, "_blk").orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(symbol).orderBy("_blk", "_pos").rowsBetween(W.unboundedPreceding, -1)  # in the order of the other window
    df = df.withColumns({f"_x_{o}": x for o, (x, _) in values.items()})
    local = {}
    for o, (_, a) in values.items():
        q = F.lit(1.0 - a)
        for tag, term in (("n", F.coalesce(F.col(f"_x_{o}"), F.lit(0.0))), ("d", F.col(f"_x_{o}").isNotNull().cast("double"))):
            local[f"_{tag}_{o}"] = F.sum(term * F.pow(q, -F.col("_pos"))).over(inside) * F.pow(q, F.col("_pos"))
    df = df.withColumns(local)
    ends = F.when((F.col("_pos") == BLOCK - 1) & F.col(symbol).isNotNull(), F.struct(*local))
    df = df.withColumn("_ends", F.collect_list(ends).over(earlier))
    out = {}
    for o, (_, a) in values.items():
        decay = F.pow(F.lit(1.0 - a), F.col("_pos") + 1)
        carried = {tag: F.aggregate("_ends", F.lit(0.0), _decayed((1.0 - a) ** BLOCK, f"_{tag}_{o}")) for tag in ("n", "d")}
        num = F.col(f"_n_{o}") + decay * carried["n"]
        den = F.col(f"_d_{o}") + decay * carried["d"]
        out[o] = F.when(F.col(f"_x_{o}").isNotNull() & (den > 0), num / den)
    return df.select(*[c for c in given if c not in out], *[e.alias(o) for o, e in out.items()])


def _decayed(rate: float, name: str):
    return lambda total, x: total * F.lit(rate) + x[name]


def ema(df: DataFrame, symbol: str, date: str, value: str, n: int, out: str) -> DataFrame:
    """alpha = 2 / (n + 1)."""
    return ewm(df, symbol, date, {out: (F.col(value), 2.0 / (n + 1))})


def macd(df: DataFrame, symbol: str, date: str, value: str = "close") -> DataFrame:
    """EMA12 - EMA26, its EMA9 and the difference."""
    df = _ewm(_blocks(df, symbol, date), symbol, {"ema12": (F.col(value), 2.0 / 13), "ema26": (F.col(value), 2.0 / 27)})
    df = df.withColumn("macd", F.col("ema12") - F.col("ema26")).drop("ema12", "ema26")
    df = _ewm(df, symbol, {"macds": (F.col("macd"), 0.2)})
    return df.select(*[c for c in df.columns if not c.startswith("_")]).withColumn("macdh", F.col("macd") - F.col("macds"))


def rsi(df: DataFrame, symbol: str, date: str, value: str = "close", n: int = 14) -> DataFrame:
    """100 - 100 / (1 + smoothed up / smoothed down)."""
    w = W.partitionBy(symbol).orderBy(date)
    df = df.withColumn("chg", F.col(value) - F.lag(value).over(w))
    df = ewm(df, symbol, date, {"up": (F.greatest("chg", F.lit(0.0)) + F.lit(0.0) * F.col("chg"), 1.0 / n),
                                "dn": (F.greatest(-F.col("chg"), F.lit(0.0)) + F.lit(0.0) * F.col("chg"), 1.0 / n)})
    value = F.when(F.col("dn") > 0, 100 - 100 / (1 + F.col("up") / F.col("dn"))).when(F.col("up") > 0, F.lit(100.0))
    return df.withColumn("rsi", value).drop("chg", "up", "dn")


def bollinger(df: DataFrame, symbol: str, date: str, value: str = "close", n: int = 20) -> DataFrame:
    """Mean of 20 rows and the band of two sample deviations."""
    w = _last(symbol, date, n)
    sd = F.stddev_samp(value).over(w)
    return df.withColumn("boll", F.avg(value).over(w)).withColumn("boll_ub", F.col("boll") + 2 * sd).withColumn("boll_lb", F.col("boll") - 2 * sd)


def atr(df: DataFrame, symbol: str, date: str, n: int = 14) -> DataFrame:
    """Smoothed true range."""
    pc = F.lag("close").over(W.partitionBy(symbol).orderBy(date))
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))
    return ewm(df.withColumn("tr", tr), symbol, date, {"atr": (F.col("tr"), 1.0 / n)})


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def vwma(df: DataFrame, symbol: str, date: str, n: int = 14) -> DataFrame:
    """Volume-weighted mean of the typical price."""
    w = _last(symbol, date, n)
    return df.withColumn("vwma", F.sum(typical() * F.col("volume")).over(w) / F.nullif(F.sum("volume").over(w), F.lit(0.0)))


def mfi(df: DataFrame, symbol: str, date: str, n: int = 14) -> DataFrame:
    """Positive share of the money flow of n rows."""
    step = W.partitionBy(symbol).orderBy(date)
    df = df.withColumn("_tp", typical()).withColumn("_ptp", F.lag("_tp").over(step))
    flow = F.col("_tp") * F.col("volume")
    pos, neg = F.when(F.col("_tp") > F.col("_ptp"), flow).otherwise(0.0), F.when(F.col("_tp") < F.col("_ptp"), flow).otherwise(0.0)
    w = _last(symbol, date, n)
    p, m = F.sum(pos).over(w), F.sum(neg).over(w)
    return df.withColumn("mfi", F.when(p + m > 0, p / (p + m))).drop("_tp", "_ptp")


def indicator_calendar(values: DataFrame, symbol: str, date: str, value: str, end: Column, look_back_days: int) -> DataFrame:
    """One row per calendar day of the look-back; days without a bar are marked."""
    days = values.where(F.col(date) <= end).select(symbol).distinct().select(
        symbol, F.explode(F.sequence(F.date_sub(end, look_back_days), end)).alias("day")
    )
    bars = values.select(F.col(symbol).alias("_s"), F.col(date).alias("_d"), F.col(value).alias("_v"))
    joined = days.join(bars, (F.col(symbol) == F.col("_s")) & (F.col("day") == F.col("_d")), "left")
    text = F.when(F.col("_s").isNull(), "N/A: Not a trading day (weekend or holiday)").when(F.col("_v").isNull(), "N/A").otherwise("value")
    return joined.select(symbol, "day", F.col("_v").alias("value"), text.alias("status"))


def indicators(df: DataFrame, symbol: str, date: str) -> DataFrame:
    """All snapshot indicators; T03 to T08 share their passes where they can."""
    out = sma(sma(df, symbol, date, "close", 50, "close_50_sma"), symbol, date, "close", 200, "close_200_sma")
    out = bollinger(out, symbol, date)
    w = W.partitionBy(symbol).orderBy(date)
    pc = F.lag("close").over(w)
    out = out.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)))
    out = out.withColumn("chg", F.col("close") - pc)
    out = _ewm(_blocks(out, symbol, date), symbol, {
        "close_10_ema": (F.col("close"), 2.0 / 11), "ema12": (F.col("close"), 2.0 / 13), "ema26": (F.col("close"), 2.0 / 27),
        "atr": (F.col("tr"), 1.0 / 14), "up": (F.greatest("chg", F.lit(0.0)) + F.lit(0.0) * F.col("chg"), 1.0 / 14),
        "dn": (F.greatest(-F.col("chg"), F.lit(0.0)) + F.lit(0.0) * F.col("chg"), 1.0 / 14),
    })
    out = out.withColumn("macd", F.col("ema12") - F.col("ema26"))
    out = _ewm(out, symbol, {"macds": (F.col("macd"), 0.2)})
    r = F.when(F.col("dn") > 0, 100 - 100 / (1 + F.col("up") / F.col("dn"))).when(F.col("up") > 0, F.lit(100.0))
    out = out.select(*[c for c in out.columns if not c.startswith("_")])
    return out.withColumn("macdh", F.col("macd") - F.col("macds")).withColumn("rsi", r).drop("ema12", "ema26", "tr", "chg", "up", "dn")


def verified_snapshot(df: DataFrame, symbol: str, date: str, on: Column, look_back_rows: int = 30) -> DataFrame:
    """Latest bar at or before the date with its indicators and the recent closes."""
    full = indicators(df.where(F.col(date) <= on), symbol, date)
    n = max(1, min(look_back_rows, 30))
    recent = top_k(full, [symbol], [F.col(date).desc()], n, "_rn").groupBy(symbol).agg(
        F.max(F.struct(date, *[c for c in full.columns if c not in (symbol, date)])).alias("m"),
        F.transform(F.array_sort(F.collect_list(F.struct(date, "close"))), lambda s: s["close"]).alias("recent_closes"),
    )
    return recent.select(symbol, "m.*", "recent_closes")


def holding_outcome(decisions: DataFrame, bars: DataFrame, symbol: str = "ticker", holding: int = 5, max_days: int | None = 12) -> DataFrame:
    """Return from the first bar at or after the trade date to the bar ``holding`` rows later.

    Both bars must lie before ``max_days`` after the trade date, else the outcome stays pending; None sets no such window.
    ``decisions`` has symbol, trade_date and benchmark. Each bar carries the close
    ``holding`` rows ahead, so a decision needs one as-of lookup per series.
    """
    w = W.partitionBy(symbol).orderBy("price_date")
    ahead = bars.select(
        F.col(symbol).alias("_sym"), "price_date", "close", F.lead("close", holding).over(w).alias("close_h"),
        F.lead("price_date", holding).over(w).alias("date_h"),
    ).withColumn("_neg", -F.datediff("price_date", F.lit("1970-01-01")))
    cols = ["price_date", "close", "close_h", "date_h"]

    def look(df: DataFrame, by: str, prefix: str) -> DataFrame:
        # one lookup per symbol and day: however many decisions share a benchmark, its line stays calendar-sized
        probe = df.select(F.col(by).alias("_sym"), "trade_date").distinct().withColumn("_neg", -F.datediff("trade_date", F.lit("1970-01-01")))
        hit = asof_join(probe, ahead, ["_sym"], "_neg", "_neg", cols)
        if max_days is not None:  # the last bar must fall inside the download window
            late = F.col("date_h") >= F.date_add("trade_date", max_days)
            hit = hit.withColumn("close_h", F.when(~late, F.col("close_h")))
        ret = F.when(F.col("close_h").isNotNull(), F.col("close_h") / F.col("close") - 1)
        hit = hit.select(F.col("_sym").alias(by), "trade_date", ret.alias(f"{prefix}_return"), F.when(ret.isNotNull(), F.col("date_h")).alias(f"{prefix}_date"))
        return df.join(hit, [by, "trade_date"], "left")

    both = look(look(decisions, symbol, "raw"), "benchmark", "bench")
    ok = F.col("raw_return").isNotNull() & F.col("bench_return").isNotNull()
    return both.select(
        *[c for c in decisions.columns],
        F.when(ok, F.col("raw_return")).alias("raw_return"), F.when(ok, F.col("bench_return")).alias("benchmark_return"),
        F.when(ok, F.col("raw_return") - F.col("bench_return")).alias("alpha_return"),
        F.when(ok, F.lit(holding)).alias("holding_days"), F.when(ok, F.col("raw_date")).alias("resolution_date"),
    )


def resolve_pending(log: DataFrame, outcomes: DataFrame, max_resolved: int | None = None) -> DataFrame:
    """Apply outcomes to pending entries; with a cap, the oldest resolved entries go.

    ``log`` has ticker, trade_date, rating, pending, resolved_on; the cap is a feature of the
    log (rotation) and never drops pending entries. The k newest resolved ones are found by a
    limit, which Spark takes per partition first.
    """
    o = outcomes.where(F.col("raw_return").isNotNull()).select("ticker", "trade_date", "raw_return", "alpha_return", "resolution_date")
    new = log.join(o, ["ticker", "trade_date"], "left").withColumns({
        "resolved_on": F.when(F.col("pending"), F.col("resolution_date")).otherwise(F.col("resolved_on")),
        "pending": F.col("pending") & F.col("resolution_date").isNull(),
    }).drop("resolution_date")
    if not max_resolved:
        return new
    resolved = new.where(~F.col("pending")).orderBy(F.col("trade_date").desc(), F.col("ticker").desc()).limit(max_resolved)
    return new.where("pending").unionByName(resolved)


def benchmark_by_suffix(ticker: Column, override: str | None = None) -> Column:
    """Benchmark index of a ticker's exchange suffix."""
    if override:
        return F.lit(override)
    t = F.upper(ticker)
    expr = F.lit(DEFAULT_BENCHMARK)
    for suffix, index in reversed(BENCHMARK_BY_SUFFIX.items()):
        expr = F.when(t.endswith(suffix), F.lit(index)).otherwise(expr)
    return expr


def daily_returns(prices: DataFrame) -> DataFrame:
    """Daily change per company over its own rows, whatever its ticker was; long format."""
    w = W.partitionBy("company_id").orderBy("price_date")
    prev = F.lag("adjusted_close").over(w)
    return prices.select("company_id", "price_date", F.coalesce(F.when(prev != 0, F.col("adjusted_close") / prev - 1), F.lit(0.0)).alias("ret"))


def returns_history(prices: DataFrame, on: Column, sessions: int = 252) -> DataFrame:
    """Daily returns of the last ``sessions`` trading dates at or before a date."""
    r = daily_returns(prices.where(F.col("price_date") <= on))
    days = r.select("price_date").distinct().orderBy(F.col("price_date").desc()).limit(sessions)
    return r.join(days, "price_date", "left_semi")


def latest_reference_price(prices: DataFrame, on: Column, lookback_days: int = 430) -> DataFrame:
    """Newest positive close per ticker and the newest date overall."""
    p = prices.where(F.col("price_date").between(F.date_sub(on, lookback_days), on) & (F.col("adjusted_close") > 0))
    overall = p.agg(F.max("price_date")).scalar()
    return p.groupBy("ticker").agg(
        F.max("price_date").alias("price_date"), F.max_by("adjusted_close", F.struct("price_date", "company_id")).alias("reference_price")
    ).withColumn("overall_date", overall)


def round_prices(prices: DataFrame, start: Column, end: Column, fields: Sequence[str] = ("open", "high", "low", "close")) -> DataFrame:
    """Prices of a range, end day included, at two decimals."""
    return prices.where(F.col("price_date").between(start, end)).withColumns({c: F.round(c, 2) for c in fields})
