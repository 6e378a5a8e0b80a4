"""Factor engine: ratios, revisions, market features, sector-neutral scores, for many dates at once."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pitgrid.functions.columns import digest_sums, clip, count_present, mean_present, safe_divide, visible_on
from pitgrid.functions.groups import join_days, join_keys, latest, quantiles, top_k, with_average_ranks
from pitgrid.functions.staging import stage
from pitgrid.operators.asof import (
    BENCHMARK_TICKER, asof_join, expand_intervals, latest_asof_facts, latest_instrument,
    latest_returns_asof, latest_score_asof, pivot_metrics, price_precedence, universe_asof,
)

# Factor families with the sign of each feature, and eligibility limits.
FACTOR_FAMILIES = {
    "value": {"earnings_yield": 1.0, "fcf_yield": 1.0, "ebitda_to_ev": 1.0},
    "quality": {"roic": 1.0, "gross_profitability": 1.0, "accruals": -1.0, "net_debt_ebitda": -1.0},
    "growth": {"revenue_growth": 1.0, "eps_growth": 1.0, "margin_change": 1.0},
    "revisions": {"eps_revision_1m": 1.0, "eps_revision_3m": 1.0, "estimate_surprise": 1.0},
    "momentum": {"momentum_12_1": 1.0, "momentum_6_1": 1.0},
    "low_risk": {"volatility_252d": -1.0, "beta_252d": -1.0},
}
INSTITUTIONAL_FAMILIES = ("value", "quality", "growth", "revisions")
MIN_FAMILIES = 4
MIN_INSTITUTIONAL = 2
WINSOR = (0.025, 0.975)
MONTH_LAG = 21
MOMENTUM_LAGS = (MONTH_LAG, 126, 252)
RISK_WINDOW = 252
MIN_RISK_RETURNS = 40
LOOKBACK_DAYS = 430

FEATURES = sorted(f for fam in FACTOR_FAMILIES.values() for f in fam)
FAMILY_COLUMNS = [f"factor_{f}" for f in FACTOR_FAMILIES]

RATIO_INPUTS = (
    "net_income", "market_cap", "price_to_earnings", "ebitda", "enterprise_value", "tev_ebitda", "free_cash_flow",
    "nopat", "invested_capital", "gross_profit", "total_assets", "operating_cash_flow", "net_debt", "revenue",
    "revenue_prior_year", "eps", "eps_prior_year", "operating_margin", "operating_margin_prior_year",
)
REVISION_INPUTS = (
    "eps_analyst_count_1m", "eps_up_revisions_1m", "eps_down_revisions_1m", "eps_up_revisions_3m", "eps_down_revisions_3m",
)
EXPORTED_RATIOS = (
    "earnings_yield", "fcf_yield", "ebitda_to_ev", "roic", "gross_profitability", "accruals", "net_debt_ebitda",
    "revenue_growth", "eps_growth", "margin_change",
)
EXPORTED_REVISIONS = ("eps_revision_1m", "eps_revision_3m", "estimate_surprise")


def ensure_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = {n: F.lit(None).cast("double") for n in names if n not in df.columns}
    return df.withColumns(missing) if missing else df


def calibrated_inverse_multiples(df: DataFrame, keys: Sequence[str], specs: dict[str, tuple[str, str, str]]) -> DataFrame:
    """per output name (numerator, denominator, reported multiple): 1 / multiple, else the raw
    ratio rescaled by the group's median raw / reported.

    The scale counts only with at least 3 overlapping rows and when it is above 10. All
    outputs share one pass over a long table of overlaps.
    """
    keys = list(keys)
    df = df.withColumns({f"_raw_{o}": safe_divide(n, d) for o, (n, d, _) in specs.items()})
    df = df.withColumns({f"_rep_{o}": safe_divide(F.lit(1.0), m) for o, (_, _, m) in specs.items()})
    ratio = {o: F.when(F.abs(f"_rep_{o}") > 1e-12, F.abs(F.col(f"_raw_{o}") / F.col(f"_rep_{o}"))) for o in specs}
    overlap = df.select(*keys, *[e.alias(o) for o, e in ratio.items()]).unpivot(keys, list(specs), "_out", "_q")
    scale = quantiles(overlap, [*keys, "_out"], "_q", {"_scale": 0.5}, few=True).where("n_all >= 3 AND _scale > 10")
    wide = scale.groupBy(*keys).agg(*[F.max(F.when(F.col("_out") == o, F.col("_scale"))).alias(f"_scale_{o}") for o in specs])
    df = join_keys(df, wide, keys, "left", few=True)  # one row per date
    df = df.withColumns({
        o: F.coalesce(F.col(f"_rep_{o}"), F.col(f"_raw_{o}") / F.coalesce(f"_scale_{o}", F.lit(1.0))) for o in specs
    })
    return df.drop(*[f"_{p}_{o}" for p in ("raw", "rep", "scale") for o in specs])


INVERSE_MULTIPLES = {
    "_earnings_yield": ("net_income", "market_cap", "price_to_earnings"),
    "_ebitda_to_ev": ("ebitda", "enterprise_value", "tev_ebitda"),
}


def fundamental_ratios(df: DataFrame, keys: Sequence[str] = ("signal_date",)) -> DataFrame:
    """ten ratios; a value exported by the vendor wins over the derived one."""
    df = ensure_columns(df, [*RATIO_INPUTS, *EXPORTED_RATIOS])
    df = calibrated_inverse_multiples(df, keys, INVERSE_MULTIPLES)
    derived = {
        "earnings_yield": F.col("_earnings_yield"),
        "fcf_yield": safe_divide("free_cash_flow", "market_cap"),
        "ebitda_to_ev": F.col("_ebitda_to_ev"),
        "roic": safe_divide("nopat", "invested_capital"),
        "gross_profitability": safe_divide("gross_profit", "total_assets"),
        "accruals": safe_divide(F.col("net_income") - F.col("operating_cash_flow"), "total_assets"),
        "net_debt_ebitda": safe_divide("net_debt", "ebitda"),
        "revenue_growth": safe_divide("revenue", "revenue_prior_year") - 1,
        # magnitude of the ratio on purpose, so a swing of sign is not read as decline
        "eps_growth": F.abs(safe_divide("eps", "eps_prior_year")) - 1,
        "margin_change": F.col("operating_margin") - F.col("operating_margin_prior_year"),
    }
    return df.withColumns({n: F.coalesce(F.col(n).cast("double"), e) for n, e in derived.items()}).drop(*INVERSE_MULTIPLES)


def breadth(up: Column, down: Column, analysts: Column) -> Column:
    """(up - down) over the larger of coverage and revisers, limited to [-1, 1]."""
    revisers = up + down
    base = F.greatest(F.when(analysts > 0, analysts), F.when(revisers > 0, revisers))
    return clip(safe_divide(up - down, F.when(base > 0, base)), -1.0, 1.0)


def revision_breadth(df: DataFrame) -> DataFrame:
    """one- and three-month breadth; an existing revision value wins."""
    df = ensure_columns(df, [*REVISION_INPUTS, *EXPORTED_REVISIONS])
    out = {}
    for w in ("1m", "3m"):
        b = breadth(F.col(f"eps_up_revisions_{w}"), F.col(f"eps_down_revisions_{w}"), F.col("eps_analyst_count_1m"))
        out[f"eps_revision_{w}"] = F.coalesce(F.col(f"eps_revision_{w}").cast("double"), b)
    return df.withColumns(out)


def estimate_change_asof(estimates: DataFrame, dates: DataFrame, metric: str = "eps_estimate", history_months: int = 4) -> DataFrame:
    """change of the newest estimate against the same fiscal target 1 and 3 month ends ago.

    A fact serves only the signal dates inside its short history window, so it is spread over
    those and folded with conditional maxima (combined map-side), not self-joined.
    """
    rows = estimates.where(F.col("metric") == metric).where(
        F.col("fiscal_period").isNotNull() & F.col("value").isNotNull() & F.col("company_id").isNotNull()
    ).select("company_id", "fiscal_period", "as_of_date", "effective_at", "ingested_at", "value")
    rows = rows.withColumn("_from", visible_on("effective_at", "as_of_date")).where("_from IS NOT NULL")
    rows = rows.withColumn("_to", F.date_add(F.add_months("as_of_date", history_months), 3))
    seen = expand_intervals(rows, dates, "_from", "_to").where(F.col("as_of_date") >= F.add_months("signal_date", -history_months))
    version = F.struct("as_of_date", "effective_at", "ingested_at", "value")
    aggs = [F.max(version).alias("cur")]
    for k in (1, 3):
        cutoff = F.last_day(F.add_months("signal_date", -k))
        aggs.append(F.max(F.when(F.col("as_of_date") <= cutoff, version)).alias(f"p{k}"))
    per_target = seen.groupBy("signal_date", "company_id", "fiscal_period").agg(*aggs)
    best = per_target.groupBy("signal_date", "company_id").agg(
        F.max(F.struct("cur.as_of_date", "cur.effective_at", "cur.ingested_at", "fiscal_period",
                       F.col("cur.value").alias("now"), F.col("p1.value").alias("v1"), F.col("p3.value").alias("v3"))).alias("b")
    )
    change = lambda k: safe_divide(F.col("b.now") - F.col(f"b.v{k}"), F.abs(f"b.v{k}"))
    return best.select("signal_date", "company_id", change(1).alias("change_1m"), change(3).alias("change_3m"))


def group_zscores(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """winsorized mean and population deviation per group: keys, lo, hi, mean, sd. Groups are those of the calendar."""
    keys = list(keys)
    q = quantiles(values, keys, value, {"lo": WINSOR[0], "hi": WINSOR[1]}, few=True).where("n_all >= 3")
    clipped = join_keys(values.where(F.col(value).isNotNull()), q, keys, few=True).withColumn("_c", clip(value, F.col("lo"), F.col("hi")))
    return clipped.groupBy(*keys).agg(
        F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.avg("_c").alias("mean"), F.stddev_pop("_c").alias("sd")
    )


def zscore(value: str | Column, stats: Column | None = None) -> Column:
    """z of a row from its group's stats (columns, or fields of ``stats``); 0 for every row of a flat group, NULL below 3 values."""
    lo, hi, mean, sd = (F.col(c) if stats is None else stats[c] for c in ("lo", "hi", "mean", "sd"))
    z = (clip(value, lo, hi) - mean) / sd
    return F.when(sd == 0, F.lit(0.0)).when(sd > 0, z)


def winsorized_zscore(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """F06 as a column on the rows."""
    stats = group_zscores(df, keys, value)
    return join_keys(df, stats, keys, "left", few=True).withColumn(out, zscore(value)).drop("lo", "hi", "mean", "sd")


ALL_SECTORS = "*all*"


def sector_neutral_zscores(df: DataFrame, features: Sequence[str], date: str = "signal_date", sector: str = "sector") -> DataFrame:
    """z inside the sector; sectors of fewer than 3 rows are scored against all rows of the date.

    Statistics of all features are taken from a long table that is counted before it is shuffled, and go to the rows as one row per date and sector; rows stay
    where they are. ``df`` is read several times. Rows that share a company and date share the greatest z of each feature; a row of no company has none.
    """
    sizes = df.groupBy(date, F.col(sector).alias("_sector")).agg(F.count(F.lit(1)).alias("_rows"))
    sizes = sizes.withColumn("_g", F.when(F.col("_rows") >= 3, F.coalesce("_sector", F.lit("*null*"))).otherwise(F.lit(ALL_SECTORS)))
    sizes = sizes.withColumn("_pooled", F.max(F.col("_g") == ALL_SECTORS).over(W.partitionBy(date))).drop("_rows")  # one row per sector
    rows = join_keys(df.withColumn("_sector", F.col(sector)), sizes, [date, "_sector"], few=True).drop("_sector")
    groups = F.array_distinct(F.when(F.col("_pooled"), F.array("_g", F.lit(ALL_SECTORS))).otherwise(F.array("_g")))
    pool = rows.select(date, F.explode(groups).alias("_g"), *[F.col(f).cast("double").alias(f) for f in features]).unpivot([date, "_g"], list(features), "feature", "v")
    stats = group_zscores(pool, [date, "feature", "_g"], "v")
    wide = stats.groupBy(date, "_g").agg(F.array(*[F.max(F.when(F.col("feature") == f, F.struct("lo", "hi", "mean", "sd"))) for f in features]).alias("_s"))
    values = F.when(F.col("company_id").isNotNull(), F.array(*[F.col(f).cast("double") for f in features]))
    # one expression for all features: spelled out for each, the step is too long to be compiled
    scored = rows.join(F.broadcast(wide), [date, "_g"], "left").withColumn("_z", F.zip_with(values, "_s", lambda v, s: zscore(v, s)))
    z = {f: F.get("_z", F.lit(i)) for i, f in enumerate(features)}
    if not df.groupBy(date, "company_id").count().where("count > 1").isEmpty():
        same = W.partitionBy(date, "company_id")
        z = {f: F.max(e).over(same) for f, e in z.items()}
    return scored.select(*df.columns, *[e.alias(f"z_{f}") for f, e in z.items()])


def factor_families(df: DataFrame) -> DataFrame:
    """null-skipping mean of signed z-scores per family."""
    return df.withColumns({
        f"factor_{fam}": mean_present([F.col(f"z_{f}") * sign for f, sign in feats.items()]) for fam, feats in FACTOR_FAMILIES.items()
    })


def factor_score(df: DataFrame) -> DataFrame:
    """mean of the families present when at least 4, of them 2 institutional, exist."""
    inst = [f"factor_{f}" for f in INSTITUTIONAL_FAMILIES]
    return df.withColumns({
        "factor_family_count": count_present(FAMILY_COLUMNS), "institutional_factor_family_count": count_present(inst),
    }).withColumn("factor_score", F.when(
        (F.col("factor_family_count") >= MIN_FAMILIES) & (F.col("institutional_factor_family_count") >= MIN_INSTITUTIONAL),
        mean_present(FAMILY_COLUMNS),
    ))


def price_states(daily: DataFrame) -> DataFrame:
    """Per company and day: past closes and running sums from which any window can be read.

    A window statistic is the difference of two running sums, so a row is never copied into
    the windows of several signal dates. The input has one row per company and day.
    """
    w = W.partitionBy("company_id").orderBy("price_date")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    prev = F.lag("adjusted_close").over(w)
    p = daily.select("company_id", "ticker", "price_date", "adjusted_close").withColumn(
        "ret", F.when(prev != 0, F.col("adjusted_close") / prev - 1)
    )
    spy = p.where(F.col("ticker") == BENCHMARK_TICKER).select("price_date", F.col("ret").alias("bench"))
    p = join_days(p.where(F.col("ticker") != BENCHMARK_TICKER), spy, ["price_date"], "left")
    both = F.col("ret").isNotNull() & F.col("bench").isNotNull()
    sums = {
        "n": F.count(F.lit(1)), "rn": F.count("ret"), "rs": F.sum(F.coalesce("ret", F.lit(0.0))),
        "rss": F.sum(F.coalesce(F.col("ret") * F.col("ret"), F.lit(0.0))),
        "bn": F.sum(both.cast("long")),
    }
    for name, e in (("ba", F.col("ret")), ("bb", F.col("bench")), ("bab", F.col("ret") * F.col("bench")), ("bbb", F.col("bench") * F.col("bench"))):
        sums[name] = F.sum(F.when(both, e).otherwise(F.lit(0.0)))
    p = p.withColumns({k: e.over(run) for k, e in sums.items()})
    p = p.withColumns({f"c{k}": F.lag("adjusted_close", k).over(w) for k in MOMENTUM_LAGS})
    p = p.withColumns({f"d{k}": F.lag("price_date", k).over(w) for k in MOMENTUM_LAGS if k != MONTH_LAG})
    p = p.withColumns({f"{c}_back": F.lag(c, RISK_WINDOW).over(w) for c in ("rs", "rss")})
    return p.withColumns({f"{c}_next": F.lead(c).over(w) for c in STATE}).drop("ret", "bench")


STATE = ("n", "rn", "rs", "rss", "bn", "ba", "bb", "bab", "bbb")
PAIRS = ("bn", "ba", "bb", "bab", "bbb")


def hidden_windows(daily: DataFrame, asks: DataFrame, lookback_days: int) -> DataFrame:
    """(signal_date, company_id, gap) of ``asks`` whose window holds a bar, own or the benchmark's, that was not public on the signal date.

    ``gap`` is the day of the first such bar. A bar hides from its price date until it is published; it meets the asks of these months only.
    """
    gap = daily.where(F.col("public") > F.col("price_date")).select("company_id", "ticker", "price_date", "public")
    months = F.explode(F.sequence(F.trunc("price_date", "month"), F.trunc(F.date_sub("public", 1), "month"), F.expr("INTERVAL 1 MONTH")))
    gap = gap.withColumn("month", months)
    hides = (F.col("price_date") <= F.col("signal_date")) & (F.col("public") > F.col("signal_date")) & (F.col("price_date") >= F.date_sub("signal_date", lookback_days))
    asked = asks.withColumn("month", F.trunc("signal_date", "month"))
    own = asked.join(gap.drop("ticker").hint("merge"), ["company_id", "month"]).where(hides).select("signal_date", "company_id", "price_date")
    days = join_days(asked.select("signal_date", "month").distinct(), gap.where(F.col("ticker") == BENCHMARK_TICKER).select("month", "price_date", "public"), ["month"]).where(hides)
    days = days.groupBy("signal_date").agg(F.min("price_date").alias("price_date"))  # one row per signal date
    found = own.unionByName(join_days(asks, days, ["signal_date"]).select("signal_date", "company_id", "price_date"))
    return found.groupBy("signal_date", "company_id").agg(F.min("price_date").alias("gap"))


def visible_tails(daily: DataFrame, ends: DataFrame, lookback_days: int) -> DataFrame:
    """Per hidden window: sums over its public bars from the day of its first hidden bar on.

    ``ends`` has the windows with ``gap`` and the close of the last bar before it. Bars hide for a few days as a rule, so a tail is a few bars
    of a window of hundreds; a return spans the hidden bars that lie between two public ones.
    """
    month = F.explode(F.sequence(F.trunc(F.greatest("gap", "_start"), "month"), F.trunc("signal_date", "month"), F.expr("INTERVAL 1 MONTH")))
    seen = (F.col("price_date") >= F.greatest("gap", "_start")) & (F.col("price_date") <= F.col("signal_date")) & (F.col("public") <= F.col("signal_date"))
    bars = daily.withColumn("month", F.trunc("price_date", "month"))
    key = ["signal_date", "company_id"]
    windows = ends.select(*key, "_start", "gap", "_base").withColumn("month", month)
    own = windows.join(bars.where(F.col("ticker") != BENCHMARK_TICKER).hint("merge"), ["company_id", "month"]).where(seen).select(*key, "_base", "price_date", "adjusted_close")
    line = W.partitionBy(*key).orderBy("price_date")
    prev = F.when(F.row_number().over(line) == 1, F.col("_base")).otherwise(F.lag("adjusted_close").over(line))
    own = own.withColumn("ret", F.when(prev != 0, F.col("adjusted_close") / prev - 1)).withColumn("back", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("price_date"))))
    # the benchmark's returns as seen on each signal date: dates x its bars
    whole = F.explode(F.sequence(F.trunc(F.date_sub("signal_date", lookback_days), "month"), F.trunc("signal_date", "month"), F.expr("INTERVAL 1 MONTH")))
    public = (F.col("price_date") >= F.date_sub("signal_date", lookback_days)) & (F.col("price_date") <= F.col("signal_date")) & (F.col("public") <= F.col("signal_date"))
    bench = bars.where(F.col("ticker") == BENCHMARK_TICKER).select("month", "price_date", "adjusted_close", "public")
    spy = join_days(ends.select("signal_date").distinct().withColumn("month", whole), bench, ["month"]).where(public)
    day = W.partitionBy("signal_date").orderBy("price_date")
    before = F.lag("adjusted_close").over(day)
    spy = spy.select("signal_date", "price_date", F.when(before != 0, F.col("adjusted_close") / before - 1).alias("bench"))
    close = lambda k: F.max(F.when(F.col("back") == k + 1, F.col("adjusted_close")))
    recent = F.when(F.col("back") <= RISK_WINDOW, F.col("ret"))
    pair = F.col("ret").isNotNull() & F.col("bench").isNotNull()
    total = lambda e: F.coalesce(F.sum(e), F.lit(0.0))
    a, b = F.when(pair, F.col("ret")), F.when(pair, F.col("bench"))
    return join_days(own, spy, ["signal_date", "price_date"], "left", broadcast=False).groupBy(*key).agg(
        F.count(F.lit(1)).alias("t_n"), F.count("ret").alias("t_all"), F.count(recent).alias("t_rn"), total(recent).alias("t_rs"), total(recent * recent).alias("t_rss"),
        F.count(a).alias("t_bn"), total(a).alias("t_ba"), total(b).alias("t_bb"), total(a * b).alias("t_bab"), total(b * b).alias("t_bbb"),
        *[close(k).alias(f"t_c{k}") for k in MOMENTUM_LAGS],
    )


def bars_behind(daily: DataFrame, windows: DataFrame) -> DataFrame:
    """Per hidden window the bars 21, 126 and 252 behind its newest public one that lie before its first hidden bar.

    Before that bar all bars count, so these are found by the number of the bar in its company's line.
    """
    w = W.partitionBy("company_id").orderBy("price_date")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    prev = F.lag("adjusted_close").over(w)
    line = daily.where(F.col("ticker") != BENCHMARK_TICKER).select("company_id", "price_date", "adjusted_close", F.row_number().over(w).alias("at"), F.when(prev != 0, F.col("adjusted_close") / prev - 1).alias("ret"))
    line = line.select("company_id", "at", "price_date", "adjusted_close", F.count("ret").over(run).alias("rn"), F.sum(F.coalesce("ret", F.lit(0.0))).over(run).alias("rs"),
                       F.sum(F.coalesce(F.col("ret") * F.col("ret"), F.lit(0.0))).over(run).alias("rss"))
    key = ["signal_date", "company_id"]
    asked = windows.select(*key, "_start", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("e_n") - (F.lit(k) - F.col("t_n"))).cast("int").alias("at"), (F.lit(k) >= F.col("t_n")).alias("before")) for k in MOMENTUM_LAGS])).alias("p"))
    asked = asked.where("p.before AND p.at > 0 AND company_id IS NOT NULL").select(*key, "_start", "p.k", F.col("p.at").alias("_place"))
    # the bars stay where the windows of their company have dealt them
    hit = asof_join(asked.repartition("company_id"), line, ["company_id"], "_place", "at", ["at", "price_date", "adjusted_close", "rn", "rs", "rss"])
    hit = hit.where((F.col("at") == F.col("_place")) & (F.col("price_date") >= F.col("_start")))
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    return hit.groupBy(*key).agg(*[pick(k, "adjusted_close").alias(f"p_c{k}") for k in MOMENTUM_LAGS], *[pick(RISK_WINDOW, c).alias(f"p_{c}") for c in ("rn", "rs", "rss")])


def daily_bars(prices: DataFrame) -> DataFrame:
    """One bar per company and day with its file and the day it was published, written once for all that read it."""
    daily = price_precedence(prices).select("company_id", "ticker", "price_date", "adjusted_close", F.to_date("effective_at").alias("public"), "source_file_id")
    return stage(daily, "daily-bars")


def market_features(prices: DataFrame, members: DataFrame, lookback_days: int = LOOKBACK_DAYS, daily: DataFrame | None = None) -> DataFrame:
    """F10 momentum, F11 volatility and F12 beta for every (signal_date, company_id) of ``members``.

    A bar counts from the day it was published (``effective_at``), not from its price date. Where all bars of a window were public, the statistics are
    differences of running sums. A window with a bar still hidden on its signal date takes the sums up to that bar and adds its public bars behind it.
    ``daily`` may bring the ``daily_bars`` of ``prices``.
    """
    daily = daily_bars(prices) if daily is None else daily
    asks = members.select("signal_date", "company_id").distinct()
    gaps = stage(hidden_windows(daily, asks, lookback_days), "hidden-windows")
    ends = stage(window_states(daily, asks, gaps, lookback_days), "window-states")
    return summed_features(ends.where("gap IS NULL")).unionByName(tailed_features(daily, ends.where("gap IS NOT NULL"), lookback_days))


def window_states(daily: DataFrame, asks: DataFrame, gaps: DataFrame, lookback_days: int) -> DataFrame:
    """Per asked window the running sums at its end (``e``; before its first hidden bar, where there is one), before its first own bar (``s``) and at the benchmark's first day (``b``)."""
    states = price_states(daily)
    # first benchmark day inside each window: its return belongs to the day before the window
    spy_days = daily.where(F.col("ticker") == BENCHMARK_TICKER).select(
        F.lit(1).alias("_k"), F.col("price_date").alias("spy_day"), F.lead("price_date").over(W.partitionBy(F.lit(1)).orderBy("price_date")).alias("spy_next")
    )
    starts = asks.select("signal_date").distinct().withColumn("_k", F.lit(1)).withColumn("_start", F.date_sub("signal_date", lookback_days))
    starts = asof_join(starts, spy_days, ["_k"], "_start", "spy_day", ["spy_day", "spy_next"], strict=True)
    first_day = daily.where(F.col("ticker") == BENCHMARK_TICKER).agg(F.min("price_date")).scalar()
    starts = starts.select("signal_date", "_start", F.coalesce("spy_next", F.when(F.col("spy_day").isNull(), first_day)).alias("spy_first"))
    asked = join_days(asks, starts, ["signal_date"]).join(gaps.hint("merge"), ["signal_date", "company_id"], "left")
    probes = asked.select(
        "signal_date", "company_id", "_start", "gap",
        F.explode(F.array(
            F.struct(F.lit("end").alias("kind"), F.coalesce(F.date_sub("gap", 1), "signal_date").alias("at")),
            F.struct(F.lit("start").alias("kind"), F.date_sub("_start", 1).alias("at")),
            F.struct(F.lit("bench").alias("kind"), F.coalesce("spy_first", "signal_date").alias("at")),
        )).alias("_p"),
    ).select("signal_date", "company_id", "_start", "gap", "_p.kind", "_p.at")
    cols = [c for c in states.columns if c not in ("company_id", "ticker")]
    hit = asof_join(probes.repartition("company_id"), states, ["company_id"], "at", "price_date", cols)  # as the states are dealt, which then stay where they are
    at_start = F.struct(*[F.coalesce(F.col(f"{c}_next"), F.lit(0)).alias(c) for c in STATE])
    at_bench = F.struct(*[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in STATE])
    return hit.groupBy("signal_date", "company_id", "_start", "gap").agg(
        F.max(F.when(F.col("kind") == "end", F.struct(*[c for c in cols if not c.endswith("_next")]))).alias("e"),
        F.max(F.when(F.col("kind") == "start", at_start)).alias("s"),
        F.max(F.when(F.col("kind") == "bench", at_bench)).alias("b"),
    )


def beta_of(d: dict[str, Column]) -> Column:
    """F12 from the count and the sums of the pairs of returns."""
    cov = d["bab"] / d["bn"] - (d["ba"] / d["bn"]) * (d["bb"] / d["bn"])
    bvar = d["bbb"] / d["bn"] - (d["bb"] / d["bn"]) * (d["bb"] / d["bn"])
    return F.when(d["bn"] >= MIN_RISK_RETURNS, F.when(bvar > 1e-18, cov / bvar))


def summed_features(ends: DataFrame) -> DataFrame:
    """F10 to F12 for windows all of whose bars are public, from running sums."""
    e = ends.where(F.col("e.price_date") >= F.col("_start"))
    one_month = F.col("e.c21")

    def momentum(k: int) -> Column:
        ok = (F.col(f"e.d{k}") >= F.col("_start")) & (F.col(f"e.c{k}") > 0)
        return F.when(ok, one_month / F.col(f"e.c{k}") - 1)

    in_window = F.col("e.rn") - F.col("s.rn")
    full = in_window >= RISK_WINDOW
    n = F.when(full, F.lit(RISK_WINDOW)).otherwise(in_window)
    base = lambda c: F.when(full, F.coalesce(f"e.{c}_back", F.lit(0.0))).otherwise(F.col(f"s.{c}"))
    mean = (F.col("e.rs") - base("rs")) / n
    var = F.greatest((F.col("e.rss") - base("rss")) / n - mean * mean, F.lit(0.0))
    vol = F.when(in_window >= MIN_RISK_RETURNS, F.sqrt(var) * F.sqrt(F.lit(252.0)))

    # states only grow, so the later of the two boundaries is the greater struct
    cut = F.greatest("s", "b")
    d = {c: F.col(f"e.{c}") - cut[c] for c in PAIRS}
    return e.select(
        "signal_date", "company_id", momentum(252).alias("momentum_12_1"), momentum(126).alias("momentum_6_1"),
        vol.alias("volatility_252d"), beta_of(d).alias("beta_252d"),
    )


def tailed_features(daily: DataFrame, ends: DataFrame, lookback_days: int) -> DataFrame:
    """F10 to F12 for windows with hidden bars: the sums before the first of them and those of the public bars behind it."""
    key = ["signal_date", "company_id"]
    held = F.coalesce(F.col("e.price_date") >= F.col("_start"), F.lit(False))
    cut = F.greatest("s", "b")
    none = lambda c: F.lit(0) if c in ("n", "rn", "bn") else F.lit(0.0)
    own = {f"o_{c}": F.when(held & (F.col("e.n") > F.col("s.n")), F.col(f"e.{c}") - F.col(f"s.{c}")).otherwise(none(c)) for c in ("rn", "rs", "rss")}
    pairs = {f"o_{c}": F.when(held & (F.col("e.n") > cut["n"]), F.col(f"e.{c}") - cut[c]).otherwise(none(c)) for c in PAIRS}
    now = {f"e_{c}": F.coalesce(F.col(f"e.{c}"), none(c)) for c in ("n", "rn", "rs", "rss")}
    rows = ends.select(*key, "_start", "gap", held.alias("_held"), F.when(held, F.col("e.adjusted_close")).alias("_base"), *[v.alias(c) for c, v in (own | pairs | now).items()])
    tails = visible_tails(daily, rows, lookback_days)
    rows = rows.join(tails.hint("merge"), key, "left").withColumn("t_n", F.coalesce("t_n", F.lit(0))).where(F.col("_held") | (F.col("t_n") > 0))
    rows = stage(rows.fillna(0, [c for c in tails.columns if c.startswith("t_") and not c.startswith("t_c")]), "tailed-windows")
    rows = rows.join(bars_behind(daily, rows.where("_held")).hint("merge"), key, "left")
    c = {k: F.coalesce(f"t_c{k}", f"p_c{k}") for k in MOMENTUM_LAGS}
    ratio = lambda k: F.when(c[k] > 0, c[MONTH_LAG] / c[k] - 1)
    # the last 252 bars: what of them lies before the gap starts behind the bar 252 back, or at the window's start
    behind = F.col("t_n") < RISK_WINDOW
    before = {x: F.when(~behind, none(x)).when(F.col("p_rn").isNotNull(), F.col(f"e_{x}") - F.col(f"p_{x}")).otherwise(F.col(f"o_{x}")) for x in ("rn", "rs", "rss")}
    n, total, squares = (before[x] + F.col(f"t_{x}") for x in ("rn", "rs", "rss"))
    var = F.greatest(squares / n - (total / n) * (total / n), F.lit(0.0))
    d = {x: F.col(f"o_{x}") + F.col(f"t_{x}") for x in PAIRS}
    return rows.select(
        *key, ratio(252).alias("momentum_12_1"), ratio(126).alias("momentum_6_1"),
        F.when(F.col("o_rn") + F.col("t_all") >= MIN_RISK_RETURNS, F.sqrt(var) * F.sqrt(F.lit(252.0))).alias("volatility_252d"), beta_of(d).alias("beta_252d"),
    )


def revision_fallback(df: DataFrame) -> DataFrame:
    """reported revision, else change from estimate history, else breadth."""
    df = ensure_columns(df, EXPORTED_REVISIONS)
    df = df.withColumns({f"eps_revision_{w}": F.coalesce(F.col(f"eps_revision_{w}").cast("double"), f"change_{w}") for w in ("1m", "3m")})
    return revision_breadth(df)


def feature_frame(membership, instruments, fundamentals, estimates, prices, dates, lookback_days: int = LOOKBACK_DAYS, daily: DataFrame | None = None) -> DataFrame:
    """Universe with every raw feature; members without data keep a row of NULLs."""
    uni = stage(universe_asof(membership, instruments, dates), "universe")
    fund = pivot_metrics(latest_asof_facts(fundamentals, dates, "period_end"), [*RATIO_INPUTS, *EXPORTED_RATIOS])
    est = pivot_metrics(latest_asof_facts(estimates, dates, "fiscal_period"), [*REVISION_INPUTS, *EXPORTED_REVISIONS])
    key = ["signal_date", "company_id"]
    df = (
        uni.join(fund, key, "left").join(est, key, "left")
        .join(estimate_change_asof(estimates, dates), key, "left")
        .join(market_features(prices, uni, lookback_days, daily), key, "left")
    )
    df = stage(df, "features")  # the calibration and the z-scores each scan this several times
    return stage(ensure_columns(revision_fallback(fundamental_ratios(df)), FEATURES), "ratios")


def factor_snapshot(membership, instruments, fundamentals, estimates, prices, dates, lookback_days: int = LOOKBACK_DAYS, daily: DataFrame | None = None) -> DataFrame:
    """scored snapshot of every signal date in one job."""
    raw = feature_frame(membership, instruments, fundamentals, estimates, prices, dates, lookback_days, daily)
    keep = ["signal_date", "company_id", "ticker", "sector", "company_name", *FEATURES, "price_to_earnings", "tev_ebitda"]
    return factor_score(factor_families(sector_neutral_zscores(raw.select(*keep), FEATURES)))


def price_sources(prices: DataFrame, members: DataFrame, lookback_days: int = LOOKBACK_DAYS, daily: DataFrame | None = None) -> DataFrame:
    """(signal_date, source_file_id): files whose bars the price features of a date read, those of members and of the benchmark.

    Per company and file the newest bar that was public on each day is carried forward; it tells whether the window held one.
    """
    key = ["company_id", "source_file_id"]
    daily = (daily_bars(prices) if daily is None else daily).select(*key, "ticker", "price_date", F.greatest("price_date", "public").alias("seen"))
    newest = daily.groupBy(*key, "seen").agg(F.max("price_date").alias("bar"))
    newest = newest.withColumn("bar", F.max("bar").over(W.partitionBy(*key).orderBy("seen").rowsBetween(W.unboundedPreceding, 0)))
    held = daily.select(*key).distinct()
    bench = daily.where(F.col("ticker") == BENCHMARK_TICKER).select(*key, F.lit(1).alias("_k")).distinct()
    asks = members.select("signal_date", "company_id").distinct().join(held, "company_id").select("signal_date", *key)
    asks = asks.union(members.select("signal_date", F.lit(1).alias("_k")).distinct().join(bench, "_k").select("signal_date", *key))
    hit = asof_join(asks, newest, key, "signal_date", "seen", ["bar"])
    return hit.where(F.col("bar") >= F.date_sub("signal_date", lookback_days)).select("signal_date", "source_file_id").distinct()


def change_sources(estimates: DataFrame, dates: DataFrame) -> DataFrame:
    """(signal_date, source_file_id): files of the estimates of the last four months that were public on the date."""
    rows = estimates.where(F.col("metric") == "eps_estimate").select("source_file_id", "as_of_date", F.greatest("as_of_date", F.to_date("effective_at")).alias("seen")).distinct()
    until = F.last_day(F.add_months("as_of_date", 4))
    rows = rows.where(F.col("seen") <= until).withColumn("month", F.explode(F.sequence(F.trunc("seen", "month"), F.trunc(until, "month"), F.expr("INTERVAL 1 MONTH"))))
    asked = dates.select("signal_date").distinct().withColumn("month", F.trunc("signal_date", "month"))
    hit = asked.join(rows, "month").where((F.col("seen") <= F.col("signal_date")) & (F.col("as_of_date") >= F.add_months("signal_date", -4)))
    return hit.select("signal_date", "source_file_id").distinct()


def snapshot_hash(snapshot: DataFrame, facts: DataFrame) -> DataFrame:
    """F16: SHA-256 over date, source ids, companies and factor families of a snapshot.

    Long id lists are not collected: each id is hashed on its own and the hashes are summed
    (order-free), then hashed together with the counts. ``facts`` has signal_date, source_file_id of all that a snapshot reads.
    """
    def digest(df: DataFrame, col: str, out: str) -> DataFrame:
        return df.select("signal_date", col).distinct().groupBy("signal_date").agg(
            F.count(F.lit(1)).alias(f"n_{out}"), digest_sums(F.col(col).cast("string")).alias(out)
        )

    a = digest(snapshot, "company_id", "companies")
    b = digest(facts, "source_file_id", "sources")
    payload = F.to_json(F.struct(
        F.col("signal_date").cast("string").alias("as_of_date"), "companies", F.lit(families_digest()).alias("families"), "n_companies", "n_sources", "sources",
    ))
    return a.join(b, "signal_date", "left").select("signal_date", "n_companies", "n_sources", F.sha2(payload, 256).alias("source_snapshot_hash"))


def families_digest() -> str:
    """SHA-256 of the factor families as sorted JSON."""
    return hashlib.sha256(json.dumps(FACTOR_FAMILIES, sort_keys=True).encode()).hexdigest()


# Columns of a stored observation.
MODEL_COLUMNS = ("elastic_score", "tree_score", "ml_score", "ensemble_score", "next_month_excess_return")


def persist_observations(snapshot: DataFrame, hashes: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """rows to store: scored companies with their raw features packed as JSON and the hash of their snapshot.

    ``hashes`` has signal_date, source_snapshot_hash; ``scored`` (signal_date, company_id) may bring any of ``MODEL_COLUMNS``, the others are NULL.
    """
    rows = snapshot.where(F.col("factor_score").isNotNull()).join(hashes.select("signal_date", "source_snapshot_hash"), "signal_date", "left")
    if scored is not None:
        rows = rows.drop(*MODEL_COLUMNS).join(scored.select("signal_date", "company_id", *[c for c in MODEL_COLUMNS if c in scored.columns]), ["signal_date", "company_id"], "left")
    packed = F.to_json(F.struct(*sorted(FEATURES)), {"ignoreNullFields": "false"})
    return ensure_columns(rows, MODEL_COLUMNS).select(
        "company_id", "ticker", F.col("signal_date").alias("as_of_date"), "sector", packed.alias("feature_json"), F.col("factor_score").cast("double"),
        *[F.col(c).cast("double") for c in MODEL_COLUMNS], "source_snapshot_hash",
    )


def short_horizon_overlay(market_returns: DataFrame, instruments: DataFrame, dates: DataFrame) -> DataFrame:
    """mean short-horizon return, standardized inside the sector known that day."""
    r = latest_returns_asof(market_returns, dates).withColumn(
        "raw", mean_present([F.col(c) / 100.0 for c in ("return_1d", "return_1w", "return_1m")])
    )
    ident = latest_instrument(instruments).select("company_id", "_day", "sector")
    r = asof_join(r.select("signal_date", "company_id", "raw"), ident, ["company_id"], "signal_date", "_day", ["sector"])
    stats = r.groupBy("signal_date", "sector").agg(F.avg("raw").alias("m"), F.stddev_pop("raw").alias("s"))
    scored = join_keys(r, stats, ["signal_date", "sector"])
    sd = F.when(F.col("s") == 0, F.lit(1.0)).otherwise(F.col("s"))
    return scored.select("signal_date", "company_id", "sector", ((F.col("raw") - F.col("m")) / sd).alias("short_horizon_score"))


def operational_rank(snapshot: DataFrame, scores: DataFrame, overlay: DataFrame) -> DataFrame:
    """half factor rank, half model score, plus at most a tenth of short-horizon score."""
    dates = snapshot.select("signal_date").distinct()
    ranked = with_average_ranks(snapshot, ["signal_date"], ["company_id"], {"factor_score": "factor_rank"}).fillna({"factor_rank": 0.0})
    ml = latest_score_asof(scores, dates).select("signal_date", "company_id", F.col("ml_score").alias("_ml"))
    key = ["signal_date", "company_id"]
    df = ranked.drop("ml_score").join(ml, key, "left").join(overlay.select(*key, "short_horizon_score"), key, "left")
    df = df.withColumn("ml_score", F.coalesce("_ml", F.lit(0.0))).drop("_ml").fillna({"short_horizon_score": 0.0})
    ens = 0.5 * F.col("factor_rank") + 0.5 * F.col("ml_score")
    return df.withColumn("ensemble_score", ens).withColumn(
        "operational_score", F.col("ensemble_score") + 0.10 * clip("short_horizon_score", -1.0, 1.0)
    )


def top_n_factor(snapshot: DataFrame, n: int = 25) -> DataFrame:
    """top n by score per date."""
    order = [F.col("factor_score").desc(), F.col("company_id").asc()]
    return top_k(snapshot.where(F.col("factor_score").isNotNull()), ["signal_date"], order, n, "rank")


def family_coverage(snapshot: DataFrame) -> DataFrame:
    """F20, counts part: companies, investable ones and family coverage per date."""
    return snapshot.groupBy("signal_date").agg(
        F.count(F.lit(1)).alias("companies"), F.count("factor_score").alias("investable"),
        *[F.count(c).alias(c) for c in FAMILY_COLUMNS],
    )


def feature_range_profile(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("signal_date",)) -> DataFrame:
    """coverage, 1st percentile, median and 99th percentile per feature."""
    keys = list(keys)
    long = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(keys, list(features), "feature", "v")
    counts = long.groupBy(*keys, "feature").agg(F.count("v").alias("coverage"))
    q = quantiles(long, [*keys, "feature"], "v", {"p01": 0.01, "median": 0.5, "p99": 0.99}).drop("n_all")
    return join_keys(counts, q, [*keys, "feature"], "left")
