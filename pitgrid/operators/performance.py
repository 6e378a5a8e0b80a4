"""Strategy measurement: labels, turnover, rank correlation, quantiles, risk and return tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pitgrid.functions.groups import average_ranks, join_keys, quantiles, with_average_ranks
from pitgrid.operators.asof import BENCHMARK_COMPANY, asof_join

HISTORY_MONTHS = 37
MONTHS = 12


def month_end_signals(prices: DataFrame, start: Column, end: Column) -> DataFrame:
    """Last trading date per month from 37 months before the start to the end."""
    return prices.groupBy(F.trunc("price_date", "month").alias("_m")).agg(F.max("price_date").alias("signal_date")).where(
        F.col("signal_date").between(F.add_months(start, -HISTORY_MONTHS), end)
    ).select("signal_date")


def holding_spans(calendar: DataFrame, signals: DataFrame) -> DataFrame:
    """Entry session after each signal and exit session after the next; one row per signal."""
    one = W.partitionBy("_k")  # trading days only: the calendar bounds these windows
    days = calendar.select("price_date").distinct().withColumn("_k", F.lit(1))
    days = days.withColumn("entry_date", F.lead("price_date").over(one.orderBy("price_date")))
    s = asof_join(signals.select("signal_date").distinct().withColumn("_k", F.lit(1)), days, ["_k"], "signal_date", "price_date", ["entry_date"])
    s = s.withColumn("exit_date", F.lead("entry_date").over(one.orderBy("signal_date")))
    return s.where("entry_date IS NOT NULL AND exit_date IS NOT NULL").select("signal_date", "entry_date", "exit_date")


def forward_returns(prices: DataFrame, signals: DataFrame, benchmark: str = BENCHMARK_COMPANY) -> DataFrame:
    """Open-to-open return from the session after a signal to the session after the next one."""
    spans = holding_spans(prices, signals)
    p = prices.select("company_id", "price_date", "open")
    entry = spans.join(p.withColumnRenamed("price_date", "entry_date").withColumnRenamed("open", "open_entry"), "entry_date")
    out = p.withColumnRenamed("price_date", "exit_date").withColumnRenamed("open", "open_exit")
    r = entry.join(out, ["exit_date", "company_id"]).withColumn("next_return", F.col("open_exit") / F.col("open_entry") - 1)
    bench = r.where(F.col("company_id") == benchmark).select("signal_date", F.col("next_return").alias("benchmark_return"))
    return r.join(bench, "signal_date", "left").select(
        "signal_date", "company_id", F.col("entry_date").alias("return_date"), "next_return", "benchmark_return",
        (F.col("next_return") - F.col("benchmark_return")).alias("next_month_excess_return"),
    )


def apply_cost(gross: Column, turnover: Column, bps: Column | float) -> Column:
    """Net of one-way turnover times basis points."""
    cost = bps if isinstance(bps, Column) else F.lit(float(bps))
    return gross - turnover * cost / 10_000


def one_way_turnover(weights: DataFrame, strategy: str = "strategy", date: str = "signal_date", name: str = "company_id") -> DataFrame:
    """Half the sum of weight changes against the strategy's previous date; 1.0 at its start.

    Each weight is sent to its own date and, negated, to the next date; the sum per name is the
    change, so one grouped pass replaces a full outer join of consecutive books.
    """
    dates = weights.select(strategy, date).distinct()
    w = W.partitionBy(strategy).orderBy(date)
    dates = dates.withColumn("_next", F.lead(date).over(w)).withColumn("_first", F.lag(date).over(w).isNull())
    own = weights.select(strategy, date, name, F.col("weight").alias("_d"))
    sent = weights.join(dates, [strategy, date]).where("_next IS NOT NULL").select(strategy, F.col("_next").alias(date), name, (-F.col("weight")).alias("_d"))
    change = own.unionByName(sent).groupBy(strategy, date, name).agg(F.sum("_d").alias("_d"))
    out = change.groupBy(strategy, date).agg((F.sum(F.abs("_d")) / 2).alias("_t"))
    return out.join(dates, [strategy, date]).select(strategy, date, F.when(F.col("_first"), F.lit(1.0)).otherwise(F.col("_t")).alias("turnover"))


def equal_weight_returns(panel: DataFrame, bps: float) -> DataFrame:
    """Equal-weighted universe per date: gross return, turnover and net return.

    A missing return counts as not held for the sum, instead of blanking the whole month.
    """
    size = panel.groupBy("signal_date").agg((1.0 / F.count(F.lit(1))).alias("weight"))
    held = panel.join(size, "signal_date").withColumn("strategy", F.lit("equal_weight_universe"))
    gross = held.groupBy("signal_date").agg(F.sum(F.col("weight") * F.col("next_return")).alias("gross"), F.count(F.lit(1)).alias("names"))
    t = one_way_turnover(held).select("signal_date", "turnover")
    return gross.join(t, "signal_date").withColumn("net", apply_cost(F.col("gross"), F.col("turnover"), bps))


def pearson(x: str, y: str) -> Column:
    """Correlation, NULL without variation (the built-in one divides by zero then)."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0)))


def rank_ic(panel: DataFrame, factors: Sequence[str], label: str = "next_month_excess_return", date: str = "signal_date") -> DataFrame:
    """Spearman correlation of each factor with the label per date; needs 5 rows and variation on both sides."""
    long = panel.select(date, "company_id", label, *factors).unpivot([date, "company_id", label], list(factors), "factor", "value")
    long = long.where(F.col("value").isNotNull() & F.col(label).isNotNull())
    ranked = with_average_ranks(long, [date, "factor"], ["company_id"], {"value": "_rv", label: "_rl"}, pct=False)
    stats = ranked.groupBy(date, "factor").agg(
        F.count(F.lit(1)).alias("n"), pearson("_rv", "_rl").alias("rho"),
        ((F.min("value") < F.max("value")) & (F.min(label) < F.max(label))).alias("_varied"),
    )
    return stats.select(date, "factor", "n", F.when((F.col("n") >= 5) & F.col("_varied"), F.col("rho")).alias("rank_ic"))


def quantile_returns(panel: DataFrame, score: str = "factor_score", label: str = "next_month_excess_return", date: str = "signal_date", bins: int = 5) -> DataFrame:
    """Mean label per score bin; linear-quantile edges, equal edges merged, right-closed; needs 10 rows."""
    rows = panel.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(date, score, label)
    names = {f"_e{i}": i / bins for i in range(bins + 1)}
    edges = quantiles(rows, [date], score, names).where("n_all >= 10").select(date, F.array_distinct(F.array(*names)).alias("_edges"))
    binned = rows.join(edges.where(F.size("_edges") > 1), date)
    below = F.size(F.filter("_edges", lambda e: e < F.col(score)))
    return binned.groupBy(date, F.greatest(below, F.lit(1)).alias("quantile")).agg(F.avg(label).alias("mean_excess_return"), F.count(F.lit(1)).alias("n"))


def factor_correlation(panel: DataFrame, factors: Sequence[str], date: str = "signal_date") -> DataFrame:
    """Pairwise-complete Spearman per date, then the mean over dates (NULL if any date has none)."""
    names = list(combinations(sorted(factors), 2))
    pairs = F.array(*[F.struct(F.lit(i).alias("_p"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for i, (a, b) in enumerate(names)])
    long = panel.select(date, "company_id", F.explode(pairs).alias("p")).select(date, "company_id", "p.*").where("x IS NOT NULL AND y IS NOT NULL")
    ranked = average_ranks(long, [date, "_p"], ["company_id"], {"x": "_rx", "y": "_ry"}, pct=False)
    ranked = ranked.withColumn("_row", F.explode(F.array_repeat(F.lit(0), F.col("n_rows").cast("int"))))  # repeated rows count as often as they stand
    # ranks vary where the values do
    varied = (F.min("_rx") < F.max("_rx")) & (F.min("_ry") < F.max("_ry"))
    per_date = ranked.groupBy(date, "_p").agg(F.when(varied, pearson("_rx", "_ry")).alias("rho"))
    name = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in names])[F.col("_p")]
    per_date = per_date.select(date, name["a"].alias("a"), name["b"].alias("b"), "rho")
    dates = panel.agg(F.count_distinct(date)).scalar()
    return per_date.groupBy("a", "b").agg(F.when(F.count("rho") == dates, F.avg("rho")).alias("rho"))


def sector_exposure(books: DataFrame, universe: DataFrame) -> DataFrame:
    """Portfolio, benchmark and active weight per date, strategy and sector, over the union of sectors."""
    key = ["signal_date", "company_id"]
    b = books.join(universe.select(*key, "sector"), key).groupBy("signal_date", "strategy", "sector").agg(F.sum("weight").alias("portfolio_weight"))
    total = universe.groupBy("signal_date").agg(F.count(F.lit(1)).alias("_n"))
    bench = universe.groupBy("signal_date", "sector").agg(F.count(F.lit(1)).alias("_s")).join(total, "signal_date").withColumn("benchmark_weight", F.col("_s") / F.col("_n"))
    bench = bench.join(books.select("signal_date", "strategy").distinct(), "signal_date").select("signal_date", "strategy", "sector", "benchmark_weight")
    out = b.join(bench, ["signal_date", "strategy", "sector"], "full_outer").fillna(0.0, ["portfolio_weight", "benchmark_weight"])
    return out.withColumn("active_weight", F.col("portfolio_weight") - F.col("benchmark_weight"))


def hold_when_uncovered(coverage: DataFrame, books: DataFrame, returns: DataFrame, min_positions: int) -> DataFrame:
    """Months with too few scores keep the last valid book, without cost; cash before the first one.

    ``coverage`` has strategy, signal_date, n_scores; ``books`` the weights built on valid months.
    """
    w = W.partitionBy("strategy").orderBy("signal_date").rowsBetween(W.unboundedPreceding, 0)
    ok = F.col("n_scores") >= min_positions
    months = coverage.withColumn("held", ~ok).withColumn("book_date", F.last(F.when(ok, F.col("signal_date")), ignorenulls=True).over(w))
    b = books.select("strategy", F.col("signal_date").alias("book_date"), "company_id", "weight")
    r = returns.select("signal_date", "company_id", "next_return")
    gross = months.join(b, ["strategy", "book_date"]).join(r, ["signal_date", "company_id"]).groupBy("strategy", "signal_date").agg(
        F.sum(F.col("weight") * F.col("next_return")).alias("gross")
    )
    return months.join(gross, ["strategy", "signal_date"], "left").fillna(0.0, ["gross"])


def wealth_curve(returns: DataFrame) -> DataFrame:
    """Growth of 1 per strategy (months per strategy bound the window)."""
    w = W.partitionBy("strategy").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return returns.where(F.col("ret").isNotNull()).withColumn("wealth", growth(F.col("ret"), w))


def growth(ret: Column, over=None) -> Column:
    """Product of 1 + ret as an aggregate or over a window; a total loss makes it 0, a greater one changes its sign."""
    put = (lambda e: e.over(over)) if over is not None else (lambda e: e)
    size = put(F.sum(F.when(ret > -1, F.log1p(ret)).when(ret < -1, F.log(-1 - ret)).otherwise(0.0)))
    sign = F.when(put(F.sum((ret < -1).cast("int"))) % 2 == 1, -1.0).otherwise(1.0)
    return F.when(put(F.max((ret == -1).cast("int"))) == 1, 0.0).otherwise(sign * F.exp(size))


def or_zero(n: Column, d: Column) -> Column:
    return F.when(d != 0, n / d).otherwise(0.0)


def strategy_metrics(returns: DataFrame) -> DataFrame:
    """CAGR, volatility, Sharpe, Sortino, drawdown, beta, information ratio, turnover, hit rate.

    ``returns`` has strategy, date, ret, bench, turnover; population deviations; 0 where undefined.
    """
    rows = wealth_curve(returns.where(F.col("bench").isNotNull()))
    w = W.partitionBy("strategy").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_dd", F.col("wealth") / F.max("wealth").over(w) - 1)
    root = F.sqrt(F.lit(float(MONTHS)))
    a = rows.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("observations"), growth(F.col("ret")).alias("_w"), F.avg("ret").alias("_m"),
        (F.stddev_pop("ret") * root).alias("annualized_volatility"),
        (F.stddev_pop(F.least("ret", F.lit(0.0))) * root).alias("_down"),
        F.avg(F.col("ret") - F.col("bench")).alias("_xm"), (F.stddev_pop(F.col("ret") - F.col("bench")) * root).alias("_te"),
        F.covar_pop("ret", "bench").alias("_cov"), F.var_pop("bench").alias("_bv"), F.min("_dd").alias("max_drawdown"),
        F.avg(F.coalesce("turnover", F.lit(0.0))).alias("average_one_way_turnover"), F.avg((F.col("ret") > 0).cast("double")).alias("monthly_hit_rate"),
    )
    return a.select(
        "strategy", F.when(F.col("_w") > 0, F.pow("_w", MONTHS / F.col("observations")) - 1).otherwise(-1.0).alias("cagr"), "annualized_volatility",
        or_zero(F.col("_m") * MONTHS, F.col("annualized_volatility")).alias("sharpe_zero_rf"), or_zero(F.col("_m") * MONTHS, F.col("_down")).alias("sortino_zero_rf"),
        "max_drawdown", F.when(F.col("_bv") > 0, F.col("_cov") / F.col("_bv")).otherwise(0.0).alias("beta"),
        or_zero(F.col("_xm") * MONTHS, F.col("_te")).alias("information_ratio"), "average_one_way_turnover", "monthly_hit_rate", "observations",
    )


def alpha_test(returns: DataFrame) -> DataFrame:
    """Regression on the benchmark: annualized alpha and its t statistic."""
    a = returns.where("ret IS NOT NULL AND bench IS NOT NULL").groupBy("strategy").agg(
        F.count(F.lit(1)).alias("observations"), F.regr_slope("ret", "bench").alias("_b"), F.regr_intercept("ret", "bench").alias("_a"),
        F.regr_syy("ret", "bench").alias("_syy"), F.regr_sxy("ret", "bench").alias("_sxy"), F.regr_sxx("ret", "bench").alias("_sxx"), F.avg("bench").alias("_mx"),
    )
    rss = F.greatest(F.col("_syy") - F.col("_b") * F.col("_sxy"), F.lit(0.0))
    s2 = rss / F.greatest(F.col("observations") - 2, F.lit(1))
    se = F.sqrt(s2 * (1.0 / F.col("observations") + F.col("_mx") * F.col("_mx") / F.col("_sxx")))
    t = F.when((se > 0) & (F.abs("_a") >= 1e-12), F.col("_a") / se).otherwise(0.0)
    return a.select("strategy", (F.col("_a") * MONTHS).alias("annualized_alpha"), t.alias("alpha_t_stat"), "observations")


def ic_summary(ics: DataFrame) -> DataFrame:
    """Mean, t statistic (sample deviation), share positive and count per factor."""
    a = ics.where(F.col("rank_ic").isNotNull()).groupBy("factor").agg(
        F.avg("rank_ic").alias("mean_rank_ic"), F.stddev_samp("rank_ic").alias("_s"), F.avg((F.col("rank_ic") > 0).cast("double")).alias("ic_positive_rate"),
        F.count(F.lit(1)).alias("observations"),
    )
    se = F.when(F.col("observations") > 1, F.col("_s") / F.sqrt("observations")).otherwise(0.0)
    return a.select("factor", "mean_rank_ic", or_zero(F.col("mean_rank_ic"), se).alias("ic_t_stat"), "ic_positive_rate", "observations")


def reprice(returns: DataFrame, old_bps: float, new_bps: Sequence[float]) -> DataFrame:
    """The same books at other costs; each row is copied once per cost level."""
    levels = F.explode(F.array(*[F.lit(float(b)) for b in new_bps])).alias("bps")
    df = returns.select("*", levels)
    return df.withColumn("ret", F.col("ret") + F.coalesce("turnover", F.lit(0.0)) * (F.lit(float(old_bps)) - F.col("bps")) / 10_000)


def cost_sensitivity(returns: DataFrame, old_bps: float, new_bps: Sequence[float]) -> DataFrame:
    """Metrics and alpha per strategy and cost level."""
    r = reprice(returns, old_bps, new_bps).withColumn("strategy", F.to_json(F.struct("strategy", "bps")))
    both = strategy_metrics(r).join(alpha_test(r).drop("observations"), "strategy")
    parsed = F.from_json("strategy", "strategy string, bps double")
    return both.withColumn("_p", parsed).withColumn("strategy", F.col("_p.strategy")).withColumn("bps", F.col("_p.bps")).drop("_p")


def strategy_comparison(returns: DataFrame, benchmark: str) -> DataFrame:
    """Metrics with ending wealth, CAGR against the benchmark and the leaders."""
    m = strategy_metrics(returns).join(
        returns.where("ret IS NOT NULL").groupBy("strategy").agg(growth(F.col("ret")).alias("ending_wealth")), "strategy"
    )
    bench = m.where(F.col("strategy") == benchmark).agg(F.max("cagr")).scalar()
    rivals = m.where(F.col("strategy") != benchmark)

    def leader(by: str) -> Column:
        return rivals.agg(F.max_by("strategy", F.struct(by, "strategy"))).scalar() == F.col("strategy")

    return m.withColumns({
        "cagr_vs_benchmark": F.col("cagr") - bench, "return_leader": leader("ending_wealth"),
        "risk_leader": leader("sharpe_zero_rf"), "drawdown_leader": leader("max_drawdown"),
    })


def agent_overlay_score(panel: DataFrame, decisions: DataFrame, variant: str, limit: float = 0.10) -> DataFrame:
    """Blended score plus the bounded adjustment of a decision record, where there is one."""
    adj = F.get_json_object("decision_json", "$.score_adjustment").cast("double")
    d = decisions.where(F.col("variant") == variant).select("signal_date", "company_id", F.greatest(F.least(adj, F.lit(limit)), F.lit(-limit)).alias("_adj"))
    return panel.join(d, ["signal_date", "company_id"], "left").withColumn(
        "agent_adjusted_score", F.col("ensemble_score") + F.coalesce("_adj", F.lit(0.0))
    ).drop("_adj")


def overlay_months(decisions: DataFrame, min_months: int = 24) -> DataFrame:
    """B20, gate part: months with decisions per variant and whether they suffice."""
    return decisions.groupBy("variant").agg(F.count_distinct("signal_date").alias("months")).withColumn("enough", F.col("months") >= min_months)


def study_sources(source_files: DataFrame) -> DataFrame:
    """Source list with the flag that any source is synthetic."""
    flag = source_files.agg(F.coalesce(F.bool_or(F.col("original_name").startswith("synthetic_")), F.lit(False))).scalar()
    return source_files.select("dataset", "original_name", "sha256", "row_count", "imported_at").withColumn("synthetic", flag)


def model_fingerprints(runs: DataFrame) -> DataFrame:
    """Distinct model settings with their call counts."""
    return runs.groupBy("model", "effort").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("case_id").alias("cases"))


def unknown_sector_share(panel: DataFrame, limit: float = 0.5) -> DataFrame:
    """Share of rows without a known sector and whether it calls for a note."""
    share = F.avg((F.coalesce("sector", F.lit("Unknown")) == "Unknown").cast("double"))
    return panel.agg(F.coalesce(share, F.lit(0.0)).alias("unknown_share")).withColumn("noted", F.col("unknown_share") >= limit)
