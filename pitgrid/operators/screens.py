"""Screens, research selections and rebalance advice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pitgrid.functions.groups import join_keys, quantiles, running_sum, top_k, with_average_ranks
from pitgrid.operators.portfolio import MAX_NAME_WEIGHT, SECTOR_ACTIVE_LIMIT

# Advice limits.
TURNOVER_BUDGET = 0.20
DEFENSIVE_RANK = 0.75
DEFENSIVE_ML = 0.25

LONG_RATINGS = ("Buy", "Overweight")
BEARISH_RATINGS = ("Underweight", "Sell")

# Evidence label, column, shown as percent.
EVIDENCE = (
    ("Composite factor score", "factor_score", False), ("ML score", "ml_score", False), ("Value factor", "factor_value", False),
    ("Quality factor", "factor_quality", False), ("Growth factor", "factor_growth", False), ("Revision factor", "factor_revisions", False),
    ("P/E", "price_to_earnings", False), ("P/B", "price_to_book", False), ("TEV / EBITDA", "tev_ebitda", False), ("ROIC", "roic", True),
    ("Gross margin", "gross_margin", True), ("Revenue growth", "revenue_growth", True), ("EPS revision (1M)", "eps_revision_1m", True),
    ("Annualized volatility", "volatility_252d", True),
)


def ranked_panel(panel: DataFrame) -> DataFrame:
    """Factor and model percentile ranks, ensemble score and their disagreement per date."""
    df = panel.withColumn("ml_score", F.coalesce("ml_score", F.lit(0.0)))
    df = with_average_ranks(df, ["signal_date"], ["company_id"], {"factor_score": "factor_rank", "ml_score": "ml_rank"})
    return df.withColumn("ensemble_score", 0.5 * F.col("factor_rank") + 0.5 * F.col("ml_score")).withColumn(
        "disagreement", F.abs(F.col("factor_rank") - F.col("ml_rank"))
    )


def priority_union(lists: Sequence[DataFrame], limit: int) -> DataFrame:
    """Lists in order of preference; a company keeps its first place; at most ``limit`` per date.

    Each list already holds a handful of rows per date.
    """
    out = None
    for i, df in enumerate(lists):
        one = df.select("signal_date", "company_id", F.struct(F.lit(i).alias("list"), F.col("_rank").alias("place")).alias("_at"))
        out = one if out is None else out.unionByName(one)
    first = out.groupBy("signal_date", "company_id").agg(F.min("_at").alias("_at"))
    return top_k(first, ["signal_date"], [F.col("_at").asc()], limit, "place").select("signal_date", "company_id", "place", F.col("_at.list").alias("reason"))


def best(df: DataFrame, score: str, n: int, worst: bool = False) -> DataFrame:
    order = F.col(score).asc() if worst else F.col(score).desc()
    return top_k(df.where(F.col(score).isNotNull()), ["signal_date"], [order, F.col("company_id").asc()], n, "_rank")


def research_candidates(panel: DataFrame, holdings: DataFrame) -> DataFrame:
    """5 best by ensemble, 3 worst holdings, 3 largest disagreements; at most 10."""
    r = ranked_panel(panel)
    held = r.join(holdings.select("company_id").distinct(), "company_id", "left_semi")
    return priority_union([best(r, "ensemble_score", 5), best(held, "ensemble_score", 3, worst=True), best(r, "disagreement", 3)], 10)


def study_selection(panel: DataFrame) -> DataFrame:
    """5 best by ensemble and 5 largest disagreements per date; at most 10."""
    r = ranked_panel(panel)
    return priority_union([best(r, "ensemble_score", 5), best(r, "disagreement", 5)], 10)


def bearish_screen(panel: DataFrame, n: int = 5) -> DataFrame:
    """Bottom-quartile names with at least two adverse signals of five."""
    df = panel.where(F.col("factor_score").isNotNull()).withColumn("ml_score", F.coalesce("ml_score", F.lit(0.0)))
    df = with_average_ranks(df, ["signal_date"], ["company_id"], {"factor_score": "factor_rank", "ml_score": "ml_rank"})
    multiples, risks = ("price_to_earnings", "price_to_book", "tev_ebitda"), ("volatility_252d", "beta_252d")
    fields = [c for c in (*multiples, *risks) if c in df.columns]
    valid = [F.when(F.col(c) > 0, F.col(c)).alias(c) if c in multiples else F.col(c) for c in fields]
    long = df.select("signal_date", *valid).unpivot(["signal_date"], fields, "field", "v")
    cut = quantiles(long, ["signal_date", "field"], "v", {"q": 0.80}).groupBy("signal_date").agg(
        *[F.max(F.when(F.col("field") == c, F.col("q"))).alias(f"_q_{c}") for c in fields]
    )
    model = df.groupBy("signal_date").agg((F.sum(F.abs("ml_score")) > 1e-9).alias("_model"))
    df = df.join(cut, "signal_date", "left").join(model, "signal_date", "left")
    high = lambda cs: any_true([F.col(c) >= F.col(f"_q_{c}") for c in cs if c in fields])
    below = lambda cs: any_true([F.col(c) < 0 for c in cs if c in df.columns])
    flags = {
        "valuation_stretched": high(multiples), "fundamental_deterioration": below(("revenue_growth", "eps_growth", "margin_change")),
        "estimate_deterioration": below(("eps_revision_1m", "eps_revision_3m", "estimate_surprise")), "market_risk": high(risks),
        "ml_weak": F.col("_model") & (F.col("ml_rank") <= 0.25),
    }
    df = df.withColumns(flags)
    count = F.lit(0)
    for f in flags:
        count = count + F.col(f).cast("int")
    weak = df.withColumn("bearish_signal_count", count).where((F.col("factor_rank") <= 0.25) & (F.col("bearish_signal_count") >= 2))
    weak = with_average_ranks(weak, ["signal_date"], ["company_id"], {"factor_score": "_r"})
    weak = weak.withColumn("bearish_screen_score", (1 - F.col("_r")) + F.col("bearish_signal_count") / 5)
    return top_k(weak, ["signal_date"], [F.col("bearish_screen_score").desc(), F.col("company_id").asc()], n, "rank")


def any_true(conds: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conds:
        out = out | F.coalesce(c, F.lit(False))
    return out


def rating_bucket(rating: Column) -> Column:
    return F.when(rating.isin(*LONG_RATINGS), "long").when(rating.isin(*BEARISH_RATINGS), "bearish").otherwise("neutral")


def decision_buckets(decisions: DataFrame, n: int = 20) -> DataFrame:
    """Newest n decision records with their bucket."""
    newest = decisions.orderBy(F.col("created_at").desc(), F.col("decision_id").desc()).limit(n)
    rating = F.get_json_object("decision_json", "$.rating")
    return newest.select("decision_id", "created_at", rating.alias("rating"), rating_bucket(F.coalesce(rating, F.lit(""))).alias("bucket"))


def equal_weight_target(ranked: DataFrame, n: int = 20) -> DataFrame:
    """Fallback target: the n best names at the name limit each."""
    return ranked.orderBy(F.col("operational_score").desc(), F.col("ticker").asc()).limit(n).select(
        "company_id", "ticker", "sector", F.lit(MAX_NAME_WEIGHT).alias("weight")
    )


def ordinal_rank(df: DataFrame, keys: Sequence[str], score: str, ties: Sequence[Column], out: str = "rank") -> DataFrame:
    """1, 2, 3 ... by score descending inside ``keys`` without putting a group into one task."""
    ranked = running_sum(df.withColumn("_one", F.lit(1.0)), keys, score, ties, "_one", out, descending=True)
    return ranked.withColumn(out, (F.col(out) + 1).cast("long")).drop("_one")


def rebalance_targets(ranked: DataFrame, target: DataFrame, holdings: DataFrame, prices: DataFrame, equity: Column) -> DataFrame:
    """Union of holdings and targets with weights, wanted change, rank and price verdict.

    ``ranked`` has ticker, sector, operational_score, ml_score, rank, n_ranked.
    """
    h = holdings.select(F.upper("ticker").alias("ticker"), "qty", "current_price", "market_value", F.lit(True).alias("_held"))
    g = target.select(F.upper("ticker").alias("ticker"), F.col("sector").alias("_tsector"), "weight")
    s = ranked.select(F.upper("ticker").alias("ticker"), F.col("sector").alias("_sector"), "operational_score", "ml_score", "rank", "n_ranked")
    df = h.join(g, "ticker", "full_outer").join(s, "ticker", "left").join(prices.select("ticker", "reference_price"), "ticker", "left")
    value = F.coalesce("market_value", F.lit(0.0))
    price = F.coalesce(F.when(F.col("reference_price") != 0, F.col("reference_price")), "current_price")
    return df.select(
        "ticker", F.coalesce("_sector", "_tsector", F.lit("Unclassified")).alias("sector"), F.coalesce("_sector", F.lit("Unclassified")).alias("held_sector"),
        "rank", "n_ranked", "ml_score", F.coalesce("operational_score", F.lit(0.0)).alias("operational_score"),
        F.coalesce("qty", F.lit(0.0)).alias("current_quantity"), value.alias("current_value"), (value / equity).alias("current_weight"),
        F.coalesce("weight", F.lit(0.0)).alias("target_weight"), (equity * F.coalesce("weight", F.lit(0.0)) - value).alias("desired_delta_value"),
        F.when(price > 0, price).otherwise(0.0).alias("reference_price"), (~F.coalesce(price > 0, F.lit(False))).alias("missing_price"),
    )


def sector_gap(actions: DataFrame, target: DataFrame) -> DataFrame:
    """Current, target and difference of sector weights over the union of sectors."""
    cur = actions.where(F.col("current_value") != 0).groupBy(F.col("held_sector").alias("sector")).agg(
        F.sum("current_weight").alias("current_weight"), F.count(F.lit(1)).alias("names_held"))
    tgt = target.groupBy("sector").agg(F.sum("weight").alias("target_weight"))
    out = cur.join(tgt, "sector", "full_outer").fillna(0.0, ["current_weight", "target_weight"])
    return out.withColumn("difference", F.col("target_weight") - F.col("current_weight"))


def risk_flags(actions: DataFrame, target: DataFrame, equity: Column) -> DataFrame:
    """Risk flags and limit of every holding, and the bucket that decides its change."""
    gaps = sector_gap(actions, target).select(F.col("sector").alias("_s"), F.col("current_weight").alias("_cur"), F.col("target_weight").alias("_tgt"), "names_held")
    df = actions.join(gaps, actions["sector"] == gaps["_s"], "left").drop("_s")
    model = actions.agg(F.sum(F.abs(F.coalesce("ml_score", F.lit(0.0)))) > 1e-9).scalar()
    held = F.col("current_quantity") > 0
    over = F.coalesce("_cur", F.lit(0.0)) - (F.coalesce("_tgt", F.lit(0.0)) + SECTOR_ACTIVE_LIMIT)
    concentrated = held & (F.col("current_weight") > MAX_NAME_WEIGHT + 1e-8)
    crowded = held & (over > 1e-8)
    weak_rank = held & F.coalesce(F.col("rank") / F.greatest("n_ranked", F.lit(1)) > DEFENSIVE_RANK, F.lit(False))
    weak_ml = held & model & F.coalesce(F.col("ml_score") < DEFENSIVE_ML, F.lit(False))
    flags = F.array_compact(F.array(
        F.when(concentrated, "position"), F.when(crowded, "sector"), F.when(weak_rank, "factor_rank"), F.when(weak_ml, "ml_score")))
    limit = F.least(
        F.col("current_weight"), F.when(concentrated, F.lit(MAX_NAME_WEIGHT)),
        F.when(crowded, F.greatest(F.col("current_weight") - over / F.col("names_held"), F.lit(0.0))),
        F.when(weak_rank | weak_ml, F.lit(MAX_NAME_WEIGHT / 2)),
    )
    df = df.withColumn("risk_flags", flags).withColumn("risk_limit_weight", F.when(held, limit).otherwise(F.col("current_weight")))
    risky = held & (F.size("risk_flags") > 0) & (F.col("risk_limit_weight") < F.col("current_weight") - 1e-8)
    buy = ~held | (F.col("target_weight") > F.col("current_weight") + 1e-8)
    return df.withColumn("bucket", F.when(risky, "risk").when(buy, "purchase").otherwise("none")).withColumn(
        "desired_delta_value",
        F.when(F.col("bucket") == "risk", equity * F.col("risk_limit_weight") - F.col("current_value"))
        .when((F.col("bucket") == "purchase"), equity * F.col("target_weight") - F.col("current_value")).otherwise(0.0),
    ).drop("_cur", "_tgt", "names_held")


def allocate_turnover_budget(actions: DataFrame, equity: Column, budget_share: float = TURNOVER_BUDGET) -> DataFrame:
    """Largest sales first into the budget, then best-scored purchases out of the proceeds."""
    df = actions.withColumn("_k", F.lit(1)).withColumn("_size", F.abs("desired_delta_value"))
    sells = running_sum(df.where(F.col("desired_delta_value") < -1e-6), ["_k"], "_size", [F.col("ticker").asc()], "_size", "_before", descending=True)
    budget = equity * budget_share
    amount = lambda total: F.greatest(F.least(F.col("_size"), total - F.col("_before")), F.lit(0.0))
    sells = sells.withColumn("proposed_delta_value", -amount(budget))
    sold = df.where(F.col("desired_delta_value") < -1e-6).agg(F.coalesce(F.sum("_size"), F.lit(0.0))).scalar()
    buys = running_sum(
        df.where(F.col("desired_delta_value") > 1e-6), ["_k"], "operational_score", [F.col("rank").desc_nulls_last(), F.col("ticker").asc()], "_size", "_before", descending=True
    ).withColumn("proposed_delta_value", amount(F.least(budget, sold)))
    rest = df.where(F.col("_size") <= 1e-6).withColumn("_before", F.lit(0.0)).withColumn("proposed_delta_value", F.lit(0.0))
    return sells.unionByName(buys).unionByName(rest).drop("_k", "_size", "_before")


def advice_actions(allocated: DataFrame, equity: Column) -> DataFrame:
    """Actions of at least a dollar and a basis point of equity, reductions first, then by size."""
    d = F.col("proposed_delta_value")
    df = allocated.where(F.abs(d) >= F.greatest(F.lit(1.0), equity * 0.0001))
    df = df.withColumn("action", F.when(d < 0, "Reduce").when(F.col("current_quantity") > 0, "Add").otherwise("Initiate"))
    price = F.col("reference_price")
    return df.withColumns({
        "proposed_notional": F.abs(d), "proposed_shares": F.when(price > 0, F.abs(d) / price),
        "target_quantity": F.when(price > 0, equity * F.col("target_weight") / price),
    }).orderBy(F.when(F.col("action") == "Reduce", 0).otherwise(1), F.col("proposed_notional").desc(), F.col("rank").asc_nulls_last(), F.col("ticker"))


def metric_evidence(rows: DataFrame, keys: Sequence[str], model_available: Column) -> DataFrame:
    """One row per metric present, formatted, with a confidence grade from the coverage counts."""
    items = F.array(*[
        F.struct(F.lit(label).alias("label"), F.col(c).cast("double").alias("v"), F.lit(pct).alias("pct"))
        for label, c, pct in EVIDENCE if c in rows.columns
    ])
    e = rows.select(*keys, "factor_family_count", "institutional_factor_family_count", F.explode(items).alias("m")).select("*", "m.*").drop("m")
    e = e.where(F.col("v").isNotNull() & ((F.col("label") != "ML score") | model_available))
    graded = F.col("label").endswith("factor") | (F.col("label") == "Composite factor score")
    full = (F.col("factor_family_count") >= 5) & (F.col("institutional_factor_family_count") >= 3)
    return e.select(
        *keys, "label", F.when(F.col("pct"), F.format_string("%.1f%%", F.col("v") * 100)).otherwise(F.format_string("%.2f", F.col("v"))).alias("value"),
        F.when(graded & full, "High").otherwise("Moderate").alias("confidence"),
    )


def order_deltas(targets: DataFrame, positions: DataFrame, prices: DataFrame, equity: Column) -> DataFrame:
    """Order side, quantity and notional that move a book to its target weights."""
    p = positions.select("ticker", F.col("qty").alias("_qty"))
    df = targets.join(prices.select("ticker", "reference_price"), "ticker").join(p, "ticker", "left")
    delta = equity * F.col("weight") / F.col("reference_price") - F.coalesce("_qty", F.lit(0.0))
    df = df.withColumn("_d", delta).where(F.abs("_d") * F.col("reference_price") >= 1.0)
    return df.select(
        "ticker", F.when(F.col("_d") > 0, "buy").otherwise("sell").alias("side"), F.round(F.abs("_d"), 6).alias("qty"),
        F.round(F.abs("_d") * F.col("reference_price"), 2).alias("notional"),
    )


POSITIONS = "positions array<struct<company_id:string,ticker:string,sector:string,weight:double,score:double>>"


def current_portfolio(portfolios: DataFrame) -> DataFrame:
    """Positions of the newest portfolio."""
    newest = portfolios.agg(F.max(F.struct("as_of_date", "created_at", "portfolio_id", "recommendation_json")).alias("m")).select("m.*")
    parsed = newest.select("portfolio_id", "as_of_date", F.from_json("recommendation_json", POSITIONS).alias("r"))
    return parsed.select("portfolio_id", "as_of_date", F.explode("r.positions").alias("p")).select("portfolio_id", "as_of_date", "p.*")


def watchlist(requests: DataFrame) -> DataFrame:
    """State after add / delete requests: valid tickers, last note wins, first time kept."""
    t = F.upper(F.trim("ticker"))
    ok = requests.withColumn("ticker", t).where(F.col("ticker").rlike("^[\\p{L}\\p{N}.-]{1,12}$"))
    ok = ok.withColumn("note", F.nullif(F.trim("note"), F.lit("")))
    last = ok.groupBy("ticker").agg(F.max(F.struct("at", "request_id", "action", "note")).alias("m"),
                                     F.max(F.when(F.col("action") == "delete", F.struct("at", "request_id"))).alias("_gone"))
    live = last.where(F.col("m.action") == "add")
    since = ok.where(F.col("action") == "add").join(live.select("ticker", "_gone"), "ticker")
    since = since.where(F.col("_gone").isNull() | (F.struct("at", "request_id") > F.col("_gone"))).groupBy("ticker").agg(F.min("at").alias("created_at"))
    return live.select("ticker", F.col("m.note").alias("note")).join(since, "ticker")
