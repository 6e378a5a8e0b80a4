"""Point-in-time selection: as-of joins and interval expansion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pitgrid.functions.columns import month_key, visible_on
from pitgrid.functions.groups import join_days, latest, top_k

FAR_FUTURE = "9999-12-31"

# Order in which price sources are preferred for one company and day.
SOURCE_RANK = {"capital_iq": 0, "yahoo_adjusted": 1, "alpaca_iex_adjusted": 2}
OTHER_SOURCE_RANK = 3

BENCHMARK_TICKER = "SPY"
BENCHMARK_COMPANY = "BENCHMARK:SPY"


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    columns: Sequence[str],
    strict: bool = False,
) -> DataFrame:
    """For each left row the last right row of the same key at or before its time.

    Both sides are put on one time line per key and the newest right row is carried
    forward, so the cost is one sort of both sides and never left x right. ``right`` must
    hold at most one row per key and time; ``strict`` excludes equal times.
    """
    keys = list(keys)
    payload = F.struct(*[F.col(c) for c in columns])
    lcols = left.columns
    lrow = F.struct(*[F.col(c) for c in lcols])
    empty_right = F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType)
    empty_left = F.lit(None).cast(left.select(lrow.alias("p")).schema["p"].dataType)
    lside = left.select(
        *keys, F.col(left_time).alias("_t"), F.lit(0 if strict else 1).alias("_side"),
        lrow.alias("_l"), empty_right.alias("_r"),
    )
    rside = right.select(
        *keys, F.col(right_time).alias("_t"), F.lit(1 if strict else 0).alias("_side"),
        empty_left.alias("_l"), payload.alias("_r"),
    )
    w = W.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    out = lside.unionByName(rside).withColumn("_r", F.last("_r", ignorenulls=True).over(w))
    out = out.where(F.col("_l").isNotNull())
    # a key is taken from the line and not from the struct, so that what follows by key needs no new shuffle
    kept = [k for k in keys if left.schema[k].dataType == out.schema[k].dataType]
    return out.select(*[F.col(c) if c in kept else F.col(f"_l.{c}").alias(c) for c in lcols], *[F.col(f"_r.{c}").alias(c) for c in columns])


def expand_intervals(intervals: DataFrame, dates: DataFrame, start: str, end: str, date_col: str = "signal_date") -> DataFrame:
    """One row per interval and signal date inside [start, end] (end NULL = open).

    Intervals are cut into months and joined on the month, so the work grows with the
    output instead of intervals x dates.
    """
    d = dates.select(date_col).distinct()
    last = d.agg(F.max(date_col)).scalar()
    first = d.agg(F.min(date_col)).scalar()
    lo = F.greatest(F.col(start), first)
    hi = F.least(F.coalesce(F.col(end), last), last)
    cut = (
        intervals.withColumn("_lo", lo).withColumn("_hi", hi).where(F.col("_lo") <= F.col("_hi"))
        .withColumn("_month", F.explode(F.sequence(month_key("_lo"), month_key("_hi"), F.expr("INTERVAL 1 MONTH"))))
    )
    by_month = d.withColumn("_month", month_key(date_col))
    return (
        join_days(cut, by_month, ["_month"])
        .where(F.col(date_col).between(F.col("_lo"), F.col("_hi")))
        .drop("_month", "_lo", "_hi")
    )


def validity_intervals(
    facts: DataFrame, keys: Sequence[str], visible: str, best: Sequence[str], payload: Sequence[str], deal: Sequence[str] | None = None
) -> DataFrame:
    """Turn facts into [valid_from, valid_to] pieces during which one fact is the best known.

    The best fact of a day is the greatest by ``best``; the running maximum over days gives
    the best known so far. Facts are reduced to one per key and day first, so the
    window sees at most one row per calendar day. With ``deal``, some of the keys, facts are shuffled by these once: the maximum of a struct
    needs sorted rows, and would sort every file split before a shuffle by day, and then rows would be shuffled again for the window.
    """
    keys = list(keys)
    if deal:
        facts = facts.where(F.col(visible).isNotNull()).select(*keys, visible, *best, *payload).repartition(*deal)
    per_day = facts.where(F.col(visible).isNotNull()).groupBy(*keys, visible).agg(
        F.max(F.struct(*best, *payload)).alias("_best")
    )
    w = W.partitionBy(*keys).orderBy(visible)
    return (
        per_day.withColumn("_best", F.max("_best").over(w.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("valid_to", F.date_sub(F.lead(visible).over(w), 1))
        .select(*keys, F.col(visible).alias("valid_from"), "valid_to", *[F.col(f"_best.{c}").alias(c) for c in [*best, *payload]])
    )


def fact_pieces(facts: DataFrame, period: str) -> DataFrame:
    """Per company and metric the newest visible fact of each span of days, ``valid_from`` to ``valid_to``.

    Facts are dealt by company, so that what a caller groups by company needs no further shuffle.
    """
    best = [period, "effective_at", "as_of_date", "ingested_at"]
    return validity_intervals(
        facts.withColumn("_visible", visible_on("effective_at", "as_of_date")),
        ["company_id", "metric"], "_visible", best, ["value", "unit", "source_file_id"], deal=["company_id"],
    )


def latest_asof_facts(facts: DataFrame, dates: DataFrame, period: str) -> DataFrame:
    """Per signal date, company and metric the newest visible fact.

    Order: period, effective_at, as_of_date, ingested_at, all descending.
    """
    return expand_intervals(fact_pieces(facts, period), dates, "valid_from", "valid_to").drop("valid_from", "valid_to")


def pivot_metrics(latest_facts: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("signal_date", "company_id")) -> DataFrame:
    """One column per known metric; the list is static, so no extra job runs."""
    return latest_facts.groupBy(*keys).agg(
        *[F.max(F.when(F.lower(F.trim("metric")) == m, F.col("value"))).alias(m) for m in metrics]
    )


def latest_instrument(instruments: DataFrame) -> DataFrame:
    """Best instrument row per company and effective day."""
    return latest(
        instruments.withColumn("_day", F.to_date("effective_at")),
        ["company_id", "_day"], ["effective_at", "as_of_date"],
        ["company_id", "_day", "ticker", "company_name", "sector"],
    )


def universe_asof(membership: DataFrame, instruments: DataFrame, dates: DataFrame, index_code: str = "SP500") -> DataFrame:
    """Members of the index on each signal date with the identity known that day."""
    m = (
        membership.where(F.col("index_code") == index_code)
        .withColumn("_from", F.greatest("member_from", F.to_date("effective_at")))
        .select("company_id", "ticker", "_from", "member_to")
    )
    members = expand_intervals(m, dates, "_from", "member_to").select("signal_date", "company_id", "ticker")
    ident = latest_instrument(instruments).select("company_id", "_day", "company_name", "sector")
    out = asof_join(members, ident, ["company_id"], "signal_date", "_day", ["company_name", "sector"])
    return out.select(
        "signal_date", "company_id", "ticker",
        F.coalesce("sector", F.lit("Unknown")).alias("sector"),
        F.coalesce("company_name", "ticker").alias("company_name"),
    )


def source_rank(source: Column | str = "source") -> Column:
    s = F.col(source) if isinstance(source, str) else source
    expr = F.lit(OTHER_SOURCE_RANK)
    for name, rank in SOURCE_RANK.items():
        expr = F.when(s == name, F.lit(rank)).otherwise(expr)
    return expr


def price_precedence(prices: DataFrame) -> DataFrame:
    """One row per company and day: best source, then newest load, then file id."""
    return latest(prices, ["company_id", "price_date"], [-source_rank(), "ingested_at", "source_file_id"])


def latest_returns_asof(market_returns: DataFrame, dates: DataFrame) -> DataFrame:
    """Newest visible short-horizon return row per company."""
    pieces = validity_intervals(
        market_returns.withColumn("_visible", visible_on("effective_at", "as_of_date")),
        ["company_id"], "_visible", ["as_of_date", "effective_at", "ingested_at"],
        ["ticker", "return_1d", "return_1w", "return_1m"],
    )
    return expand_intervals(pieces, dates, "valid_from", "valid_to").select(
        "signal_date", "company_id", "ticker", "return_1d", "return_1w", "return_1m"
    )


def latest_score_asof(observations: DataFrame, dates: DataFrame) -> DataFrame:
    """All scores of the single newest scored date at or before each signal date."""
    scored = observations
    days = scored.select(F.col("as_of_date").alias("score_date")).distinct()
    w = W.partitionBy("_one").orderBy("score_date")
    # one row per calendar day: the window is as small as a calendar
    spans = (
        days.withColumn("_one", F.lit(1))
        .withColumn("_until", F.date_sub(F.lead("score_date").over(w), 1))
        .select("score_date", F.col("score_date").alias("_start"), "_until")
    )
    picked = expand_intervals(spans, dates, "_start", "_until").select("signal_date", "score_date")
    return picked.join(scored, scored["as_of_date"] == picked["score_date"]).select(
        "signal_date", "score_date", "company_id", "ml_score"
    )


def evidence_asof(fundamentals: DataFrame, estimates: DataFrame, dates: DataFrame) -> DataFrame:
    """Newest fact per metric from both tables as evidence items."""
    # texts are made once per piece, before it is spread over its dates
    items = [
        pieces.select(
            "company_id", F.concat_ws(":", "source_file_id", "metric").alias("evidence_id"),
            F.initcap(F.replace("metric", F.lit("_"), F.lit(" "))).alias("label"),
            "value", "unit", "effective_at", "source_file_id", F.col("metric").alias("field"), "valid_from", "valid_to",
        ) for pieces in (fact_pieces(fundamentals, "period_end"), fact_pieces(estimates, "fiscal_period"))
    ]
    found = expand_intervals(items[0].unionByName(items[1]), dates, "valid_from", "valid_to").drop("valid_from", "valid_to")
    return found.select("signal_date", *[c for c in found.columns if c != "signal_date"])


def default_cutoff(fundamentals: DataFrame, estimates: DataFrame, market_returns: DataFrame, prices: DataFrame, today: Column) -> DataFrame:
    """Greatest of three latest dates capped at today; last price date when all are empty."""
    latest_dates = None
    for df in (fundamentals, estimates, market_returns):
        one = df.agg(F.max("as_of_date").alias("d"))
        latest_dates = one if latest_dates is None else latest_dates.unionByName(one)
    last_price = prices.agg(F.max("price_date")).scalar()
    return latest_dates.agg(F.max("d").alias("d")).select(
        F.when(F.col("d").isNotNull(), F.least("d", today)).otherwise(last_price).alias("cutoff")
    )


def content_window(df: DataFrame, ts: str, start: Column, end: Column, now: Column) -> DataFrame:
    """Keep start <= ts < end + 1 day; undated rows only when the window reaches the present."""
    dated = (F.col(ts) >= start.cast("timestamp_ntz")) & (F.col(ts) < F.date_add(end, 1).cast("timestamp_ntz"))
    live = end.cast("timestamp_ntz") >= now - F.expr("INTERVAL 1 DAY")
    return df.where(F.when(F.col(ts).isNotNull(), dated).otherwise(live))


def vintage_asof(macro: DataFrame, dates: DataFrame, lookback_days: int) -> DataFrame:
    """P10: macro value known on each signal date, observations inside the look-back."""
    pieces = validity_intervals(macro, ["series", "obs_date"], "vintage", ["vintage"], ["value"])
    # an observation stops mattering lookback_days after its date
    pieces = pieces.withColumn(
        "valid_to", F.least(F.coalesce("valid_to", F.lit(FAR_FUTURE).cast("date")), F.date_add("obs_date", lookback_days))
    ).withColumn("valid_from", F.greatest("valid_from", "obs_date"))
    return expand_intervals(pieces, dates, "valid_from", "valid_to").select(
        "signal_date", "series", "obs_date", "vintage", "value"
    )


def ticker_asof(rows: DataFrame, membership: DataFrame, lookback_days: int = 430) -> DataFrame:
    """Ticker valid on the price date, NULL when the date lies outside a known ticker's life.

    Membership is joined on the company, and its rows per company are few (one per ticker
    spell); the matches of a row are folded into one by the aggregate right after.
    """
    rows = rows.withColumn("_req", F.upper(F.trim("ticker")))
    keys = ["company_id", "_req", "price_date"]
    spells = membership.groupBy("company_id").agg(
        F.array_sort(F.collect_set(F.struct(
            "member_from", F.upper(F.trim("ticker")).alias("sym"),
            F.coalesce("member_to", F.lit(FAR_FUTURE).cast("date")).alias("until"),
        ))).alias("spells")
    )
    joined = rows.join(spells, "company_id", "left")
    day = F.col("price_date")
    own = F.filter("spells", lambda s: s["sym"] == F.col("_req"))
    allowed = F.exists(own, lambda s: (F.date_sub(s["member_from"], lookback_days) <= day) & (day <= s["until"]))
    active = F.filter("spells", lambda s: (s["member_from"] <= day) & (day <= s["until"]))
    known = F.coalesce(F.size(own), F.lit(0)) > 0
    resolved = (
        F.when(F.col("_req") == BENCHMARK_TICKER, F.col("_req"))
        .when(~known, F.col("_req"))
        .when(~allowed, F.lit(None).cast("string"))
        .otherwise(F.coalesce(F.get(active, F.lit(0))["sym"], F.col("_req")))
    )
    return joined.withColumn("ticker_at_date", resolved).drop("spells", "_req")


def symbol_company_map(instruments: DataFrame, membership: DataFrame, start: Column, end: Column) -> DataFrame:
    """Ticker to company: newest instrument first, then newest membership in the window."""
    a = instruments.select(
        F.upper(F.trim("ticker")).alias("ticker"), "company_id", F.lit(1).alias("_p"), F.to_date("effective_at").alias("_d")
    )
    b = membership.where(
        (F.col("member_from") <= end) & (F.col("member_to").isNull() | (F.col("member_to") >= start))
    ).select(F.upper(F.trim("ticker")).alias("ticker"), "company_id", F.lit(0).alias("_p"), F.col("member_from").alias("_d"))
    both = a.unionByName(b).where((F.col("ticker") != "") & (F.col("ticker") != BENCHMARK_TICKER))
    picked = latest(both, ["ticker"], ["_p", "_d"], ["ticker", "company_id"])
    spark = instruments.sparkSession
    bench = spark.range(1).select(F.lit(BENCHMARK_TICKER).alias("ticker"), F.lit(BENCHMARK_COMPANY).alias("company_id"))
    return picked.unionByName(bench)


def staleness_check(bars: DataFrame, symbol: str, day: str, on: Column, max_age_days: int = 10) -> DataFrame:
    """Latest row per symbol and whether it is more than ``max_age_days`` before the date."""
    return bars.where(F.col(day) <= on).groupBy(symbol).agg(F.max(day).alias("latest_date")).select(
        symbol, "latest_date", F.datediff(on, "latest_date").alias("age_days"),
        (F.datediff(on, "latest_date") > max_age_days).alias("is_stale"),
    )


def unsettled_last_bar(bars: DataFrame, symbol: str, day: str, close: str, start: Column, end: Column) -> DataFrame:
    """Newest in-range bar per symbol and whether its close is missing."""
    picked = bars.where(F.col(day).between(start, end)).groupBy(symbol).agg(
        F.max(F.struct(F.col(day).alias("d"), F.col(close).alias("c"))).alias("m")
    )
    return picked.select(symbol, F.col("m.d").alias("last_date"), F.col("m.c").isNull().alias("is_unsettled"))


def lessons_asof(entries: DataFrame, asks: DataFrame, n_same: int = 5, n_cross: int = 3) -> DataFrame:
    """Per asked (ticker, as_of): newest resolved lessons of the ticker and of others.

    Newest means latest in the log (trade date, then ticker). For other tickers the newest
    ``n_cross`` lessons always belong to the ``n_cross + 1`` most recent tickers, so a short
    list per as-of date is enough and asks never meet all entries.
    """
    asks = asks.select("ask_ticker", "as_of").distinct()
    order = [F.col("trade_date").desc(), F.col("ticker").desc()]
    known = recent_lessons(entries, asks.select("as_of").distinct(), max(n_same, n_cross))
    cols = ["ask_ticker", "as_of", "kind", "rank", "ticker", "trade_date", "resolved", "rating"]

    # both sides are large, and the file of the asks is smaller than their rows
    same = asks.join(known.withColumnRenamed("ticker", "ask_ticker").hint("merge"), ["as_of", "ask_ticker"]).withColumn("ticker", F.col("ask_ticker"))
    same = top_k(same, ["ask_ticker", "as_of"], order, n_same, "rank").withColumn("kind", F.lit("same"))

    newest = known.groupBy("as_of", "ticker").agg(F.max("trade_date").alias("trade_date"))
    short = known.join(top_k(newest, ["as_of"], order, n_cross + 1).select("as_of", "ticker"), ["as_of", "ticker"])
    # one short list per date, newest first, in which an ask passes over its own ticker
    lesson = F.struct("trade_date", "ticker", "resolved", "rating")
    lists = top_k(short, ["as_of", "ticker"], order, n_cross).groupBy("as_of").agg(F.sort_array(F.collect_list(lesson), asc=False).alias("_list"))
    others = F.slice(F.filter("_list", lambda x: x["ticker"] != F.col("ask_ticker")), 1, n_cross)
    cross = join_days(asks, lists, ["as_of"]).select("ask_ticker", "as_of", F.posexplode(others).alias("_at", "_e"))
    cross = cross.select("ask_ticker", "as_of", "_e.*", (F.col("_at") + 1).alias("rank"), F.lit("cross").alias("kind"))
    return same.select(*cols).unionByName(cross.select(*cols))


def recent_lessons(entries: DataFrame, dates: DataFrame, k: int) -> DataFrame:
    """Lessons that can be among the newest k of their ticker on each date.

    A lesson is surely out once the k lessons after it are all resolved; the callers cut
    to exactly k afterwards.
    """
    resolved = entries.where(F.col("resolved").isNotNull())
    w = W.partitionBy("ticker").orderBy("trade_date").rowsBetween(1, k)
    pieces = resolved.withColumn(
        "_until", F.when(F.count("resolved").over(w) == k, F.date_sub(F.max("resolved").over(w), 1))
    )
    d = dates.withColumnRenamed("as_of", "signal_date")
    return expand_intervals(pieces, d, "resolved", "_until").drop("_until").withColumnRenamed("signal_date", "as_of")


def extreme_return_in_membership(prices: DataFrame, membership: DataFrame, threshold: float = 3.0) -> DataFrame:
    """P20: daily moves above the threshold while the company is an index member."""
    w = W.partitionBy("company_id", "ticker").orderBy("price_date")
    moves = (
        prices.withColumn("prev_close", F.lag("adjusted_close").over(w))
        .withColumn("move", F.when(F.abs("prev_close") > 0, F.col("adjusted_close") / F.col("prev_close") - 1))
        .where(F.abs("move") > threshold)
    )
    m = membership.where(F.col("index_code") == "SP500").select(
        F.col("company_id").alias("_c"), "member_from", F.coalesce("member_to", F.lit(FAR_FUTURE).cast("date")).alias("_to")
    )
    active = moves.where(F.col("ticker") != BENCHMARK_TICKER).join(
        m, (F.col("company_id") == F.col("_c")) & F.col("price_date").between(F.col("member_from"), F.col("_to")), "left_semi"
    )
    return active.unionByName(moves.where(F.col("ticker") == BENCHMARK_TICKER)).select(
        "company_id", "ticker", "price_date", "prev_close", "adjusted_close", "move"
    )


def best_snapshot_per_period(coverage: DataFrame, unit: str) -> DataFrame:
    """Snapshot with the best coverage ratio per month or quarter; the earliest wins ties."""
    ratio = F.when(F.col("active_count") > 0, F.col("covered") / F.col("active_count")).otherwise(F.lit(0.0))
    df = coverage.withColumn("ratio", ratio).withColumn("period", F.trunc("snapshot_date", unit))
    picked = df.groupBy("period").agg(
        F.max(F.struct("ratio", (-F.datediff("snapshot_date", F.lit("1970-01-01"))).alias("o"), "snapshot_date", "covered", "active_count")).alias("m")
    )
    return picked.select("period", F.col("m.snapshot_date"), F.col("m.covered"), F.col("m.active_count"), F.col("m.ratio"))
