"""Text, social, macro and decision-record operators; expressions only, whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pitgrid.functions.columns import digest_sums
from pitgrid.functions.groups import latest, quantiles, top_k

# Rating scale.
RATINGS = ("Buy", "Overweight", "Hold", "Underweight", "Sell")
REVIEW = "REVIEW"

# Broker symbols with no rule of their own.
SYMBOL_ALIASES = {
    "XAUUSD": "GC=F", "XAU": "GC=F", "GOLD": "GC=F", "XAGUSD": "SI=F", "XAG": "SI=F", "SILVER": "SI=F", "XPTUSD": "PL=F", "XPDUSD": "PA=F",
    "WTICOUSD": "CL=F", "USOIL": "CL=F", "WTI": "CL=F", "BCOUSD": "BZ=F", "UKOIL": "BZ=F", "BRENT": "BZ=F", "NATGAS": "NG=F", "XNGUSD": "NG=F",
    "COPPER": "HG=F", "XCUUSD": "HG=F",
    "SPX500": "^GSPC", "US500": "^GSPC", "SPX": "^GSPC", "NAS100": "^NDX", "US100": "^NDX", "USTEC": "^NDX", "US30": "^DJI", "DJI30": "^DJI", "WS30": "^DJI",
    "GER40": "^GDAXI", "GER30": "^GDAXI", "DE40": "^GDAXI", "UK100": "^FTSE", "JP225": "^N225", "JPN225": "^N225", "FRA40": "^FCHI", "EU50": "^STOXX50E", "HK50": "^HSI",
}
CRYPTO_BASES = ("BTC", "ETH", "SOL", "XRP", "ADA", "DOGE", "LTC", "BCH", "DOT", "AVAX", "LINK")
CURRENCIES = (
    "USD", "EUR", "GBP", "JPY", "CHF", "CAD", "AUD", "NZD", "CNY", "CNH", "HKD", "SGD", "SEK", "NOK", "DKK", "PLN",
    "MXN", "ZAR", "TRY", "INR", "KRW", "BRL", "RUB", "THB",
)

# Macro aliases to series ids.
MACRO_SERIES = {
    "fed_funds_rate": "FEDFUNDS", "federal_funds_rate": "FEDFUNDS", "fed_funds": "FEDFUNDS", "2y_treasury": "DGS2", "10y_treasury": "DGS10",
    "30y_treasury": "DGS30", "10y_2y_spread": "T10Y2Y", "yield_curve": "T10Y2Y", "cpi": "CPIAUCSL", "core_cpi": "CPILFESL", "pce": "PCEPI",
    "core_pce": "PCEPILFE", "inflation_expectations": "T10YIE", "real_gdp": "GDPC1", "gdp": "GDP", "industrial_production": "INDPRO",
    "unemployment_rate": "UNRATE", "unemployment": "UNRATE", "nonfarm_payrolls": "PAYEMS", "payrolls": "PAYEMS", "initial_claims": "ICSA",
    "m2": "M2SL", "money_supply": "M2SL", "vix": "VIXCLS", "dollar_index": "DTWEXBGS", "consumer_sentiment": "UMCSENT",
    "housing_starts": "HOUST", "retail_sales": "RSAFS",
}

# Labels that differ from the title-cased field name.
FIELD_LABELS = {
    "price_to_earnings": "P/E", "price_to_book": "P/B", "tev_ebitda": "TEV / EBITDA", "ebitda": "EBITDA", "ebitda_margin": "EBITDA Margin",
    "eps_estimate": "EPS Estimate", "eps_analyst_count_1m": "EPS Analysts (1M)", "eps_up_revisions_1m": "EPS Up Revisions (1M)",
    "eps_down_revisions_1m": "EPS Down Revisions (1M)", "eps_up_revisions_3m": "EPS Up Revisions (3M)", "eps_down_revisions_3m": "EPS Down Revisions (3M)",
    "roic": "ROIC", "return_on_equity": "ROE", "return_on_assets": "ROA", "sp_norm_eps_act_or_est": "S&P Norm EPS",
}

ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}

ARTICLE = (
    "title string, summary string, publisher string, link string, providerPublishTime bigint, "
    "content struct<title:string,summary:string,pubDate:string,provider:struct<displayName:string>,canonicalUrl:struct<url:string>,clickThroughUrl:struct<url:string>>"
)


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Value of a fixed map, NULL when absent."""
    pairs = [x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]
    return F.try_element_at(F.create_map(*pairs), key)


def extract_articles(df: DataFrame, payload: str) -> DataFrame:
    """Nested or flat article JSON to title, summary, publisher, link and UTC time."""
    a = F.from_json(F.col(payload), ARTICLE)
    df = df.withColumn("_a", a)
    c, nested = "_a.content", F.col("_a.content").isNotNull()
    iso = F.try_to_timestamp(F.col(f"{c}.pubDate")).cast("timestamp_ntz")
    epoch = F.when(F.col("_a.providerPublishTime") != 0, F.timestamp_seconds("_a.providerPublishTime").cast("timestamp_ntz"))
    pick = lambda n, f, default: F.coalesce(F.when(nested, F.col(n)).otherwise(F.col(f)), F.lit(default))
    return df.withColumns({
        "title": pick(f"{c}.title", "_a.title", "No title"), "summary": pick(f"{c}.summary", "_a.summary", ""),
        "publisher": pick(f"{c}.provider.displayName", "_a.publisher", "Unknown"),
        "link": F.coalesce(F.when(nested, F.coalesce(f"{c}.canonicalUrl.url", f"{c}.clickThroughUrl.url")).otherwise(F.col("_a.link")), F.lit("")),
        "published_at": F.when(nested, iso).otherwise(epoch),
    }).drop("_a", payload)


def dedupe_titles(df: DataFrame, title: str, order: list[str], limit: int | None = None) -> DataFrame:
    """First row per non-empty title in query order; ``limit`` is the report's own length."""
    columns = df.columns
    packed = F.struct(*[F.col(o) for o in order], *[F.col(c) for c in columns if c not in order])
    first = df.where(F.coalesce(F.col(title), F.lit("")) != "").groupBy(title).agg(F.min(packed).alias("_m"))
    out = first.select(*[F.col(title) if c == title else F.col(f"_m.{c}").alias(c) for c in columns])
    return out.orderBy(*order).limit(limit) if limit else out


def strip_html(html: Column) -> Column:
    """Post body between its markers if present, tags to blanks, entities resolved, blanks collapsed."""
    h = F.coalesce(html, F.lit(""))
    inner = F.split_part(F.split_part(h, F.lit("<!-- SC_OFF -->"), F.lit(2)), F.lit("<!-- SC_ON -->"), F.lit(1))
    h = F.when(F.contains(h, F.lit("<!-- SC_OFF -->")) & F.contains(h, F.lit("<!-- SC_ON -->")), inner).otherwise(h)
    text = F.regexp_replace(h, "<[^>]+>", " ")
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, "[\\s\\u00a0]+", " "))


def sentiment_counts(df: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Labelled and unlabelled messages with half-even rounded percents."""
    a = df.groupBy(*keys).agg(
        F.count_if(F.coalesce(F.col(label) == "Bullish", F.lit(False))).alias("bullish"),
        F.count_if(F.coalesce(F.col(label) == "Bearish", F.lit(False))).alias("bearish"), F.count(F.lit(1)).alias("total"),
    ).withColumn("unlabeled", F.col("total") - F.col("bullish") - F.col("bearish"))
    pct = lambda c: F.when(F.col("total") > 0, F.bround(100 * F.col(c) / F.col("total"), 0).cast("long")).otherwise(0)
    return a.withColumn("bull_pct", pct("bullish")).withColumn("bear_pct", pct("bearish"))


def post_digest(df: DataFrame, channel: str, order: list[Column], per_channel: int) -> DataFrame:
    """The newest posts per channel as display lines with a 240-character excerpt."""
    posts = top_k(df, [channel], order, per_channel, "place")
    flat = lambda c: F.trim(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("\n"), F.lit(" ")))
    body = flat("selftext")
    excerpt = F.when(F.char_length(body) > 240, F.concat(F.substring(body, 1, 240), F.lit("…"))).otherwise(body)
    day = F.coalesce(F.date_format("created_at", "yyyy-MM-dd"), F.lit("?"))
    metrics = F.when(F.col("score").isNotNull() & F.col("num_comments").isNotNull(), F.format_string(" · %4d↑ · %3dc", "score", "num_comments")).otherwise("")
    line = F.concat(F.lit("["), day, metrics, F.lit("] "), flat("title"))
    return posts.select(channel, "place", line.alias("line"), excerpt.alias("excerpt"))


def crypto_base(symbol: Column) -> Column:
    """Base of a known USD, USDT or USDC crypto pair, else NULL."""
    compact = F.replace(F.rtrim(F.upper(F.trim(symbol)), F.lit("+")), F.lit("-"), F.lit(""))
    base = F.regexp_extract(compact, "^(.*?)(USDT|USDC|USD)$", 1)
    return F.when(base.isin(*CRYPTO_BASES), base)


def social_symbol(symbol: Column) -> Column:
    """Crypto as BASE.X, everything else upper-cased."""
    base = crypto_base(symbol)
    return F.when(base.isNotNull(), F.concat(base, F.lit(".X"))).otherwise(F.upper(F.trim(symbol)))


def normalize_symbol(symbol: Column) -> Column:
    """Alias, crypto pair, currency pair, else the upper-cased symbol."""
    s = F.rtrim(F.upper(F.trim(symbol)), F.lit("+"))
    base = crypto_base(symbol)
    pair = (F.char_length(s) == 6) & F.substring(s, 1, 3).isin(*CURRENCIES) & F.substring(s, 4, 3).isin(*CURRENCIES)
    mapped = F.coalesce(lookup(SYMBOL_ALIASES, s), F.concat(base, F.lit("-USD")), F.when(pair, F.concat(s, F.lit("=X"))), s)
    return F.when(F.trim(symbol) == "", symbol).otherwise(mapped)


def symbol_valid(symbol: Column, max_len: int = 32) -> Column:
    """Allowed characters, at most 32, not only dots."""
    ok = symbol.rlike("^[A-Za-z0-9._\\-\\^=+]+$") & (F.char_length(symbol) <= max_len) & ~symbol.rlike("^\\.+$")
    return F.coalesce(ok, F.lit(False))


def macro_change(df: DataFrame, max_rows: int = 40) -> tuple[DataFrame, DataFrame]:
    """Per series first, last, change and percent; and the newest rows to show."""
    points = df.where(F.col("raw").isNotNull() & ~F.trim("raw").isin(".", "")).withColumn("value", F.expr("try_cast(raw AS DOUBLE)"))
    ends = points.groupBy("series").agg(
        F.min(F.struct("obs_date", "value")).alias("a"), F.max(F.struct("obs_date", "value")).alias("z"), F.count(F.lit(1)).alias("n_points"))
    delta = F.col("z.value") - F.col("a.value")
    summary = ends.select(
        "series", "n_points", F.col("a.obs_date").alias("first_date"), F.col("a.value").alias("first_value"), F.col("z.obs_date").alias("last_date"),
        F.col("z.value").alias("last_value"), delta.alias("delta"), F.when(F.col("a.value") != 0, delta / F.nullif(F.col("a.value"), F.lit(0.0)) * 100).alias("pct"),
    )
    return summary, top_k(points, ["series"], [F.col("obs_date").desc()], max_rows, "place")


def macro_alias(indicator: Column) -> Column:
    """Series id of an alias, a plausible raw id itself, else NULL (rejected)."""
    key = F.translate(F.lower(F.trim(indicator)), " -", "__")
    raw = F.upper(F.trim(indicator))
    return F.coalesce(lookup(MACRO_SERIES, key), F.when((raw != "") & (F.char_length(raw) <= 30) & ~raw.rlike("\\s"), raw))


def rank_prediction_markets(df: DataFrame, now: Column, limit: int = 6) -> DataFrame:
    """X11: open markets by volume with the first outcome's probability; ``limit`` is the report's length."""
    m = df.withColumn("_o", F.from_json("outcomes", "array<string>")).withColumn("_p", F.from_json("outcomePrices", "array<string>"))
    live = ~F.coalesce("closed", F.lit(False)) & (F.col("end_at").isNull() | (F.col("end_at") >= now))
    m = m.where(live & (F.coalesce(F.size("_o"), F.lit(0)) > 0) & (F.coalesce(F.size("_p"), F.lit(0)) > 0))
    prob = F.expr("try_cast(get(_p, 0) AS DOUBLE)")
    return m.orderBy(F.coalesce("volume", F.lit(0.0)).desc(), F.col("market_id")).limit(limit).select(
        "market_id", "question", F.get("_o", F.lit(0)).alias("outcome"), prob.alias("probability"), F.coalesce("volume", F.lit(0.0)).alias("volume"),
        F.when(F.col("week_change") != 0, F.col("week_change") * 100).alias("week_change_pp"),
    ).where("probability IS NOT NULL")


def fold_width(text: Column) -> Column:
    """Full-width letters, digits and punctuation to ASCII."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    return F.translate(text, wide, "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)))


def extract_rating(text: Column) -> Column:
    """Rating of the first line with a valid label, else the first standalone rating word, else NULL."""
    t = fold_width(text)
    words = "|".join(RATINGS)
    # the shortest run up to a separator that is followed by a word; only the first such match of a line counts
    lines = F.transform(F.split(t, "\\r\\n|[\\n\\r\\u000b\\u000c\\u0085\\u2028\\u2029]"), lambda s: F.lower(F.regexp_extract(s, "(?iU)rating.*?[:\\-][\\s*]*(\\w+)", 1)))
    label = F.get(F.filter(lines, lambda w: w.isin(*[r.lower() for r in RATINGS])), F.lit(0))
    word = F.nullif(F.lower(F.regexp_extract(t, f"(?iU)\\b({words})\\b", 1)), F.lit(""))
    return F.initcap(F.coalesce(label, word))


def signal(text: Column) -> Column:
    """Rating or REVIEW."""
    return F.coalesce(extract_rating(text), F.lit(REVIEW))


def evidence_refs(refs: Column) -> Column:
    """``source:field`` references, first occurrences in order, as structs with a display label."""
    tidy = F.filter(F.array_distinct(F.transform(refs, lambda r: F.trim(r))), lambda r: r.rlike("(?s)^[^:]+:.+$"))

    def item(r: Column) -> Column:
        source = F.regexp_extract(r, "(?s)^([^:]+):", 1)
        field = F.regexp_extract(r, "(?s)^[^:]+:(.+)$", 1)
        label = F.coalesce(lookup(FIELD_LABELS, field), F.initcap(F.trim(F.replace(field, F.lit("_"), F.lit(" ")))))
        return F.struct(r.alias("raw"), source.alias("source_id"), field.alias("field"), label.alias("label"))

    return F.transform(tidy, item)


def strip_citations(summary: Column) -> Column:
    """Summary without citation blocks and tokens, blanks tidied; the original if nothing is left."""
    s = F.trim(F.coalesce(summary, F.lit("")))
    out = s
    for pattern, to in (
        ("(?i)\\[(?:\\s*src_[^,\\]\\s]+:[^,\\]\\s]+\\s*,?)+\\]", ""), ("(?i)src_[0-9a-z]+:[a-z0-9_]+", ""), ("\\[\\s*,?\\s*\\]", ""),
        ("\\s{2,}", " "), ("\\s+\\)", ")"), ("\\s+([,.;])", "$1"),
    ):
        out = F.regexp_replace(out, pattern, to)
    out = F.trim(out, F.lit(" ,"))
    return F.when(out != "", out).otherwise(s)


def unsupported_refs(refs: Column, valid: Column) -> Column:
    """Sorted references that are not in the packet's evidence."""
    return F.array_sort(F.array_except(F.array_distinct(refs), valid))


def uncited_number(text: Column) -> Column:
    """Text holds a number that does not follow a letter."""
    return F.coalesce(text.rlike("(?<![A-Za-z])[-+]?\\d+(?:\\.\\d+)?%?"), F.lit(False))


def evidence_availability(packets: DataFrame, evidence: DataFrame) -> DataFrame:
    """Packets with their future evidence counted and an order-free hash of the evidence.

    Evidence is hashed row by row and the hashes are summed, so no packet is collected.
    """
    e = evidence.join(packets.select("packet_id", "as_of_date"), "packet_id")
    late = F.to_date("effective_at") > F.col("as_of_date")
    line = F.to_json(F.struct("evidence_id", F.col("effective_at").cast("string").alias("at")))
    a = e.groupBy("packet_id").agg(F.count(F.lit(1)).alias("items"), F.count_if(late).alias("future_items"), digest_sums(line).alias("_h"))
    return a.select("packet_id", "items", "future_items", (F.col("future_items") == 0).alias("accepted"), F.sha2(F.concat_ws("|", "packet_id", "items", "_h"), 256).alias("packet_hash"))


def model_scorecard(runs: DataFrame) -> DataFrame:
    """Success, reference, stability, bounds, latency and token figures per model.

    ``runs`` has model, case_id, success, rating, refs_total, refs_valid, score_adjustment, latency, input_tokens, output_tokens.
    """
    ok = F.col("success")
    votes = runs.where(ok).groupBy("model", "case_id", "rating").agg(F.count(F.lit(1)).alias("_n"))
    stable = votes.groupBy("model", "case_id").agg((F.max("_n") / F.sum("_n")).alias("_s")).groupBy("model").agg(F.avg("_s").alias("rating_stability"))
    median = quantiles(runs, ["model"], "latency", {"median_latency_ms": 0.5}).drop("n_all")
    ratio = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    total, valid = F.sum(F.when(ok, F.col("refs_total"))), F.sum(F.when(ok, F.col("refs_valid")))
    base = runs.groupBy("model").agg(
        F.count_distinct("case_id").alias("cases"), ratio(F.count_if(ok), F.count(F.lit(1))).alias("schema_success_rate"),
        ratio(valid, total).alias("evidence_coverage"), ratio(total - valid, total).alias("unsupported_claim_rate"),
        ratio(F.count_if(ok & F.col("score_adjustment").between(-0.10, 0.10)), F.count_if(ok)).alias("numerical_consistency"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
    )
    return base.join(stable, "model", "left").join(median, "model", "left").fillna(0.0, ["rating_stability", "median_latency_ms"])


def model_selection(scores: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Weighted quality; best decision model; cheapest supporting model near its best.

    One row per model configuration. Fixed weights: success .25, coverage .25, supported .20, stability .15, bounds .15.
    """
    q = (F.col("schema_success_rate") * 0.25 + F.col("evidence_coverage") * 0.25 + (1 - F.col("unsupported_claim_rate")) * 0.20
         + F.col("rating_stability") * 0.15 + F.col("numerical_consistency") * 0.15)
    s = scores.withColumn("quality", q)
    decision = s.where("role_scope = 'decision'")
    best_decision = F.coalesce(
        decision.agg(F.max_by("model", F.struct("quality", "model"))).scalar(), s.agg(F.max_by("model", F.struct("quality", "model"))).scalar())
    support = s.where("role_scope = 'supporting'")
    near = support.where(F.col("quality") >= support.agg(F.max("quality")).scalar() - tolerance)
    cheapest = near.agg(F.min_by("model", F.struct(F.col("input_tokens") + F.col("output_tokens"), "median_latency_ms", "model"))).scalar()
    return s.withColumn("selected_for", F.when(F.col("model") == best_decision, "decision").when(F.col("model") == cheapest, "supporting"))


def usage_totals(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls and tokens."""
    return calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))
