"""Text, social, macro and model-record queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitgrid.operators import text
from pitgrid.plans.factor import DIGEST
from pitgrid.plans.registry import query, step

NULLS = "CAST(NULL AS STRING)"


def articles(t):
    d = t.documents.withColumn("title", F.substring_index("text", "\n", 1)).withColumn("ts", F.lit(1704067200) + F.col("doc_id") * 3600)
    nested = F.to_json(F.struct(F.struct(
        "title", F.col("lang").alias("summary"), F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("pubDate"),
        F.struct(F.col("source").alias("displayName")).alias("provider"), F.struct(F.concat(F.lit("http://a/"), "doc_id").alias("url")).alias("canonicalUrl")).alias("content")))
    flat = F.to_json(F.struct(F.when(F.col("doc_id") % 4 != 0, F.col("title")).alias("title"), F.col("lang").alias("summary"),
                              F.when(F.col("doc_id") % 8 != 0, F.col("ts")).alias("providerPublishTime")))
    return d.select("doc_id", F.when(F.col("doc_id") % 2 == 1, nested).otherwise(flat).alias("payload"))


step("articles", """
  SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN split_part(text, chr(10), 1) ELSE 'No title' END AS title, lang AS summary, CASE WHEN doc_id % 2 = 1 THEN source ELSE 'Unknown' END AS publisher,
         CASE WHEN doc_id % 2 = 1 THEN concat('http://a/', doc_id) ELSE '' END AS link, CASE WHEN doc_id % 8 <> 0 THEN make_timestamp((1704067200 + doc_id * 3600) * 1000000) END AS published_at
  FROM documents""")


@query("X01_extract_articles", "doc_id:i title:s summary:s publisher:s link:s published_at:t", "SELECT * FROM articles")
def x01(t):
    return text.extract_articles(articles(t), "payload")


@query("X02_dedupe_titles", "title:s doc_id:i", "SELECT title, min(doc_id) AS doc_id FROM (SELECT doc_id, text AS title FROM documents) d WHERE title <> '' GROUP BY title")
def x02(t):
    return text.dedupe_titles(t.documents.select("doc_id", F.col("text").alias("title"), "lang"), "title", ["doc_id"])


BODY = "CASE WHEN page_id % 3 = 0 THEN concat('<p>x</p><!-- SC_OFF -->', html, '<!-- SC_ON --> tail') ELSE html END"


def unescape_sql(x: str) -> str:
    for e, c in text.ENTITIES.items():
        x = f"replace({x}, '{e}', '{c if c != chr(39) else chr(39) * 2}')"
    return x


@query("X03_strip_html", "page_id:i n_chars:i body_hash:s", f"""
  SELECT page_id, length(b) AS n_chars, sha256(b) AS body_hash FROM (SELECT page_id, trim(regexp_replace({unescape_sql("regexp_replace(h, '<[^>]+>', ' ', 'g')")}, '[\\s ]+', ' ', 'g')) AS b FROM (
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN split_part(split_part(x, '<!-- SC_OFF -->', 2), '<!-- SC_ON -->', 1) ELSE x END AS h FROM (SELECT page_id, {BODY} AS x FROM pages) a) p) q""")
def x03(t):
    b = t.pages.select("page_id", text.strip_html(F.expr(BODY)).alias("b"))
    return b.select("page_id", F.char_length("b").alias("n_chars"), F.sha2("b", 256).alias("body_hash"))


@query("X04_sentiment_counts", "ticker:s bullish:i bearish:i unlabeled:i total:i bull_pct:i bear_pct:i", """
  SELECT ticker, count(*) FILTER (WHERE label = 'Bullish') AS bullish, count(*) FILTER (WHERE label = 'Bearish') AS bearish, count(*) FILTER (WHERE label IS NULL) AS unlabeled, count(*) AS total,
         round_even(100.0 * count(*) FILTER (WHERE label = 'Bullish') / count(*), 0) AS bull_pct, round_even(100.0 * count(*) FILTER (WHERE label = 'Bearish') / count(*), 0) AS bear_pct
  FROM messages GROUP BY ticker""")
def x04(t):
    return text.sentiment_counts(t.messages, ["ticker"])


@query("X05_post_digest", "source:s place:i line:s excerpt:s", """
  SELECT source, place, concat('[2024-01-', lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0'), CASE WHEN doc_id % 3 <> 0 THEN printf(' · %4d↑ · %3dc', n_chars, doc_id % 50) ELSE '' END, '] ', trim(split_part(text, chr(10), 1), ' ')) AS line,
         CASE WHEN length(b) > 240 THEN concat(substr(b, 1, 240), '…') ELSE b END AS excerpt
  FROM (SELECT *, trim(replace(text, chr(10), ' '), ' ') AS b, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS place FROM documents) d WHERE place <= 5""")
def x05(t):
    posts = t.documents.select(
        "source", "doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("selftext"), F.when(F.col("doc_id") % 3 != 0, F.col("n_chars")).alias("score"),
        (F.col("doc_id") % 50).alias("num_comments"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int")).alias("created_at"))
    return text.post_digest(posts, "source", [F.col("doc_id").desc()], 5)


SYMBOLS = ("xauusd+", "btc-usd", "ETHUSDT", "eurusd", "GOLD", "aapl", "BRK.B", "spx500", " gbpjpy ", "dogeusdc", "usdusd+", "abcusd", "^GSPC", "../x", "...", "a b")
PICK = "list_extract([" + ", ".join(f"'{s}'" for s in SYMBOLS) + "], CAST(p_partkey % 16 AS INT) + 1)"


def symbols(t):
    arr = F.array(*[F.lit(s) for s in SYMBOLS])
    return t.part.select("p_partkey", F.get(arr, (F.col("p_partkey") % 16).cast("int")).alias("symbol"), "p_name", "p_size")


def values_sql(answers: tuple) -> str:
    return "list_extract([" + ", ".join("NULL" if a is None else ("true" if a is True else "false" if a is False else f"'{a}'") for a in answers) + "], CAST(p_partkey % 16 AS INT) + 1)"


@query("X06_normalize_symbol", "p_partkey:i symbol:s canonical:s", f"SELECT p_partkey, {PICK} AS symbol, " + values_sql((
    "GC=F", "BTC-USD", "ETH-USD", "EURUSD=X", "GC=F", "AAPL", "BRK.B", "^GSPC", "GBPJPY=X", "DOGE-USD", "USDUSD=X", "ABCUSD", "^GSPC", "../X", "...", "A B")) + " AS canonical FROM part")
def x06(t):
    return symbols(t).withColumn("canonical", text.normalize_symbol(F.col("symbol")))


@query("X07_crypto_base", "p_partkey:i base:s social:s", "SELECT p_partkey, " + values_sql((None, "BTC", "ETH", None, None, None, None, None, None, "DOGE", None, None, None, None, None, None)) + " AS base, "
       + values_sql(("XAUUSD+", "BTC.X", "ETH.X", "EURUSD", "GOLD", "AAPL", "BRK.B", "SPX500", "GBPJPY", "DOGE.X", "USDUSD+", "ABCUSD", "^GSPC", "../X", "...", "A B")) + " AS social FROM part")
def x07(t):
    return symbols(t).select("p_partkey", text.crypto_base(F.col("symbol")).alias("base"), text.social_symbol(F.col("symbol")).alias("social"))


@query("X08_symbol_validity", "p_partkey:i symbol_ok:b name_ok:b", "SELECT p_partkey, " + values_sql((True,) * 8 + (False,) + (True,) * 4 + (False, False, False))
       + " AS symbol_ok, regexp_full_match(repeat(replace(p_name, ' ', '-'), p_size), '[A-Za-z0-9._\\-^=+]+') AND length(repeat(p_name, p_size)) <= 32 AS name_ok FROM part")
def x08(t):
    name = F.repeat(F.replace("p_name", F.lit(" "), F.lit("-")), F.col("p_size"))
    return symbols(t).select("p_partkey", text.symbol_valid(F.col("symbol")).alias("symbol_ok"), text.symbol_valid(name).alias("name_ok"))


def macro_points(t):
    return t.macro.where(F.col("vintage") == F.date_add("obs_date", 60)).withColumn("raw", F.when(F.month("obs_date") % 5 == 0, ".").otherwise(F.col("value").cast("string")))


step("macro_points", "SELECT * FROM macro WHERE vintage = obs_date + 60 AND month(obs_date) % 5 <> 0")


@query("X09_macro_change", "series:s n_points:i first_date:d first_value:f last_date:d last_value:f delta:f pct:f", """
  SELECT series, count(*) AS n_points, min(obs_date) AS first_date, min_by(value, obs_date) AS first_value, max(obs_date) AS last_date, max_by(value, obs_date) AS last_value,
         max_by(value, obs_date) - min_by(value, obs_date) AS delta, (max_by(value, obs_date) - min_by(value, obs_date)) / min_by(value, obs_date) * 100 AS pct FROM macro_points GROUP BY series""")
def x09(t):
    return text.macro_change(macro_points(t))[0]


@query("X09_macro_rows", "series:s place:i obs_date:d value:f", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY obs_date DESC) AS place FROM macro_points) q WHERE place <= 40")
def x09b(t):
    return text.macro_change(macro_points(t))[1]


ASKED = ("Core CPI", "10y-treasury", "gdp", "bank of japan rate", "DGS5", " vix ", "a_series_id_that_is_longer_than_30", "")


@query("X10_macro_alias", "p_partkey:i series:s", "SELECT p_partkey, list_extract(['CPILFESL', 'DGS10', 'GDP', NULL, 'DGS5', 'VIXCLS', NULL, NULL], CAST(p_partkey % 8 AS INT) + 1) AS series FROM part")
def x10(t):
    arr = F.array(*[F.lit(s) for s in ASKED])
    return t.part.select("p_partkey", text.macro_alias(F.get(arr, (F.col("p_partkey") % 8).cast("int"))).alias("series"))


@query("X11_rank_prediction_markets", "market_id:i question:s outcome:s probability:f volume:f week_change_pp:f", """
  SELECT p_partkey AS market_id, p_name AS question, 'Yes' AS outcome, p_size / 100.0 AS probability, p_retailprice AS volume, CASE WHEN p_size % 10 <> 5 THEN (p_size % 10 - 5) AS DOUBLE END AS week_change_pp
  FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 7 <> 0 AND (p_partkey % 4 <> 1) ORDER BY p_retailprice DESC, p_partkey LIMIT 6""".replace("(p_size % 10 - 5) AS DOUBLE", "CAST(p_size % 10 - 5 AS DOUBLE)"))
def x11(t):
    m = t.part.select(
        F.col("p_partkey").alias("market_id"), F.col("p_name").alias("question"), F.when(F.col("p_partkey") % 7 == 0, "[]").otherwise('["Yes", "No"]').alias("outcomes"),
        F.to_json(F.array((F.col("p_size") / 100).cast("string"), (1 - F.col("p_size") / 100).cast("string"))).alias("outcomePrices"), F.col("p_retailprice").alias("volume"),
        (F.col("p_partkey") % 9 == 0).alias("closed"), F.when(F.col("p_partkey") % 4 == 1, F.lit("2024-01-01")).otherwise(F.lit("2024-06-01")).cast("timestamp_ntz").alias("end_at"),
        ((F.col("p_size") % 10 - 5) / 100.0).alias("week_change"))
    return text.rank_prediction_markets(m, F.lit("2024-03-01").cast("timestamp_ntz"))


TAILS = ("Rating: **Buy**", "rating - overweight", "**Rating**: HOLD", "Rating： Underweight", "Rating: strong\nRating: Sell", "", "Rating: unknown")


@query("X12_extract_rating", "doc_id:i rating:s signal:s", """
  SELECT doc_id, coalesce(a, CASE WHEN w = '' THEN NULL ELSE upper(w[1]) || w[2:] END) AS rating, coalesce(a, CASE WHEN w = '' THEN NULL ELSE upper(w[1]) || w[2:] END, 'REVIEW') AS signal
  FROM (SELECT doc_id, list_extract(['Buy', 'Overweight', 'Hold', 'Underweight', 'Sell', NULL, NULL], CAST(doc_id % 7 AS INT) + 1) AS a,
        lower(regexp_extract(text, '(?i)\\b(Buy|Overweight|Hold|Underweight|Sell)\\b', 1)) AS w FROM documents) d""")
def x12(t):
    body = F.concat("text", F.lit("\n"), F.get(F.array(*[F.lit(s) for s in TAILS]), (F.col("doc_id") % 7).cast("int")))
    d = t.documents.select("doc_id", body.alias("b"))
    return d.select("doc_id", text.extract_rating(F.col("b")).alias("rating"), text.signal(F.col("b")).alias("signal"))


def cited(t):
    ref = lambda k, f: F.concat(F.lit("src_"), ((F.col("doc_id") + k) % 5).cast("string"), F.lit(f":{f}"))
    return t.documents.select("doc_id", "text", F.array(ref(0, "roic"), ref(1, "net_income"), ref(0, "roic"), F.lit("nofield"), F.lit("src_9:price_to_earnings")).alias("refs"))


@query("X13_evidence_refs", "doc_id:i labels:s sources:s summary:s", """
  SELECT doc_id, 'ROIC|Net Income|P/E' AS labels, concat('src_', doc_id % 5, '|src_', (doc_id + 1) % 5, '|src_9') AS sources,
         concat('Doc ', doc_id, ' earns well, and grows (steadily). End') AS summary FROM documents""")
def x13(t):
    prose = F.concat(F.lit("Doc "), "doc_id", F.lit(" earns well [src_1:roic, src_2:eps] , and grows (steadily src_3:revenue ) ."), F.lit(" End [ ], "))
    c = cited(t).withColumn("e", text.evidence_refs(F.col("refs")))
    return c.select("doc_id", F.array_join(F.transform("e", lambda x: x["label"]), "|").alias("labels"), F.array_join(F.transform("e", lambda x: x["source_id"]), "|").alias("sources"),
                    text.strip_citations(prose).alias("summary"))


@query("X14_unsupported_refs", "doc_id:i bad:s", """
  SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct([concat('src_', doc_id % 5, ':roic'), concat('src_', (doc_id + 1) % 5, ':net_income'), 'nofield', 'src_9:price_to_earnings']),
         lambda r: r NOT IN ('src_1:roic', 'src_2:roic', 'src_2:net_income', 'src_3:net_income'))), ',') AS bad FROM documents""")
def x14(t):
    valid = F.array(*[F.lit(v) for v in ("src_1:roic", "src_2:roic", "src_2:net_income", "src_3:net_income")])
    return cited(t).select("doc_id", F.array_join(text.unsupported_refs(F.col("refs"), valid), ",").alias("bad"))


@query("X15_uncited_number", "doc_id:i has_number:b", "SELECT doc_id, regexp_matches(text, '(^|[^A-Za-z])[-+]?[0-9]') OR regexp_matches(text, '[0-9][0-9]') OR regexp_matches(text, '[A-Za-z][-+][0-9]') AS has_number FROM documents")
def x15(t):
    return t.documents.select("doc_id", text.uncited_number(F.col("text")).alias("has_number"))


@query("X16_evidence_availability", "packet_id:s items:i future_items:i accepted:b packet_hash:s", f"""
  SELECT company_id AS packet_id, count(*) AS items, count(*) FILTER (WHERE CAST(effective_at AS DATE) > d) AS future_items, count(*) FILTER (WHERE CAST(effective_at AS DATE) > d) = 0 AS accepted,
         sha256(concat(company_id, '|', count(*), '|', {DIGEST.format("line")})) AS packet_hash
  FROM (SELECT f.*, concat('{{"evidence_id":"', source_file_id, ':', metric, '","at":"', strftime(effective_at, '%Y-%m-%d %H:%M:%S'), '"}}') AS line, DATE '2001-06-30' + CAST(CAST(company_id AS BIGINT) % 4 * 60 AS INT) AS d FROM fundamentals f) q GROUP BY company_id""")
def x16(t):
    packets = t.fundamentals.select(F.col("company_id").alias("packet_id")).distinct().withColumn(
        "as_of_date", F.date_add(F.lit("2001-06-30").cast("date"), (F.col("packet_id").cast("bigint") % 4 * 60).cast("int")))
    ev = t.fundamentals.select(F.col("company_id").alias("packet_id"), F.concat_ws(":", "source_file_id", "metric").alias("evidence_id"), "effective_at")
    return text.evidence_availability(packets, ev)


step("model_runs", """
  SELECT concat('m', turn % 4) AS model, conv_id AS case_id, (conv_id + turn) % 11 <> 0 AS success, CAST((conv_id + turn) % 5 AS VARCHAR) AS rating, 1 + length(text) % 4 AS refs_total,
         least(1 + length(text) % 4, conv_id % 3 + 1) AS refs_valid, (length(text) % 30) / 100.0 - 0.15 AS score_adjustment, CAST(length(text) AS DOUBLE) AS latency, length(text) AS input_tokens, length(role) AS output_tokens
  FROM conversations""")


def model_runs(t):
    n = F.char_length("text")
    return t.conversations.select(
        F.concat(F.lit("m"), F.col("turn") % 4).alias("model"), F.col("conv_id").alias("case_id"), ((F.col("conv_id") + F.col("turn")) % 11 != 0).alias("success"),
        ((F.col("conv_id") + F.col("turn")) % 5).cast("string").alias("rating"), (1 + n % 4).alias("refs_total"), F.least(1 + n % 4, F.col("conv_id") % 3 + 1).alias("refs_valid"),
        ((n % 30) / 100.0 - 0.15).alias("score_adjustment"), n.cast("double").alias("latency"), n.alias("input_tokens"), F.char_length("role").alias("output_tokens"))


SCORE = "schema_success_rate:f evidence_coverage:f unsupported_claim_rate:f rating_stability:f numerical_consistency:f median_latency_ms:f input_tokens:i output_tokens:i"
step("scorecard", """
  SELECT r.model, count(DISTINCT case_id) AS cases, avg(CASE WHEN success THEN 1.0 ELSE 0 END) AS schema_success_rate, sum(refs_valid) FILTER (WHERE success) / sum(refs_total) FILTER (WHERE success) AS evidence_coverage,
         sum(refs_total - refs_valid) FILTER (WHERE success) / sum(refs_total) FILTER (WHERE success) AS unsupported_claim_rate, max(s.st) AS rating_stability,
         count(*) FILTER (WHERE success AND score_adjustment BETWEEN -0.10 AND 0.10) / count(*) FILTER (WHERE success) AS numerical_consistency,
         median(latency) AS median_latency_ms, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens
  FROM model_runs r JOIN (SELECT model, avg(st) AS st FROM (SELECT model, case_id, max(n) / sum(n) AS st FROM (
      SELECT model, case_id, rating, count(*) AS n FROM model_runs WHERE success GROUP BY 1, 2, 3) a GROUP BY 1, 2) b GROUP BY 1) s ON s.model = r.model GROUP BY r.model""")


@query("X17_model_scorecard", "model:s cases:i " + SCORE, "SELECT * FROM scorecard")
def x17(t):
    return text.model_scorecard(model_runs(t))


@query("X18_model_selection", "model:s quality:f selected_for:s", """
  SELECT model, quality, CASE WHEN role = 'decision' AND quality = max(quality) OVER (PARTITION BY role) THEN 'decision'
    WHEN role = 'supporting' AND model = (SELECT model FROM scored_models WHERE role = 'supporting' AND quality >= (SELECT max(quality) FROM scored_models WHERE role = 'supporting') - 0.02
       ORDER BY input_tokens + output_tokens, median_latency_ms, model LIMIT 1) THEN 'supporting' END AS selected_for FROM scored_models""")
def x18(t):
    s = text.model_scorecard(model_runs(t)).withColumn("role_scope", F.when(F.col("model") == "m0", "decision").when(F.col("model") == "m1", "decision").otherwise("supporting"))
    return text.model_selection(s)


step("scored_models", """
  SELECT *, schema_success_rate * 0.25 + evidence_coverage * 0.25 + (1 - unsupported_claim_rate) * 0.2 + rating_stability * 0.15 + numerical_consistency * 0.15 AS quality,
         CASE WHEN model IN ('m0', 'm1') THEN 'decision' ELSE 'supporting' END AS role FROM scorecard""")


@query("X19_usage_totals", "model:s calls:i input_tokens:i output_tokens:i", "SELECT model, count(*) AS calls, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens FROM model_runs GROUP BY model")
def x19(t):
    return text.usage_totals(model_runs(t), ["model"])
