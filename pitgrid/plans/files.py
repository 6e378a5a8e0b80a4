"""Source and sink queries: files are written from the tables by Spark, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitgrid.functions.staging import stage_folder
from pitgrid.operators import quality
from pitgrid.plans.certification import gaps
from pitgrid.plans.ingestion import export, typed
from pitgrid.plans.registry import query
from pitgrid.sources import lake, readers, writers

day = lambda s: F.lit(s).cast("date")
ts = lambda s: F.lit(s).cast("timestamp_ntz")


def once(t, name, write):
    """Folder of a file set, written on first use in a session."""
    key = f"_folder_{name}"
    if key not in t.__dict__:
        path = stage_folder(t.spark, name)
        write(path)
        t.__dict__[key] = path
    return t.__dict__[key]


@query("S01_scan_csv_export", "SP_ENTITY_ID:s IQ_PERIOD_END:s IQ_TOTAL_REV:f IQ_NET_INC_PARENT:s", "SELECT raw_id AS SP_ENTITY_ID, pe AS IQ_PERIOD_END, rev AS IQ_TOTAL_REV, ni IS NULL AS IQ_NET_INC_PARENT FROM export_rows")
def s01(t):
    cols = export(t).columns
    path = once(t, "csv", lambda p: export(t).where("SP_ENTITY_ID IS NOT NULL").write.option("header", True).csv(p))
    df = readers.scan_csv_export(t.spark, path, cols)
    return df.withColumns({"IQ_TOTAL_REV": F.expr("try_cast(IQ_TOTAL_REV AS DOUBLE)"), "IQ_NET_INC_PARENT": F.col("IQ_NET_INC_PARENT").isNull()})


def lake_root(t):
    """The lake of the price table, one generation; a fixture."""
    return once(t, "lake", lambda p: writers.merge_into_price_lake(t.spark, p, t.prices))


_YEARS = "price_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'"


@query("S02_scan_price_lake", "company_id:s price_date:d source:s close:f", f"""
  SELECT p.company_id, price_date, source, close FROM prices p JOIN (SELECT DISTINCT company_id FROM holdings) h ON h.company_id = p.company_id WHERE {_YEARS}
  UNION ALL SELECT company_id, price_date, source, close FROM prices WHERE ticker = 'SPY' AND {_YEARS}""")
def s02(t):
    spy = t.prices.where("ticker = 'SPY'").select("ticker").distinct()
    return readers.scan_price_lake(readers.price_lake(t.spark, lake_root(t), 1997, 1999), day("1997-01-01"), day("1999-12-31"), t.holdings, spy)


def vintages(t):
    """A later load that corrects the prices of one source."""
    return t.prices.where("source = 'yahoo_adjusted'").withColumns({"close": F.col("close") + 1, "ingested_at": ts("2002-02-01"), "source_file_id": F.lit("src_fix")})


@query("S03_merge_price_lake", "company_id:s price_date:d source:s close:f source_file_id:s", "SELECT company_id, price_date, source, CASE WHEN source = 'yahoo_adjusted' AND price_date >= DATE '1998-01-01' THEN close + 1 ELSE close END AS close, CASE WHEN source = 'yahoo_adjusted' AND price_date >= DATE '1998-01-01' THEN 'src_fix' ELSE source_file_id END AS source_file_id FROM prices")
def s03(t):
    """The correction touches the years from 1998 on; each call writes a generation of its own."""
    root = once(t, "merged-lake", lambda p: writers.merge_into_price_lake(t.spark, p, t.prices))
    writers.merge_into_price_lake(t.spark, root, vintages(t).where("price_date >= DATE '1998-01-01'"))
    return lake.read_parts(t.spark, root)


def symbol_rows(t):
    return t.prices.where("company_id <> '5'").select("ticker", "company_id").distinct()


@query("S04_flatten_bars_json", "company_id:s ticker:s price_date:d open:f close:f volume:f source:s effective_at:t", """
  SELECT company_id, ticker, price_date, open, close, CASE WHEN volume > 3 THEN volume ELSE 0 END AS volume, 'alpaca_iex_adjusted' AS source, CAST(price_date + INTERVAL 1 DAY AS TIMESTAMP) - INTERVAL 1 MICROSECOND AS effective_at FROM prices_best WHERE company_id <> '5'""")
def s04(t):
    def write(path):
        bar = F.struct(F.concat(F.col("price_date").cast("string"), F.lit("T05:00:00Z")).alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.when(F.col("volume") > 3, F.col("volume")).alias("v"))
        # a page holds a month of bars of one ticker
        page = t.prices_best.groupBy("ticker", F.trunc("price_date", "month").alias("m")).agg(F.collect_list(bar).alias("bars"))
        page.select(F.lit(1).alias("batch"), F.month("m").alias("page"), F.struct(F.create_map(F.lower("ticker"), "bars").alias("bars"), F.lit(None).cast("string").alias("next_page_token")).alias("response")).write.option("compression", "gzip").json(path)

    pages = t.spark.read.schema(readers.BARS_SCHEMA).json(once(t, "bars", write))
    return readers.flatten_bars_json(pages, symbol_rows(t), day("2002-01-01"))


@query("S05_flatten_chart_json", "company_id:s ticker:s price_date:d open:f high:f low:f close:f adjusted_close:f volume:f source:s", """
  SELECT company_id, ticker, price_date, open * 0.5 AS open, high * 0.5 AS high, low * 0.5 AS low, close * 0.5 AS close, close * 0.5 AS adjusted_close, CASE WHEN volume > 3 THEN volume ELSE 0 END AS volume, 'yahoo_adjusted' AS source
  FROM prices_best WHERE company_id <> '5' AND volume <= 48 AND volume <> 7""")
def s05(t):
    def write(path):
        item = F.struct("price_date", F.when(F.col("volume") != 7, F.col("open")).alias("open"), "high", "low", F.when(F.col("volume") <= 48, F.col("close")).alias("close"),
                        F.when(F.col("volume") > 3, F.col("volume")).alias("volume"), (F.col("close") * 0.5).alias("adj"))
        g = t.prices_best.groupBy("ticker", F.year("price_date").alias("y")).agg(F.array_sort(F.collect_list(item)).alias("a"))
        col = lambda n: F.transform("a", lambda x: x[n]).alias("adjclose" if n == "adj" else n)
        stamp = F.transform("a", lambda x: F.unix_timestamp(x["price_date"].cast("timestamp")) + 50_000).alias("timestamp")
        quote = F.array(F.struct(*[col(n) for n in ("open", "high", "low", "close", "volume")])).alias("quote")
        result = F.array(F.struct(stamp, F.struct(quote, F.array(F.struct(col("adj"))).alias("adjclose")).alias("indicators"))).alias("result")
        g.select("ticker", F.struct(F.struct(result).alias("chart")).alias("response")).write.option("ignoreNullFields", False).json(path)

    pages = t.spark.read.schema(readers.CHART_SCHEMA).json(once(t, "chart", write))
    return readers.flatten_chart_json(pages, symbol_rows(t), day("2002-01-01"))


KEY = ["company_id", "fiscal_period", "effective_at", "metric"]


@query("S06_upsert_by_key", "company_id:s fiscal_period:d effective_at:t metric:s value:f source_file_id:s", """
  SELECT company_id, fiscal_period, effective_at, metric, CASE WHEN year(as_of_date) >= 2000 THEN value * 2 ELSE value END AS value, CASE WHEN year(as_of_date) >= 2000 THEN 'src_new' ELSE source_file_id END AS source_file_id FROM estimates""")
def s06(t):
    new = t.estimates.where(F.year("as_of_date") >= 2000).withColumns({"source_file_id": F.lit("src_new"), "ingested_at": ts("2002-01-01")})
    batch = new.unionByName(new.withColumns({"value": F.col("value") * 2, "ingested_at": ts("2002-01-02")}))
    year = F.year("effective_at")
    root = once(t, "estimates", lambda p: writers.upsert_into(t.spark, p, t.estimates.where(F.year("as_of_date") < 2001), year, KEY, ["ingested_at", "source_file_id"]))
    writers.upsert_into(t.spark, root, batch, year, KEY, ["ingested_at", "source_file_id"])
    return lake.read_parts(t.spark, root)


@query("S07_insert_if_absent", "company_id:s fiscal_period:d effective_at:t metric:s value:f source_file_id:s", """
  SELECT company_id, fiscal_period, effective_at, metric, value, CASE WHEN year(as_of_date) >= 2001 THEN 'src_new' ELSE source_file_id END AS source_file_id FROM estimates""")
def s07(t):
    new = t.estimates.where(F.year("as_of_date") >= 1999).withColumns({"source_file_id": F.lit("src_new"), "ingested_at": ts("2002-01-01")})
    batch = new.unionByName(new.withColumns({"value": F.col("value") * 2, "ingested_at": ts("2002-01-02")}))
    return writers.insert_if_absent(t.estimates.where(F.year("as_of_date") < 2001), batch, KEY, ["ingested_at", "source_file_id"])


@query("S08_idempotent_files", "files:i new_files:i ids:i", "SELECT count(*) AS files, count(*) FILTER (WHERE n % 2 = 0) AS new_files, count(*) FILTER (WHERE n % 2 = 0) AS ids FROM (SELECT unnest(range(7)) AS n) x WHERE EXISTS (SELECT 1 FROM estimates e WHERE year(e.as_of_date) - 1995 = n)")
def s08(t):
    """One file per year of estimates; the odd ones are registered already."""
    def write(path):
        t.estimates.select((F.year("as_of_date") - 1995).alias("n"), F.concat_ws(",", "company_id", "metric", "value").alias("line")).repartition("n").write.partitionBy("n").text(path)

    path = once(t, "registered", write)
    none = t.spark.range(0).select(F.lit("").alias("sha256"))
    every = readers.register_files(t.spark, path, none)
    odd = readers.register_files(t.spark, f"{path}/n=[135]", none)
    new = readers.register_files(t.spark, path, odd)
    return new.agg(F.count(F.lit(1)).alias("new_files"), F.count_distinct("source_file_id").alias("ids")).withColumn("files", every.agg(F.count(F.lit(1))).scalar())


@query("S09_source_register", "source_file_id:s dataset:s row_count:i metadata_json:s", """
  SELECT concat('src_exp_', year(period_end)) AS source_file_id, 'fundamentals' AS dataset, count(*) FILTER (WHERE verdict = 'valid') AS row_count,
         concat('{"status":"accepted","rejected_rows":', count(*) FILTER (WHERE verdict <> 'valid'), '}') AS metadata_json FROM export_typed GROUP BY year(period_end)
  UNION ALL SELECT source_file_id, dataset, row_count, metadata_json FROM source_files""")
def s09(t):
    rows = typed(t).select(F.concat(F.lit("src_exp_"), F.year("period_end").cast("string")).alias("source_file_id"), F.lit("fundamentals").alias("dataset"), "verdict")
    known = t.source_files.select("source_file_id", "dataset", "row_count", "imported_at", "metadata_json")
    return writers.source_register(known, rows, ["source_file_id", "dataset"], ts("2002-01-01"))


@query("S10_supersede_source", "company_id:s price_date:d source:s source_file_id:s", "SELECT * FROM prices WHERE source_file_id = 'src_a'")
def s10(t):
    return writers.supersede_source(t.prices, t.source_files, "chart", F.lit("src_a"))


@query("S11_flatten_atom_feed", "title:s created_at:t n_chars:i body_hash:s", """
  SELECT concat('Page ', page_id) AS title, TIMESTAMP '2024-01-01' + INTERVAL (page_id) HOUR AS created_at, length(b) AS n_chars, sha256(b) AS body_hash
  FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\\s ]+', ' ', 'g')) AS b FROM (SELECT page_id, replace(html, '&', '+') AS html FROM pages) p) q""")
def s11(t):
    def write(path):
        esc = F.replace(F.replace(F.replace(F.replace("html", F.lit("&"), F.lit("+")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("\r"), F.lit(" "))
        at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 3600), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
        entry = F.concat(F.lit("<entry><title>Page "), "page_id", F.lit("</title><published>"), at, F.lit('</published><content type="html">'), esc, F.lit("</content></entry>"))
        # a feed document holds 25 entries
        feed = t.pages.groupBy(F.floor(F.col("page_id") / 25)).agg(F.concat_ws("\n", F.collect_list(entry)).alias("e"))
        feed.select(F.concat(F.lit("<feed>\n"), "e", F.lit("\n</feed>"))).write.option("maxRecordsPerFile", 1).text(path)

    out = readers.scan_atom_feed(t.spark, once(t, "atom", write))
    return out.select("title", "created_at", F.char_length("selftext").alias("n_chars"), F.sha2("selftext", 256).alias("body_hash"))


@query("S12_scan_decision_log", "date:s ticker:s rating:s pending:b raw:s alpha:s holding:s resolved:s decision:s reflection:s", """
  SELECT CAST(trade_date AS VARCHAR) AS date, ticker, rating, month(trade_date) % 2 = 0 AS pending, CASE WHEN month(trade_date) % 2 <> 0 THEN '+1.5%' END AS raw, CASE WHEN month(trade_date) % 2 <> 0 THEN '-0.5%' END AS alpha,
         CASE WHEN month(trade_date) % 2 <> 0 THEN '5d' END AS holding, CASE WHEN month(trade_date) % 2 <> 0 THEN CAST(trade_date + 10 AS VARCHAR) END AS resolved, concat('Rating: ', rating) AS decision,
         CASE WHEN month(trade_date) % 2 <> 0 THEN 'learned' ELSE '' END AS reflection FROM decisions""")
def s12(t):
    def write(path):
        done = F.month("trade_date") % 2 != 0
        tag = F.concat(F.lit("["), F.concat_ws(" | ", F.col("trade_date").cast("string"), "ticker", "rating", F.when(done, F.concat(F.lit("+1.5% | -0.5% | 5d | resolved:"), F.date_add("trade_date", 10).cast("string"))).otherwise("pending")), F.lit("]"))
        block = F.concat(tag, F.lit("\n\nDECISION:\nRating: "), "rating", F.when(done, "\n\nREFLECTION:\nlearned").otherwise(""), F.lit("\n\n" + readers.ENTRY_END + "\n"))
        t.decisions.select(block).write.option("lineSep", "\n").text(path)

    return readers.scan_decision_log(t.spark, once(t, "log", write))


@query("S13_statement_reports_asof", "company_id:s n_annual:i n_quarterly:i", """
  SELECT CAST(k AS VARCHAR) AS company_id, count(*) FILTER (WHERE month(period_end) = 12 AND (period_end <= DATE '1999-06-30' OR year(period_end) = 2000)) AS n_annual, count(*) FILTER (WHERE period_end <= DATE '1999-06-30') AS n_quarterly FROM fund_quarter GROUP BY k""")
def s13(t):
    rep = F.create_map(F.lit("fiscalDateEnding"), F.col("period_end").cast("string"), F.lit("totalRevenue"), F.col("revenue").cast("string"))
    undated = F.create_map(F.lit("totalRevenue"), F.col("revenue").cast("string"))
    annual = F.when(F.month("period_end") == 12, F.when(F.year("period_end") == 2000, undated).otherwise(rep))
    s = t.fund_quarter.groupBy(F.col("k").cast("string").alias("company_id")).agg(F.collect_list(annual).alias("annualReports"), F.collect_list(rep).alias("quarterlyReports"))
    out = readers.statement_reports_asof(s.select("company_id", F.to_json(F.struct("annualReports", "quarterlyReports")).alias("payload")), "payload", day("1999-06-30"))
    return out.select("company_id", F.size("annualReports").alias("n_annual"), F.size("quarterlyReports").alias("n_quarterly"))


@query("S14_statement_columns_asof", "company_id:s item:s period:d value:f", """
  SELECT CAST(k AS VARCHAR) AS company_id, 'revenue' AS item, period_end AS period, revenue AS value FROM fund_quarter WHERE month(period_end) = 12 AND year(period_end) BETWEEN 1995 AND 1998""")
def s14(t):
    at = lambda y: F.max(F.when((F.year("period_end") == y) & (F.month("period_end") == 12), F.col("revenue")))
    wide = t.fund_quarter.groupBy(F.col("k").cast("string").alias("company_id")).agg(*[at(y).alias(f"{y}-12-31 00:00:00") for y in range(1995, 2002)], at(2001).alias("TTM"))
    return readers.statement_columns_asof(wide.withColumn("item", F.lit("revenue")), "item", ["company_id"], day("1999-06-30")).where("value IS NOT NULL")


@query("S15_csv_date_range", "timestamp:s company_id:s close:f", "SELECT CAST(price_date AS VARCHAR) AS timestamp, company_id, close FROM prices_best WHERE price_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'")
def s15(t):
    path = once(t, "csv_prices", lambda p: t.prices_best.select(F.col("price_date").cast("string").alias("timestamp"), "company_id", "close").write.option("header", True).csv(p))
    df = readers.scan_csv_export(t.spark, path, ["timestamp", "company_id", "close"])
    return readers.csv_date_range(df, day("1998-01-01"), day("1998-12-31"))


@query("S16_export_gap_manifest", "rows:i unique_tickers:i needs_fundamentals:i needs_estimates:i needs_instrument_identity:i", """
  SELECT count(*) AS "rows", count(DISTINCT ticker) AS unique_tickers, count(*) FILTER (WHERE needs_fundamentals) AS needs_fundamentals, count(*) FILTER (WHERE needs_estimates) AS needs_estimates, count(*) FILTER (WHERE needs_instrument_identity) AS needs_instrument_identity FROM gaps_q""")
def s16(t):
    path = once(t, "gaps", lambda p: writers.export_gap_manifest(gaps(t), p))
    schema = "company_id string, ticker string, first_member date, last_member date, needs_fundamentals boolean, needs_estimates boolean, needs_instrument_identity boolean"
    return quality.gap_summary(t.spark.read.schema(schema).option("header", True).csv(path))


@query("S17_archive_raw_pages", "pages:i prefix_ok:b", "SELECT count(DISTINCT html) AS pages, true AS prefix_ok FROM pages")
def s17(t):
    path = once(t, "archive", lambda p: writers.archive_raw_pages(t.pages.select("html"), p))
    back = t.spark.read.schema("value string, sha256 string, prefix string").json(path)
    return back.agg(F.count(F.lit(1)).alias("pages"), F.every((F.sha2("value", 256) == F.col("sha256")) & F.col("sha256").startswith(F.col("prefix"))).alias("prefix_ok"))


