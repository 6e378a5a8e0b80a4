"""Scans of the vendor and archive formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pitgrid.functions.groups import latest
from pitgrid.operators.text import strip_html
from pitgrid.sources import lake

BARS_SCHEMA = (
    "batch int, page int, response struct<bars:map<string,array<struct<t:string,o:double,h:double,l:double,c:double,v:double>>>,next_page_token:string>"
)
CHART_SCHEMA = (
    "ticker string, response struct<chart:struct<result:array<struct<timestamp:array<bigint>,"
    "indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>>,"
    "adjclose:array<struct<adjclose:array<double>>>>>>>>"
)
ENTRY_END = "<!-- ENTRY_END -->"


def scan_csv_export(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV export with a header as text columns; all-empty rows dropped. No schema inference."""
    schema = ", ".join(f"`{c}` STRING" for c in columns)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path).na.drop("all")


def price_lake(spark: SparkSession, root: str, first_year: int, last_year: int) -> DataFrame | None:
    """The lake's valid files of some years; other years are not listed."""
    return lake.read_parts(spark, root, [str(y) for y in range(first_year, last_year + 1)])


def scan_price_lake(prices: DataFrame, start: Column, end: Column, companies: DataFrame | None = None, tickers: DataFrame | None = None) -> DataFrame:
    """Date range of the lake for companies OR tickers; a missing list means no filter.

    The date range reaches the Parquet scan. Lists come as DataFrames of any size and are
    joined, so no literal list is built; a row kept by both is kept once.
    """
    df = prices.where(F.col("price_date").between(start, end))
    if companies is None and tickers is None:
        return df
    hit = F.lit(False)
    for i, (ids, col) in enumerate(((companies, "company_id"), (tickers, "ticker"))):
        if ids is not None:
            df = df.join(ids.select(F.col(col)).distinct().withColumn(f"_hit{i}", F.lit(True)), col, "left")
            hit = hit | F.coalesce(F.col(f"_hit{i}"), F.lit(False))
    return df.where(hit).select(*prices.columns)


def bars_to_prices(rows: DataFrame, source: str, as_of: Column) -> DataFrame:
    """Shared tail: availability at the end of the day, last row per company, ticker and day."""
    out = rows.withColumns({
        "source": F.lit(source), "as_of_date": as_of,
        "effective_at": F.date_add("price_date", 1).cast("timestamp_ntz") - F.expr("INTERVAL 0.000001 SECOND"),
    })
    return latest(out, ["company_id", "ticker", "price_date"], ["_seq"]).drop("_seq")


def flatten_bars_json(pages: DataFrame, symbols: DataFrame, as_of: Column, source: str = "alpaca_iex_adjusted") -> DataFrame:
    """Pages of {ticker: [bars]} to price rows; unknown tickers dropped, missing volume 0."""
    lists = pages.select("batch", "page", F.explode("response.bars").alias("_t", "_bars")).withColumn("ticker", F.upper(F.trim("_t")))
    # lists meet the symbols whole: a bar on its own would carry ticker and page through the shuffle
    bars = lists.join(symbols.select("ticker", "company_id"), "ticker").select("batch", "page", "ticker", "company_id", F.posexplode("_bars").alias("_pos", "b"))
    price = F.col("b.c")
    rows = bars.select(
        "company_id", "ticker", F.to_date(F.substring("b.t", 1, 10)).alias("price_date"), F.col("b.o").alias("open"), F.col("b.h").alias("high"), F.col("b.l").alias("low"),
        price.alias("close"), price.alias("adjusted_close"), F.coalesce("b.v", F.lit(0.0)).alias("volume"), F.struct("batch", "page", "_pos").alias("_seq"))
    return bars_to_prices(rows, source, as_of)


def flatten_chart_json(pages: DataFrame, symbols: DataFrame, as_of: Column, source: str = "yahoo_adjusted") -> DataFrame:
    """Parallel arrays to price rows scaled by adjclose / close; incomplete bars skipped."""
    r = pages.select(F.upper(F.trim("ticker")).alias("ticker"), F.col("response.chart.result")[0].alias("r"))
    q = "r.indicators.quote"
    zipped = F.arrays_zip(
        F.col("r.timestamp").alias("ts"), *[F.col(q)[0][c].alias(c) for c in ("open", "high", "low", "close", "volume")],
        F.col("r.indicators.adjclose")[0]["adjclose"].alias("adj"))
    b = r.select("ticker", F.posexplode(zipped).alias("_pos", "b")).select("ticker", "_pos", "b.*")
    ok = F.col("close").isNotNull() & (F.col("close") != 0) & F.col("adj").isNotNull() & F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull()
    factor = F.col("adj") / F.nullif(F.col("close"), F.lit(0.0))
    rows = b.where(ok).join(symbols.select("ticker", "company_id"), "ticker").select(
        "company_id", "ticker", F.to_date(F.timestamp_seconds("ts")).alias("price_date"), *[(F.col(c) * factor).alias(c) for c in ("open", "high", "low", "close")],
        F.col("adj").alias("adjusted_close"), F.coalesce("volume", F.lit(0.0)).alias("volume"), F.struct("_pos").alias("_seq"))
    return bars_to_prices(rows, source, as_of)


ATOM_SCHEMA = "title string, published string, content struct<_VALUE:string,_type:string>"


def scan_atom_feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom files: title, UTC time, stripped body."""
    raw = spark.read.format("xml").option("rowTag", "entry").schema(ATOM_SCHEMA).load(path)
    at = F.try_to_timestamp("published")
    return raw.select(
        F.coalesce("title", F.lit("")).alias("title"), F.unix_timestamp(at).alias("created_utc"), at.cast("timestamp_ntz").alias("created_at"), strip_html(F.col("content._VALUE")).alias("selftext"))


def scan_decision_log(spark: SparkSession, path: str) -> DataFrame:
    """Decision log blocks to rows; blocks without a proper tag line are skipped."""
    raw = spark.read.option("lineSep", ENTRY_END).text(path)
    block = F.regexp_replace("value", "^\\s+|\\s+$", "")
    tag = F.trim(F.regexp_extract(block, "^([^\\r\\n]*)", 1))
    body = F.regexp_extract(block, "(?s)^[^\\r\\n]*[\\r\\n]+(.*)$", 1)
    df = raw.select(tag.alias("tag"), body.alias("body")).where(F.col("tag").rlike("^\\[.*\\]$"))
    parts = F.transform(F.split(F.expr("substring(tag, 2, length(tag) - 2)"), "\\|"), lambda x: F.trim(x))
    df = df.select("body", parts.alias("f")).where(F.size("f") >= 4)
    at = lambda i: F.get("f", F.lit(i))
    pending = at(3) == "pending"
    # of several such fields the last one counts
    late = F.try_element_at(F.filter("f", lambda x, i: (i >= 6) & x.startswith("resolved:")), F.lit(-1))
    return df.select(
        at(0).alias("date"), at(1).alias("ticker"), at(2).alias("rating"), pending.alias("pending"), F.when(~pending, at(3)).alias("raw"), at(4).alias("alpha"), at(5).alias("holding"),
        F.trim(F.substr(late, F.lit(10))).alias("resolved"),
        F.regexp_replace(F.regexp_extract("body", "(?s)DECISION:\\s*(.*?)(?:\\s*REFLECTION:|\\s*$)", 1), "\\s+$", "").alias("decision"),
        F.regexp_replace(F.regexp_extract("body", "(?s)REFLECTION:\\s*(.*)$", 1), "\\s+$", "").alias("reflection"),
    )


REPORTS = "struct<annualReports:array<map<string,string>>,quarterlyReports:array<map<string,string>>>"


def statement_reports_asof(df: DataFrame, payload: str, on: Column) -> DataFrame:
    """Statement JSON cut to reports with a fiscal date at or before the date (undated ones stay)."""
    keep = lambda r: F.coalesce(F.try_element_at(r, F.lit("fiscalDateEnding")), F.lit("")) <= on.cast("string")
    parsed = df.withColumn("_r", F.from_json(payload, REPORTS))
    return parsed.withColumns({k: F.filter(F.col(f"_r.{k}"), keep) for k in ("annualReports", "quarterlyReports")}).drop("_r")


def statement_columns_asof(df: DataFrame, row: str, keys: Sequence[str], on: Column) -> DataFrame:
    """Statement with period dates as column names, long, without periods after the date or unreadable ones."""
    periods = [c for c in df.columns if c != row and c not in keys]
    long = df.unpivot([*keys, row], periods, "period", "value")
    return long.withColumn("period", F.try_to_date(F.substring("period", 1, 10), "yyyy-MM-dd")).where(F.col("period") <= on)


def csv_date_range(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows whose first column is a date inside the range."""
    d = F.expr(f"try_cast(`{df.columns[0]}` AS DATE)")
    return df.where(d.between(start, end))


def register_files(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """New files by content hash: id, hash, name; hashes already registered are skipped.

    Each file is hashed by the task that reads it; contents are not shuffled.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    hashed = f.select(F.sha2("content", 256).alias("sha256"), F.element_at(F.split("path", "/"), -1).alias("original_name"), "length")
    one = hashed.groupBy("sha256").agg(F.min("original_name").alias("original_name"), F.max("length").alias("bytes"))
    return one.join(known.select("sha256").distinct(), "sha256", "left_anti").withColumn("source_file_id", F.concat(F.lit("src_"), F.substring("sha256", 1, 24)))
