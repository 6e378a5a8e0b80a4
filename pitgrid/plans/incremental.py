"""Streaming queries: each runs over all files there are, then its sink is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitgrid.functions.groups import latest
from pitgrid.functions.staging import stage_folder
from pitgrid.plans.files import once
from pitgrid.plans.ingestion import export
from pitgrid.plans.registry import query
from pitgrid.streaming import streams


def sink(t, name):
    root = stage_folder(t.spark, name)
    return f"{root}/out", f"{root}/checkpoint"


def dealt(rows, files):
    """``rows`` in that many partitions; those of a large table are put together, so no row goes through a shuffle."""
    return rows.coalesce(files) if rows.rdd.getNumPartitions() >= files else rows.repartition(files)


def messages(t):
    """Event files as a message stream."""
    schema = t.events.schema
    raw = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    label = F.when(F.col("event_type") == "purchase", "Bullish").when(F.col("event_type") == "error", "Bearish")
    return raw.select("event_id", F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), label.alias("label"), "event_type")


@query("ST1_stream_ingest_exports", "company_id:s period_end:d effective_at:t as_of_date:d metric:s value:f", "SELECT * FROM export_typed WHERE verdict = 'valid'")
def st1(t):
    cols = export(t).columns

    def write(path):
        export(t).where("SP_ENTITY_ID IS NOT NULL").repartition(6, "SP_ENTITY_ID").write.option("header", True).csv(path)

    out, ckpt = sink(t, "ingest")
    streams.stream_ingest_exports(t.spark, once(t, "export_files", write), cols, "fundamentals", out, ckpt, files_per_batch=2)
    return streams.ingested(t.spark, out, "fundamentals")


@query("ST2_stream_dedupe_content", "ticker:s event_type:s", "SELECT DISTINCT concat('T', user_id) AS ticker, event_type FROM events")
def st2(t):
    out, ckpt = sink(t, "dedupe")
    s = streams.stream_dedupe(messages(t), "ts", ["ticker", "event_type"], "60 days").select("ticker", "event_type")
    streams.run_available(s.writeStream.format("parquet").option("path", out), ckpt)
    return t.spark.read.schema("ticker string, event_type string").parquet(out)


WINDOW_SQL = """
  SELECT '{kind}' AS kind, w AS window_start, ticker, count(*) FILTER (WHERE event_type = 'purchase') AS bullish, count(*) FILTER (WHERE event_type = 'error') AS bearish, count(*) AS total
  FROM (SELECT concat('T', user_id) AS ticker, event_type, unnest([{starts}]) AS w FROM events) e
  WHERE w + INTERVAL {days} DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY w, ticker"""
DAY0 = "date_trunc('day', ts)"


@query("ST3_stream_sentiment_window", "kind:s window_start:t ticker:s bullish:i bearish:i total:i",
       WINDOW_SQL.format(kind="tumbling", starts=DAY0, days=1) + " UNION ALL " + WINDOW_SQL.format(kind="sliding", starts=f"{DAY0}, {DAY0} - INTERVAL 1 DAY", days=2))
def st3(t):
    res = None
    for kind, size, slide in (("tumbling", "1 day", None), ("sliding", "2 days", "1 day")):
        out, ckpt = sink(t, kind)
        s = streams.stream_sentiment(messages(t), "ts", "1 day", size, slide)
        streams.run_available(s.writeStream.outputMode("append").format("parquet").option("path", out), ckpt)
        one = t.spark.read.schema(s.schema).parquet(out).withColumn("kind", F.lit(kind))
        res = one if res is None else res.unionByName(one)
    return res


@query("ST4_stream_latest_bar", "ticker:s price_date:d close:f is_stale:b", """
  SELECT ticker, max(price_date) AS price_date, max_by(close, row(price_date, source)) AS close, date_diff('day', max(price_date), DATE '2001-11-10') > 10 AS is_stale FROM prices GROUP BY ticker""")
def st4(t):
    path = once(t, "bar_files", lambda p: dealt(t.prices.select("ticker", "price_date", "source", "close"), 6).write.parquet(p))
    out, ckpt = sink(t, "latest_bar")
    bars = t.spark.readStream.schema("ticker string, price_date date, source string, close double").option("maxFilesPerTrigger", 2).parquet(path)
    streams.run_available(streams.stream_latest_bar(bars).writeStream.outputMode("update").foreachBatch(streams.batch_writer(out, lambda d: d)), ckpt)
    now = latest(t.spark.read.parquet(out), ["ticker"], ["batch"], ["ticker", "price_date", "close"])
    return now.withColumn("is_stale", F.datediff(F.lit("2001-11-10"), "price_date") > 10)
