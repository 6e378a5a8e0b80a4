"""Incremental forms of the batch operators (Structured Streaming)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from pitgrid.functions.groups import latest
from pitgrid.operators.ingest import import_export, verdict_issues
from pitgrid.sources.contracts import CONTRACTS


def batch_writer(path: str, transform: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: every micro-batch owns a folder, so a replayed batch overwrites itself."""

    def write(df: DataFrame, batch_id: int) -> None:
        transform(df).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def current_rows(spark: SparkSession, path: str, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Table of a batch sink: per key the row of the newest batch (then ``order``)."""
    return latest(spark.read.parquet(path), key, ["batch", *order]).drop("batch")


def run_available(writer, checkpoint: str):
    """Process everything that is there, then stop."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def stream_ingest_exports(spark: SparkSession, source: str, columns: Sequence[str], dataset: str, sink: str, checkpoint: str, files_per_batch: int = 100):
    """ST1: new export files through the contract into accepted rows and issues, safe to replay.

    The verdict is computed once per batch and kept for both writes.
    """
    schema = ", ".join(f"`{c}` STRING" for c in columns)
    raw = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).csv(source)

    def write(df: DataFrame, batch_id: int) -> None:
        judged = import_export(df, dataset).persist()
        try:
            judged.where("verdict = 'valid'").drop("verdict").write.mode("overwrite").parquet(f"{sink}/accepted/batch={batch_id}")
            verdict_issues(judged, dataset).write.mode("overwrite").parquet(f"{sink}/issues/batch={batch_id}")
        finally:
            judged.unpersist()

    return run_available(raw.writeStream.foreachBatch(write), checkpoint)


def ingested(spark: SparkSession, sink: str, dataset: str) -> DataFrame:
    """ST1: current contract rows of the sink, last write per key."""
    return current_rows(spark, f"{sink}/accepted", CONTRACTS[dataset].key)


def stream_dedupe(items: DataFrame, ts: str, keys: Sequence[str], delay: str) -> DataFrame:
    """ST2: first item per key within the watermark."""
    return items.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_sentiment(messages: DataFrame, ts: str, delay: str, size: str, slide: str | None = None) -> DataFrame:
    """ST3: label counts per ticker and window; rows later than the watermark are dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return messages.withWatermark(ts, delay).groupBy(w.alias("w"), "ticker").agg(
        F.count_if(F.coalesce(F.col("label") == "Bullish", F.lit(False))).alias("bullish"),
        F.count_if(F.coalesce(F.col("label") == "Bearish", F.lit(False))).alias("bearish"), F.count(F.lit(1)).alias("total"),
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "ticker", "bullish", "bearish", "total")


def stream_latest_bar(bars: DataFrame) -> DataFrame:
    """ST4: newest bar per symbol, kept in state and updated by every batch."""
    return bars.groupBy("ticker").agg(F.max(F.struct("price_date", "source", "close")).alias("m")).select("ticker", F.col("m.price_date").alias("price_date"), F.col("m.close").alias("close"))
