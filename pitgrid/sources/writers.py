"""Merges and sinks. A merge of a DataFrame returns the new table; tables on disk are merged by partition and swapped in by ``lake``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pitgrid.functions.groups import latest
from pitgrid.functions.staging import stage
from pitgrid.sources import lake
from pitgrid.sources.contracts import UPSERT_KEYS


def merge_price_lake(existing: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """One row per company, day and source: newest load, then file id."""
    both = incoming if existing is None else existing.unionByName(incoming)
    return latest(both, UPSERT_KEYS["prices"], ["ingested_at", "source_file_id"])


def merge_into_price_lake(spark: SparkSession, root: str, incoming: DataFrame) -> list[str]:
    """``incoming`` merged into the lake at ``root``; only the years it touches are written. Returns these."""
    return lake.merge_parts(spark, root, incoming, F.year("price_date"), UPSERT_KEYS["prices"], ["ingested_at", "source_file_id"], ["company_id", "price_date"])


def upsert_into(spark: SparkSession, root: str, incoming: DataFrame, part: Column, key: Sequence[str], order: Sequence[str]) -> list[str]:
    """S06, sink: upsert of a table on disk, partition by partition. Returns the partitions written."""
    return lake.merge_parts(spark, root, incoming, part, key, order, list(key))


def upsert_by_key(existing: DataFrame, incoming: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Incoming rows replace those with the same key; the last by ``order`` wins inside the batch."""
    fresh = latest(incoming, key, order)
    return fresh.unionByName(existing.join(fresh.select(*key), list(key), "left_anti"))


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Only keys not there yet are added; the first by ``order`` wins inside the batch."""
    rest = [c for c in incoming.columns if c not in key and c not in order]
    first = incoming.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("_m")).select(*[F.col(c) if c in key else F.col(f"_m.{c}").alias(c) for c in incoming.columns])
    return existing.unionByName(first.join(existing.select(*key), list(key), "left_anti"))


def source_register(existing: DataFrame, rows: DataFrame, keys: Sequence[str], at: Column) -> DataFrame:
    """One provenance row per file with its counts as metadata JSON, upserted on the id."""
    a = rows.groupBy(*keys).agg(F.count_if(F.col("verdict") == "valid").alias("row_count"), F.count_if(F.col("verdict") != "valid").alias("_rej"))
    meta = F.to_json(F.struct(F.when(F.col("row_count") > 0, "accepted").otherwise("rejected").alias("status"), F.col("_rej").alias("rejected_rows")))
    # one row per file, used twice below: written, so that the rows are counted once
    new = stage(a.select(*keys, "row_count", at.alias("imported_at"), meta.alias("metadata_json")), "register")
    return upsert_by_key(existing, new, ["source_file_id"], ["imported_at"])


def supersede_source(table: DataFrame, source_files: DataFrame, provider: str, keep: Column) -> DataFrame:
    """Rows of older sources of the same provider removed."""
    old = source_files.where((F.get_json_object("metadata_json", "$.provider") == provider) & (F.col("source_file_id") != keep)).select("source_file_id")
    return table.join(old, "source_file_id", "left_anti")


def export_gap_manifest(gaps: DataFrame, path: str) -> None:
    """Gap rows as CSV."""
    gaps.write.mode("errorifexists").option("header", True).csv(path)


def archive_raw_pages(pages: DataFrame, path: str) -> DataFrame:
    """Raw pages as JSON lines under the first 12 hex digits of their content hash.

    The hash prefix is the folder; pages of one hash are identical, so one copy is kept.
    """
    text = F.to_json(F.struct(*pages.columns))
    out = pages.select(F.sha2(text, 256).alias("sha256"), text.alias("value")).groupBy("sha256").agg(F.first("value").alias("value"))
    out = out.withColumn("prefix", F.substring("sha256", 1, 12))
    # by the first two digits only: files stay large however many pages there are
    out.select("value", "sha256", "prefix", F.substring("sha256", 1, 2).alias("shard")).write.mode("errorifexists").partitionBy("shard").json(path)
    return out
