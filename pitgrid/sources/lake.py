"""A Parquet table in generations: a merge writes the partitions it touches anew, and a manifest names those that are valid.

Layout below the root: ``data/g<number>-<id>/part=<value>`` and ``manifest/<number>``. Readers follow the manifest with the highest number. A merge
writes its data first, then its manifest under a name of its own, and swaps it in by one rename; broken off at any
point before, it leaves the table as it was. Files of untouched partitions are never rewritten.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pitgrid.functions.groups import latest

MANIFEST = "part string, path string"


class ConcurrentMergeError(RuntimeError):
    """Another merge was published since this one began."""


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(root).getFileSystem(spark._jsc.hadoopConfiguration())


def generation(spark: SparkSession, root: str) -> int:
    """Number of the valid manifest; 0: no table yet."""
    path, fs = _files(spark, root)
    folder = path(f"{root}/manifest")
    return max((int(f.getPath().getName()) for f in fs.listStatus(folder)), default=0) if fs.exists(folder) else 0


def valid_parts(spark: SparkSession, root: str) -> dict[str, str]:
    """Partition value to folder, one entry per partition."""
    n = generation(spark, root)
    return {r["part"]: r["path"] for r in spark.read.schema(MANIFEST).json(f"{root}/manifest/{n}").collect()} if n else {}


def read_parts(spark: SparkSession, root: str, wanted: Sequence[str] | None = None) -> DataFrame | None:
    """Rows of the valid partitions, or of those in ``wanted``; no other folder is listed or read. None: there is no such partition."""
    held = valid_parts(spark, root)
    paths = [p for v, p in sorted(held.items()) if wanted is None or v in wanted]
    return spark.read.parquet(*paths) if paths else None


def merge_parts(spark: SparkSession, root: str, incoming: DataFrame, part: Column, key: Sequence[str], order: Sequence[str], sort: Sequence[str]) -> list[str]:
    """Upsert ``incoming`` by ``key``: of rows with one key, old and new, the greatest by ``order`` stays. Returns the partitions written.

    ``part`` must be a function of the key, and not null: a key then never changes its partition. Rows of a partition are spread by
    the first key column and sorted by ``sort``. An empty batch publishes nothing.
    """
    began = generation(spark, root)
    held = valid_parts(spark, root)
    fresh = incoming.withColumn("part", part.cast("string"))
    touched = sorted(r["part"] for r in fresh.select("part").distinct().collect())  # partitions, such as years
    if not touched:
        return []
    old = read_parts(spark, root, touched)
    both = fresh if old is None else fresh.unionByName(old.withColumn("part", part.cast("string")))
    merged = latest(both, [*key, "part"], order, both.columns)
    folder = f"{root}/data/g{began + 1}-{uuid.uuid4().hex}"
    merged.repartition("part", key[0]).sortWithinPartitions("part", *sort).write.mode("errorifexists").option("compression", "zstd").partitionBy("part").parquet(folder)
    publish(spark, root, began, held | {v: f"{folder}/part={v}" for v in touched})
    return touched


def publish(spark: SparkSession, root: str, began: int, parts: dict[str, str]) -> None:
    """Make ``parts`` the valid partitions, if generation ``began`` still is the newest."""
    path, fs = _files(spark, root)
    draft = f"{root}/drafts/{uuid.uuid4().hex}"
    spark.createDataFrame(sorted(parts.items()), MANIFEST).coalesce(1).write.json(draft)
    fs.mkdirs(path(f"{root}/manifest"))
    target = path(f"{root}/manifest/{began + 1}")
    if fs.exists(target) or not fs.rename(path(draft), target):
        raise ConcurrentMergeError(f"generation {began + 1} of {root} is there already")
