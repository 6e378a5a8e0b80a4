"""Lineage cuts: intermediate tables written to the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pitgrid.session import checkpoint_folder


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Used where a result feeds several branches of one plan: without the cut each branch would
    carry the whole upstream plan, and a lost executor would redo it. The folder is the
    session's ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/staged/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{checkpoint_folder(spark)}/staged/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
