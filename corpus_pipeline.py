"""The corpus pipeline: rejected documents go, one of each group of near-duplicates stays, secrets are masked, sources are mixed, texts are packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitgrid.functions.staging import stage_folder
from pitgrid.llm import mixing, packing, rules, secrets, similar
from pitgrid.llm.common import table
from pitgrid.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules; their columns."""
    return rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash links and of texts that share 80 % of their 5-word shingles; the columns of ``docs``."""
    return similar.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark; the columns of ``docs``."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document and pass of the mix, cut to the words taken; the columns of ``docs``."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences, with their token ids."""
    return packing.pack(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("mask_secrets", mask_secrets),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Hashes, tokens and the packing order have no SQL form; tests compare the stages' operators, and the rows that near_dedup keeps, with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = stage_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
