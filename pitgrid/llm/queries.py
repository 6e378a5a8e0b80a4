"""Registered queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pitgrid.functions.staging import stage
from pitgrid.llm import collocations, hyperminhash, lexical, licenses, mixing, packing, quality_model, rules, secrets, sharding, simhash, sketches, warc
from pitgrid.llm.common import table
from pitgrid.llm.sql import ORACLE_SQL

SHARDS = tuple(f"shard-{i:04d}" for i in range(256))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_text(F.col("fp")).alias("fingerprint"), "component_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_model.train(docs, labels.where(~quality_model.held_out("doc_id")))
    found = quality_model.scores(docs, model)
    return found.select("doc_id", quality_model.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, secrets.BASE), F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.edited_and_next(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), list(SHARDS)).select("doc_id", "slot", "shard_no", "shard")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.licenses(table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct("base_at.label"))
    both = F.array_sort(F.array_union(F.col("base_at.label"), F.coalesce(F.col("spans.label"), F.expr("cast(array() as array<string>)"))))
    return found.select("doc_id", "n_words", F.size("base_at").cast("long").alias("n_base"), F.array_min("base_at.at").cast("long").alias("first_word"),
                        F.array_max("base_at.at").cast("long").alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
                        F.coalesce(F.array_max("spans.score"), F.lit(0.0)).alias("score"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    # the counts are small next to the texts: written once, they serve the sketches and the verdicts
    rows = stage(rules.measured(docs).drop("text"), "measured")
    found = rules.judged(rows, rules.thresholds(rules.sketches(rows)))
    return found.select("doc_id", *[F.col(f"_q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_quality, op3_secrets, op4_mixing, op5_packing, op6_sketches, op7_sharding, op8_licenses, op9_warc, op10_quality_rules,
                                op11_ranked_search, op12_collocations, op13_hyperminhash)}

__all__ = ["ORACLE_SQL", "QUERIES"]
