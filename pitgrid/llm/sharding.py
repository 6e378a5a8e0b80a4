"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table (an offset and a step of the
slots' cyclic group). The shards take turns; each claims the first slot of its order that is still free, until none is.
Shares differ by at most one slot, and when a shard leaves, few slots of the others change hands.
A row's shard is one look into the table: a broadcast of bounded size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLOTS = 65_537
MAX_SLOTS = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """Shard number of every slot; ``slots`` is a prime of at most ``MAX_SLOTS``, and at least the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and differ")
    if not _is_prime(slots) or not len(shards) <= slots <= MAX_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    digests = [hashlib.sha256(s.encode()).digest() for s in shards]
    place = [int.from_bytes(d[:8], "big") % slots for d in digests]
    step = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 if slots > 2 else 1 for d in digests]
    owner = [-1] * slots
    left = slots
    while left:
        for s in range(len(shards)):
            at = place[s]
            while owner[at] >= 0:
                at = (at + step[s]) % slots
            owner[at] = s
            place[s] = (at + step[s]) % slots
            left -= 1
            if not left:
                break
    return np.array(owner, dtype=np.int64)


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: 60 bits of its SHA-256 modulo the table size; null keys share the slot of the text "null"."""
    digest = F.sha2(F.coalesce(key.cast("string"), F.lit("null")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots


def place(rows: DataFrame, shards: list[str], key_col: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """``rows`` with their ``slot``, ``shard_no`` and ``shard`` (name).

    Equal keys share a shard; a null key has one too. Columns of ``rows`` with these names are replaced. No shuffle:
    the table has one row per slot and is broadcast. An empty table gives an empty result.
    """
    spark: SparkSession = rows.sparkSession
    owner = lookup_table(shards, slots)
    names = pa.array(shards).take(pa.array(owner))
    table = spark.createDataFrame(pa.table({"_slot": pa.array(np.arange(slots)), "shard_no": pa.array(owner), "shard": names}))
    kept = rows.drop("slot", "shard_no", "shard") if key_col not in ("slot", "shard_no", "shard") else rows
    out = kept.withColumn("_slot", slot_of(F.col(key_col), slots)).join(F.broadcast(table), "_slot")
    return out.withColumnRenamed("_slot", "slot")
