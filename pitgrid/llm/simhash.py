"""SimHash near-duplicates: popcounts of fingerprint segments, a grid join, exact verification.

A 64-bit fingerprint becomes the vector of the bit counts of its segments. One flipped bit moves that vector by one step,
so the Manhattan distance of two vectors never exceeds the Hamming distance. Two fingerprints within
distance 2 therefore have vectors at most two steps apart, and some grid cell is at most one step from
both: every fingerprint is posted to its own cell and to the cells one step away, and partners meet in a cell.

Candidates are verified without listing pairs of a crowded cell. A cell with two fingerprints gives
one pair, checked by XOR. Fingerprints of fuller cells are posted to the 65 words at most one bit away: two
of them share such a word exactly if they differ in at most two bits, and a word has at most 65 members, tied to their smallest.
Work is linear in the number of distinct fingerprints whatever the size of a group of copies.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pitgrid.functions.staging import stage
from pitgrid.llm.common import map_rows, spread_join
from pitgrid.llm.components import connected

BITS = 64
SEED = 42

_byte_bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_lanes = np.arange(8) * 256
_weights = np.uint64(1) << np.arange(BITS, dtype=np.uint64)


def simhash(text: bytes | None, k: int = 3) -> int:
    """Signed 64-bit SimHash of the k-word shingles of a UTF-8 text, A-Z lower-cased; no words: 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-k].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)]
    h = np.array(hashes, dtype="<u8")
    # one histogram per byte of the hash instead of 64 sums over unpacked bits
    seen = np.bincount((h.view(np.uint8).reshape(-1, 8) + _lanes).ravel(), minlength=2048).reshape(8, 256)
    ones = (seen @ _byte_bits).ravel()
    return int(_weights[2 * ones > len(h)].sum(dtype=np.uint64).astype(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(doc_id, fp) per row of ``docs``; fp is the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary"))
    return map_rows(rows, lambda: lambda i, t: ((i, simhash(t, k)),), "doc_id long, fp long")


def hex_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _posts(fps: DataFrame, segments: int) -> DataFrame:
    """(cell, fp): the cell of each fingerprint's popcount vector and all cells one step away."""
    width = BITS // segments
    base = width + 1
    # bit counts of all segments, as the digits of one number
    counts = [F.bit_count(F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit((1 << width) - 1))) for i in range(segments)]
    own = fps.select("fp", *[c.alias(f"c{i}") for i, c in enumerate(counts)])
    cell = sum((F.col(f"c{i}") * F.lit(base**i).cast("long") for i in range(segments)), F.lit(0).cast("long"))
    own = own.withColumn("cell", cell)
    near = [F.col("cell")]
    for i in range(segments):
        step = F.lit(base**i).cast("long")
        near += [F.when(F.col(f"c{i}") < width, F.col("cell") + step), F.when(F.col(f"c{i}") > 0, F.col("cell") - step)]
    return own.select("fp", F.explode(F.array(*near)).alias("cell")).where("cell IS NOT NULL")


def links(fps: DataFrame, segments: int = 16) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fp``) that differ in 1 or 2 bits.

    Fingerprints within distance 2 end up in one connected component of the edges; not every such pair is an edge of its own.
    ``segments`` (a divisor of 64) sets the grid: more segments, finer cells and more posts (2 x segments + 1).
    """
    posts = _posts(fps, segments)
    cells = posts.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    cells = stage(cells, "cells")
    pairs = cells.where("n = 2").select("a", "b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
    crowded = posts.join(cells.where("n > 2").select("cell"), "cell").select("fp").distinct()
    near = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(BITS)]
    words = crowded.select("fp", F.explode(F.array(*near)).alias("word"))
    shared = words.groupBy("word").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    stars = shared.select("a", F.explode("all").alias("b")).where("a <> b")
    return pairs.union(stars).distinct()


def components(rows: DataFrame, segments: int = 16) -> DataFrame:
    """(fp, component_id) per distinct fingerprint of the written table ``rows`` (doc_id, fp): the smallest doc_id that it reaches."""
    first = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = connected(links(first.select("fp"), segments)).select(F.col("node").alias("fp"), "root")
    member = roots.join(first, "fp")
    smallest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    merged = member.join(smallest, "root").select("fp", "component_id")
    return first.join(merged, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, segments: int = 16) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``: the smallest doc_id that its fingerprint reaches
    over links of at most two differing bits, itself included.

    Null, empty and blank texts have fingerprint 0 and link like any other. A null doc_id takes part and never
    is the smallest, unless its component holds no other (then component_id is null). Rows with
    equal doc_id stay apart. Other columns are not read. An empty table gives an empty result.
    """
    rows = stage(fingerprints(docs, id_col, text_col, k), "fingerprints")
    return spread_join(rows, components(rows, segments), "fp").select("doc_id", "fp", "component_id")
