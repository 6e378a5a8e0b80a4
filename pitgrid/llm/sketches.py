"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash in the lowest ``1 / scale`` of the hash range. The threshold is the same for all texts, so
sketches of parts merge by union, and the share of a sketch found in another estimates how
much of the smaller text lies in the larger one, however unequal they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pitgrid.llm.common import shingle_hashes, words_of

SCALE = 4
SHINGLE = 5
#: rows per chunk of the successor search
CHUNK_ROWS = 4096
MAX_CHUNKS = 1 << 16


def with_sketch(df: DataFrame, text_col: str, out: str, k: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """``df`` and the column ``out``: sorted distinct retained hashes of the k-word shingles of a text; no words: empty.

    A text all of whose hashes lie above the threshold keeps its smallest one, so that short texts can be told
    apart; a merge drops it where another hash is retained. Steps are columns of their own, so each is computed once.
    """
    bound = -(1 << 63) + (1 << 64) // scale
    steps = df.withColumn("_w", words_of(F.col(text_col))).withColumn("_h", shingle_hashes("_w", k)).drop("_w")
    steps = steps.withColumn("_k", F.filter("_h", lambda h: h < F.lit(bound)))
    kept = F.when(F.size("_k") > 0, F.array_sort(F.array_distinct("_k"))).otherwise(F.array_compact(F.array(F.array_min("_h"))))
    return steps.withColumn(out, kept).drop("_h", "_k")


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Sketch of two texts taken together (shingles across the seam apart)."""
    bound = -(1 << 63) + (1 << 64) // scale
    both = F.array_union(a, b)
    kept = F.filter(both, lambda h: h < F.lit(bound))
    return F.when(F.size(kept) > 0, F.array_sort(kept)).otherwise(F.array_compact(F.array(F.array_min(both))))


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that the other one holds; two empty sketches: 1, one empty: 0."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise((F.size(a) == F.size(b)).cast("double"))


def sketch_text(s: Column) -> Column:
    """A sketch as text: its hashes as 16 hex digits each, joined by commas."""
    return F.lower(F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), ","))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch): the text of the next document by ascending doc_id, then text; of the last the first's.

    Ids are cut into chunks at actual ids (quantiles, bounded in number by ``MAX_CHUNKS``). The first document of a chunk
    is read in the chunk before as well, so a window inside chunks sees every successor, and no task holds more than a chunk.
    A null id counts as the smallest. Rows with equal ids follow each other by text. A lone document follows itself.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # a null id sorts first as the smallest long
    low = -(1 << 63)
    rows = rows.withColumn("order_id", F.coalesce("doc_id", F.lit(low).cast("long")))
    ids = rows.select("order_id")
    facts = ids.agg(F.count(F.lit(1)).alias("n"), F.min("order_id").alias("lo")).first()
    n, lowest = facts["n"], facts["lo"]
    rows = with_sketch(rows, "text", "sketch", k, scale)
    if not n:
        return rows.select("doc_id", "text", "sketch", F.col("text").alias("next_text"), F.col("sketch").alias("next_sketch"))
    chunks = min(MAX_CHUNKS, max(1, n // CHUNK_ROWS))
    cuts = []
    if chunks > 1:
        at = [i / chunks for i in range(1, chunks)]
        got = ids.agg(F.percentile_approx("order_id", [float(x) for x in at], F.lit(4 * chunks if chunks < 2500 else 10_000)).alias("q")).first()["q"]
        cuts = sorted({x for x in got if x > lowest})
    known = F.array(*[F.lit(x).cast("long") for x in cuts]) if cuts else F.expr("cast(array() as array<bigint>)")
    # chunk number: cuts at or below the id, by halving
    low_high = F.struct(F.lit(0).alias("l"), F.lit(len(cuts)).alias("h"))
    half = lambda s: F.floor((s["l"] + s["h"]) / 2).cast("int")
    step = lambda s, _: F.when(s["l"] >= s["h"], s).otherwise(
        F.when(F.get(known, half(s)) <= F.col("order_id"), F.struct((half(s) + 1).alias("l"), s["h"].alias("h"))).otherwise(F.struct(s["l"].alias("l"), half(s).alias("h"))))
    number = F.aggregate(F.sequence(F.lit(0), F.lit(max(1, len(cuts)).bit_length())), low_high, step)["l"] if cuts else F.lit(0)
    rows = rows.withColumn("chunk", number)
    # the first rows of a chunk are guests at the end of the one before; the first of all, at the end of the last
    first = F.when(F.col("order_id") == lowest, F.lit(len(cuts))).when(F.col("chunk") > 0, F.when(F.get(known, F.col("chunk") - 1) == F.col("order_id"), F.col("chunk") - 1))
    own = F.struct(F.col("chunk").alias("c"), F.lit(0).alias("guest"))
    guest = F.struct(first.alias("c"), F.lit(1).alias("guest"))
    spread = rows.select("doc_id", "text", "sketch", "order_id", F.explode(F.when(first.isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("at"))
    spread = spread.select("doc_id", "text", "sketch", "order_id", F.col("at.c").alias("chunk"), F.col("at.guest").alias("guest"))
    order = W.partitionBy("chunk").orderBy("guest", "order_id", "text")
    after = spread.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order))
    return after.where("guest = 0").select("doc_id", "text", "sketch", "next_text", "next_sketch")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """(doc_id, sketch) per row; null texts count as empty. Rows with equal or null ids stay apart; other columns are not read."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return with_sketch(rows, "text", "sketch", k, scale).select("doc_id", "sketch")


def edited_and_next(docs: DataFrame, k: int = SHINGLE, scale: int = SCALE, **columns) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    Texts are shuffled once, together with their sketches, so each text is sketched once and its edited form once.
    """
    rows = with_next(docs, k=k, scale=scale, **columns).withColumn("n", F.char_length("text")).withColumn("cut", F.floor(F.col("n") / 4).cast("int"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - F.col("cut")), F.substring(F.col("next_text"), F.lit(1), F.col("cut")))
    rows = rows.select("doc_id", F.col("n").cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    rows = with_sketch(rows.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_sketch", k, scale)
    return rows.select("doc_id", "n_chars", "edited_sha256", sketch_text(F.col("sketch")).alias("fingerprint"), sketch_text(F.col("edited_sketch")).alias("edited_fingerprint"),
                       containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
