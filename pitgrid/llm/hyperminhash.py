"""MinHash near-duplicates by HyperMinHash registers.

The hashes of a text's word pairs are dealt to buckets by their first bits. A bucket keeps its smallest hash as a floating-point number of 16 bits: the count of
its leading zeros and the ten bits that follow. Empty buckets borrow from others in an order that is the same for all texts. Four registers
are one band; texts that share a band are candidates. The share of equal registers, corrected for
registers that agree by accident, drops candidates far below the wanted similarity; all others are compared by their whole sets.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pitgrid.functions.staging import stage
from pitgrid.llm.common import find_package, map_rows, spread_join
from pitgrid.llm.components import connected
from pitgrid.llm.setjoin import links

BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
MANTISSA = 10
#: Registers of a band: a pair at 80 % shares none of 32 bands with a chance of 5e-8.
ROWS = 4
#: Standard deviations below the wanted similarity at which an estimate drops a pair.
MARGIN = 6.0
KNOWN = 1 << 20

_REST = 64 - BUCKET_BITS
_edges = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(_REST)
_rng = np.random.default_rng(13)
#: For each bucket the order in which it looks for a value when it is empty.
_lenders = np.stack([_rng.permutation(BUCKETS) for _ in range(BUCKETS)], axis=1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """64-bit hashes of words, the last ``KNOWN`` or fewer remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 13)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """Hashes of hashes."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def pair_set(text: bytes | None, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word pairs of a UTF-8 text, A-Z lower-cased; one word: its own hash; none: empty."""
    words = (text or b"").lower().split()
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(h) > 1:
        h = mix(mix(h[:-1]) + h[1:])
    return np.unique(h)


def registers(hashes: np.ndarray) -> np.ndarray:
    """One unsigned 16-bit register per bucket of a sorted, not empty set: leading zeros, then the mantissa."""
    at = np.searchsorted(hashes, _edges)
    low = hashes[np.minimum(at, len(hashes) - 1)]
    full = (at < len(hashes)) & ((low >> np.uint64(_REST)) == np.arange(BUCKETS, dtype=np.uint64))
    part, exponent = np.frexp((low & np.uint64((1 << _REST) - 1)).astype(np.float64))
    mantissa = np.maximum(0, (2 * part - 1) * (1 << MANTISSA)).astype(np.int64)
    out = ((_REST - exponent) << MANTISSA | mantissa).astype(np.uint16)
    empty = np.flatnonzero(~full)
    for lenders in _lenders:
        if not len(empty):
            break
        found = full[lenders[empty]]
        out[empty[found]] = out[lenders[empty[found]]]
        empty = empty[~found]
    return out


@lru_cache(maxsize=4096)
def accidental(a: int, b: int) -> float:
    """Chance that two unrelated registers are equal, with 2 ** a and 2 ** b hashes per bucket."""
    zeros = np.arange(_REST)[:, None]
    low = 2.0 ** -(zeros + 1.0) * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA))
    high = low + 2.0 ** -(zeros + 1.0 + MANTISSA)
    cell = lambda n: np.exp(-n * low) - np.exp(-n * high)
    return float((cell(2.0**a) * cell(2.0**b)).sum())


def similarity(equal: int, a: int, b: int) -> float:
    """Jaccard estimate from the number of equal registers of sets of a and b elements, less those equal by accident."""
    chance = accidental(*(max(0, round(math.log2(n / BUCKETS))) for n in (a, b)))
    return (equal / BUCKETS - chance) / (1 - chance)


def bound(a: int, b: int, least: float) -> float:
    """Estimates below this are dropped: ``MARGIN`` deviations under ``least``, by the buckets that the smaller set fills."""
    filled = BUCKETS * (1 - (1 - 1 / BUCKETS) ** min(a, b))
    return least - MARGIN * math.sqrt(least * (1 - least) / filled)


def set_id(s: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return xxhash.xxh64_intdigest(s.tobytes(), 1) - (1 << 63)


def band_posts(classes: DataFrame) -> DataFrame:
    """(id, band): one row per set of ``classes`` (id, regs) and band."""
    return classes.select("id", F.posexplode("regs").alias("i", "r")).select("id", F.xxhash64("i", "r").alias("band"))


def likely(pairs: DataFrame, classes: DataFrame, percent: int = 80) -> DataFrame:
    """The ``pairs`` (a, b and other columns) whose sizes and registers in ``classes`` (id, n, regs) allow ``percent`` of shared elements."""
    side = lambda s: classes.select(F.col("id").alias(s), F.col("n").alias(f"_n{s}"), F.col("regs").alias(f"_r{s}"))
    kept = pairs.columns
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("_na", "_nb") >= percent * F.greatest("_na", "_nb"))

    def run(batches):
        for batch in batches:
            flat = lambda c: batch.column(c).flatten().to_numpy().view(np.uint16).reshape(-1, BUCKETS)  # noqa: E731, B023
            equal = (flat("_ra") == flat("_rb")).sum(axis=1).tolist()
            sizes = zip(equal, batch.column("_na").to_pylist(), batch.column("_nb").to_pylist(), strict=True)
            good = [similarity(e, a, b) >= bound(a, b, percent / 100) for e, a, b in sizes]
            yield batch.select(kept).filter(pa.array(good, pa.bool_()))

    find_package(pairs.sparkSession)
    return both.select(*kept, "_na", "_nb", "_ra", "_rb").mapInArrow(run, pairs.schema)


def _marks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, n, id, regs) per row of ``docs``: id names the set, regs holds four registers per long; no words: both null."""
    i, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    rows = docs.select(F.xxhash64(i, text).alias("row"), i.alias("doc_id"), text.cast("binary").alias("text"))

    def make():
        known = WordHashes()

        def mark(row, doc, text):
            s = pair_set(text, known)
            if not len(s):
                return ((row, doc, 0, None, None),)
            return ((row, doc, len(s), set_id(s), registers(s).view(np.int64)),)

        return mark

    return map_rows(rows, make, "row long, doc_id long, n long, id long, regs array<long>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``.

    Two texts link if their sets of word pairs share ``percent`` of the union. component_id is the smallest doc_id reachable over links, kept says
    that it is the row's own. A text of one word has that word as its set; null, empty and blank texts have none and link with nothing. Rows with equal
    doc_id stay apart and both have it; a null doc_id takes part and is the smallest only where the component has no other (then
    component_id is null and the row is kept). Other columns are not read. An empty table gives an empty result.
    """
    marks = stage(_marks(docs, id_col, text_col), "marks")
    classes = stage(marks.where("id IS NOT NULL").groupBy("id").agg(F.min("doc_id").alias("first"), F.min("row").alias("row"), F.min("n").alias("n"), F.min("regs").alias("regs")), "set-classes")
    text = F.col(text_col).cast("string")

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = classes.join(ids, "id").select("row")
        rows = docs.select(F.xxhash64(F.col(id_col).cast("long"), text).alias("row"), text.cast("binary").alias("text")).join(wanted, "row", "left_semi").select("text")

        def make():
            known = WordHashes()

            def one(text):
                s = pair_set(text, known)
                return ((set_id(s), s.view(np.int64)),) if len(s) else ()

            return one

        return map_rows(rows, make, "id long, s array<long>").dropDuplicates(["id"])

    edges = links(band_posts(classes), sets_of, None, percent, lambda pairs: likely(pairs, classes, percent))
    roots = connected(edges).join(classes.select(F.col("id").alias("node"), "first"), "node")
    smallest = roots.groupBy("root").agg(F.min("first").alias("least"))
    merged = roots.join(smallest, "root").select(F.col("node").alias("id"), "least")
    own = classes.join(merged, "id", "left").select("id", F.coalesce("least", "first").alias("least"))
    linked = spread_join(marks.where("id IS NOT NULL").select("id", "doc_id", "n"), own, "id").select("doc_id", "n", F.col("least").alias("component_id"))
    every = linked.union(marks.where("id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
