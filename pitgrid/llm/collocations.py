"""Phrase collocations: frequent n-grams by mergeable Misra-Gries summaries, then counted exactly and scored by their weakest cut.

A summary with c counters loses at most mass / (c + 1) of any count, also when it is merged from parts. N-grams are dealt to hash partitions, each
with its own summary, which takes more counters before it would lose ``least`` / ``SPARE`` (so it has more than mass / threshold) and records what it
lost: every n-gram with ``least`` occurrences survives, and few others do. A further pass over the texts counts the survivors exactly.

An n-gram that frequent has frequent parts, so the summaries are made level by level: words, then pairs of surviving
words, then runs of surviving pairs. What the levels before let through is tested in a bit table of fixed size; a false hit adds work and changes no result.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from pitgrid.functions.staging import stage
from pitgrid.llm.common import find_package

LONGEST = 5
#: log2 of the bits in the table of survivors that every task reads: 16 MB, whatever the input.
TABLE_BITS = 27
#: Words of all languages in a task's memory at a time; their n-grams are summed before they leave it.
BUFFER = 1 << 20
#: Phrases that a task holds before they leave it.
HELD = 1 << 18
#: Hash partitions of the n-grams; a task has some of them, each with a summary of its own.
PARTS = 4096
#: Counters that a summary begins with.
COUNTERS = 1 << 10
#: A summary loses less than this part of the threshold.
SPARE = 8
#: Splits of the texts that a task of the exact pass takes.
SPLITS = 4
#: Words that a task remembers the hashes of.
KNOWN = 1 << 18

_BREAK = b"\xff"  # in no UTF-8 text
# A-Z lower-cased, . , ; : ! ? and \n \v \f \r end a piece, a tab is a space
_BYTES = bytes(c + 32 if 65 <= c <= 90 else 255 if c in b".,;:!?\n\v\f\r" else 32 if c == 9 else c for c in range(256))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
            self[_BREAK] = 0
        h = self[word] = xxhash.xxh64_intdigest(word, 12) | 1
        return h


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a run from that of its front and of its last word."""
    x = (a ^ (a >> np.uint64(29))) * _M1 + b
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(29))


def _runs(batches, with_words: bool, buffer: int):
    """(lang, words, hashes) of texts with one language, ``buffer`` words in memory at a time (half with words); hash 0 is the end of a piece."""
    known = _Hashes({_BREAK: 0})
    held: dict[str, tuple[list, list, int]] = {}
    total, most = 0, buffer // 2 if with_words else buffer
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = (text or b"").translate(_BYTES).replace(_BREAK, b" \xff ").split()
                words.append(_BREAK)
                w, h, n = held.get(lang) or ([], [], 0)
                h.append(np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words)))
                if with_words:
                    w.append(words)
                held[lang] = (w, h, n + len(words))
                total += len(words)
                if total >= most:
                    # the language with the most words leaves
                    lang = max(held, key=lambda x: held[x][2])
                    w, h, n = held.pop(lang)
                    total -= n
                    yield lang, w, np.concatenate(h)
    while held:
        lang, (w, h, _) = held.popitem()
        yield lang, w, np.concatenate(h)


def _levels(h: np.ndarray, seed: np.uint64, longest: int):
    """(k, hashes, whole): hash of the k-gram at every place, and whether it lies within a piece; pieces end at hash 0."""
    whole = h != 0
    # the language is part of every hash
    grams = words = mix(np.full(len(h), seed), h)
    yield 1, grams, whole
    for k in range(2, longest + 1):
        n = len(h) - k + 1
        if n <= 0:
            return
        whole = whole[:n] & (h[k - 1 :] != 0)
        grams = mix(grams[:n], words[k - 1 :])
        yield k, grams, whole


def _seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode(), 34))


def _in_table(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(65 - (64 * len(table)).bit_length())
    return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _kept(h: np.ndarray, seed: np.uint64, first: int, last: int, table: np.ndarray | None):
    """(k, hashes, places) of the k-grams, first <= k <= last, all of whose shorter runs below ``first`` are in ``table``."""
    ok = None
    for k, grams, whole in _levels(h, seed, last):
        good = whole if ok is None else whole & ok[: len(whole)]
        if k >= first:
            at = np.flatnonzero(good)
            yield k, grams[at], at
        elif table is not None:
            at = np.flatnonzero(good)
            good = np.zeros(len(whole), dtype=bool)
            good[at] = _in_table(table, grams[at])
        ok = good[:-1] & good[1:]


def _counts(texts: DataFrame, first: int, last: int, table=None) -> DataFrame:
    """(h, n): occurrences of the k-grams of parts of the texts by their 64-bit hash."""

    buffer = BUFFER

    def run(batches):
        bits = None if table is None else np.frombuffer(table.value, dtype=np.uint64)
        for lang, _, h in _runs(batches, False, buffer):
            found = [np.zeros(0, dtype=np.uint64), *(g for _, g, _ in _kept(h, _seed(lang), first, last, bits))]
            hashes, n = np.unique(np.concatenate(found), return_counts=True)
            for lo in range(0, len(hashes), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(hashes[lo : lo + 65536].view(np.int64)), pa.array(n[lo : lo + 65536])], names=["h", "n"])

    find_package(texts.sparkSession)
    return texts.mapInArrow(run, "h long, n long")


def gathered(texts: DataFrame) -> DataFrame:
    """``texts`` in tasks of ``SPLITS`` splits each, without a shuffle; two tasks a core remain where there are that many splits."""
    splits = texts.rdd.getNumPartitions()
    return texts.coalesce(max(1, min(splits, max(2 * texts.sparkSession.sparkContext.defaultParallelism, splits // SPLITS))))


def exact_counts(texts: DataFrame, longest: int, table) -> DataFrame:
    """(lang, phrase, n): occurrences of every phrase whose hash and parts are in ``table``; phrase '' counts the words of the language.

    A task adds up ``HELD`` phrases by their hashes before they leave it; what leaves is summed by the phrases themselves. Nearly every task finds
    nearly every frequent phrase, of which a longer text has more, so tasks take several splits: fewer parts of each sum leave.
    """
    buffer = BUFFER

    def run(batches):
        bits = np.frombuffer(table.value, dtype=np.uint64)
        held: dict[str, dict[int, list]] = {}

        def leave():
            for lang, found in held.items():
                rows = list(found.values())
                for lo in range(0, len(rows), 16384):
                    n, phrases = zip(*rows[lo : lo + 16384], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(phrases), pa.array(n, pa.int64())], names=["lang", "phrase", "n"])
            held.clear()

        for lang, parts, h in _runs(batches, True, buffer):
            words = list(chain.from_iterable(parts))
            found = held.setdefault(lang, {})
            found.setdefault(0, [0, ""])[0] += int(np.count_nonzero(h))
            ok = None
            for k, grams, whole in _levels(h, _seed(lang), longest):
                at = np.flatnonzero(whole if ok is None else whole & ok[: len(whole)])
                at = at[_in_table(bits, grams[at])]
                keys, first, n = np.unique(grams[at], return_index=True, return_counts=True)
                for key, i, c in zip(keys.tolist(), at[first].tolist(), n.tolist(), strict=True):
                    if key in found:
                        found[key][0] += c
                    else:
                        found[key] = [c, b" ".join(words[i : i + k]).decode()]
                ok = np.zeros(len(whole), dtype=bool)
                ok[at] = True
                ok = ok[:-1] & ok[1:]
            if sum(map(len, held.values())) >= HELD:
                yield from leave()
        yield from leave()

    find_package(texts.sparkSession)
    return gathered(texts).mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


class Summary:
    """Misra-Gries counters of one hash partition; ``merge`` takes counts in any order and in parts. A count is too low by ``lost`` at most.

    The counters exceed mass / threshold by construction: where lowering them all once more would lose ``allowed`` or more, their number doubles instead.
    """

    def __init__(self, allowed: int, counters: int = COUNTERS):
        self.allowed, self.counters, self.lost = allowed, counters, 0
        self.keys, self.n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def merge(self, keys: np.ndarray, n: np.ndarray) -> None:
        keys, n = np.concatenate([self.keys, keys]), np.concatenate([self.n, n])
        keys, at = np.unique(keys, return_inverse=True)
        n = np.bincount(at, weights=n).astype(np.int64) if len(at) else n[:0]
        while len(keys) > self.counters:
            # all counters are lowered by the largest that has to go
            less = int(np.partition(n, len(n) - self.counters - 1)[len(n) - self.counters - 1])
            if self.lost + less >= self.allowed:
                self.counters *= 2
                continue
            keys, n = keys[n > less], n[n > less] - less
            self.lost += less
        self.keys, self.n = keys, n


def survivors(counts: DataFrame, least: int) -> DataFrame:
    """(h): a superset of the hashes that ``counts`` (h, n) gives ``least`` occurrences in all.

    Counts go to the summaries of their hash partitions in one shuffle. A summary loses less than ``least / SPARE`` of any count; a hash
    whose count could not reach ``least`` even with that is left out.
    """
    allowed = max(1, least // SPARE)

    def run(batches):
        summaries: dict[int, Summary] = {}
        waiting: list[pa.RecordBatch] = []

        def merge():
            p, h, n = (np.concatenate([b.column(c).to_numpy() for b in waiting]) for c in range(3))
            order = np.argsort(p, kind="stable")
            p, h, n = p[order], h[order], n[order]
            starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]).tolist()
            for lo, hi in zip(starts, [*starts[1:], len(p)], strict=True):
                summaries.setdefault(int(p[lo]), Summary(allowed)).merge(h[lo:hi], n[lo:hi])
            waiting.clear()

        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= 1 << 20:
                merge()
        if waiting:
            merge()
        for s in summaries.values():
            keys = s.keys[s.n + s.lost >= least]
            for lo in range(0, len(keys), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + 65536])], names=["h"])

    find_package(counts.sparkSession)
    part = F.pmod("h", F.lit(PARTS)).cast("int")
    return counts.select(part.alias("part"), "h", "n").repartition("part").mapInArrow(run, "h long")


def bit_table(hashes: DataFrame):
    """A broadcast table of 2 ** TABLE_BITS bits with those set that the hashes (column ``h``) name by their first bits."""
    at = F.shiftrightunsigned("h", 64 - TABLE_BITS)
    words = hashes.select(F.shiftrightunsigned(at, 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - TABLE_BITS}) & 63 as int))").alias("bit"))
    found = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (TABLE_BITS - 6), dtype=np.int64)
    table[found["at"].to_numpy()] = found["bits"].to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(table.tobytes())


def frequent(docs: DataFrame, least: int = 100, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, n): all phrases of 1 to ``longest`` words with ``least`` occurrences or more, and per language '' with its number of words."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text"))
    known = survivors(_counts(texts, 1, 1), least)
    for first, last in ((2, 2), (3, longest)):
        if first <= longest:
            known = stage(known, "survivors")
            known = known.union(survivors(_counts(texts, first, min(last, longest), bit_table(known)), least))
    found = stage(exact_counts(texts, longest, bit_table(stage(known, "survivors"))), "exact-counts")
    return found.where((F.col("n") >= least) | (F.col("phrase") == ""))


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by score, a (both descending) and phrase (by UTF-8 bytes).

    A-Z are lower-cased; . , ; : ! ? and line ends part pieces, spaces and tabs words. A phrase of 2 to ``longest`` words with a >= ``least`` occurrences, overlaps
    included, is cut into its first k words (l occurrences) and the rest (r): score = floor(1000 a n / (l r)), n the words of the language; the lowest cut
    counts, ties to the smallest k. Phrases inside a longer one with as many occurrences go. Products are decimals of 38 digits.
    A null language is ``und``; null and empty texts have no words; repeated rows count as often as they stand; doc_id and other columns are
    not read. An empty table gives an empty result. A long text is one run of words, in memory whole; others are taken ``BUFFER`` words at a time.
    """
    counts = frequent(docs, least, longest, text_col, lang_col)
    words = F.split("phrase", " ")
    names = counts.where("phrase <> ''").withColumnRenamed("n", "a")
    runs = names.withColumn("w", words).withColumn("size", F.size("w")).where("size > 1")
    longer = runs.where("size > 2").select("lang", F.explode(F.array(F.expr("array_join(slice(w, 1, size - 1), ' ')"), F.expr("array_join(slice(w, 2, size - 1), ' ')"))).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    own = runs.join(longer, ["lang", "phrase"], "left").where("most IS NULL OR most < a").drop("most")
    cut = own.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("front"), F.expr("array_join(slice(w, k + 1, size), ' ')").alias("rest"))
    part = lambda key, n: names.select("lang", F.col("phrase").alias(key), F.col("a").alias(n))
    cut = cut.join(part("front", "l"), ["lang", "front"]).join(part("rest", "r"), ["lang", "rest"]).join(counts.where("phrase = ''").select("lang", "n"), "lang")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    cut = cut.withColumn("up", F.lit(1000).cast("decimal(4,0)") * whole("a") * whole("n")).withColumn("down", whole("l") * whole("r"))
    best = cut.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr("up div down").alias("score"), "k", "l", "r")).alias("m"))
    best = best.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = best.withColumn("rank", place).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
