"""Ranked lexical search of many items at once, with the work that items share done once.

Items of a block are read together. Terms that occur in the same items form one node; pairs of nodes that several items hold become
nodes of their own, again and again, until nothing is shared any more. The result is a sharing graph: leaves are terms, an inner node is the sum
of two others, an item the sum of a few nodes. Per batch of documents every node's score accumulator is computed once, from
the leaves up, and items add up the accumulators of their nodes. All sums are 64-bit integers, so the order of additions does not matter.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from pitgrid.functions.staging import stage
from pitgrid.llm.common import find_package, map_rows

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed pattern of a term: runs of ASCII letters, digits and all characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Terms of a block of items: what the driver and every task hold of the items at a time.
BLOCK_TERMS = 20_000
#: Documents whose accumulators are in memory at a time.
BATCH = 256

# A-Z lower-cased, everything between terms a space; bytes of characters beyond ASCII stay
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text in their order; null: none."""
    return (text or b"").translate(_TERM_BYTES).split()


def sharing_graph(items: list[list[int]], n_terms: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """(nodes, parts): node ``n_terms + i`` is the sum of the pair ``nodes[i]`` of earlier ones; an item is the sum of its ``parts``.

    Terms of the same two or more items are merged first. Then, round after round, the pairs of nodes found in most items are
    replaced by one node wherever two items or more still hold both.
    """
    nodes: list[tuple[int, int]] = []

    def add(a: int, b: int) -> int:
        nodes.append((a, b))
        return n_terms + len(nodes) - 1

    where = defaultdict(list)
    for i, terms in enumerate(items):
        for t in sorted(set(terms)):
            where[t].append(i)
    alike = defaultdict(list)
    for t in sorted(where):
        alike[tuple(where[t])].append(t)
    alone: list[list[int]] = [[] for _ in items]
    shared: list[set[int]] = [set() for _ in items]
    for holders, terms in alike.items():
        if len(holders) == 1:
            alone[holders[0]].extend(terms)
            continue
        node = terms[0]
        for t in terms[1:]:
            node = add(node, t)
        for i in holders:
            shared[i].add(node)
    while True:
        found = Counter(pair for held in shared for pair in combinations(sorted(held), 2))
        pairs = sorted((p for p, n in found.items() if n > 1), key=lambda p: (-found[p], p))
        if not pairs:
            break
        holders = defaultdict(set)
        for i, held in enumerate(shared):
            for node in held:
                holders[node].add(i)
        for a, b in pairs:
            both = holders[a] & holders[b]
            if len(both) < 2:
                continue
            node = add(a, b)
            for i in both:
                shared[i] -= {a, b}
                shared[i].add(node)
            holders[a] -= both
            holders[b] -= both
    return nodes, [sorted(held) + own for held, own in zip(shared, alone, strict=True)]


def counted(docs: DataFrame, terms: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, t, f) per row of ``docs`` with a term: n all its terms with repeats, t numbers in ``terms`` and f their occurrences."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary"))

    def make():
        known = {t: i for i, t in enumerate(terms)}

        def row(i, text):
            found = terms_of(text)
            if not found:
                return ()
            held = Counter(filter(known.__contains__, found))
            return ((i, len(found), [known[t] for t in held], list(held.values())),)

        return row

    return map_rows(rows, make, "doc_id long, n long, t array<int>, f array<int>")


def best_documents(rows: DataFrame, weights: np.ndarray, nodes: list[tuple[int, int]], parts: list[list[int]], n_docs: int, n_words: int, k: int) -> DataFrame:
    """(item, doc_id, score): of every partition of ``counted`` rows at least the k best documents of each item, with score above 0."""
    n_terms, n_items = len(weights), len(parts)
    order = [np.array(p, dtype=np.int64) for p in parts]
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        sums = np.zeros((n_terms + len(nodes), BATCH), dtype=np.int64)
        floor = np.ones(n_items, dtype=np.int64)  # score of an item's k-th best document so far
        pool = [np.zeros(0, dtype=np.int64)] * 4  # item, whether the id is null, id, score

        def best(pool):
            item, none, doc, score = pool
            at = np.lexsort((doc, none, -score, item))
            item, score = item[at], score[at]
            rank = np.arange(len(item)) - np.searchsorted(item, np.arange(n_items))[item]
            floor[item[rank == k - 1]] = score[rank == k - 1]
            return [x[rank < k] for x in (item, none[at], doc[at], score)]

        for batch in batches:
            words = batch.column(1).to_numpy()
            none = batch.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = batch.column(0).fill_null(0).to_numpy()
            ends = batch.column(2).offsets.to_numpy()
            terms, found = batch.column(2).values.to_numpy(), batch.column(3).values.to_numpy().astype(np.int64)
            for lo in range(0, batch.num_rows, BATCH):
                hi = min(lo + BATCH, batch.num_rows)
                n, cut = hi - lo, slice(ends[lo], ends[hi])
                col = np.repeat(np.arange(n), np.diff(ends[lo : hi + 1]))
                t, tf = terms[cut], found[cut]
                m = 10 + (90 * words[lo:hi] * n_docs) // n_words
                sums[:n_terms] = 0
                sums[t, col] = weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[col]))
                for i, (a, b) in enumerate(nodes):
                    np.add(sums[a], sums[b], out=sums[n_terms + i])
                new = []
                for i, p in enumerate(parts):
                    score = sums[p, :n].sum(axis=0)
                    good = np.flatnonzero(score >= floor[i])
                    new.append((np.full(len(good), i), none[lo + good], ids[lo + good], score[good]))
                pool = best([np.concatenate(x) for x in zip(pool, *new, strict=True)])
        item, none, doc, score = pool
        if len(item):
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64(), mask=none == 1), pa.array(score, pa.int64())], schema=schema)

    find_package(rows.sparkSession)
    return rows.mapInArrow(run, "item int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` documents with the highest score above 0, ties by ascending doc_id, null ids last.

    A document's score sums, over the item's distinct terms, w * (10^9 tf div (1000 tf + 8 m)), with w = floor(1000 ln((2N + 2) / (2 df + 1))) and
    m = 10 + 90 n N div L: N documents have a term, L terms in all, n in this document, df documents hold the term, tf times in this one.
    Rows of ``items`` with equal ids, nulls too, are one item with the terms of all its rows; null, empty and blank texts have no terms, and such
    items no result. Rows of ``docs`` are documents of their own, repeated ones too. Other columns are not read. Empty tables give an empty result.

    Items are taken in blocks of about ``BLOCK_TERMS`` terms. Each block reads every text once and writes its terms' counts (``counted``);
    every task keeps k documents an item, so the last ranking sorts tasks x items x k rows.
    """
    spark = docs.sparkSession
    plain = F.translate(F.coalesce(F.col(item_text_col).cast("string"), F.lit("")), UPPER, LOWER)
    each = items.select(F.col(item_col).cast("long").alias("item_id"), F.regexp_extract_all(plain, F.lit(TERM), F.lit(0)).alias("t"))
    each = stage(each.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("t")).where(F.size("t") > 0), "items")
    n_terms = each.agg(F.sum(F.size("t"))).first()[0] or 0
    blocks = -(-n_terms // BLOCK_TERMS)
    out = None
    for b in range(blocks):
        block = each.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        held = sorted((r["item_id"] is None, r["item_id"] or 0, r["t"]) for r in block)
        terms = sorted({t for _, _, ts in held for t in ts})
        number = {t: i for i, t in enumerate(terms)}
        nodes, parts = sharing_graph([[number[t] for t in ts] for _, _, ts in held], len(terms))
        rows = stage(counted(docs, [t.encode() for t in terms], id_col, text_col), "term-counts")
        total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
        if not held or not total["n"]:
            continue
        df = np.zeros(len(terms), dtype=np.int64)
        for r in rows.select(F.explode("t").alias("t")).groupBy("t").count().collect():
            df[r["t"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
        found = best_documents(rows, weights, nodes, parts, total["n"], total["l"], k)
        names = spark.createDataFrame([(i, None if none else item) for i, (none, item, _) in enumerate(held)], "item int, item_id long")
        place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        best = found.withColumn("rank", place).where(F.col("rank") <= k).join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.union(best)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
