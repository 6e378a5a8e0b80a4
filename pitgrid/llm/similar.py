"""Near-duplicates of a wider reach for the pipeline: texts whose word shingles agree to 80 %.

Such texts differ in about nine of 64 SimHash bits, far beyond what a grid of popcounts can find by a bound, so the
pipeline adds these links to the SimHash ones. One pass over the texts gives their fingerprints, the names of their shingle sets and HyperMinHash
registers; a second one reads the sets of those that meet in a band, and ``setjoin.links`` compares them whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from pitgrid.functions.staging import stage
from pitgrid.llm.common import free_names, map_rows, spread_join
from pitgrid.llm.components import connected
from pitgrid.llm.hyperminhash import WordHashes, band_posts, likely, mix, registers, set_id
from pitgrid.llm.setjoin import links
from pitgrid.llm.simhash import components, simhash


def shingle_set(text: bytes | None, known: dict[bytes, int], k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles, A-Z lower-cased; fewer words: the whole sequence; none: empty."""
    words = (text or b"").lower().split()
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(k, len(h))
    runs = h[: len(h) - k + 1]
    for j in range(1, k):
        runs = mix(runs) + h[j : len(h) - k + 1 + j]
    return np.unique(mix(runs + np.uint64(k)))


def row_keys(id_col: str, text_col: str, names: list[str]) -> list[Column]:
    """Two hashes of doc_id and text, together the key of a row; rows without a doc_id have keys like any other."""
    i, t = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return [F.xxhash64(i, t).alias(names[0]), F.xxhash64(F.lit(1), t, i).alias(names[1])]


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(row, row2, id, group) per row of ``docs``: its key, its doc_id and a number of its group of near-duplicates.

    Groups are connected by SimHash links (two bits or fewer of 64) and by texts that share ``percent`` of their k-word shingles.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(*row_keys(id_col, text_col, ["row", "row2"]), F.col(id_col).cast("long").alias("id"), text.cast("binary").alias("text"))

    def make_marks():
        known = WordHashes()

        def marks(row, row2, doc, text):
            s = shingle_set(text, known, k)
            return ((row, row2, doc, simhash(text), len(s), set_id(s), registers(s).view(np.int64)) if len(s) else (row, row2, doc, simhash(text), 0, None, None),)

        return marks

    marks = stage(map_rows(rows, make_marks, "row long, row2 long, id long, fp long, n long, set long, regs array<long>"), "marks")
    near = components(marks.select(F.col("row").alias("doc_id"), "fp"))
    own = stage(spread_join(marks.select("row", "row2", "id", "fp", "set"), near, "fp").select("row", "row2", "id", "set", F.col("component_id").alias("g")), "simhash-groups")
    classes = marks.where("set IS NOT NULL").groupBy(F.col("set").alias("id")).agg(F.min("n").alias("n"), F.min("row").alias("row"), F.min("regs").alias("regs"))
    held = own.where("set IS NOT NULL").groupBy(F.col("set").alias("id"), "g").agg(F.lit(1).alias("one")).groupBy("id").agg(F.min("g").alias("g"), F.collect_set("g").alias("all"))
    classes = stage(classes.join(held, "id"), "set-classes")
    copies = classes.where(F.size("all") > 1).select(F.col("g").alias("a"), F.explode("all").alias("b")).where("a <> b")

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = classes.join(ids, "id").select("row")

        def make_sets():
            known = WordHashes()

            def one(text):
                s = shingle_set(text, known, k)
                return ((set_id(s), s.view(np.int64)),) if len(s) else ()

            return one

        return map_rows(rows.select("row", "text").join(wanted, "row", "left_semi").select("text"), make_sets, "id long, s array<long>").dropDuplicates(["id"])

    found = links(band_posts(classes), sets_of, classes.select("id", "g"), percent, lambda pairs: likely(pairs, classes, percent))
    merged = connected(copies.union(found)).select(F.col("node").alias("g"), "root")
    return spread_join(own, merged, "g", "left").select("row", "row2", "id", F.coalesce("root", "g").alias("group"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` less near-duplicates: one row of each group stays, that with the smallest doc_id; one without a doc_id only if the group has no other.

    Groups are those of ``groups``. Rows are told apart by doc_id and text: a row that repeats both is a copy, different texts under one doc_id or
    under none are documents of their own. Null texts and texts without words are one group. Columns are those of ``docs``, whatever their names; an
    empty table gives an empty result.
    """
    found = groups(docs, id_col, text_col, k, percent)
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "row2")).alias("m")
    key = free_names(docs, "row", "row2")
    kept = stage(found.groupBy("group").agg(best).select(F.col("m.row").alias(key[0]), F.col("m.row2").alias(key[1])), "kept")
    # one key for the join and for repeated rows, so texts are shuffled once
    rows = docs.select("*", *row_keys(id_col, text_col, key))
    return rows.hint("merge").join(kept, key, "left_semi").dropDuplicates(key).drop(*key)
