"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pitgrid.functions.staging import stage


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is one node of its component.

    Each round points every node at its smallest neighbour, shortens the pointers twice and replaces the ends of
    every edge by what they point at. Edges inside a tree vanish, so a chain shrinks at least by a
    factor of four a round. Edge and pointer tables are written in the shared folder each round; the driver sees counts only.
    Null ends and loops are ignored; no edges: empty result.
    """
    left = stage(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct(), "edges")
    roots = None
    while left.count():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("p")).select("n", F.least("n", "p").alias("p"))
        for _ in range(2):
            higher = up.select(F.col("n").alias("p"), F.col("p").alias("pp"))
            up = up.join(higher, "p").select("n", F.col("pp").alias("p"))
        up = stage(up, "pointers")
        if roots is None:
            roots = up.select(F.col("n").alias("node"), F.col("p").alias("root"))
        else:
            step = up.select(F.col("n").alias("root"), "p")
            roots = stage(roots.join(step, "root", "left").select("node", F.coalesce("p", "root").alias("root")), "roots")
        left = (
            left.join(up.select(F.col("n").alias("a"), F.col("p").alias("pa")), "a")
            .join(up.select(F.col("n").alias("b"), F.col("p").alias("pb")), "b")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .where("a <> b").distinct()
        )
        left = stage(left, "edges")
    return left.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots
