"""Links between sets of hashes that share a given part, for all sets that meet in a band.

Sets are named by a long id, so equal sets are one. Small bands give all their pairs. In a crowded band every set is paired with two heads; verified
links make groups, and what a crowded band still holds of different groups goes through an exact prefix filter (``apart_pairs``). No
step lists the pairs of a crowded band, and none that could link is left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from pitgrid.functions.staging import stage
from pitgrid.llm.components import connected

#: Sets of a band up to which all its pairs are listed.
FEW = 8
#: Partners of a head that are compared in one task.
PARTNERS = 256


def shared_bands(posts: DataFrame) -> DataFrame:
    """(id, band, n): bands of ``posts`` (id, band) that hold n > 1 sets."""
    sizes = posts.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return stage(posts.join(sizes, "band").select("id", "band", "n"), "shared-bands")


def band_pairs(shared: DataFrame) -> DataFrame:
    """(a, b, first): all pairs of small bands; in a crowded one each set with two heads ``a``: that which shares most with all, and one drawn anew per band.

    The original of a family of edited copies keeps the bands that its copies lose one by one, so it is the head of most of them.
    ``first`` marks one pair per set, that in its fullest band: these tie most of a family together.
    """
    weight = shared.groupBy("id").agg(F.sum("n").alias("weight"))
    drawn = F.struct(F.xxhash64("band", "id").alias("o"), F.col("id").alias("a"))
    central = F.struct("weight", F.xxhash64("id").alias("o"), F.col("id").alias("a"))
    heads = shared.join(weight, "id").groupBy("band").agg(F.max(central).alias("c"), F.min(drawn).alias("d"))
    met = shared.join(heads.select("band", F.col("c.a").alias("c"), F.col("d.a").alias("d")), "band")
    best = met.where("id <> c").groupBy("id").agg(F.max(F.struct("n", "c")).alias("m")).select(F.col("m.c").alias("a"), F.col("id").alias("b"), F.lit(True).alias("first"))
    every = met.where(F.col("n") > FEW).select(F.explode(F.array_distinct(F.array("c", "d"))).alias("a"), F.col("id").alias("b"), F.lit(False).alias("first")).where("a <> b")
    small = shared.where(F.col("n") <= FEW).groupBy("band").agg(F.collect_list("id").alias("all"))
    small = small.select("all", F.explode("all").alias("a")).select("a", F.explode("all").alias("b"), F.lit(False).alias("first")).where("a < b")
    return best.union(every).union(small).groupBy("a", "b").agg(F.max("first").alias("first"))


def agreeing(pairs: DataFrame, sets: DataFrame, percent: int = 80) -> DataFrame:
    """The ``pairs`` (a, b) whose sets in ``sets`` (id, s) share ``percent`` of their union, compared whole.

    A head ``a`` of many partners is copied once per ``PARTNERS`` of them, so its partners spread over tasks.
    """
    copies = F.ceil(F.col("m") / PARTNERS).cast("int")
    heads = stage(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m")).select("a", copies.alias("copies")), "heads")
    left = sets.join(heads, F.col("id") == F.col("a")).select("a", "copies", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("s").alias("sa")).drop("copies")
    each = pairs.select("a", "b").join(heads, "a").select("a", "b", F.pmod(F.xxhash64("b"), "copies").cast("int").alias("copy"))
    both = each.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").join(left, ["a", "copy"])
    both = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("n"), F.size(F.array_intersect("sa", "sb")).alias("both"))
    return both.where((100 + percent) * F.col("both") >= percent * F.col("n")).select("a", "b")


def apart_pairs(sets: DataFrame, percent: int = 80) -> DataFrame:
    """(a, b): every pair of ``sets`` (id, g, s) of different groups ``g`` that can share ``percent`` of its union; others may be among them.

    Elements that only one group holds cannot be shared; a set with too few others goes, and those left are counted again. Elements that the same sets
    hold are one class with a weight. Classes stand in one order for all sets, the rarer first, elements of one group before all; two sets that similar share
    a class that begins among the first n - ceil(percent n) + 1 elements of each. Pairs meet by class and length class, so
    no two sets are paired whose sizes differ too much.
    """
    part = percent / 100
    rows = sets.select("id", "g", "s", F.size("s").alias("n")).where("n > 0")
    for last in (False, True):
        each = rows.select("id", "g", "n", F.explode("s").alias("e"))
        if last:
            name = [F.bit_xor(F.xxhash64("id")), F.sum(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 40))), F.min("id")]
            held = each.groupBy("e").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count(F.lit(1)).alias("df"), F.xxhash64(*name).alias("c")).where("lo <> hi").select("e", "df", "c")
            each = stage(each.join(held, "e").groupBy("id", "g", "n", "df", "c").agg(F.count(F.lit(1)).alias("w")), "classes")
        else:
            held = each.groupBy("e").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("e")
            enough = each.join(held, "e").groupBy("id", "n").agg(F.count(F.lit(1)).alias("w")).where(100 * F.col("w") >= percent * F.col("n")).select("id")
            rows = stage(rows.join(enough, "id"), "sets-apart")
    order = F.array_sort(F.collect_list(F.struct("df", "c", "w")))
    held = each.groupBy("id", "g", "n").agg(order.alias("cs"), F.sum("w").alias("shared"))
    # elements before each class, those of one group included
    before = F.aggregate(F.slice("cs", F.lit(1), F.col("i")), F.col("n") - F.col("shared"), lambda s, x: s + x["w"])
    posts = held.select("id", "g", "n", "cs", "shared", F.posexplode("cs").alias("i", "x")).withColumn("before", before)
    posts = posts.where(F.col("before") <= F.col("n") - F.ceil(F.col("n") * percent / 100)).select("id", "g", "n", F.col("x.c").alias("c"), F.col("x.w").alias("w"), "before")
    # sizes within a ratio of ``percent`` differ by one length class at most
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / part)) + 1e-9).cast("int")
    posts = stage(posts.withColumn("size", size), "prefixes")
    side = lambda rows, s: rows.select("c", "size", *[F.col(v).alias(f"{v}{s}") for v in ("id", "g", "n", "before")])
    large = posts.withColumn("size", F.explode(F.array("size", F.col("size") - 1)))
    both = side(posts, "y").join(side(large, "x"), ["c", "size"]).where("gx <> gy")
    left = F.least(F.col("nx") - F.col("beforex"), F.col("ny") - F.col("beforey"))
    both = both.where((F.struct("ny", "idy") < F.struct("nx", "idx")) & (100 * F.col("ny") >= percent * F.col("nx")) & ((100 + percent) * left >= percent * (F.col("nx") + F.col("ny"))))
    return both.select(F.col("idx").alias("a"), F.col("idy").alias("b")).distinct()


def links(posts: DataFrame, sets_of: Callable[[DataFrame], DataFrame], groups: DataFrame | None = None, percent: int = 80,
          screen: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Edges (a, b) between groups: the groups that they connect are those of all pairs that share a band and ``percent`` of their union.

    ``posts`` (id, band) name the bands of each set, ``sets_of`` gives (id, s) for ids, ``groups`` (id, g) what is one
    group from the start (null: each id its own), and ``screen`` drops pairs that need no comparison.
    """
    screen = screen or (lambda pairs: pairs)
    shared = shared_bands(posts)
    if groups is None:
        with_groups = lambda rows, c, out: rows.withColumn(out, F.col(c))
    else:
        with_groups = lambda rows, c, out: rows.join(groups.select(F.col("id").alias(c), F.col("g").alias(out)), c)
    pairs = with_groups(with_groups(band_pairs(shared), "a", "ga"), "b", "gb").where("ga <> gb")
    pairs = stage(screen(pairs), "candidates")
    crowd = stage(with_groups(shared.where(F.col("n") > FEW).select("id", "band"), "id", "g"), "crowd")
    sets = stage(sets_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(crowd.select("id")).distinct()), "sets")
    edges = None
    for some in (F.col("first"), ~F.col("first")):
        wanted = pairs.where(some)
        if edges is not None:
            roots = connected(edges)
            root = lambda c, out: roots.select(F.col("node").alias(c), F.col("root").alias(out))  # noqa: E731, B023
            wanted = wanted.join(root("ga", "ra"), "ga", "left").join(root("gb", "rb"), "gb", "left").where(F.coalesce("ra", "ga") != F.coalesce("rb", "gb"))
        wanted = stage(wanted.select("a", "b", "ga", "gb"), "wanted")
        new = agreeing(wanted, sets, percent).join(wanted, ["a", "b"]).select(F.col("ga").alias("a"), F.col("gb").alias("b"))
        edges = stage(new if edges is None else edges.union(new), "links")
    roots = connected(edges)
    now = crowd.join(roots.withColumnRenamed("node", "g"), "g", "left").select("id", "band", F.coalesce("root", "g").alias("g"))
    mixed = now.groupBy("band").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("band")
    apart = stage(now.join(mixed, "band").select("id", "g").distinct(), "still-apart")
    if apart.isEmpty():
        return edges
    found = stage(screen(apart_pairs(sets.join(apart, "id"), percent)), "apart-pairs")
    new = agreeing(found, sets, percent)
    ends = lambda c, out: apart.select(F.col("id").alias(c), F.col("g").alias(out))
    new = new.join(ends("a", "ga"), "a").join(ends("b", "gb"), "b").select(F.col("ga").alias("a"), F.col("gb").alias("b"))
    return stage(edges.union(new), "links")
