"""Index roster reconstruction from a seed list and dated add / remove events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pitgrid.functions.groups import latest

PUBLIC_PREFIX = "PUBLICSP500:"

# Share classes and renamed tickers that belong to one company.
SHARE_CLASS_GROUPS = {
    "BRK.A": "BRK.B", "BRK.B": "BRK.B", "BK": "BNY", "BNY": "BNY", "BALL": "BALL", "BLL": "BALL",
    "DISCA": "DISCA", "DISCK": "DISCA", "EQR": "VMRK", "VMRK": "VMRK", "FOX": "FOXA", "FOXA": "FOXA",
    "GOOG": "GOOGL", "GOOGL": "GOOGL", "NWS": "NWSA", "NWSA": "NWSA", "PARA": "PSKY", "PSKY": "PSKY",
    "VIAC": "PSKY", "GEN": "GEN", "SYMC": "GEN", "MMC": "MRSH", "MRSH": "MRSH", "UA": "UAA", "UAA": "UAA",
    "WLTW": "WTW", "WTW": "WTW",
}
ROSTER_BAND = (490, 505)


def share_class_table(spark) -> DataFrame:
    """The fixed share-class groups as rows (ticker, canonical)."""
    pairs = F.map_from_arrays(
        F.array(*[F.lit(k) for k in SHARE_CLASS_GROUPS]), F.array(*[F.lit(v) for v in SHARE_CLASS_GROUPS.values()])
    )
    return spark.range(1).select(F.explode(pairs).alias("ticker", "canonical"))


def company_of_ticker(tickers: DataFrame, company_map: DataFrame, classes: DataFrame) -> DataFrame:
    """P14, key part: ticker to canonical ticker and company (of the canonical, else its own, else of any ticker of the group, else public id)."""
    m = company_map.select(F.col("ticker").alias("_t"), F.col("company_id").alias("_c"))
    t = tickers.select("ticker").distinct().join(classes, "ticker", "left").withColumn("canonical", F.coalesce("canonical", "ticker"))
    t = t.join(m.select(F.col("_t").alias("canonical"), F.col("_c").alias("_canon_id")), "canonical", "left")
    t = t.join(m.select(F.col("_t").alias("ticker"), F.col("_c").alias("_own_id")), "ticker", "left")
    group = classes.join(m.select(F.col("_t").alias("ticker"), "_c"), "ticker").groupBy("canonical").agg(F.min("_c").alias("_group_id"))
    t = t.join(group, "canonical", "left")
    return t.select(
        "ticker", "canonical",
        F.coalesce("_canon_id", "_own_id", "_group_id", F.concat(F.lit(PUBLIC_PREFIX), "canonical")).alias("company_id"),
    )


def representative(active_ticker: Column, canonical: Column) -> Column:
    """Aggregate: smallest active canonical ticker, else smallest active ticker."""
    return F.coalesce(F.min(F.when(active_ticker == canonical, active_ticker)), F.min(active_ticker))


def collapse_share_classes(roster: DataFrame, company_map: DataFrame, classes: DataFrame) -> DataFrame:
    """One representative ticker per company of a roster."""
    return company_of_ticker(roster, company_map, classes).groupBy("company_id").agg(
        representative(F.col("ticker"), F.col("canonical")).alias("ticker"), F.count(F.lit(1)).alias("n_classes")
    )


def event_states(seed: DataFrame, events: DataFrame) -> DataFrame:
    """One row per ticker, day and action with the roster state just before it.

    Removals come before additions on the same day, and an event sets the state by itself,
    so the state before an event is the action of the ticker's previous one (or the seed).
    """
    e = events.groupBy("ticker", "day", "action").agg(F.count(F.lit(1)).alias("n_events"))
    e = e.join(seed.select("ticker").distinct().withColumn("_seed", F.lit(True)), "ticker", "left")
    w = W.partitionBy("ticker").orderBy("day", F.when(F.col("action") == "removed", 0).otherwise(1))
    before = F.coalesce(F.lag(F.col("action") == "added").over(w), F.col("_seed"), F.lit(False))
    return e.withColumn("present_before", before).drop("_seed")


def membership_noops(seed: DataFrame, events: DataFrame) -> DataFrame:
    """Removals of an absent or additions of a present ticker; repeats within a day count too."""
    noop = F.col("present_before") == (F.col("action") == "added")
    n = F.when(noop, F.col("n_events")).otherwise(F.col("n_events") - 1)
    return event_states(seed, events).withColumn("n_noops", n).where(F.col("n_noops") > 0).select("ticker", "day", "action", "n_noops")


def ticker_spells(seed: DataFrame, events: DataFrame, seed_date: Column) -> DataFrame:
    """Roster spells per ticker: [spell_from, spell_to), spell_to NULL while still present."""
    last_of_day = F.max(F.col("action") == "added").alias("present")
    changes = events.groupBy("ticker", "day").agg(last_of_day)
    start = seed.select("ticker").distinct().select("ticker", seed_date.alias("day"), F.lit(True).alias("present"), F.lit(0).alias("_o"))
    timeline = start.unionByName(changes.withColumn("_o", F.lit(1)))
    w = W.partitionBy("ticker").orderBy("day", "_o")
    timeline = timeline.withColumn("_prev", F.coalesce(F.lag("present").over(w), F.lit(False)))
    flips = timeline.where(F.col("present") != F.col("_prev"))
    flips = flips.withColumn("spell_to", F.lead("day").over(w))
    return flips.where("present").where(F.col("spell_to").isNull() | (F.col("spell_to") > F.col("day"))).select(
        "ticker", F.col("day").alias("spell_from"), "spell_to"
    )


def membership_intervals(seed: DataFrame, events: DataFrame, seed_date: Column, company_map: DataFrame, classes: DataFrame) -> DataFrame:
    """Closed membership intervals per company; a change of representative starts a new one.

    One pass over the starts and ends of a company's spells (those of its share classes), in order of days.
    """
    spells = ticker_spells(seed, events, seed_date)
    ident = company_of_ticker(spells, company_map, classes)
    spells = spells.join(ident, "ticker")
    # starts and ends in the order of days; the set of open tickers is carried along, a canonical ticker before others
    name = F.struct((F.col("ticker") != F.coalesce("canonical", F.lit(""))).alias("other"), "ticker").alias("name")
    moves = spells.select("company_id", name, F.explode(F.array(
        F.struct(F.col("spell_from").alias("day"), F.lit(True).alias("opens")), F.struct(F.col("spell_to").alias("day"), F.lit(False).alias("opens")))).alias("m"))
    moves = moves.where("m.day IS NOT NULL").groupBy("company_id", F.col("m.day").alias("day")).agg(
        F.collect_set(F.when(F.col("m.opens"), F.col("name"))).alias("opened"), F.collect_set(F.when(~F.col("m.opens"), F.col("name"))).alias("closed"))
    line = moves.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("day", "opened", "closed"))).alias("line"))
    empty = F.struct(F.expr("cast(array() as array<struct<other: boolean, ticker: string>>)").alias("open"), F.expr("cast(array() as array<struct<day: date, ticker: string>>)").alias("out"))

    def step(s: Column, x: Column) -> Column:
        now = F.array_union(F.array_except(s["open"], x["closed"]), x["opened"])
        return F.struct(now.alias("open"), F.concat(s["out"], F.array(F.struct(x["day"].alias("day"), F.array_min(now)["ticker"].alias("ticker")))).alias("out"))

    states = line.select("company_id", F.inline(F.aggregate("line", empty, step)["out"]))
    w = W.partitionBy("company_id").orderBy("day")
    changed = states.withColumn("_prev", F.lag("ticker").over(w)).where(~F.col("ticker").eqNullSafe(F.col("_prev")))
    out = changed.withColumn("member_to", F.date_sub(F.lead("day").over(w), 1)).where(F.col("ticker").isNotNull())
    return out.select("company_id", "ticker", F.col("day").alias("member_from"), "member_to")


def roster_reconcile(seed: DataFrame, events: DataFrame, seed_date: Column, published: DataFrame) -> DataFrame:
    """Tickers on only one of the rebuilt final roster and the published roster."""
    final = ticker_spells(seed, events, seed_date).where("spell_to IS NULL").select("ticker", F.lit(True).alias("in_rebuilt")).distinct()
    pub = published.select("ticker", F.lit(True).alias("in_published")).distinct()
    both = final.join(pub, "ticker", "full_outer")
    return both.where(F.col("in_rebuilt").isNull() | F.col("in_published").isNull()).select(
        "ticker", F.coalesce("in_rebuilt", F.lit(False)).alias("in_rebuilt"), F.coalesce("in_published", F.lit(False)).alias("in_published")
    )


def roster_band(seed: DataFrame, events: DataFrame, seed_date: Column, band: tuple[int, int] = ROSTER_BAND) -> DataFrame:
    """P16, size part: smallest and greatest roster size over time and whether both lie in the band.

    Daily net changes are summed first, so the running count sees one row per calendar day.
    """
    spells = ticker_spells(seed, events, seed_date)
    daily = (
        spells.select(F.col("spell_from").alias("day"), F.lit(1).alias("d"))
        .unionByName(spells.where("spell_to IS NOT NULL").select(F.col("spell_to").alias("day"), F.lit(-1).alias("d")))
        .groupBy("day").agg(F.sum("d").alias("d"))
    )
    w = W.partitionBy(F.lit(1)).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    sizes = daily.withColumn("size", F.sum("d").over(w))
    return sizes.agg(F.min("size").alias("min_size"), F.max("size").alias("max_size")).withColumn(
        "in_band", (F.col("min_size") >= band[0]) & (F.col("max_size") <= band[1])
    )


def ticker_company_map(*tables: DataFrame) -> DataFrame:
    """First table that knows a ticker gives its company; smallest company id inside a table."""
    out = None
    for i, t in enumerate(tables):
        one = t.groupBy(F.upper(F.trim("ticker")).alias("ticker")).agg(F.min("company_id").alias("company_id"))
        one = one.where(F.col("ticker") != "").withColumn("_p", F.lit(-i))
        out = one if out is None else out.unionByName(one)
    return latest(out, ["ticker"], ["_p"], ["ticker", "company_id"])
