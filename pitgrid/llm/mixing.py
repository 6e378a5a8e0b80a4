"""Mixing sources to target weights: a low-discrepancy schedule of equal-token blocks.

Slot i of the mix sits at the point frac(i x golden ratio) of the unit interval; laid over the cumulative
target weights, the point names the source of that slot. The points fill the interval evenly, so
any stretch of the mix holds the sources in their proportions. The r-th slot of a source takes
the r-th block of its token line: its documents in a seeded shuffle, end to end, again and again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pitgrid.functions.staging import stage
from pitgrid.llm.common import words_of

#: 2^32 / golden ratio, odd (fixed value): multiples modulo 2^32 are the golden-ratio points.
GOLDEN = 2_654_435_769
GRID = 1 << 32
CHUNK = 4096
CELL = 20  # 2^12 cells of the unit interval
#: weights of the sources in code point order, repeating (fixed by the contract)
WEIGHTS = (3, 1, 2)


def size_of(text: Column) -> Column:
    """Words of a text; null: 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t-\\r]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), limit: int = 2) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    The sources, by code point and null last, weigh ``weights``, repeating; they share ``share`` (a fraction) of all
    sizes. No target exceeds ``limit`` times its source's size; the excess goes to the others by weight.
    A source is at its limit exactly if limit x size / weight lies below the final water level, so
    sources are ordered by that ratio and the level is read off running sums: no iteration.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    which = (F.row_number().over(order) - 1) % len(weights)
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (which + 1).cast("int")).cast("double"))
    cap = F.col("source_size").cast("double") * limit
    fill = W.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    whole = W.partitionBy()
    by = by.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(whole) * share[0] / share[1]
    by = by.withColumn("level", (total - before) / weight_left)
    # the level of the first source below its limit holds for all after it
    by = by.withColumn("rank", F.row_number().over(fill))
    final = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("rank", "level"))).over(whole)
    by = by.withColumn("final", final["level"])
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("final")))
    return by.select("source", "source_size", target.alias("target"))


def _before(totals: DataFrame, key: str, part: str, amount: str, out: str) -> DataFrame:
    """Sum of ``amount`` over the lower parts of a key; one row per part, so small."""
    w = W.partitionBy(key).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    return totals.select(key, part, F.coalesce(F.sum(amount).over(w), F.lit(0)).cast("long").alias(out))


def schedule(goals: DataFrame, block: int) -> DataFrame:
    """(slot, source_no, block_no) for all slots, from the staged rows of (source_no, lo, hi, slots).

    Ranks of slots within a source come in two steps, per chunk of slots and inside a chunk, so a
    source with most of the slots is not ranked in one task.
    """
    spark = goals.sparkSession
    slots = int(goals.agg(F.max("slots")).first()[0] or 0)
    line = spark.range(slots).select(F.col("id").alias("slot"), (F.col("id") * GOLDEN % GRID).alias("point"), F.floor(F.col("id") / CHUNK).alias("chunk"))
    # an interval is listed under every cell of the unit interval that it touches: an equi join finds the source of a point
    cells = goals.where("hi > lo").select("source_no", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", CELL), F.shiftright(F.col("hi") - 1, CELL))).alias("cell"))
    named = line.withColumn("cell", F.shiftright("point", CELL)).join(cells, "cell").where("point >= lo AND point < hi")
    counts = named.groupBy("source_no", "chunk").agg(F.count(F.lit(1)).alias("n"))
    inside = F.row_number().over(W.partitionBy("source_no", "chunk").orderBy("slot")) - 1
    ranked = named.select("slot", "source_no", "chunk", inside.alias("inside"))
    return ranked.join(_before(counts, "source_no", "chunk", "n", "before"), ["source_no", "chunk"]).select(
        "slot", "source_no", (F.col("before") + F.col("inside")).alias("block_no"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 4096, seed: int = 17,
        weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), limit: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, goals, pieces) of the mix.

    rows: row_key, doc_id, tie (hash of the text), source_no, size, start (place on its source's token line).
    goals: source, source_no, source_size, target, slots and the source's interval lo..hi of the schedule.
    pieces: slot, source_no, row_key, pass, first, words - the words a slot takes of a document.

    ``block`` is the wished number of words of a slot; a source with n slots has blocks of target / n words,
    which differs from it by less than one part in its number of slots, so a source takes its target and not a rounded number of blocks.
    A source whose target is too small for a slot of its own gets its words in one extra slot at the end.
    Null texts have size 0 and are never taken; null sources are a source of their own, the last. Rows with equal doc_id are
    documents of their own, shuffled by doc_id and text. An empty table, or one without words, gives no pieces.
    """
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 256)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col)).alias("size"),
                       key.alias("key"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"))
    rows = stage(rows, "sizes")
    goals = targets(rows, weights, share, limit)
    number = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    goals = goals.withColumn("source_no", number).withColumn("slots", F.ceil(F.sum("target").over(W.partitionBy()) / block).cast("long"))
    up = F.sum("target").over(W.orderBy("source_no").rowsBetween(W.unboundedPreceding, 0))
    whole = F.sum("target").over(W.partitionBy())
    # rounded bounds: the end of one interval is the start of the next, the last one ends at the grid's end
    hi = F.when(F.col("source_no") == F.max("source_no").over(W.partitionBy()), F.lit(GRID)).otherwise(F.floor(up / whole * GRID))
    goals = goals.withColumn("hi", F.when(whole > 0, hi).otherwise(0).cast("long"))
    goals = stage(goals.withColumn("lo", F.lag("hi", 1, 0).over(W.orderBy("source_no"))), "goals")

    # place of each document on its source's line: per bucket of the shuffle, then inside it
    named = rows.join(goals.select("source", "source_no"), rows["source"].eqNullSafe(goals["source"])).drop("source")
    named = named.withColumn("bucket", F.substring("key", 1, 3))
    totals = named.groupBy("source_no", "bucket").agg(F.sum("size").alias("n"))
    inside = W.partitionBy("source_no", "bucket").orderBy("key", "tie", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = named.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn(
        "row_no", F.row_number().over(W.partitionBy("source_no", "bucket").orderBy("key", "tie", "size")))
    placed = placed.join(_before(totals, "source_no", "bucket", "n", "before"), ["source_no", "bucket"]).select(
        F.concat_ws(":", "source_no", "bucket", "row_no").alias("row_key"), "doc_id", "tie", "source_no", "size", (F.col("before") + F.col("inside")).alias("start"))
    placed = stage(placed, "places")

    slots = schedule(goals, block)
    per = slots.groupBy("source_no").agg(F.count(F.lit(1)).alias("blocks"))
    # width of a source's blocks: its rounded target split evenly; block j covers floor(j T / n) .. floor((j + 1) T / n)
    width = goals.join(per, "source_no", "left").select(
        "source_no", "source_size", F.round("target").cast("long").alias("goal"), F.coalesce("blocks", F.lit(1)).cast("long").alias("blocks"),
        F.col("blocks").isNull().alias("extra"), "slots")
    width = stage(width.where("goal > 0 AND source_size > 0"), "widths")
    edge = lambda j: F.expr(f"cast(floor(cast({j} as decimal(38,0)) * goal / blocks) as bigint)")
    extra = width.where("extra").select(F.col("slots").alias("slot"), "source_no", F.lit(0).cast("long").alias("block_no"))
    blocks = slots.unionByName(extra).join(width, "source_no").select("slot", "source_no", "block_no", edge("block_no").alias("b0"), edge("(block_no + 1)").alias("b1"))

    # a document lies once on the line per pass; it meets the blocks that its interval touches
    passes = F.expr("sequence(0L, cast(ceil(goal / source_size) as bigint) - 1)")
    laid = placed.where("size > 0").join(width.drop("extra", "slots"), "source_no").withColumn("pass", F.explode(passes))
    laid = laid.withColumn("d0", F.col("pass") * F.col("source_size") + F.col("start")).where("d0 < goal")
    laid = laid.withColumn("d1", F.least(F.col("d0") + F.col("size"), F.col("goal")))
    # estimate of the first and last block, one to the safe side; the overlap below is exact
    first = F.expr("greatest(0L, cast(floor(cast(d0 as decimal(38,0)) * blocks / goal) as bigint) - 1)")
    last = F.expr("least(blocks - 1, cast(floor(cast(d1 as decimal(38,0)) * blocks / goal) as bigint) + 1)")
    touched = laid.select("row_key", "doc_id", "source_no", "pass", "d0", "d1", F.explode(F.sequence(first, last)).alias("block_no"))
    met = touched.join(blocks, ["source_no", "block_no"])
    begin, end = F.greatest("d0", "b0"), F.least("d1", "b1")
    pieces = met.where(end > begin).select("slot", "source_no", "row_key", "pass", (begin - F.col("d0")).alias("first"), (end - begin).alias("words"))
    return placed, goals, pieces


def taken(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row of ``docs``: the words the mix takes of it."""
    placed, goals, pieces = mix(docs, **how)
    sums = pieces.groupBy("row_key").agg(F.sum("words").alias("taken"))
    return (
        placed.join(goals.select("source_no", "source_size", "target"), "source_no")
        .join(sums, "row_key", "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    )


def mixed_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length_col: str = "n_chars", **how) -> DataFrame:
    """``docs`` as the mix takes them: one row per document and pass, the text cut to the words taken in it.

    A document taken whole keeps its text as it is; a cut one is its first words joined by a space. Documents of which nothing is
    taken are left out. Columns are those of ``docs``; ``length_col``, where present, follows a cut text.
    Rows that repeat doc_id and text lie side by side on the token line, so they share few
    different cuts; each gets one of them.
    """
    placed, _, pieces = mix(docs, id_col=id_col, text_col=text_col, **how)
    by_pass = pieces.groupBy("row_key", "pass").agg(F.sum("words").alias("words"))
    cuts = by_pass.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("pass", "words"))).alias("cuts"))
    name = lambda i, t: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("null")), t)
    rows = placed.join(cuts, "row_key", "left").select(name(F.col("doc_id"), F.col("tie")).alias("_row"), "size", F.coalesce("cuts", F.expr("array()")).alias("cuts"))
    plans = rows.groupBy("_row", "size", "cuts").agg(F.count(F.lit(1)).alias("n")).groupBy("_row").agg(
        F.max("size").alias("_size"), F.sort_array(F.collect_list(F.struct("cuts", "n"))).alias("_plans"))
    own = docs.withColumn("_row", name(F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))))
    own = own.join(plans, "_row").withColumn("_n", F.row_number().over(W.partitionBy("_row").orderBy("_row")))
    # the plan whose running count reaches this row's number
    pick = F.aggregate("_plans", F.struct(F.lit(0).cast("long").alias("seen"), F.expr("cast(null as array<struct<pass:bigint,words:bigint>>)").alias("cuts")),
                       lambda s, p: F.struct((s["seen"] + p["n"]).alias("seen"), F.when(s["cuts"].isNull() & (s["seen"] + p["n"] >= F.col("_n")), p["cuts"]).otherwise(s["cuts"]).alias("cuts")))
    own = own.withColumn("_cut", F.explode(pick["cuts"])).withColumn("_whole", F.col("_cut.words") >= F.col("_size"))
    cut = F.array_join(F.slice(words_of(F.col(text_col)), F.lit(1), F.col("_cut.words").cast("int")), " ")
    own = own.withColumn("_text", F.when(F.col("_whole"), F.col(text_col)).otherwise(cut))
    new = {text_col: F.col("_text")}
    if length_col in docs.columns:
        new[length_col] = F.when(F.col("_whole"), F.col(length_col)).otherwise(F.char_length("_text")).cast(docs.schema[length_col].dataType)
    return own.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])
