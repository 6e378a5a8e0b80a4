"""Quality rules with thresholds that follow the data.

Each document is measured in whole numbers. Histograms of the measures per language and source are the sketches: counts add up, so
sketches of parts, and of all sources of a language, merge by summing. A threshold lies a tolerance and a multiple of
the lower half's spread above the median; documents above it are rejected, besides those that fail the base rules.

A group's threshold is drawn to its language's, and that to the threshold of all, as if each group had ``PRIOR`` more documents there: few
documents move it little, many decide it, and no size switches from one rule to another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pitgrid.functions.staging import stage
from pitgrid.llm.common import free_names, shingle_hashes, words_of

#: measure -> tolerance above the median: per mille of characters, words and lines; tenths of a character
MEASURES = {"symbols": 60, "capitals": 200, "repeated_lines": 400, "word_length": 15}
SPREAD = 4
#: documents by whose weight a threshold is drawn to that of the level above
PRIOR = 100
#: leading bits that a bucket keeps of a value: smaller ones are exact, others off by less than 1 / 2 ** (BITS - 1)
BITS = 8


def measured(docs: DataFrame, text_col: str = "text", prefix: str = "_q_") -> DataFrame:
    """``docs`` and its counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the measures.

    New columns carry ``prefix``. Null and blank texts have no words and all counts 0. A 5-word window is compared by a 64-bit hash within its own text.
    """
    p = lambda c: f"{prefix}{c}"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.withColumn(p("w"), words_of(text))
    d = d.withColumn(p("n_words"), F.size(p("w")).cast("long")).withColumn(p("word_chars"), F.char_length(F.array_join(p("w"), "")).cast("long"))
    d = d.withColumn(p("n_symbols"), (F.char_length(text) - F.char_length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long"))
    d = d.withColumn(p("lines"), F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != ""))
    d = d.withColumn(p("n_lines"), F.size(p("lines"))).withColumn(p("n_dup_lines"), (F.col(p("n_lines")) - F.size(F.array_distinct(p("lines")))).cast("long"))
    d = d.withColumn(p("capitals"), F.size(F.filter(p("w"), lambda w: (w == F.upper(w)) & (w != F.lower(w)))))
    # windows found twice or more: neighbours in the order of their hashes are equal
    d = d.withColumn(p("h"), F.when(F.col(p("n_words")) >= 5, shingle_hashes(p("w"), 5)).otherwise(F.expr("cast(array() as array<bigint>)")))
    sorted_ = F.array_sort(F.transform(p("h"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct(p("h"))) < F.size(p("h"))
    d = d.withColumn(p("s"), F.when(some, sorted_))
    same = lambda x, j: F.coalesce(F.get(F.col(p("s")), j)["h"] == x["h"], F.lit(False))
    twice = F.filter(F.transform(p("s"), lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"])), lambda i: i.isNotNull())
    d = d.withColumn(p("at"), F.array_sort(twice))
    # each window adds the words up to the next one, five at most
    adds = F.transform(p("at"), lambda a, j: F.least(F.lit(5), F.coalesce(F.get(F.col(p("at")), j + 1) - a, F.lit(5))))
    d = d.withColumn(p("n_repeat_words"), F.coalesce(F.aggregate(adds, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long"))
    d = d.withColumn(p("base_failed"), (F.col(p("n_words")) < 10) | (100 * F.col(p("n_repeat_words")) > 20 * F.col(p("n_words"))))
    ratio = lambda a, b, m: F.when(F.col(p(b)) > 0, F.expr(f"{m} * `{p(a)}` div `{p(b)}`")).otherwise(0).cast("long")
    d = d.withColumn(p("m_symbols"), ratio("n_symbols", "word_chars", 1000)).withColumn(p("m_capitals"), ratio("capitals", "n_words", 1000))
    d = d.withColumn(p("m_repeated_lines"), ratio("n_dup_lines", "n_lines", 1000)).withColumn(p("m_word_length"), ratio("word_chars", "n_words", 10))
    return d.drop(*[p(c) for c in ("w", "lines", "n_lines", "capitals", "h", "s", "at")])


def bucket(v: Column) -> Column:
    """Lower bound of a value's bucket: the value with all but its first ``BITS`` bits cleared."""
    cut = F.length(F.bin(v)) - BITS
    return F.when(v < 1 << BITS, v).otherwise(F.call_function("shiftleft", F.call_function("shiftright", v, cut), cut)).cast("long")


def sketches(rows: DataFrame, prefix: str = "_q_") -> DataFrame:
    """(lang, source, measure, bucket, n): one histogram per language, source and measure, over documents with ten words or more."""
    each = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(f"{prefix}m_{m}")).alias("bucket")) for m in MEASURES])
    long = rows.where(F.col(f"{prefix}n_words") >= 10).select("lang", "source", F.explode(each).alias("x")).select("lang", "source", "x.measure", "x.bucket")
    return long.groupBy("lang", "source", "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def thresholds(parts: DataFrame) -> DataFrame:
    """(lang, source, t_<measure>...) per group, each threshold drawn to those of its language and of all.

    Quantiles are the smallest bucket whose running count reaches the share; all arithmetic is on whole numbers.
    """
    levels = [parts.select(F.lit(0).alias("level"), "lang", "source", "measure", "bucket", "n")]
    by_lang = parts.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    levels.append(by_lang.select(F.lit(1).alias("level"), "lang", F.lit(None).cast("string").alias("source"), "measure", "bucket", "n"))
    of_all = by_lang.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    levels.append(of_all.select(F.lit(2).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "measure", "bucket", "n"))
    all_ = levels[0].unionByName(levels[1]).unionByName(levels[2])
    key = ["level", "lang", "source", "measure"]
    up = F.sum("n").over(W.partitionBy(*key).orderBy("bucket"))
    whole = F.sum("n").over(W.partitionBy(*key))
    ranked = all_.withColumn("up", up).withColumn("docs", whole)
    at = lambda q: F.min(F.when(F.col("up") * 100 >= F.col("docs") * q, F.col("bucket")))
    found = ranked.groupBy(*key).agg(F.max("docs").alias("docs"), at(50).alias("q50"), at(10).alias("q10"))
    slack = F.element_at(F.create_map(*[F.lit(x) for kv in MEASURES.items() for x in kv]), F.col("measure"))
    found = found.withColumn("t", F.col("q50") + SPREAD * (F.col("q50") - F.col("q10")) + slack)
    own = found.where("level = 0").select("lang", "source", "measure", "docs", "t")
    one = found.where("level = 1").select(F.col("lang").alias("_l"), F.col("measure").alias("_m"), F.col("docs").alias("_dl"), F.col("t").alias("_tl"))
    top = found.where("level = 2").select(F.col("measure").alias("_n"), F.col("t").alias("_ta"))
    own = own.join(one, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("measure") == F.col("_m"))).join(top, F.col("measure") == F.col("_n"))
    drawn = own.withColumn("_tl", F.expr(f"(_dl * _tl + {PRIOR} * _ta) div (_dl + {PRIOR})"))
    drawn = drawn.withColumn("t", F.expr(f"(docs * t + {PRIOR} * _tl) div (docs + {PRIOR})"))
    return drawn.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, F.col("t"))).alias(f"t_{m}") for m in MEASURES])


def judged(rows: DataFrame, bounds: DataFrame, prefix: str = "_q_") -> DataFrame:
    """Measured ``rows`` with ``<prefix>kept``; null languages and sources are groups of their own.

    A document whose group has no document of ten words or more fails the base rules anyway.
    """
    # written first: its size is then known, and a small table is joined without a shuffle of the rows
    groups = stage(bounds.select(F.col("lang").alias("_l0"), F.col("source").alias("_s0"), F.struct(*[f"t_{m}" for m in MEASURES]).alias("_b")), "thresholds")
    out = rows.join(groups, F.col("lang").eqNullSafe(F.col("_l0")) & F.col("source").eqNullSafe(F.col("_s0")), "left")
    fits = F.lit(True)
    for m in MEASURES:
        fits = fits & F.coalesce(bucket(F.col(f"{prefix}m_{m}")) <= F.col(f"_b.t_{m}"), F.lit(True))
    return out.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & fits).drop("_l0", "_s0", "_b")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with its columns, whatever their names.

    Null, empty and blank texts have no words and go; repeated rows pass or go together; the thresholds are the same in any order of rows, and an empty table
    gives an empty result. Each text is measured once; what is written are the counts. The verdicts find their rows by doc_id, language, source and
    a hash of the text, which costs one shuffle of the texts and no copy of them.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    (name,) = free_names(docs, "row_key")
    key = F.concat_ws("\x01", text("doc_id"), text("lang"), text("source"), F.xxhash64(text("text"))).alias(name)
    rows = stage(measured(docs.select("lang", "source", "text", key)).drop("text"), "measured")
    kept = judged(rows, thresholds(sketches(rows))).where("_q_kept").select(name)
    return docs.select("*", key).hint("merge").join(kept, name, "left_semi").drop(name)
