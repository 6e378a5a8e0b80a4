"""License scan by diagonal voting.

Every rolling k-word hash of a text that occurs in a license template is joined to its template positions. Matches of one
copied passage share the difference of their positions, the diagonal; inserted or missing words move it a little, so
neighbouring diagonals are merged. A template is reported if the words of its verified
span cover enough of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from pitgrid.functions.staging import stage

# fixed values: phrases and their labels
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Public license notices (fixed texts).
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "this project is licensed under the terms of the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
            "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
            "copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
               "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software "
               "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
               "see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
            "either version 3 of the license or at your option any later version"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
            "see the gnu general public license for more details"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the bsd 3 clause license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
            "provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-case words; null: none. ``lower`` also folds letters beyond A-Z, which neither cuts nor joins words,
    and no phrase has a letter that another one folds to."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def template_grams(spark: SparkSession, templates=TEMPLATES, k: int = 3) -> DataFrame:
    """(template, label, template_words, gram, h, at): rolling k-grams of the templates; a bounded table."""
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, text string").coalesce(1)
    rows = rows.withColumn("words", words_of(F.col("text"))).withColumn("template_words", F.size("words"))
    rows = rows.select("template", "label", "template_words", "words", F.posexplode("words").alias("at", "first")).where(F.col("at") <= F.col("template_words") - k)
    gram = F.array_join(F.slice("words", F.col("at") + 1, F.lit(k)), " ")
    return rows.select("template", "label", "template_words", "at", gram.alias("gram"), F.xxhash64(*[F.get("words", F.col("at") + j) for j in range(k)]).alias("h"))


def matches(docs: DataFrame, grams: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """doc_id, tie, n_words, base_at, hits per row of ``docs``.

    tie is a hash of the text, base_at the starts and labels of the phrases, hits the positions, hashes and words of
    the rolling k-grams whose hash some template has. Every gram of every text is hashed; the test against
    the templates' hashes (a bounded set) only spares rows that the join could not match.
    """
    known = [r["h"] for r in grams.select("h").distinct().collect()]  # bounded by the templates
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tie"), words_of(text).alias("w"))

    def label_at(i: Column) -> Column:
        """Label of the phrase that starts at word i, or null."""
        out = F.lit(None).cast("string")
        for phrase, label in PHRASES:
            same = F.lit(True)
            for j, p in enumerate(phrase.split()):
                same = same & F.coalesce(F.get(F.col("w"), i + j) == p, F.lit(False))
            out = F.when(same, F.lit(label)).otherwise(out)
        return out

    places = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.struct(i.alias("at"), label_at(i).alias("label")))
    # every phrase ends with this word: other texts are not searched
    base_at = F.when(F.array_contains("w", "license"), F.filter(places, lambda x: x["label"].isNotNull())).otherwise(F.expr("cast(array() as array<struct<at:int,label:string>>)"))
    hashed = F.transform("w", lambda w, i: F.struct(i.alias("pos"), F.xxhash64(w, *[F.get(F.col("w"), i + j) for j in range(1, k)]).alias("h")))
    rows = rows.withColumn("hits", F.filter(hashed, lambda x: x["h"].isin(known) & (x["pos"] <= F.size("w") - k)))
    worded = F.transform("hits", lambda x: F.struct(x["pos"].alias("pos"), x["h"].alias("h"), F.array_join(F.slice(F.col("w"), x["pos"] + 1, F.lit(k)), " ").alias("gram")))
    return rows.select("doc_id", "tie", F.size("w").cast("long").alias("n_words"), base_at.alias("base_at"), worded.alias("hits"))


def spans(rows: DataFrame, grams: DataFrame, row_cols: list[str], k: int = 3, drift: int = 4, cover: float = 0.6) -> DataFrame:
    """Reported templates per row of ``row_cols``: template, label, first_word, last_word, score."""
    hits = rows.select(*row_cols, F.explode("hits").alias("x")).select(*row_cols, "x.pos", "x.h", "x.gram")
    # the join compares the words too, so a hash collision gives no vote
    met = hits.join(F.broadcast(grams), ["h", "gram"]).select(*row_cols, "template", "label", "template_words", "at", "pos", (F.col("pos") - F.col("at")).alias("diagonal"))
    key = [*row_cols, "template", "label", "template_words"]
    votes = met.groupBy(*key, "diagonal").agg(F.collect_set(F.struct("at", "pos")).alias("votes"))
    # merge diagonals that follow each other closely
    order = W.partitionBy(*key).orderBy("diagonal")
    start = F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= drift, 0).otherwise(1)
    runs = votes.withColumn("start", start).withColumn("run", F.sum("start").over(order))
    merged = runs.groupBy(*key, "run").agg(F.flatten(F.collect_list("votes")).alias("votes"))
    # verification: words of the template and of the span that matched grams cover
    grown = lambda c: F.array_distinct(F.flatten(F.transform(F.col(f"votes.{c}"), lambda p: F.sequence(p, p + (k - 1)))))
    merged = merged.withColumn("t_words", F.size(grown("at"))).withColumn("d_words", F.size(grown("pos")))
    merged = merged.withColumn("first_word", F.array_min("votes.pos").cast("long")).withColumn("last_word", (F.array_max("votes.pos") + (k - 1)).cast("long"))
    share, dense = F.col("t_words") / F.col("template_words"), F.col("d_words") / (F.col("last_word") - F.col("first_word") + 1)
    return merged.withColumn("score", share).where((share >= cover) & (dense >= cover)).select(*row_cols, "template", "label", "first_word", "last_word", "score")


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, k: int = 3, drift: int = 4, cover: float = 0.6) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, base_at, spans (array of template, label, first_word, last_word, score).

    Texts are read once; what is written and joined are positions only. Null and empty texts have no words, phrases or spans.
    Rows with equal doc_id and text have equal results; a null doc_id is an id like any other. Other columns are not read.
    """
    grams = template_grams(docs.sparkSession, templates, k)
    rows = stage(matches(docs, grams, id_col, text_col, k), "license-matches")
    voted = rows.where(F.size("hits") > 0).groupBy("doc_id", "tie").agg(F.first("hits").alias("hits"))  # equal rows once
    found = spans(voted, grams, ["doc_id", "tie"], k, drift, cover)
    by = found.groupBy(F.col("doc_id").alias("_d"), F.col("tie").alias("_t")).agg(F.sort_array(F.collect_list(F.struct("first_word", "last_word", "template", "label", "score"))).alias("spans"))
    return rows.drop("hits").join(by, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tie") == F.col("_t")), "left").select("doc_id", "n_words", "base_at", "spans")
