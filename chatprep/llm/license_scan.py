"""Licence scans by diagonal voting.

The rolling k-word hashes of every text are joined to the positions of the same hash in the
licence templates. A hit votes for the diagonal (place in the text minus place in the template);
votes are summed by diagonal, neighbouring diagonals (words put in or left out) are merged into
spans, and a span is verified by the share of the template's grams whose words it really holds,
and by its length. Built-in column functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from chatprep.llm.common import Scratch, alnum_words, skew_join

#: Words of a gram.
GRAM = 3
#: Diagonals at most this far apart belong to one span.
BAND = 4
#: Least share of a long template's grams that a span must hold, and most words per template word.
MIN_COVER = 0.6
MAX_STRETCH = 1.5
#: Templates of at most this many grams are exact phrases: all grams on one diagonal.
PHRASE_GRAMS = 6
#: Above so many distinct template grams, the text side is not reduced by the list of hashes.
MAX_LISTED = 20_000


@dataclass(frozen=True)
class Template:
    """``base`` marks the fixed phrases; ``text`` needs at least GRAM words."""
    label: str
    text: str
    base: bool = False


# The base phrases and their labels.
BASE_TEMPLATES = [
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
]

# Phrases and opening passages of well-known public licence texts.
MORE_TEMPLATES = [
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
                    "and associated documentation files (the \"Software\"), to deal in the Software without "
                    "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
                    "distribute, sublicense, and/or sell copies of the Software"),
    Template("mit", "SPDX License Identifier MIT"),
    Template("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of "
                         "the License at http://www.apache.org/licenses/LICENSE-2.0"),
    Template("apache-2", "SPDX License Identifier Apache 2.0"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met"),
    Template("gpl", "GNU General Public License"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                    "GNU General Public License as published by the Free Software Foundation"),
    Template("lgpl", "GNU Lesser General Public License"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
                    "without fee is hereby granted"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("cc-by-nc", "Creative Commons Attribution NonCommercial"),
    Template("cc-by-sa", "Creative Commons Attribution ShareAlike"),
    Template("all-rights-reserved", "all rights reserved"),
]


def template_grams(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """(h, tpl, label, base, tpos, n_grams, w1, w2, w3): one row per gram of each template."""
    raw = spark.createDataFrame([(i, t.label, t.base, t.text) for i, t in enumerate(templates)],
                                "tpl int, label string, base boolean, text string")
    words = raw.withColumn("_w", alnum_words(F.col("text")))
    return _with_grams(words).select(
        "g.h", "tpl", "label", "base", F.col("g.pos").alias("tpos"), (F.size("_w") - (GRAM - 1)).alias("n_grams"),
        F.col("g.w1").alias("t1"), F.col("g.w2").alias("t2"), F.col("g.w3").alias("t3"))


def _gram_array(words, only: list[int] | None = None):
    at = lambda i: F.get(words, i)
    starts = F.sequence(F.lit(0), F.size(words) - GRAM)
    if only is not None:
        starts = F.filter(starts, lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)).isin(only))
    grams = F.transform(starts, lambda i: F.struct(
        F.xxhash64(at(i), at(i + 1), at(i + 2)).alias("h"), i.alias("pos"),
        at(i).alias("w1"), at(i + 1).alias("w2"), at(i + 2).alias("w3")))
    return F.when(F.size(words) >= GRAM, grams)


def _with_grams(df: DataFrame) -> DataFrame:
    return df.withColumn("g", F.explode(_gram_array(F.col("_w"))))


def spans(docs: DataFrame, scratch: Scratch, templates: list[Template], text: str = "text",
          keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """(texts, spans). texts: rid, ``keep``, n_words, one row per row of ``docs``. spans: rid,
    label, base, first, last (words from 0), cover (share of the template's grams), exact.

    ``rid`` numbers the rows, so repeated rows are scanned each on their own. Only grams whose
    hash is a template's leave the scan (the templates are a fixed list), with their words, so
    that a hit is verified by words and not by its hash.
    """
    spark = docs.sparkSession
    grams = template_grams(spark, templates)
    listed = [r[0] for r in grams.select("h").distinct().limit(MAX_LISTED + 1).collect()]
    only = listed if len(listed) <= MAX_LISTED else None
    rows = (docs.select(*keep, F.col(text).alias("_text")).withColumn("_w", alnum_words(F.col("_text")))
            .select(F.monotonically_increasing_id().alias("rid"), *keep, F.size("_w").cast("long").alias("n_words"),
                    _gram_array(F.col("_w"), only).alias("grams")))
    rows = scratch.table(rows, "texts")
    hits = skew_join(rows.select("rid", F.explode("grams").alias("g")).select("rid", "g.*"), grams, "h", F.col("rid"))
    hits = hits.filter((F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2")) & (F.col("w3") == F.col("t3")))
    # votes by diagonal; a diagonal that a template crosses more than once is cut into its occurrences
    voted = (hits.withColumn("diag", F.col("pos") - F.col("tpos"))
             .groupBy("rid", "tpl", "label", "base", "n_grams", "diag")
             .agg(F.count(F.lit(1)).alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"),
                  F.collect_list("tpos").alias("tposs")))
    by_tpl = W.partitionBy("rid", "tpl").orderBy("diag")
    near = F.coalesce(F.col("diag") - F.lag("diag").over(by_tpl) <= BAND, F.lit(False)) & ~F.col("phrase")
    merged = (voted.withColumn("phrase", F.col("n_grams") <= PHRASE_GRAMS)
              .withColumn("new", F.when(near, 0).otherwise(1))
              .withColumn("span", F.sum("new").over(by_tpl))
              .groupBy("rid", "tpl", "label", "base", "n_grams", "phrase", "span")
              .agg(F.min("lo").alias("first"), (F.max("hi") + GRAM - 1).cast("long").alias("last"),
                   F.size(F.array_distinct(F.flatten(F.collect_list("tposs")))).alias("held")))
    cover = F.col("held") / F.col("n_grams")
    length = F.col("last") - F.col("first") + 1
    good = F.when(F.col("phrase"), F.col("held") == F.col("n_grams")).otherwise(
        (cover >= MIN_COVER) & (length <= MAX_STRETCH * (F.col("n_grams") + GRAM - 1)))
    found = merged.filter(good).select("rid", "label", "base", F.col("first").cast("long").alias("first"), "last",
                                       cover.alias("cover"))
    return rows.drop("grams"), found


def scan(docs: DataFrame, scratch: Scratch, templates: list[Template] | None = None, text: str = "text",
         keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: ``keep``, n_words, n_base, first_word, last_word,
    base_labels, labels, score (the best cover of a span, 0 if there is none).

    Null and empty texts have no words and no labels; repeated rows get the same values each;
    an empty table gives an empty one.
    """
    rows, found = spans(docs, scratch, templates or BASE_TEMPLATES + MORE_TEMPLATES, text, keep)
    base = F.col("base")
    joined = lambda c: F.array_join(F.sort_array(c), ",")
    per = found.groupBy("rid").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        joined(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        joined(F.collect_set("label")).alias("labels"), F.max("cover").alias("score"))
    return (rows.join(per, "rid", "left").drop("rid")
            .withColumn("n_base", F.coalesce("n_base", F.lit(0).cast("long")))
            .withColumn("base_labels", F.coalesce("base_labels", F.lit("")))
            .withColumn("labels", F.coalesce("labels", F.lit("")))
            .withColumn("score", F.coalesce("score", F.lit(0.0))))
