"""Licence notices in documents, paragraph by paragraph, with DataFrame and SQL functions only.

A multinomial logistic regression over word n-grams is trained on the notices below: whole, cut, and
inside other words, against sentences that only sound like one. Only n-grams with a word that licences are made of (`MARKS`) are
features and the penalty is an L1 one, so few weights remain; they are a small table that the n-grams of
marked paragraphs are joined with. A paragraph without a mark holds no feature and is none. Part of the
notices' variants is held back to set the probability below which a paragraph is `unknown`; a family
is confirmed if the paragraph holds `CONFIRM` of the n-grams of one of its notices, else it is `unknown` too.

Defined cases: null and empty texts have no paragraphs; a paragraph is a line; equal rows are scanned each;
ties go to the first family by name; extra columns are ignored."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIRM = 0.6
UNKNOWN = "unknown"
N_GRAMS = (1, 2, 3)
# Notices of licence families as they are published, and sentences that are none.
NOTICES = (
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("all-rights-reserved", "All rights reserved."),
    ("all-rights-reserved", "Proprietary and confidential. All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd", "Released under the BSD License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "Released into the public domain under CC0 1.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights; this work is dedicated to the public domain."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
)
OTHERS = (
    "The driver renewed his license last week.", "Her licence to teach was granted in May.", "The shop sells licensed toys and games.",
    "Permission to enter the building was refused.", "Copyright law is a wide field.", "He read about the apache people of the plains.",
    "The gnu is a large antelope.", "The committee will license new drivers.", "A warranty of two years is included.",
    "The domain is public and the park is free.", "Human rights are reserved for no one.", "They kept the matter confidential.",
    "The mozilla browser opened slowly.", "Creative people met in the commons.", "The redistribution of land took years.",
)
MARKS = (
    "licen", "copyright", "apache", "gnu", "bsd", "mozilla", "creative", "commons", "cc0", "cc", "reserved", "proprietary",
    "confidential", "permission", "redistribut", "public domain", "waived",
)
# A mark that many other words contain counts as a word of its own only.
_WHOLE = {"cc": "cc by"}


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9.]+|\\.(?![0-9])", " "), " "), lambda w: w != "")


def _n_grams(words: Column) -> Column:
    """The distinct n-grams that hold a mark."""
    def of(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1)))
        return F.coalesce(F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " ")), F.array().cast("array<string>"))

    return F.filter(F.array_distinct(F.concat(*(of(n) for n in N_GRAMS))), _marked)


def _marked(text: Column) -> Column:
    return reduce(or_, (text.contains(_WHOLE.get(m, m)) for m in MARKS))


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table as SQL literals."""
    names = [c.split()[0] for c in schema.split(", ")]
    literals = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(row, names, strict=True))) for row in rows))
    return spark.range(1).select(F.inline(literals))


def _variants(spark: SparkSession) -> DataFrame:
    """(family, grams, fold): training paragraphs."""
    notices = _table(spark, [(f, t) for f, t in NOTICES] + [(UNKNOWN, t) for t in OTHERS], "family string, text string")
    words = notices.select("family", _words(F.col("text")).alias("w"))
    size = F.size("w")
    # Whole; without the first or last words; with words around.
    cut = words.select("family", "w", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("a"), F.lit(0).alias("z")).union(
        words.select("family", "w", F.lit(0).alias("a"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("z")))
    cut = cut.filter(size - F.col("a") - F.col("z") >= F.greatest(F.lit(2), F.ceil(size * 0.7))).select(
        "family", F.slice("w", F.col("a") + 1, size - F.col("a") - F.col("z")).alias("w"))
    around = words.select("family", F.explode(F.array(*(F.concat(F.split(F.lit(x), " "), F.col("w"), F.split(F.lit(y), " ")) for x, y in (
        ("this text is", "see the file for details"), ("copyright 2020 the authors", "and others"),
        ("copyright c 2021 by", "etc"), ("note that", "as stated above"))))).alias("w"))
    made = cut.union(around).select("family", _n_grams(F.col("w")).alias("grams"))
    return made.withColumn("fold", F.pmod(F.xxhash64("family", "grams"), F.lit(5)))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, text): the lines of documents that hold a mark, with the number of each."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = kept.filter(_marked(F.lower("text"))).select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "text"))
    return lines.filter(_marked(F.lower("text")))


def licence_notices(docs: DataFrame, *, confirm: float = CONFIRM) -> DataFrame:
    """(doc_id, paragraph, family, probability, likeness, notice): one row for each paragraph with a mark; family `unknown`
    where the classifier is not sure or no notice of the family confirms it."""
    spark = docs.sparkSession
    names = sorted({f for f, _ in NOTICES} | {UNKNOWN})
    code = F.array_position(F.array(*(F.lit(n) for n in names)), F.col("family")).cast("double") - 1
    examples = _variants(spark).withColumn("label", code).coalesce(1).cache()
    train = examples.filter("fold > 0")
    counted = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2).fit(train)
    model = LogisticRegression(family="multinomial", regParam=1e-4, elasticNetParam=1.0, maxIter=60).fit(counted.transform(train))
    weights = model.coefficientMatrix.toArray()
    table = [(g, names[c], float(weights[c, i])) for i, g in enumerate(counted.vocabulary) for c in range(len(names)) if weights[c, i] != 0]
    bias = {n: float(b) for n, b in zip(names, model.interceptVector.toArray(), strict=True)}
    weighed = _table(spark, table, "gram string, family string, weight double").groupBy("gram").agg(
        F.map_from_entries(F.collect_list(F.struct("family", "weight"))).alias("adds"))

    def judged(rows: DataFrame, keys: list[str]) -> DataFrame:
        """`keys`, the most likely family and its probability, from rows with `grams`."""
        numbered = rows.withColumn("_row", F.monotonically_increasing_id())
        hits = numbered.select("_row", *keys, F.explode_outer("grams").alias("gram")).join(F.broadcast(weighed), "gram", "left")
        sums = hits.groupBy("_row", *keys).agg(*(F.sum(F.coalesce(F.col("adds")[n], F.lit(0.0))).alias(f"s_{i}") for i, n in enumerate(names)))
        logits = F.array(*(F.col(f"s_{i}") + F.lit(bias[n]) for i, n in enumerate(names)))
        top = F.array_max(logits)
        total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
        best = F.element_at(F.array(*(F.lit(n) for n in names)), F.array_position(logits, top).cast("int"))
        return sums.select(*keys, best.alias("family"), (1 / total).alias("probability"))

    # The threshold: between what the unknown reach in the held-back part and what notices have.
    aside = judged(examples.filter("fold = 0").withColumnRenamed("family", "truth"), ["truth"])
    wrong = F.max(F.when((F.col("truth") == UNKNOWN) & (F.col("family") != UNKNOWN), F.col("probability")))
    right = F.percentile(F.when(F.col("truth") == F.col("family"), F.col("probability")), F.lit(0.02))
    low, high = aside.agg(wrong, right).first()
    threshold = min(max(low or 0.0, 0.5), high or 0.5)
    notices = _table(spark, list(NOTICES), "family string, notice string").select(
        "family", "notice", _n_grams(_words(F.col("notice"))).alias("own"))
    by_family = F.map_from_entries(F.collect_list(F.struct("family", "list")))
    listed = notices.groupBy("family").agg(F.collect_list(F.struct("notice", "own")).alias("list")).agg(by_family.alias("notices"))

    scanned = paragraphs(docs).withColumn("grams", _n_grams(_words(F.col("text"))))
    found = judged(scanned, ["doc_id", "paragraph", "grams"])
    compared = F.transform(F.col("notices")[F.col("family")], lambda t: F.struct(
        (F.size(F.array_intersect(t["own"], F.col("grams"))) / F.size(t["own"])).alias("likeness"), t["notice"].alias("notice")))
    best = F.array_max(compared)
    out = found.join(F.broadcast(listed)).withColumn("best", best)
    sure = (F.col("probability") >= threshold) & (F.col("best.likeness") >= confirm)
    return out.select("doc_id", "paragraph", F.when(sure, F.col("family")).otherwise(UNKNOWN).alias("family"), "probability",
                      F.coalesce("best.likeness", F.lit(0.0)).alias("likeness"), F.when(sure, F.col("best.notice")).alias("notice"))
