"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a line or several neighbouring lines with words in each, as notices are often wrapped:
all runs of lines are taken whose inner lines hold at most REACH words, twice the longest template, and
that would hold less of some template without their first or their last line. Its features are the
words and pairs of words in it, also across line ends, hashed into a sparse vector. Multinomial logistic regression tells the licence families and the class `unknown` apart; it
is trained on variants of TEMPLATES (whole, cut short, with words left out, embedded) against
NEAR_MISSES and at most MAX_UNKNOWN paragraphs of the corpus. On variants that training did not see, a
second regression turns the margin over `unknown` into a probability. A paragraph counts if that
is at least one half and it holds half of the word pairs of a template of the predicted family.
Of confirmed paragraphs of a family that share a line the one with the largest overlap counts, of
equal ones the shortest. Every paragraph is judged; what no template could confirm is left out before it is scored. That filter is
lossless: a paragraph that holds half of a template's pairs holds a word of NEEDED, and only those
whose overlap reaches CONFIRM go on. CUE is for the count `n_cued` alone. The corpus rows of `unknown` are
lines of any kind outside the paragraphs that are scored, as these hold half of a licence.

Everything is DataFrame functions and JVM estimators. Null and empty texts have no paragraphs.
Repeated rows are judged alike; extra columns are left alone (the input stays as struct `row`). An
empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.lineage import stored
from meterline.tables import small_table

MAX_UNKNOWN = 4_000
CONFIRM = 0.5
FEATURE_BITS = 14
UNKNOWN = "unknown"
CUE = r"(?i)licen[cs]e|copyright|permission|redistribut|warrant|public domain|copyleft"
WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"

#: Usual notices of each family. Fixed values.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License.",
        "This software is distributed under the Apache 2.0 license."),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license."),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0."),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License."),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GPL version 2 or later."),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files.",
        "Licensed under the MIT license."),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "The author has dedicated the work to the public domain under CC0 1.0.",),
}
#: Sentences with a cue word that state no licence.
NEAR_MISSES = (
    "All rights reserved, no part may be copied without permission of the publisher.",
    "The driver showed his driving licence to the officer.",
    "A licence plate was found near the road.",
    "The court ruled on copyright law last week.",
    "She asked for permission to leave the room.",
    "The warranty of the machine ended in May.",
    "A fishing license costs ten dollars a year.",
    "Copyright 2019 the authors of the report.",
    "The film fell into the public domain long ago.",
    "The council renewed the licence of the radio station.",
    "Permission was denied by the committee.",
    "Redistribution of wealth was the topic of the debate.",
    "The search warrant was issued in the morning.",
    "They licensed the song to a film studio.",
)
#: Words of templates that plain texts are full of.
COMMON = frozenset(
    "a an and any are as be been by can following for from has have in into is it its may not of on or "
    "that the these this to under use used was were which with you your".split())


def _template_pairs(template: str) -> list[str]:
    words = re.findall(WORD, template.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _needed() -> list[str]:
    """Words of which any text that holds CONFIRM of a template's pairs has one: the pairs without
    such a word are fewer than that."""
    chosen: set[str] = set()
    for pairs in PAIRS:
        left = [p.split(" ") for p in pairs if chosen.isdisjoint(p.split(" "))]
        while len(left) >= CONFIRM * len(pairs):
            chosen.add(max({x for p in left for x in p}, key=lambda x: (
                x not in COMMON, sum(x in p for p in left), len(x), x)))
            left = [p for p in left if chosen.isdisjoint(p)]
    return sorted(chosen)


PAIRS = [_template_pairs(t) for texts in TEMPLATES.values() for t in texts]
REACH = 2 * max(len(re.findall(WORD, t.lower())) for texts in TEMPLATES.values() for t in texts)
NEEDED = r"(?<![a-z0-9])(?:" + "|".join(map(re.escape, _needed())) + r")(?![a-z0-9])"


def _words(column):
    return F.regexp_extract_all(F.lower(column), F.lit(WORD), F.lit(0))


def _pairs(column):
    return F.zip_with(F.slice(column, 1, F.size(column)), F.slice(column, 2, F.size(column)),
                      lambda a, b: F.concat_ws(" ", a, b))


def _pair_set(words):
    return F.array_distinct(F.filter(_pairs(words), lambda p: p.contains(" ")))


def with_features(df: DataFrame) -> DataFrame:
    """Adds words, word pairs and the sparse vector of both to rows with `paragraph`."""
    df = df.withColumn("words", _words(F.col("paragraph")))
    df = df.withColumn("pairs", _pair_set(F.col("words")))
    df = df.withColumn("grams", F.concat("words", "pairs"))
    return HashingTF(numFeatures=1 << FEATURE_BITS, binary=True, inputCol="grams",
                     outputCol="features").transform(df)


def _variants(df: DataFrame) -> DataFrame:
    """Ten variants of each paragraph, numbered: itself twice, its first and last parts, some of its
    words left out, and others around it."""
    words = F.split("paragraph", " ")
    n = F.size(words)
    join = lambda w: F.array_join(w, " ")
    drop = lambda k: join(F.filter(words, lambda x, i: i % 7 != k))
    part = lambda share: F.greatest(F.ceil(n * share), F.least(n, F.lit(5))).cast("int")
    forms = [F.col("paragraph"), F.upper("paragraph"), drop(2), drop(4), drop(6),
             join(F.slice(words, 1, part(0.7))), join(F.slice(words, -part(0.8), part(0.8))),
             F.concat(F.lit("Note: the files in this folder. "), "paragraph"),
             F.concat("paragraph", F.lit(" See the file for details.")),
             F.concat(F.lit("// "), "paragraph", F.lit(" //"))]
    return df.select("label", F.posexplode(F.array(*forms)).alias("variant", "paragraph"))


def training_rows(spark: SparkSession, corpus: DataFrame, n_paragraphs: int) -> DataFrame:
    """(label, variant, paragraph, held_out): variants of templates and near misses, and different
    paragraphs of `corpus`: one in so many by hash that about four times MAX_UNKNOWN of its
    `n_paragraphs` are left, of these the ones with the least hash."""
    one_in = max(1, n_paragraphs // (4 * MAX_UNKNOWN))
    rows = [(family, t) for family, texts in TEMPLATES.items() for t in texts]
    rows += [(UNKNOWN, t) for t in NEAR_MISSES]
    made = _variants(small_table(spark, rows, T.StructType.fromDDL("label string, paragraph string")))
    drawn = (corpus.where("length(trim(paragraph)) > 0")
             .where(F.pmod(F.xxhash64("paragraph"), F.lit(one_in)) == 0)
             .select("paragraph").distinct().orderBy(F.xxhash64("paragraph"), "paragraph").limit(MAX_UNKNOWN)
             .select(F.lit(UNKNOWN).alias("label"),
                     F.pmod(F.xxhash64(F.reverse("paragraph")), F.lit(10)).cast("int").alias("variant"), "paragraph"))
    # variants 3, 6 and 9 are for calibration
    return made.union(drawn).withColumn("held_out", F.col("variant").isin(3, 6, 9))


class Classifier:
    def __init__(self, families: list[str], model, calibration):
        self.families, self.model, self.calibration = families, model, calibration

    def margins(self, df: DataFrame) -> DataFrame:
        """Adds the best family and its margin over `unknown`, which is the last class."""
        k = len(self.families)
        scored = self.model.transform(with_features(df)).withColumn(
            "raw", vector_to_array("rawPrediction"))
        scored = scored.withColumn("best", F.array_max(F.slice("raw", 1, k)))
        names = F.array(*[F.lit(f) for f in self.families])
        return scored.withColumn("margin", F.col("best") - F.element_at("raw", k + 1)).withColumn(
            "family", F.element_at(names, F.array_position("raw", F.col("best")).cast("int")))

    def classify(self, df: DataFrame) -> DataFrame:
        """Adds family, p (calibrated), overlap with the family's nearest template, and confirmed."""
        scored = self.margins(df)
        weight, bias = self.calibration
        templates = small_table(
            df.sparkSession, [(f, t) for f, texts in TEMPLATES.items() for t in texts],
            T.StructType.fromDDL("family string, template string"))
        pairs = templates.groupBy("family").agg(F.collect_list(
            _pair_set(_words(F.col("template")))).alias("templates"))
        near = F.array_max(F.transform("templates", lambda t: F.size(
            F.array_intersect(t, F.col("pairs"))) / F.size(t)))
        return (scored.join(F.broadcast(pairs), "family")  # a row per family of TEMPLATES
                .withColumn("p", 1 / (1 + F.exp(-(F.lit(weight) * F.col("margin") + F.lit(bias)))))
                .withColumn("overlap", near)
                .withColumn("confirmed", (F.col("p") >= 0.5) & (F.col("overlap") >= CONFIRM)))


def fit(spark: SparkSession, corpus: DataFrame, n_paragraphs: int) -> Classifier:
    families = sorted(TEMPLATES)
    classes = F.array(*[F.lit(f) for f in [*families, UNKNOWN]])
    rows = stored(training_rows(spark, corpus, n_paragraphs).withColumn(
        "y", (F.array_position(classes, F.col("label")) - 1).cast("double")), "licence-training")
    model = LogisticRegression(featuresCol="features", labelCol="y", family="multinomial",
                               regParam=1e-3, maxIter=60).fit(
        with_features(rows.where("not held_out")).select("features", "y"))
    held_out = Classifier(families, model, (1.0, 0.0)).margins(rows.where("held_out"))
    margins = VectorAssembler(inputCols=["margin"], outputCol="m").transform(
        held_out.select("margin", (F.col("label") != UNKNOWN).cast("double").alias("known")))
    platt = LogisticRegression(featuresCol="m", labelCol="known", regParam=1e-3).fit(margins)
    return Classifier(families, model, (float(platt.coefficients[0]), float(platt.intercept)))


def candidates(text) -> tuple:
    """From a column of texts: structs (line, last, paragraph) of the paragraphs that hold CONFIRM
    of the pairs of a template. The steps are columns for `_steps`."""
    lowered = F.lower(text)
    every = sorted({p for pairs in PAIRS for p in pairs})
    known = lambda pairs: F.filter(pairs, lambda p: p.isin(every))
    nothing = F.array().cast("array<string>")
    words = F.transform(F.split(lowered, "\n", -1), lambda p: F.struct(
        p.alias("text"), _words(p).alias("words")))
    following = lambda i: F.try_element_at("worded", i + 2)["words"]  # i is from 0
    lines = F.transform("worded", lambda x, i: F.struct(
        x["text"].alias("text"), F.size(x["words"]).alias("size"), known(_pairs(x["words"])).alias("inner"),
        F.when((F.size(x["words"]) > 0) & (F.size(following(i)) > 0), known(F.array(F.concat_ws(
            " ", F.element_at(x["words"], -1), F.element_at(following(i), 1))))).otherwise(nothing).alias("link")))
    part = lambda name, a, b: F.flatten(F.transform(
        F.slice("lines", a + 1, F.greatest(b - a + 1, F.lit(0))), lambda x: x[name]))
    pairs = lambda a, b: F.array_distinct(F.concat(part("inner", a, b), part("link", a, b - 1)))
    windows = F.flatten(F.transform(
        F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.size(
            F.element_at("lines", i + 1)["inner"]) + F.size(F.element_at("lines", i + 1)["link"]) > 0),
        lambda i: F.transform(_ends(i), lambda j: F.struct(
            i.alias("line"), j.alias("last"), pairs(i, j).alias("all"),
            pairs(i + 1, j).alias("later"), pairs(i, j - 1).alias("sooner")))))
    templates = F.array(*[F.array(*map(F.lit, p)) for p in PAIRS])
    held = lambda t, m: F.size(F.array_intersect(t, m))
    least = min(len(p) for p in PAIRS) * CONFIRM
    near = F.filter(
        F.filter("windows", lambda x: F.size(x["all"]) >= least), lambda x: F.exists(templates, lambda t: (
            held(t, x["all"]) >= CONFIRM * F.size(t)) & (held(t, x["later"]) < held(t, x["all"]))
            & (held(t, x["sooner"]) < held(t, x["all"]))))
    whole = F.transform("near", lambda x: F.struct(x["line"], x["last"], F.array_join(F.transform(F.slice(
        "lines", x["line"] + 1, x["last"] - x["line"] + 1), lambda y: y["text"]), " ").alias("paragraph")))
    return (F.when(lowered.rlike(NEEDED), words), lines, windows, near, whole)


def _ends(i):
    """Last lines of the paragraphs that start at line i. Each inner line holds a word."""
    state = lambda words, open_, ends: F.struct(
        words.alias("words"), open_.alias("open"), ends.alias("ends"))

    def further(a, j):
        size = F.element_at("lines", j + 1)["size"]
        open_ = a["open"] & (size > 0) & (a["words"] <= REACH)
        inner = F.when(j == i, F.lit(0)).otherwise(size)
        return F.when(open_, state(a["words"] + inner, open_, F.concat(a["ends"], F.array(j)))).otherwise(
            state(a["words"], F.lit(False), a["ends"]))

    none = F.array().cast("array<int>")
    upto = F.least(i + REACH + 1, F.size("lines") - 1)
    return F.aggregate(F.sequence(i, upto), state(F.lit(0), F.lit(True), none), further, lambda a: a["ends"])


def _with_candidates(df: DataFrame, text) -> DataFrame:
    """Adds `candidates` to `df`."""
    names = ("worded", "lines", "windows", "near", "candidates")
    for name, step in zip(names, candidates(text)):
        df = df.withColumn(name, step)
    return df.drop(*names[:-1])


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` as struct `row`, with n_paragraphs, n_cued (lines, and those with a cue
    word), n_licensed, families (sorted) and found: structs (line, last, family, p, overlap) of the
    confirmed paragraphs. What is kept between the steps are the paragraphs to score, by 96 bits of
    hashes of id and text, which repeated rows share; no text is stored a second time."""
    spark = docs.sparkSession
    value = F.coalesce(text, F.lit(""))
    key = [F.xxhash64(id_column, value).alias("h1"), F.hash(value, id_column).alias("h2")]
    filled = F.filter(F.split(value, "\n", -1), lambda p: F.length(F.trim(p)) > 0)
    kept = docs.select(*key, value.alias("value"), filled.alias("filled"))
    kept = kept.select(
        "h1", "h2", "value", F.size("filled").cast("long").alias("n_paragraphs"),
        F.size(F.filter("filled", lambda p: p.rlike(CUE))).cast("long").alias("n_cued"))
    kept = stored(_with_candidates(kept, F.col("value")).drop("value")
                  .dropDuplicates(["h1", "h2"]), "licence-paragraphs")
    total = kept.agg(F.sum("n_paragraphs")).first()[0] or 0
    scored = kept.select("h1", "h2", F.inline("candidates"))
    lines = docs.select(*key, F.posexplode(F.split(text, "\n", -1)).alias("at", "paragraph"))
    model = fit(spark, lines.join(scored.drop("paragraph"), F.expr("at between line and last") & (
        lines.h1 == scored.h1) & (lines.h2 == scored.h2), "left_anti"), total)
    found = (model.classify(scored).where("confirmed").groupBy("h1", "h2", "family")
             .agg(F.sort_array(F.collect_list(F.struct(
                 (-F.col("overlap")).alias("order"), (F.col("last") - F.col("line")).alias("more"),
                 "line", "last", "family", "p", "overlap"))).alias("all"))
             .select("h1", "h2", F.inline(_apart("all"))).groupBy("h1", "h2")
             .agg(F.sort_array(F.collect_list(F.struct("line", "last", "family", "p", "overlap"))).alias("found")))
    counts = kept.select("h1", "h2", "n_paragraphs", "n_cued")
    return (docs.select(F.struct("*").alias("row"), *key)
            .join(counts.join(found, ["h1", "h2"], "left"), ["h1", "h2"]).select(
        "row", "n_paragraphs", "n_cued",
        F.expr("cast(coalesce(size(found), 0) as long)").alias("n_licensed"),
        F.expr("array_sort(array_distinct(coalesce(found.family, array())))").alias("families"), "found"))


def _apart(found: str):
    """Of paragraphs that share a line the first in the order of `found`."""
    kind = ("array<struct<order: double, more: int, line: int, last: int, family: string, p: double, "
            "overlap: double>>")
    return F.aggregate(found, F.array().cast(kind), lambda kept, x: F.when(F.exists(
        kept, lambda y: (y["line"] <= x["last"]) & (x["line"] <= y["last"])), kept).otherwise(
        F.concat(kept, F.array(x))))
