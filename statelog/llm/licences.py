"""Licence scans: a trained classifier of paragraphs, confirmed against templates.

A paragraph is a line. Its features are the word unigrams and bigrams that occur in the templates;
those of function words alone are no features. A multinomial logistic regression learns the
families from the templates and from parts of them, and an unknown class from ordinary sentences
about licences and rights and from all different lines of the corpus that share words with templates but
do not resemble one. A family counts only above its threshold, which is set on the fifth of these lines
that the model has not learnt from. A prediction is confirmed by the share of bigrams that the paragraph and
a template of the family have in common.

A line without a template word has no feature and is unknown by construction, so it is not scored.
Only DataFrame and SQL functions are used, and the DataFrame API of the regression.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statelog.llm.common import stored

UNKNOWN = "unknown"

#: Notices of well-known licences, as their publishers word them.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("mit", "mit-line", "Released under the MIT License."),
    ("mit", "mit-notice", "This project is licensed under the terms of the MIT license."),
    ("mit", "mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
     "software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("mit", "mit-warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."),
    ("apache", "apache-line", "Licensed under the Apache License, Version 2.0."),
    ("apache", "apache-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use "
     "this file except in compliance with the License."),
    ("apache", "apache-copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "apache-basis", "Unless required by applicable law or agreed to in writing, software distributed under "
     "the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND."),
    ("gpl", "gpl-line", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of "
     "the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
     "or (at your option) any later version."),
    ("gpl", "gpl-lesser", "This library is free software under the terms of the GNU Lesser General Public License."),
    ("gpl", "gpl-affero", "Licensed under the GNU Affero General Public License, version 3."),
    ("bsd", "bsd-line", "Released under the BSD 3-Clause License."),
    ("bsd", "bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are "
     "permitted provided that the following conditions are met:"),
    ("bsd", "bsd-notice", "Redistributions of source code must retain the above copyright notice, this list of "
     "conditions and the following disclaimer."),
    ("mpl", "mpl-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl", "mpl-line", "Licensed under the Mozilla Public License, version 2.0."),
    ("cc-nc", "cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-nc", "cc-by-nc-long", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
     "International License."),
    ("cc-nc", "cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0."),
    ("cc", "cc-by", "Licensed under CC BY 4.0."),
    ("cc", "cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc", "cc-by-long", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("public-domain", "cc0", "To the extent possible under law, the author has waived all copyright and related rights "
     "to this work (CC0 1.0 Universal)."),
    ("public-domain", "pd", "This work has been released into the public domain."),
    ("reserved", "arr", "All rights reserved."),
    ("reserved", "arr-copyright", "Copyright (c) 2024 Example Inc. All rights reserved."),
    ("reserved", "arr-permission", "No part of this publication may be reproduced without the prior written permission "
     "of the publisher."),
)

#: Ordinary sentences with the same words.
ORDINARY: tuple[str, ...] = (
    "The driver lost his license after the accident.", "A fishing license costs twenty dollars in this county.",
    "They fought for civil rights and were heard.", "The table by the window is reserved for two.",
    "All seats in the front row are reserved.", "Software version 3 comes out next week.",
    "The public library is free and open to all.", "She works for the general of the army.",
    "He asked for permission to leave the room.", "The copyright office moved to another building.",
    "The council may grant a building permit under these conditions.", "Please read the terms of use of the event.",
    "The Apache helicopter landed near the village.", "MIT admits fewer than a thousand students a year.",
    "The source of the river was found in the hills.", "A warranty of two years comes with the machine.",
    "The work of the committee is published every year.", "The creative team found common ground.",
    "The foundation provides software to schools.", "The domain of the function is the real line.",
    "Wildebeest such as the gnu live on the plains.", "The notice on the door was torn.",
    "Distributed systems need agreed conditions.", "You may use the copy machine without charge.",
)

#: Words that are no feature by themselves.
FUNCTION_WORDS: tuple[str, ...] = tuple(
    "a an the of and or to in on at by for from with without into under as is are be was were been has have this that "
    "these it its any all no not you we they he she his her may can must will his their or so if than then but".split())

LIKENESS = 0.6
#: A line of the unknown class shares less than this with every template; of the different ones every
#: fifth sets the thresholds alone.
UNLIKE = 0.3
LEAST_PROBABILITY = 0.5
#: Words of a template's part, and the step from one part to the next.
PART, PART_STEP = 8, 4


def _words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, with inner dots between digits."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9.]+|\.(?![0-9])"), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    return F.when(
        F.size(words) > 1,
        F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.slice(words, i, 2)))),
    ).otherwise(F.array().cast("array<string>"))


def _grams(words: Column) -> Column:
    return F.array_distinct(F.concat(words, _bigrams(words)))


def _literal(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few fixed rows as a literal of the plan."""
    return spark.range(1).select(
        F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("row")).select("row.*")


def templates(spark: SparkSession) -> DataFrame:
    """(family, template, words, bigrams)"""
    rows = [{"family": f, "template": n, "text": t} for f, n, t in TEMPLATES]
    found = _literal(spark, rows, "family: string, template: string, text: string")
    return found.select("family", "template", _words(F.col("text")).alias("words")).withColumn(
        "bigrams", _bigrams(F.col("words")))


def _vocabulary(spark: SparkSession) -> tuple[list[str], list[str]]:
    """The features, and the words of which each has one at least."""
    stop = F.array(*(F.lit(w) for w in FUNCTION_WORDS))
    grams = templates(spark).select(F.explode(_grams(F.col("words"))).alias("gram")).distinct()
    kept = grams.where(F.size(F.array_except(F.split("gram", " "), stop)) > 0)
    found = sorted(r.gram for r in kept.collect())
    return found, sorted({w for g in found for w in g.split(" ")} - set(FUNCTION_WORDS))


def _lines(docs: DataFrame, anchors: list[str]) -> DataFrame:
    """(id, doc_id, paragraph, words) of the lines that have a word of a template."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("id"), "doc_id",
        F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    known = F.array(*(F.lit(w) for w in anchors))
    return rows.select("id", "doc_id", "paragraph", _words(F.col("line")).alias("words")).where(
        F.arrays_overlap("words", known))


def _likeness(one: Column, two: Column) -> Column:
    """Common bigrams over those of the shorter side."""
    return F.coalesce(
        F.size(F.array_intersect(one, two)) / F.nullif(F.least(F.size(one), F.size(two)), F.lit(0)), F.lit(0.0))


def _unlike(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """All different lines that resemble no template, with a hash of each."""
    grams = templates(spark).agg(F.collect_list("bigrams").alias("all_bigrams"))
    distinct = lines.select("words").distinct().withColumn("bigrams", _bigrams(F.col("words")))
    # One row of templates, broadcast.
    both = distinct.withColumn("one", F.lit(1)).join(F.broadcast(grams.withColumn("one", F.lit(1))), "one")
    most = F.array_max(F.transform("all_bigrams", lambda t: _likeness(F.col("bigrams"), t)))
    return both.where(most < UNLIKE).select("words", F.xxhash64("words").alias("hash"))


@dataclass(frozen=True)
class Model:
    """Families, thresholds, intercepts, and a weight for each feature and family."""

    families: list[str]
    intercepts: list[float]
    weights: dict[str, list[float]]
    thresholds: dict[str, float]
    anchors: list[str]


def _candidates(docs: DataFrame) -> DataFrame:
    """The lines of ``_lines``, read from the texts once."""
    _, anchors = _vocabulary(docs.sparkSession)
    return stored(_lines(docs, anchors), "licence-candidates")


def train(docs: DataFrame) -> Model:
    """The regression and its thresholds; ``docs`` gives lines of the unknown class."""
    return _trained(_candidates(docs))


def _trained(lines: DataFrame) -> Model:
    spark = lines.sparkSession
    features, anchors = _vocabulary(spark)
    families = [UNKNOWN, *sorted({f for f, _, _ in TEMPLATES})]
    whole = templates(spark).select("family", "words")
    parts = whole.where(F.size("words") > PART).select(
        "family", F.explode(F.transform(
            F.sequence(F.lit(1), F.size("words") - PART + 1, F.lit(PART_STEP)),
            lambda i: F.slice("words", i, PART))).alias("words"))
    ordinary = _literal(spark, [{"text": t} for t in ORDINARY], "text: string").select(
        F.lit(UNKNOWN).alias("family"), _words(F.col("text")).alias("words"))
    empty = spark.range(1).select(F.lit(UNKNOWN).alias("family"), F.array().cast("array<string>").alias("words"))
    unlike = stored(_unlike(spark, lines), "licence-lines").withColumn("held", F.pmod("hash", F.lit(5)) == 0)
    rows = whole.union(parts).union(ordinary).union(empty).union(
        unlike.where("not held").select(F.lit(UNKNOWN), "words"))
    label = F.array_position(F.array(*(F.lit(f) for f in families)), F.col("family")) - 1
    rows = stored(rows.select("family", label.cast("double").alias("label"), _grams(F.col("words")).alias("grams")),
                  "licence-rows")
    sizes = {r.family: r["count"] for r in rows.groupBy("family").count().collect()}
    balance = F.element_at(F.create_map(*(F.lit(x) for f, n in sizes.items() for x in (f, 1.0 / n))), F.col("family"))
    vectors = CountVectorizerModel.from_vocabulary(features, inputCol="grams", outputCol="features", minTF=0.0)
    vectors.setBinary(True)
    fitted = LogisticRegression(
        family="multinomial", maxIter=60, regParam=0.0005, weightCol="weight", standardization=False,
    ).fit(vectors.transform(rows.withColumn("weight", balance)))
    matrix, intercepts = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray().copy()
    # Lines without features are unknown whatever was fitted.
    intercepts[0] = max(intercepts[0], intercepts[1:].max() + 1.0)
    weights = {g: [float(x) for x in matrix[:, i]] for i, g in enumerate(features)}
    model = Model(families, [float(x) for x in intercepts], weights, {}, anchors)
    held = unlike.where("held").select(F.monotonically_increasing_id().alias("id"), F.lit(0).alias("paragraph"), "words")
    wrong = _scored(held, model).groupBy("family").agg(F.max("probability").alias("most")).collect()
    most = {r.family: r.most for r in wrong}
    thresholds = {f: max(LEAST_PROBABILITY, min(0.99, 1.02 * most.get(f, 0.0))) for f in families[1:]}
    return Model(families, model.intercepts, weights, thresholds, anchors)


def _scored(lines: DataFrame, model: Model) -> DataFrame:
    """(id, paragraph, family, probability): the likeliest family of each line with a feature."""
    rows = [{"gram": g, "w": w} for g, w in model.weights.items()]
    table = F.broadcast(_literal(lines.sparkSession, rows, "gram: string, w: array<double>"))
    grams = lines.select("id", "paragraph", F.explode(_grams(F.col("words"))).alias("gram")).join(table, "gram")
    size = len(model.families)
    sums = grams.groupBy("id", "paragraph").agg(*(F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(size)))
    logits = [F.col(f"s{i}") + F.lit(model.intercepts[i]) for i in range(size)]
    most = F.greatest(*logits[1:])
    total = sum((F.exp(x - F.greatest(*logits)) for x in logits), F.lit(0.0))
    family = F.coalesce(*(F.when(x == most, F.lit(f)) for f, x in list(zip(model.families, logits))[1:]))
    return sums.select(
        "id", "paragraph", family.alias("family"),
        (F.exp(most - F.greatest(*logits)) / total).alias("probability"))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """A row for each line of a document that the classifier takes for a licence notice.

    ``family`` and its ``probability``; the ``template`` of the family that is most like the line,
    the ``similarity`` of both, and whether that confirms the prediction. Lines of the unknown class,
    NULL and empty texts give no row. Repeated rows are reported each; an empty table gives no rows;
    other columns are ignored. Rows are numbered as they are read: ``docs`` must give the same rows
    in the same order whenever it is read, as a table in files does.
    """
    docs = docs.select("doc_id", "text")
    lines = _candidates(docs) if model is None else stored(_lines(docs, model.anchors), "licence-candidates")
    model = model or _trained(lines)
    least = F.element_at(
        F.create_map(*(F.lit(x) for f, t in model.thresholds.items() for x in (f, t))), F.col("family"))
    found = _scored(lines, model).where(F.col("probability") >= least)
    # A few templates a family.
    known = F.broadcast(templates(docs.sparkSession).select("family", "template", F.col("bigrams").alias("known")))
    lines = lines.withColumn("bigrams", _bigrams(F.col("words"))).drop("words")
    compared = found.join(lines, ["id", "paragraph"]).join(known, "family").withColumn(
        "similarity", _likeness(F.col("bigrams"), F.col("known")))
    best = F.max(F.struct("similarity", "template"))
    rows = compared.groupBy("id", "paragraph", "doc_id", "family", "probability").agg(best.alias("best"))
    return rows.select(
        "doc_id", "paragraph", "family", "probability", "best.template", "best.similarity",
        (F.col("best.similarity") >= LIKENESS).alias("confirmed"))
