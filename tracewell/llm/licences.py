"""License scans by a trained paragraph classifier.

Texts are cut into paragraphs: sentences of lines. Word unigrams and bigrams,
hashed to a sparse vector, go to a multinomial logistic regression over licence
families and a class for ordinary text. A prediction needs a probability over a
threshold that is calibrated on held-out ordinary paragraphs, else the class is
unknown; and it is confirmed by comparison with the templates of the family it
names: the share of the paragraph's word trigrams that they hold.

Every paragraph is scored. `found` can be held to those that share a word trigram with
a template, which can be told first and leaves few to score; the scan is not.
It is fitted on the templates below and on ordinary paragraphs: one of each of about NEGATIVES // 2 documents, drawn
by hash from the whole text, twice. Everything is DataFrame and JVM-side ML work."""

from __future__ import annotations

import re
from itertools import groupby

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = 1 << 13
#: About as many ordinary paragraphs the classifier is fitted on, at any size of the corpus.
NEGATIVES = 4000
#: Share of held-out ordinary paragraphs that may pass the threshold.
FALSE_RATE = 0.005
LEAST_PROBABILITY = 0.5
#: Share of a paragraph's trigrams that its family's templates must hold.
TEMPLATE_PERCENT = 50
#: Where a line ends one sentence and starts the next.
SENTENCE_END = r"(?<=[.!?])\s+(?=\p{Lu})"
ORDINARY, UNKNOWN = "none", "unknown"

#: What notices and grants of each family say.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "MIT License.",
        "Distributed under MIT.",
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http www apache org licenses LICENSE-2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "gpl": (
        "GNU GPL v3 or later.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License version 2 or later.",
        "This program is free software: you can redistribute it and modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "cc-by": (
        "Creative Commons Attribution 4.0 International.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "public-domain": (
        "CC0 1.0 Universal.",
        "Licensed under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
        "This work has been dedicated to the public domain.",
    ),
    "reserved": (
        "All rights reserved.",
        "Copyright, all rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher, all rights reserved.",
    ),
}


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _grams(words: Column, n: int) -> Column:
    """Runs of n words. Whole arrays are zipped: a slice at each place costs the whole array each time."""
    out, size = F.slice(words, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0))), F.size(words)
    for i in range(2, n + 1):
        out = F.zip_with(out, F.slice(words, F.lit(i), F.greatest(size - (n - 1), F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _featured(df: DataFrame) -> DataFrame:
    """df(paragraph) with grams: unigrams, bigrams and a mark of the first word."""
    grams = lambda w: F.when(F.size(w) > 0, F.concat(w, _grams(w, 2), F.array(F.concat(F.lit("^ "), F.try_element_at(w, F.lit(1)))))).otherwise(w)
    return df.withColumn("grams", _bound(_words(F.col("paragraph")), grams))


def _paragraphs(text: Column) -> Column:
    """Sentences of lines, as an array; blank ones don't count."""
    return F.filter(F.flatten(F.transform(F.split(text, "\n"), lambda line: F.split(line, SENTENCE_END))), lambda x: F.trim(x) != "")


def _trigrams(words: Column) -> Column:
    """Distinct word trigrams, or the whole of a shorter paragraph."""
    return F.when(F.size(words) < 3, F.array(F.array_join(words, " "))).otherwise(F.array_distinct(_grams(words, 3)))


def template_grams() -> dict[str, list[str]]:
    """family -> the trigrams of its templates; short templates stand whole."""
    return {f: sorted({" ".join(w[i : i + 3]) for t in ts for w in [_plain(t)] for i in range(max(1, len(w) - 2))}) for f, ts in TEMPLATES.items()}


def template_pattern() -> str:
    """Finds a template's trigram in lower-case text, by first letters and words. It takes
    any non-ASCII letter for a gap, so it never misses one; what it finds is looked at again."""
    gap, by_first = "[^a-z0-9]+", {}
    for gram in sorted({g for grams in template_grams().values() for g in grams}):
        first, *rest = gram.split(" ")
        by_first.setdefault(first, []).append(gap.join(rest))
    words = [(w[0], f"{w[1:]}{gap}(?:{'|'.join(rest)})") for w, rest in by_first.items()]
    letters = [f"{c}(?:{'|'.join(x for _, x in ws)})" for c, ws in groupby(words, key=lambda x: x[0])]
    return f"(?<![a-z0-9])(?:{'|'.join(letters)})"


def paragraphs(docs: DataFrame, whole: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, paragraph: all of them, or those with a template's trigram."""
    if whole:
        lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
        return lines.select("doc_id", F.explode(F.split("line", SENTENCE_END)).alias("paragraph")).where(F.trim("paragraph") != "")
    hint = template_pattern()
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.lower("line").rlike(hint))
    parts = lines.select("doc_id", F.explode(F.split("line", SENTENCE_END)).alias("paragraph")).where(F.lower("paragraph").rlike(hint))
    every = F.array(*[F.lit(t) for t in sorted({t for g in template_grams().values() for t in g})])
    return parts.where(_bound(_trigrams(_words(F.col("paragraph"))), lambda g: F.arrays_overlap(g, every)))


def _held(grams: Column, held: Column) -> Column:
    """Whether the templates' grams in `held` confirm a paragraph of these grams."""
    return 100 * F.size(F.array_intersect(grams, held)) >= TEMPLATE_PERCENT * F.size(grams)


def templates(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(family).alias("family"), F.lit(t).alias("paragraph")) for family, ts in TEMPLATES.items() for t in ts]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


def training_rows(docs: DataFrame) -> DataFrame:
    """family, paragraph, weight, held: the templates and the halves of the long
    ones; ordinary sentences of the corpus, as they are and with a word of licences
    put in, so that one word alone decides nothing. Documents are chosen by a hash
    threshold, and of each the paragraph of the least hash, before anything is sorted;
    paragraphs that some family's templates confirm aren't ordinary."""
    spark = docs.sparkSession
    own = templates(spark)
    half = own.withColumn("w", F.split("paragraph", " ")).where(F.size("w") >= 12)
    n = F.floor(F.size("w") / 2).cast("int")
    halves = half.select("family", F.explode(F.array(F.array_join(F.slice("w", F.lit(1), n), " "), F.array_join(F.slice("w", n + 1, F.size("w")), " "))).alias("paragraph"))
    total = docs.count()
    share = min(1.0, NEGATIVES / 2 / max(total, 1))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    least = F.array_min(F.transform(_paragraphs(F.col("text")), lambda x: F.struct(F.xxhash64(x).alias("hash"), x.alias("paragraph"))))
    plain = chosen.select(least["paragraph"].alias("paragraph")).where("paragraph is not null")
    grams = F.array(*[F.array(*[F.lit(t) for t in g]) for g in template_grams().values()])
    plain = plain.where(~_bound(_trigrams(_words(F.col("paragraph"))), lambda g: F.exists(grams, lambda h: _held(g, h))))
    bait = F.element_at(F.array(*[F.lit(w) for w in ("license", "copyright", "permission", "warranty", "the license", "no permission")]), (F.pmod(F.xxhash64("paragraph"), F.lit(6)) + 1).cast("int"))
    negatives = plain.unionByName(plain.select(F.concat_ws(" ", "paragraph", bait).alias("paragraph"))).withColumn("family", F.lit(ORDINARY))
    rows = own.unionByName(halves).withColumn("weight", F.lit(20.0)).unionByName(negatives.withColumn("weight", F.lit(1.0)))
    return rows.withColumn("held", (F.col("family") == ORDINARY) & (F.pmod(F.xxhash64("paragraph"), F.lit(4)) == 0))


class Classifier:
    """A fitted model, its class names and its calibrated threshold."""

    def __init__(self, docs: DataFrame):
        self.names = [ORDINARY, *TEMPLATES]
        rows = _featured(training_rows(docs.select("doc_id", F.col("text").cast("string").alias("text"))))
        label = F.array_position(F.array(*[F.lit(x) for x in self.names]), F.col("family")) - 1
        rows = rows.withColumn("label", label.cast("double")).persist()
        try:
            steps = [HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES), LogisticRegression(family="multinomial", maxIter=25, regParam=0.001, weightCol="weight")]
            self.model = Pipeline(stages=steps).fit(rows.where("not held"))
            top = self.scored(rows.where("held")).select(F.when(F.col("guess") != ORDINARY, F.col("p")).otherwise(0.0).alias("p"))
            cut = top.agg(F.percentile("p", 1.0 - FALSE_RATE)).first()[0]
        finally:
            rows.unpersist()
        self.threshold = max(LEAST_PROBABILITY, float(cut or 0.0))

    def scored(self, featured: DataFrame) -> DataFrame:
        p = vector_to_array("probability")
        out = self.model.transform(featured).withColumn("p", F.array_max(p))
        guess = F.element_at(F.array(*[F.lit(x) for x in self.names]), (F.col("prediction") + 1).cast("int"))
        return out.withColumn("guess", guess).drop("features", "rawPrediction", "probability", "prediction")


def found(docs: DataFrame, model: Classifier | None = None, whole: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, paragraph, family, p, likeness: every
    paragraph (unless whole: of a template's trigram) that the model doesn't take for ordinary text. family is unknown where
    the probability is under the threshold or the templates don't confirm it."""
    model = model or Classifier(docs)
    df = model.scored(_featured(paragraphs(docs.select("doc_id", F.col("text").cast("string").alias("text")), whole)))
    by_family = F.create_map(*[x for f, g in template_grams().items() for x in (F.lit(f), F.array(*[F.lit(t) for t in g]))])
    df = df.where(F.col("guess") != ORDINARY).withColumn("g", _trigrams(_words(F.col("paragraph"))))
    held = F.try_element_at(by_family, F.col("guess"))
    sure = (F.col("p") >= model.threshold) & _held(F.col("g"), held)
    return df.select("doc_id", "paragraph", F.when(sure, F.col("guess")).otherwise(UNKNOWN).alias("family"), "p", (F.size(F.array_intersect("g", held)) / F.size("g")).alias("likeness"))


def _plain(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def scanned(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, families (sorted, confirmed ones), n_unknown
    (paragraphs that look like a licence but are no known one). Null and empty
    texts have none. Rows that repeat a doc_id, or have none, share what their texts hold."""
    hits = found(docs, whole=True).groupBy(F.col("doc_id").alias("__id")).agg(F.sort_array(F.collect_set(F.when(F.col("family") != UNKNOWN, F.col("family")))).alias("families"), F.count_if(F.col("family") == UNKNOWN).alias("n_unknown"))
    ids = docs.select("doc_id")
    out = ids.join(hits, ids["doc_id"].eqNullSafe(hits["__id"]), "left")
    return out.select("doc_id", F.coalesce("families", F.array().cast("array<string>")).alias("families"), F.coalesce("n_unknown", F.lit(0)).cast("long").alias("n_unknown"))
