"""Licence notices in texts, by a trained paragraph classifier that templates confirm.

The classifier is a multinomial logistic regression with an L1 penalty over word unigrams and
bigrams. It is trained on varied templates of every family, and on paragraphs of the corpus and
scrambled templates as the class "unknown". A part of these rows is held out and gives the
least probability at which a family is right often enough; below it a paragraph is unknown.
What the classifier finds is compared with the templates of its family.

A paragraph is a line of a text. One without any weighted n-gram scores as the intercepts,
which is unknown; so only paragraphs that join the weight table are scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .line_dedup import lines_of, once
from .storage import packed, stored, text_key

#: fixed values: public notices of licence families
TEMPLATES = {
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3.",
        "Licensed under the GNU Affero General Public License v3.0.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "CC-BY-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "CC-BY-NC-4.0": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "CC-BY-SA-4.0": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License.",
        "This work is licensed under the GNU General Public License, version 2.",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License.",
        "This work is licensed under the GNU General Public License, version 3.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "Released under the ISC License.",
    ],
    "LGPL-3.0": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, version 3.",
        "Licensed under the GNU Lesser General Public License v3.0.",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "Released under the MIT License.",
        "Licensed under the MIT license.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
    ],
}
UNKNOWN = "unknown"
CLASSES = [*sorted(TEMPLATES), UNKNOWN]
#: variants of each template, documents that give unknown paragraphs, n-grams of which less than this share of them holds one
VARIANTS, SAMPLE_DOCS, COMMON = 40, 400, 0.01


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+", -1), lambda w: w != "")


def grams(words: Column) -> Column:
    """Unigrams and bigrams of an array of words."""
    pairs = F.when(
        F.size(words) > 1,
        F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b)),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def template_table(spark: SparkSession) -> DataFrame:
    """(family, template, words)."""
    rows = [(f, k, t) for f in sorted(TEMPLATES) for k, t in enumerate(TEMPLATES[f])]
    return spark.createDataFrame(rows, "family string, template int, text string").select("family", "template", word_list(F.col("text")).alias("words"))


def training_rows(docs: DataFrame, sample_docs: int) -> DataFrame:
    """(family, words, part): varied templates, scrambled ones and paragraphs of sampled texts.

    The sample is the ``sample_docs`` different texts with the smallest hash. A sampled paragraph that
    shares half of its bigrams with a template is left out, as it may be a notice.
    """
    spark = docs.sparkSession
    templates = template_table(spark)
    seeds = templates.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
    roll = lambda w, i: F.pmod(F.xxhash64(w, i, F.col("seed"), F.col("template")), F.lit(100))
    # seed 0 is the template itself; others lose some words, and surroundings come from other templates' words
    varied = seeds.select(
        "family", F.when(F.col("seed") == 0, F.col("words")).otherwise(F.filter("words", lambda w, i: roll(w, i) >= 12)).alias("words"),
    )
    scrambled = seeds.select(
        F.lit(UNKNOWN).alias("family"),
        F.transform(
            F.sort_array(F.transform(F.filter("words", lambda w, i: roll(w, i) >= 40), lambda w, i: F.struct(roll(w, i + 7).alias("o"), w.alias("w")))),
            lambda x: x["w"],
        ).alias("words"),
    )
    pairs = templates.select(F.explode(grams(F.col("words"))).alias("g")).filter(F.col("g").contains(" ")).distinct().orderBy("g")
    known = F.array(*[F.lit(r["g"]) for r in pairs.collect()])
    # hashes are put in order, 8 bytes each; the texts are then those up to the last of them
    hashed = docs.select("text", F.xxhash64("text").alias("h")).filter("text is not null")
    limit = hashed.select("h").distinct().orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    texts = hashed.filter(F.col("h") <= F.lit(limit)).select("text").distinct()
    lines = texts.select(F.explode(lines_of(F.col("text"))).alias("line")).distinct().select(once(word_list(F.col("line"))).alias("words"))
    own = F.filter(grams(F.col("words")), lambda g: g.contains(" "))
    shared = F.size(F.array_intersect(own, known))
    plain = lines.filter(2 * shared < F.greatest(F.lit(1), F.size(own))).select(F.lit(UNKNOWN).alias("family"), "words")
    rows = varied.union(scrambled).union(plain).filter(F.size("words") > 0)
    return stored(rows.withColumn("part", F.pmod(F.xxhash64("family", "words"), F.lit(10))).distinct())


def vocabulary(rows: DataFrame, common: float) -> list[str]:
    """N-grams of the templates that few unknown paragraphs of the corpus hold, sorted."""
    spark = rows.sparkSession
    own = template_table(spark).select(F.explode(grams(F.col("words"))).alias("g")).distinct()
    unknown = rows.filter(F.col("family") == UNKNOWN)
    n = unknown.count()
    seen = unknown.select(F.explode(F.array_distinct(grams(F.col("words")))).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    # scrambled templates are unknown rows as well and share words with families: only frequent words go
    often = seen.filter(F.col("n") > max(20.0, common * n)).join(own.filter(~F.col("g").contains(" ")), "g", "left_semi")
    short = own.filter(F.length("g") < 2)
    return [r["g"] for r in own.join(often, "g", "left_anti").join(short, "g", "left_anti").orderBy("g").collect()]


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, common: float = COMMON, precision: float = 0.99) -> tuple[list[str], list[list[float]], list[float], float]:
    """(n-grams, weights of every class for each, intercepts, least probability)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel
    from pyspark.ml.functions import vector_to_array

    rows = training_rows(docs, sample_docs)
    words = vocabulary(rows, common)
    vectors = CountVectorizerModel.from_vocabulary(words, inputCol="grams", outputCol="features")
    vectors.setBinary(True)
    label = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("family")) - 1
    data = stored(vectors.transform(rows.withColumn("grams", grams(F.col("words")))).select("family", label.cast("double").alias("label"), "features", "part"))
    model = LogisticRegression(family="multinomial", regParam=0.0005, elasticNetParam=1.0, standardization=False, maxIter=60).fit(
        data.filter("part < 7")
    )
    tested = model.transform(data.filter("part >= 7")).withColumn("p", vector_to_array("probability"))
    best = F.array_max(F.slice("p", 1, len(CLASSES) - 1))
    held = tested.select(
        best.alias("best"), (F.array_position("p", best) - 1 == F.col("label")).cast("int").alias("right"), F.monotonically_increasing_id().alias("tie")
    )
    # the held-out rows are bounded by the templates and the sample
    upto = Window.orderBy(F.desc("best"), "tie")
    curve = held.select("best", F.sum("right").over(upto).alias("right"), F.row_number().over(upto).alias("n"))
    least = curve.filter(F.col("right") >= precision * F.col("n")).agg(F.min("best")).first()[0]
    weights = model.coefficientMatrix.toArray().T.tolist()
    used = [k for k, w in enumerate(weights) if any(w)]
    return [words[k] for k in used], [weights[k] for k in used], model.interceptVector.toArray().tolist(), max(0.5, least if least is not None else 1.0)


def paragraphs(rows: DataFrame) -> DataFrame:
    """(k1, k2, pos, line, l1, l2) of rows (k1, k2, text); l1 and l2 identify the line."""
    lines = rows.select("k1", "k2", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    return lines.withColumns({"l1": F.xxhash64("line"), "l2": F.hash("line")})


def licence_lines(rows: DataFrame, model: tuple, least_similar: float) -> DataFrame:
    """(l1, l2, family, probability, similarity, confirmed) of the lines that the classifier finds."""
    words, weights, intercepts, least = model
    spark = rows.sparkSession
    table = spark.createDataFrame(list(zip(words, weights)), "gram string, w array<double>")
    split = paragraphs(rows).select("l1", "l2", once(word_list(F.col("line"))).alias("words"))
    each = split.select("l1", "l2", F.explode(grams(F.col("words"))).alias("gram"))
    # the table holds n-grams of the templates only; binary features count once for a line
    hits = each.join(F.broadcast(table.select("gram")), "gram", "left_semi").distinct()
    k = len(CLASSES)
    logits = hits.join(F.broadcast(table), "gram").groupBy("l1", "l2").agg(
        F.array(*[F.round(F.sum(F.col("w")[c]), 9) + F.lit(intercepts[c]) for c in range(k)]).alias("z")
    )
    exps = logits.select("l1", "l2", once(F.transform("z", lambda z: F.exp(z - F.array_max("z")))).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    top = F.array_max(F.slice("e", 1, k - 1))
    names = F.array(*map(F.lit, CLASSES))
    found = exps.select(
        "l1", "l2", F.get(names, (F.array_position("e", top) - 1).cast("int")).alias("family"), F.round(top / total, 6).alias("probability")
    ).filter(F.col("probability") >= least)
    found = stored(found)
    # the words of the found lines, once for each line
    lines = paragraphs(rows).join(found, ["l1", "l2"]).groupBy("l1", "l2", "family", "probability").agg(F.min("line").alias("line"))
    compared = lines.select("*", once(grams(word_list(F.col("line")))).alias("own")).join(
        F.broadcast(template_table(spark).select("family", grams(F.col("words")).alias("theirs"))), "family"
    )
    common, own, theirs = F.size(F.array_intersect("own", "theirs")), F.size(F.array_distinct("own")), F.size(F.array_distinct("theirs"))
    # a notice may stand inside other words, or be a part of a longer template
    similar = F.greatest(common / (own + theirs - common), 0.9 * common / theirs, F.when(own >= 7, 0.9 * common / own).otherwise(0.0))
    return compared.groupBy("l1", "l2", "family", "probability").agg(F.round(F.max(similar), 6).alias("similarity")).withColumn(
        "confirmed", F.col("similarity") >= least_similar
    )


def licences(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, least_similar: float = 0.5,
) -> DataFrame:
    """(id, families, found): every document with its confirmed licence families, sorted, and all findings.

    ``found`` lists (pos, family, probability, similarity, confirmed) of the paragraphs that are
    not unknown. Null and empty texts have no findings; equal rows get equal results; a table
    without any text trains on the templates alone.
    """
    rows = packed(docs, id_col, text_col).select("id", F.col("text").cast("string").alias("text")).withColumns(text_key())
    found = stored(licence_lines(rows, train(rows, sample_docs), least_similar))
    placed = paragraphs(rows).join(found, ["l1", "l2"]).select("k1", "k2", F.struct("pos", "family", "probability", "similarity", "confirmed").alias("f"))
    per_text = stored(placed.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("f")).alias("found")))
    confirmed = F.transform(F.filter("found", lambda x: x["confirmed"]), lambda x: x["family"])
    return rows.select("id", "k1", "k2").join(per_text, ["k1", "k2"], "left").select(
        "id", F.coalesce(F.sort_array(F.array_distinct(confirmed)), F.array().cast("array<string>")).alias("families"), "found"
    )
