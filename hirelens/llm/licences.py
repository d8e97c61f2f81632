"""Licence scan: a trained paragraph classifier over word n-grams, calibrated, its predictions confirmed by templates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Common notices of public licences, (family, notice).
TEMPLATES: list[tuple[str, str]] = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-2.0", "Released under the Apache License 2.0."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "This work is distributed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "Licensed under the GNU GPL v3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License."),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 2.1 or 3."),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd", "Licensed under the 3-clause BSD License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0", "Released under CC0 1.0 Universal: to the extent possible under law, the author has waived all copyright and related rights."),
    ("unlicense", "This is free and unencumbered software released into the public domain, see the Unlicense."),
    ("apache-2.0", "Apache License Version 2.0"), ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("mit", "MIT License"), ("mit", "The MIT License (MIT)"), ("mit", "SPDX-License-Identifier: MIT"),
    ("gpl-3.0", "GNU General Public License Version 3"), ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"), ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("gpl-2.0", "GNU General Public License Version 2"), ("gpl-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"), ("gpl-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("lgpl", "GNU Lesser General Public License"), ("lgpl", "SPDX-License-Identifier: LGPL-2.1-or-later"), ("lgpl", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("agpl-3.0", "GNU Affero General Public License"), ("agpl-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("mpl-2.0", "Mozilla Public License Version 2.0"), ("mpl-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("bsd", "BSD 3-Clause License"), ("bsd", "BSD 2-Clause License"), ("bsd", "SPDX-License-Identifier: BSD-3-Clause"), ("bsd", "SPDX-License-Identifier: BSD-2-Clause"),
    ("isc", "ISC License"), ("isc", "SPDX-License-Identifier: ISC"),
    ("cc-by-nc", "SPDX-License-Identifier: CC-BY-NC-4.0"), ("cc-by-sa", "SPDX-License-Identifier: CC-BY-SA-4.0"), ("cc-by", "SPDX-License-Identifier: CC-BY-4.0"),
    ("cc0", "CC0 1.0 Universal"), ("cc0", "SPDX-License-Identifier: CC0-1.0"), ("unlicense", "The Unlicense"), ("unlicense", "SPDX-License-Identifier: Unlicense"),
]
# Licence-like paragraphs that belong to none of the families.
OTHERS = [
    "All rights reserved. No part of this publication may be reproduced without permission.",
    "Copyright held by the authors.", "Licensed to the customer under a separate commercial agreement.", "The licence fee is due every year.",
    "You need a driving licence to rent a car.", "The use of this site is subject to our terms of service.", "This offer comes without any warranty of the seller.",
    "He asked for permission to leave and was granted a day.", "The public library is open to any person.", "A version of the work was released last year.",
]
#: Every template holds one of these; a paragraph without any is no licence notice and is not scored.
CUE = r"\bMIT\b|\bGNU\b|\bGPL|\bCC[ -]?(?:BY|0)|(?i:licen[sc]e|creative commons|copyright|redistribut|permission|public domain|mozilla|warrant|all rights reserved)"


#: A letter or number: a line without any, as one of comment marks alone, ends a paragraph.
WORDS = r"[\p{L}\p{N}]"
#: Comment marks made of letters; all others are no part of words anyway.
MARK = r"^\s*(?:dnl|rem|REM)\s"


def split_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)


def grams(text: Column) -> Column:
    """Words and pairs of neighbouring words, lower-cased."""
    words = split_words(text)
    pairs = F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, F.filter(pairs, lambda p: F.instr(p, " ") > 0))


def examples(spark: SparkSession, templates: Sequence[tuple[str, str]], others: Sequence[str], plain: DataFrame) -> DataFrame:
    """(label, text, held_out): variants of the templates with words left out or in other surroundings, other notices, plain paragraphs."""
    known = spark.createDataFrame([*templates, *(("unknown", t) for t in others)], "label string, text string")
    varied = known.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("w", F.split("text", " "))
    # Variant 0 is the template; 1 to 8 leave out every ninth word from another start on; 9 to 11 add a frame.
    shorter = F.concat_ws(" ", F.filter("w", lambda x, i: (i + F.col("variant")) % 9 != 0))
    frame = F.element_at(F.array(F.lit("Note: {}"), F.lit("{} See the file for details."), F.lit("Copyright 2024 the authors. {}")), F.col("variant") - 8)
    text = F.when(F.col("variant") == 0, F.col("text")).when((F.col("variant") <= 8) & (F.size("w") >= 9), shorter).when(F.col("variant") >= 9, F.replace(frame, F.lit("{}"), F.col("text"))).otherwise(F.col("text"))
    return varied.select("label", text.alias("text"), (F.col("variant") % 4 == 3).alias("held_out")).unionByName(
        plain.select(F.lit("unknown").alias("label"), "text", (F.crc32("text") % 4 == 3).alias("held_out")))


def _pairs(text: Column) -> Column:
    """The distinct pairs of neighbouring words."""
    return F.filter(F.array_distinct(grams(text)), lambda g: F.instr(g, " ") > 0)


def windows(src: DataFrame, shapes: Column, longest: int, confirm: float) -> DataFrame:
    """(id, paragraph, line) of texts with a cue: for every line with a cue the lines about it that hold most pairs of one template.

    A window runs over neighbouring lines without a blank one between them. It counts if a
    template stands in it (see `_needed`) and its first and its last line each add two pairs
    to the others'; of those with most pairs the shortest is taken, then the last. A line
    about which no window counts stands alone. Equal windows of a row are one.
    """
    lines = src.filter(F.col("text").rlike(CUE)).select("id", F.monotonically_increasing_id().alias("row"), F.split("text", "\n").alias("lines"))
    # Every line of a window has a word, so no more lines than the longest template has words are looked at.
    around = lambda c: F.struct(c.alias("c"), F.reverse(F.slice("lines", F.greatest(c + 1 - longest, F.lit(1)), F.least(c, F.lit(longest)))).alias("before"),
                                F.element_at("lines", c + 1).alias("own"), F.slice("lines", c + 2, F.lit(longest)).alias("after"))
    places = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(CUE), i)), lambda i: i.isNotNull())
    # Only the lines about a cue are carried on, not the text once for each of its lines.
    cued = lines.select("id", "row", F.explode(F.transform(places, around)).alias("x")).select("id", "row", "x.*")

    def reach(near: Column) -> Column:
        """How many lines, nearest first, stand before a blank one and within the longest template's words."""
        state = lambda is_open, n, words: F.struct(is_open.alias("is_open"), n.alias("n"), words.alias("words"))
        more = lambda a, x: state(a["words"] + F.size(split_words(x)) < longest, a["n"] + 1, a["words"] + F.size(split_words(x)))
        step = lambda a, x: F.when(a["is_open"] & x.rlike(WORDS), more(a, x)).otherwise(state(F.lit(False), a["n"], a["words"]))
        return F.aggregate(near, state(F.lit(True), F.lit(0), F.lit(0)), step, lambda a: a["n"])

    cued = cued.withColumns({"up": reach(F.col("before")), "down": reach(F.col("after"))})
    lines = F.concat(F.reverse(F.slice("before", F.lit(1), F.col("up"))), F.array("own"), F.slice("after", F.lit(1), F.col("down")))
    near = cued.select("id", "row", "c", "up", F.transform(lines, lambda x: F.regexp_replace(x, MARK, " ")).alias("near"))
    held = lambda t, pairs: F.size(F.array_intersect(t["pairs"], pairs))
    # Pairs only grow with the window: what the whole neighbourhood does not hold, no window holds.
    near = near.withColumn("all", _pairs(F.concat_ws(" ", "near"))).withColumn("shapes", F.filter(shapes, lambda t: held(t, F.col("all")) >= _needed(t, confirm)))
    part = lambda s, n: _pairs(F.concat_ws(" ", F.slice("near", s + 1, n)))
    spans = F.flatten(F.transform(F.sequence(F.lit(0), F.col("up")), lambda s: F.transform(F.sequence(F.col("up"), F.size("near") - 1), lambda e: F.struct(s.alias("s"), (e - s + 1).alias("n")))))
    texts = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["n"].alias("n"), part(x["s"], x["n"]).alias("full"),
                                                  F.when(x["n"] > 1, part(x["s"] + 1, x["n"] - 1)).alias("headless"), F.when(x["n"] > 1, part(x["s"], x["n"] - 1)).alias("tailless")))
    near = near.withColumn("texts", F.when(F.size("shapes") > 0, texts))
    tight = lambda t, x: (held(t, x["full"]) >= _needed(t, confirm)) & ((x["n"] == 1) | (held(t, x["full"]) - F.greatest(held(t, x["headless"]), held(t, x["tailless"])) >= 2))
    ranked = F.flatten(F.transform("texts", lambda x: F.transform(F.filter("shapes", lambda t: tight(t, x)), lambda t: F.struct(held(t, x["full"]).alias("most"), (-x["n"]).alias("less"), x["s"].alias("s")))))
    best = near.select("id", "row", "c", "up", "near", F.array_max(ranked).alias("w"))
    s, n = F.coalesce(F.col("w.s"), F.col("up")), F.coalesce(-F.col("w.less"), F.lit(1))
    return best.select("id", "row", (F.col("c") - F.col("up") + s).alias("paragraph"), F.concat_ws(" ", F.slice("near", s + 1, n)).alias("line")).dropDuplicates(["row", "paragraph", "line"]).drop("row")


def _needed(shape: Column, confirm: float) -> Column:
    """How many pairs of a template have to stand in a text: of short forms, up to three pairs, all."""
    return F.when(F.size(shape["pairs"]) <= 3, F.size(shape["pairs"]) * 1.0).otherwise(F.size(shape["pairs"]) * confirm)


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[tuple[str, str]] = tuple(TEMPLATES), others: Sequence[str] = tuple(OTHERS),
                  plain: int = 400, size: int = 1 << 14, confirm: float = 0.6) -> DataFrame:
    """(id, paragraph, family, probability, similarity, confirmed): one row for each paragraph with a cue of a licence.

    A paragraph is a line with a cue, or the lines about it over which a notice is wrapped
    (see `windows`), numbered by its first line. The classifier is multinomial logistic regression on
    hashed words and word pairs, fitted on variants of the templates, on other notices and on
    at most `plain` lines without a cue taken from the documents (those with the smallest
    hash among the first lines of texts). A second regression, on variants the first has not
    seen, turns its margin into the probability that the family is right; below one half the
    family is `unknown`. A prediction is confirmed if `confirm` of the word pairs of one of the
    family's templates stand in the paragraph, all of short forms; otherwise it is `unknown` as well.

    Null and empty texts, and lines without a cue, give no row. Rows of a null or repeated id
    are scanned one by one. Other columns are left out. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    first = src.select(F.substring_index("text", "\n", 1).alias("text")).filter("length(text) > 20").filter(~F.col("text").rlike(CUE))
    # A line is a bounded sample row for fitting, so it is cut; what is scanned never is.
    lines = first.select(F.substring("text", 1, 400).alias("text"), F.xxhash64("text").alias("h")).orderBy("h", "text").limit(plain).select("text")
    known = examples(spark, templates, others, lines).withColumn("grams", grams(F.col("text")))
    families = ["unknown", *sorted({f for f, _ in templates})]
    index = F.array_position(F.array(*map(F.lit, families)), F.col("label")) - 1
    hashing = HashingTF(numFeatures=size, binary=True, inputCol="grams", outputCol="features")
    rows = hashing.transform(known.withColumn("y", index.cast("double"))).select("y", "features", "held_out", "grams").cache()
    model = LogisticRegression(labelCol="y", family="multinomial", regParam=0.002, maxIter=60, probabilityCol="p", rawPredictionCol="raw", predictionCol="best").fit(rows.filter("NOT held_out"))

    def margin(df: DataFrame) -> DataFrame:
        """Adds the best family and how far its score is above that of `unknown`."""
        scored = model.transform(df).withColumn("s", vector_to_array("raw"))
        own = F.slice("s", 2, len(families) - 1)
        return scored.withColumn("at", F.array_position(own, F.array_max(own)).cast("int")).withColumn("margin", F.array_max(own) - F.element_at("s", 1))

    judged = margin(rows.filter("held_out")).withColumn("right", F.when(F.col("at") == F.col("y"), 1.0).otherwise(0.0))
    slope = LogisticRegression(labelCol="right", featuresCol="one", regParam=0.001, maxIter=50).fit(VectorAssembler(inputCols=["margin"], outputCol="one").transform(judged).select("right", "one"))
    a, b = float(slope.coefficients[0]), float(slope.intercept)
    rows.unpersist()

    # The templates are a parameter: a literal of the plan, not a table.
    patterns = spark.createDataFrame([*templates], "family string, notice string").select("family", _pairs(F.col("notice")).alias("pairs"), F.size(split_words(F.col("notice"))).alias("words"))
    held = [(r["family"], r["pairs"], r["words"]) for r in patterns.collect() if r["pairs"]]
    shapes = F.array(*[F.struct(F.lit(f).alias("family"), F.array(*map(F.lit, p)).alias("pairs")) for f, p, _ in held])
    scored = margin(hashing.transform(windows(src, shapes, max(n for *_, n in held), confirm).withColumn("grams", grams(F.col("line")))))
    probability = 1 / (1 + F.exp(-(F.col("margin") * a + b)))
    named = scored.select("id", "paragraph", "grams", F.element_at(F.array(*map(F.lit, families[1:])), F.col("at")).alias("guess"), probability.alias("probability"))
    own = F.filter(shapes, lambda t: t["family"] == F.col("guess"))
    share = lambda t: F.size(F.array_intersect(t["pairs"], F.col("grams")))
    alike = F.array_max(F.transform(own, lambda t: share(t) / F.size(t["pairs"])))
    stands = F.exists(own, lambda t: share(t) >= _needed(t, confirm))
    found = named.withColumn("similarity", alike).withColumn("confirmed", (F.col("probability") >= 0.5) & stands)
    return found.select(F.col("id").alias(id_col), "paragraph", F.when(F.col("confirmed"), F.col("guess")).otherwise("unknown").alias("family"), "probability", "similarity", "confirmed")

