"""License notices by MinHash over text windows, in DataFrame functions only.

Texts are cut into overlapping windows of words; for every length of template there is a window length and a step such that some window
holds a whole occurrence. A window and the template in it then share so many of their five-word shingles that one of ``BANDS`` MinHash
values agrees almost surely (similarity at least 0.26: missed with a chance below 0.74 ^ 48, one in a million). What the bands
retrieve, by number of the window alone, is verified by exact containment of the template's shingles. Windows without an anchor (a long word or a whole shingle, such
that every template shingle holds one) cannot share a shingle; they are not sketched, which loses nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrospark.llm.common import table, with_row_key
from dendrospark.session import cut

WIDTH, BANDS, CONTAINED = 5, 48, 80

# Notices by license.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("apache-2.0", 'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND'),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software'),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Released under the BSD License"),
    ("bsd", "Licensed under the BSD License"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)

#: Longest template, words in a window, step between windows. A window less a step is at least as long as the template.
CLASSES = ((6, 7, 2), (10, 12, 3), (18, 24, 7), (36, 48, 13))


def plain(text: str) -> list[str]:
    """Lower-case words without signs; the same rule as ``normal_words``."""
    kept = "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in text.lower())
    return kept.split()


def normal_words(text: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))


def anchors(templates=TEMPLATES) -> tuple[list[str], list[str]]:
    """Few long words that most template shingles hold (greedy), and the shingles without a long word, as phrases."""
    open_ = {tuple(w[i: i + WIDTH]) for _, t in templates for w in [plain(t)] for i in range(len(w) - WIDTH + 1)}
    chosen = []
    while words := {w for s in open_ for w in s if len(w) > 5}:
        best = max(words, key=lambda w: (sum(w in s for s in open_), len(w), w))
        chosen.append(best)
        open_ = {s for s in open_ if best not in s}
    return sorted(chosen), sorted(" ".join(s) for s in open_)


def anchor_pattern(words: list[str], phrases: list[str]) -> str:
    """Matches every lower-case text that holds an anchor; between the words of a phrase stand signs and spaces."""
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"(?<![a-z0-9])(?:{'|'.join([*words, *[p.replace(' ', gap) for p in phrases]])})(?![a-z0-9])"


def shingles(words: Column) -> Column:
    """Distinct hashes of the five-word runs."""
    last = F.size(words) - WIDTH
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WIDTH)]))
    return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(runs))


def minima(hashes: Column) -> Column:
    """One MinHash value per band."""
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda b: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, b))))


def template_table(spark: SparkSession) -> DataFrame:
    """``template, license, t_class, t_set``: one row per template, so bounded by the list above."""
    rows = []
    for i, (name, text) in enumerate(TEMPLATES):
        words = plain(text)
        rows.append((i, name, next(c for c, (most, _, _) in enumerate(CLASSES) if len(words) <= most), words))
    made = spark.createDataFrame(rows, "template int, license string, t_class int, words array<string>")
    return made.withColumn("t_set", shingles(F.col("words"))).drop("words")


def _windows(words: Column, size: int, step: int, known: Column, phrases: list[str]) -> Column:
    """Windows with an anchor; the last one ends with the text."""
    last = F.greatest(F.size(words) - size, F.lit(0))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(step)), F.array(last)))
    return F.filter(F.transform(starts, lambda s: F.slice(words, s + 1, size)), lambda w: F.arrays_overlap(w, known) | reduce(
        lambda a, p: a | F.contains(F.array_join(w, " "), F.lit(p)), phrases, F.lit(False)))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``doc_id, n_windows`` (sketched), ``n_templates`` (verified) and ``licenses`` (their names, sorted, comma-joined) for every row.

    Null, empty and short texts have no license; repeated rows and null ids are kept as they are; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    words, phrases = anchors()
    text = F.col("text")
    maybe = F.coalesce(F.lower(text).rlike(anchor_pattern(words, phrases)), F.lit(False))
    found = cut(with_row_key(docs.select("doc_id", F.when(maybe, normal_words(text)).alias("_words"))))
    listed = F.array(*[F.lit(a) for a in words])

    def of_class(number: int, size: int, step: int) -> Column:
        return F.transform(_windows(F.col("_words"), size, step, listed, phrases), lambda w: F.struct(F.lit(number).alias("c"), w.alias("w")))

    windows = found.filter(F.size("_words") >= WIDTH).select("_rid", F.explode(F.concat(*[of_class(c, size, step) for c, (_, size, step) in enumerate(CLASSES)])).alias("x"))
    sets = windows.select("_rid", F.col("x.c").alias("t_class"), shingles(F.col("x.w")).alias("w_set")).filter(F.size("w_set") > 0)
    # equal windows are one row each: a notice that a third of all texts share is sketched and verified once
    sketched = cut(sets.groupBy("_rid", "t_class", F.sort_array("w_set").alias("w_set")).agg(F.count(F.lit(1)).alias("_times"))
                   .withColumn("_set", F.xxhash64("w_set")))
    kinds = cut(sketched.select("t_class", "w_set").distinct().withColumn("_window", F.monotonically_increasing_id()))
    banded = kinds.select("_window", "t_class", F.posexplode(minima(F.col("w_set"))).alias("band", "low"))
    templates = template_table(spark)
    bands = templates.select("template", "t_class", F.posexplode(minima(F.col("t_set"))).alias("band", "low"))
    near = banded.join(F.broadcast(bands), ["t_class", "band", "low"]).select("_window", "template").distinct()  # templates are a fixed list
    met = near.join(kinds.select("_window", "t_class", "w_set"), "_window").join(F.broadcast(templates.drop("t_class")), "template")
    inside = 100 * F.size(F.array_intersect("w_set", "t_set")) >= CONTAINED * F.size("t_set")
    # at most all templates of the fixed list
    held = cut(met.filter(inside).groupBy("t_class", "w_set").agg(F.collect_set("template").alias("_t"), F.collect_set("license").alias("_l")))
    of_rows = sketched.join(held.withColumn("_set", F.xxhash64("w_set")), ["t_class", "_set", "w_set"])
    verified = of_rows.groupBy("_rid").agg(F.array_distinct(F.flatten(F.collect_set("_t"))).alias("_t"), F.array_distinct(F.flatten(F.collect_set("_l"))).alias("_l"))
    counted = sketched.groupBy("_rid").agg(F.sum("_times").alias("_n"))
    return found.drop("_words").join(counted, "_rid", "left").join(verified, "_rid", "left").select(
        "doc_id", F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_windows"),
        F.greatest(F.size(F.coalesce("_t", F.array().cast("array<int>"))), F.lit(0)).cast("bigint").alias("n_templates"),
        F.coalesce(F.array_join(F.sort_array("_l"), ","), F.lit("")).alias("licenses"))


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    """License notices of every document."""
    return scan_licenses(table(spark, sf_dir, "documents"))
