"""License scans, in DataFrame functions only: sparse TF-IDF cosine to templates, then inheritance down the folders.

* A unit of text is a line. Its words (a-z and digits, lower case) are weighed by term frequency times the inverse document
  frequency over the templates; a word of no template weighs as the rarest. The cosine to every template is taken, and the best of a file's lines
  is the file's own licence if it reaches ``THRESHOLD``; headers and licence files are treated alike, wherever the line stands.
* A notice that is wrapped over lines or shares a line with other words reaches the threshold in no line. So files without such a
  line are searched for runs: wherever three consecutive words of a template or of a text in ``HEADS`` stand, whatever line
  breaks and comment signs are between them, the run of that template's length around them is scored like a line, with the weights of
  templates and heads together. A line that reaches the threshold is preferred to any run.
* Lines without any key word of the templates cannot reach the threshold (``key_words`` proves it) and are left aside.
  Equal lines are scored once, so a line that a third of all files hold costs one row per task.
* A licence file (named licence, license, copying or notice, with any extension) speaks for its folder and what is below. A
  file without own licence takes that of the nearest folder above that has one; folders are joined by their paths, each
  folder of the corpus with its ancestors, so the number of files in a folder does not matter.
* Ties go to the licence name, then the path, that sorts first.

A null text has no lines; rows without a path are left out, and of repeated paths the largest text counts. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import one_per_id, stored, table

THRESHOLD = 0.8

# Notices by which a licence is known.
TEMPLATES = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the 3-Clause BSD License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "MIT": [
        "Released under the MIT License.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
}

_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_FREE_LIBRARY = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
# Heads of licence files and usual headers, for runs only. Older versions are there so as not to be taken for the newer ones.
HEADS = {
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", _FREE.format("Affero General Public License", "3")],
    "Apache-2.0": [
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991", _FREE.format("General Public License", "2")],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _FREE.format("General Public License", "3")],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", _FREE_LIBRARY.format("2.1")],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _FREE.format("Lesser General Public License", "3"), _FREE_LIBRARY.format("3")],
    "MPL-2.0": ["Mozilla Public License Version 2.0 1. Definitions"],
}

WORD = "[a-z0-9]+"
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice)(\..*)?$"

# Words that most lines have: the last to be chosen as key words.
EVERYDAY = {"2", "3", "4", "0", "a", "and", "any", "are", "by", "form", "in", "is", "of", "only", "that", "the", "this", "to", "under", "use", "with", "work"}


def run_templates() -> dict[str, list[str]]:
    return {n: TEMPLATES.get(n, []) + HEADS.get(n, []) for n in sorted({*TEMPLATES, *HEADS})}


def weights(templates: dict[str, list[str]] = TEMPLATES) -> tuple[list[tuple[str, int, str, float]], dict[str, float], float]:
    """((licence, template, word, normalised weight) rows, idf by word, idf of any other word)."""
    texts = [(name, re.findall(WORD, t.lower())) for name, ts in templates.items() for t in ts]
    df = Counter(w for _, ws in texts for w in {*ws})
    idf = {w: round(math.log((1 + len(texts)) / (1 + n)) + 1, 6) for w, n in sorted(df.items())}
    other = round(math.log(1 + len(texts)) + 1, 6)
    rows = []
    for i, (name, ws) in enumerate(texts):
        tf = Counter(ws)
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in tf.items()))
        rows += [(name, i, w, round(n * idf[w] / norm, 9)) for w, n in sorted(tf.items())]
    return rows, idf, other


def key_words(threshold: float = THRESHOLD) -> list[str]:
    """Words such that a line without any of them has a cosine below the threshold to every template."""
    rows, _, _ = weights()
    keys: set[str] = set()
    for i in range(rows[-1][1] + 1):
        own = sorted((word in EVERYDAY, -w * w, word) for _, k, word, w in rows if k == i)
        rest = 1.0 + sum(w for _, w, word in own if word in keys)
        for _, w, word in own:
            if rest < threshold**2 - 1e-6:
                break
            if word not in keys:
                keys.add(word)
                rest += w
    return sorted(keys)


def line_licences(lines: DataFrame, threshold: float = THRESHOLD, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(line, licence, score) for the distinct ``lines`` that reach the threshold."""
    rows, idf, other = weights(templates)
    spark = lines.sparkSession
    known = F.broadcast(spark.createDataFrame(rows, "licence string, template int, word string, weight double"))  # the templates' words
    worth = F.broadcast(spark.createDataFrame(sorted(idf.items()), "word string, idf double"))
    words = lines.select("line", F.explode(F.regexp_extract_all(F.lower("line"), F.lit(WORD), F.lit(0))).alias("word"))
    tf = words.groupBy("line", "word").agg(F.count("*").alias("tf"))
    valued = tf.join(worth, "word", "left").withColumn("value", F.col("tf") * F.coalesce("idf", F.lit(other)))
    norms = valued.groupBy("line").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    dots = valued.join(known, "word").groupBy("line", "licence", "template").agg(F.sum(F.col("value") * F.col("weight")).alias("dot"))
    scores = dots.join(norms, "line").withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("score") >= threshold)
    return _best(scores, ["line"], ["licence"])


def _best(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Per key the row of the highest score, ties to the names that sort first."""
    low = F.min(F.struct((-F.col("score")).alias("score"), *names)).alias("b")
    return df.groupBy(*keys).agg(low).select(*keys, *[F.col(f"b.{n}") for n in names], (-F.col("b.score")).alias("score"))


def runs(files: DataFrame) -> DataFrame:
    """(path, line): the distinct runs of ``files`` that share three consecutive words with a template or head, one space between words."""
    seeds = set()
    for ts in run_templates().values():
        for t in ts:
            ws = re.findall(WORD, t.lower())
            seeds |= {(" ".join(ws[k : k + 3]), k, len(ws)) for k in range(len(ws) - 2)}
    known = F.array(*[F.lit(x) for x in sorted({s for s, _, _ in seeds})])
    # Through inline(), so that the optimiser computes words and threes once per file and not once per place.
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    words = files.select("path", F.inline(F.array(F.struct(words.alias("words")))))
    threes = F.transform("words", lambda w, i: F.concat_ws(" ", w, F.get("words", i + 1), F.get("words", i + 2)))
    threes = words.select("path", "words", F.inline(F.array(F.struct(threes.alias("threes")))))
    met = threes.filter(F.size(F.array_intersect("threes", known)) > 0)
    places = F.filter(F.transform("threes", lambda x, i: F.struct(x.alias("seed"), i.alias("place"))), lambda x: F.array_contains(known, x["seed"]))
    met = met.select("path", "words", F.inline(places))
    table = F.broadcast(files.sparkSession.createDataFrame(sorted(seeds), "seed string, offset int, length int"))  # the templates' words
    start = F.col("place") - F.col("offset")
    first = F.greatest(start, F.lit(0))
    run = F.array_join(F.slice("words", first + 1, start + F.col("length") - first), " ")
    return met.join(table, "seed").select("path", run.alias("line")).distinct()


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scanned(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per file of (path, text): path, licence, score, how (own, inherited or none), from_folder."""
    keyed = F.col("path").cast("string")
    files = _one_per_path(files.select(keyed.alias("path"), "text"))
    held = r"(?i)(^|[^a-z0-9])(" + "|".join(key_words(threshold)) + ")([^a-z0-9]|$)"
    lines = files.filter(F.col("text").rlike(held)).select("path", F.explode(F.split("text", "\n", -1)).alias("line"))
    lines = stored(lines.filter(F.col("line").rlike(held)).distinct())
    found = stored(line_licences(lines.select("line").distinct(), threshold))
    own = stored(_best(lines.join(found, "line"), ["path"], ["licence"]))
    rest = stored(runs(files.filter("text IS NOT NULL").join(own.select("path"), "path", "left_anti")))
    found = stored(line_licences(rest.select("line").distinct(), threshold, run_templates()))
    own = stored(own.unionByName(_best(rest.join(found, "line"), ["path"], ["licence"])))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    speaking = own.filter(name.rlike(LICENCE_FILE)).withColumn("from_folder", folder_of(F.col("path")))
    speaking = stored(_best(speaking, ["from_folder"], ["licence", "path"]).select("from_folder", "licence", "score"))
    paths = files.select("path", folder_of(F.col("path")).alias("folder"))
    folders = stored(paths.select("folder").distinct())
    parts = F.split("folder", "/", -1)
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("from_folder")))
    chain = folders.select("folder", F.inline(F.when(F.col("folder") != "", above).otherwise(F.slice(above, 1, 1))))
    nearest = chain.join(speaking, "from_folder").groupBy("folder").agg(
        F.max(F.struct("depth", "from_folder", "licence", "score")).alias("up"))
    joined = paths.join(own.withColumnsRenamed({"licence": "_own", "score": "_score"}), "path", "left").join(stored(nearest), "folder", "left")
    mine = F.col("_own").isNotNull()
    return joined.select(
        "path", F.coalesce("_own", "up.licence").alias("licence"), F.coalesce("_score", "up.score").alias("score"),
        F.when(mine, "own").when(F.col("up").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(~mine, F.col("up.from_folder")).alias("from_folder"),
    )


def _one_per_path(files: DataFrame) -> DataFrame:
    files = files.filter(F.col("path").isNotNull())
    again = files.groupBy("path").agg(F.count("*").alias("_times")).filter("_times > 1").select("path")
    if again.isEmpty():
        return files
    best = files.join(again, "path", "left_semi").groupBy("path").agg(F.max("text").alias("text"))
    return files.join(again, "path", "left_anti").unionByName(best)


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as a tree of files: source/lang/hundred/doc_id.txt.

    A document that opens with a line naming a licence stands for the LICENSE of a folder: of its source below 300
    characters, of its language there below 1,000, else of its hundred; the extension keeps paths apart.
    """
    docs = one_per_id(docs, "doc_id", "text", "lang", "source", "n_chars")
    source, lang = F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none"))
    opens = F.coalesce(F.lower(F.substring_index("text", "\n", 1)).contains("licen"), F.lit(False))
    hundred = F.floor(F.col("doc_id") / 100).cast("string")
    up = F.when(F.length("text") < 300, source).when(F.length("text") < 1000, F.concat_ws("/", source, lang)).otherwise(F.concat_ws("/", source, lang, hundred))
    path = F.when(opens, F.concat(up, F.lit("/LICENSE."), "doc_id")).otherwise(
        F.concat(F.concat_ws("/", source, lang, hundred), F.lit("/"), "doc_id", F.lit(".txt")))
    return docs.select(path.alias("path"), "text")


def digest(spark, folder: str) -> DataFrame:
    return scanned(as_files(table(spark, folder, "documents")))
