"""License scans: sparse TF-IDF cosine of headers and files to templates, then inheritance from the nearest directory. DataFrame operations only.

Candidates are each line, each paragraph and the whole text of a file, against all templates, and for each template the windows of
as many words as it has, laid wherever one of its heavy words stands over the same word of the text, whatever the line breaks
between; the best cosine speaks for the file. A candidate speaks for a template only with two different words of it, lest a
one-word line (German "Mit.") be a licence. Templates are few and of bounded size; a word's weight is its count times its idf over
the templates, a word of no template having the largest idf.

Nothing that reaches the threshold is passed over: a candidate's cosine with a template is at most the norm of those of the
template's weights whose words it has (Cauchy-Schwarz). The heavy words of a template, its longest uncommon ones, are such that
all its other words together are below the threshold, so files, lines and places without a heavy word are left out, and candidates whose shared words weigh too little by the same bound, before any row is shuffled. A file that is a
licence file gives its licence to its directory; files without a header take that of their nearest ancestor directory.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sidetrace.llm.common import fixed, prepare, small_or_shuffled, text_or_empty

#: Header and licence-file templates by SPDX identifier, and the short names after "SPDX-License-Identifier:". The usual
#: wording of public licences. The first sentence of the BSD family stands for three clauses; a text of two has a sentence of its own, and wins the tie.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "LGPL-3.0": [
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "Licensed under the GNU Lesser General Public License, version 3",
        "GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ],
    "LGPL-2.1": [
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "AGPL-3.0": [
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "Licensed under the GNU Affero General Public License, version 3",
        "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "ISC License", "SPDX-License-Identifier: ISC"],
}
#: Words that are heavy last, for prose is full of them. Fixed values.
COMMON = frozenset("a an and any as at be by can each for free from in is it may not of on only or that the this to under use with work you".split())
#: Names of files that speak for their directory. Fixed values.
FILE_NAMES = r"(?i)(^|/)(licen[cs]e|copying|unlicense)(\.(txt|md|rst|html))?$"
#: A word: a run of these, without the dots at its ends.
_WORD = r"[a-z0-9](?:[a-z0-9.]*[a-z0-9])?"
_LINE, _PARAGRAPHS = r"[^\n\r]+", r"(?:\r\n?|\n)[^A-Za-z0-9\n\r]*[\n\r]\s*"
#: Words of a text that are looked through at once; a longer text is cut, with the neighbours that windows need.
CHUNK = 2048


def words(line: str) -> list[str]:
    return re.findall(_WORD, line.lower())


def word_column(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(_WORD), F.lit(0))


class Weights:
    """Unit TF-IDF vectors of the templates, their heavy words, and where in a template these stand."""

    def __init__(self, templates: dict[str, list[str]], threshold: float) -> None:
        self.texts = [(name, k, words(t)) for name, ts in templates.items() for k, t in enumerate(ts)]
        df = Counter(w for *_, t in self.texts for w in set(t))
        n = len(self.texts)
        self.idf = {w: 1 + math.log((1 + n) / (1 + d)) for w, d in df.items()}
        self.unseen = 1 + math.log(1 + n)
        self.vectors: list[tuple[str, int, dict[str, float]]] = []
        self.heavy: set[str] = set()
        self.anchors: list[tuple[str, str, int, int, int]] = []  # word, license, template, offset, words of the template
        for name, k, t in self.texts:
            v = {w: tf * self.idf[w] for w, tf in Counter(t).items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            v = {w: x / norm for w, x in v.items()}
            self.vectors.append((name, k, v))
            left, own = 1.0, set()
            for w, x in sorted(v.items(), key=lambda p: (p[0] in COMMON, -len(p[0]), p[0])):
                if left < threshold * threshold:
                    break
                own.add(w)
                left -= x * x
            self.heavy |= own
            self.anchors += [(w, name, k, i, len(t)) for i, w in enumerate(t) if w in own]
        self.longest = max(len(t) for *_, t in self.texts)


def weighs(found: Column, template: Column, threshold: float) -> Column:
    """Whether the words of a template (array of word, mass) that are found are two at least and weigh enough for the threshold."""
    shared = F.filter(template, lambda e: F.array_contains(found, e["word"]))
    return F.exists(F.array(shared), lambda m: (F.size(m) > 1) & (F.aggregate(m, F.lit(0.0), lambda s, e: s + e["mass"]) >= threshold * threshold - 1e-9))


def candidates(files: DataFrame, w: Weights, threshold: float) -> DataFrame:
    """Rows (path, words, license, template) of what may reach the threshold; a window is for one template, others are for all (null)."""
    spark = files.sparkSession
    masses = {(name, k): [(word, x * x) for word, x in v.items()] for name, k, v in w.vectors}
    # fixed arrays as one literal each, which the optimizer folds
    every = F.from_json(F.lit(json.dumps([{"m": [{"word": word, "mass": x} for word, x in rows]} for rows in masses.values()])), "array<struct<m:array<struct<word:string,mass:double>>>>")
    vocabulary, heavy = (F.split(F.lit(" ".join(sorted(x))), " ") for x in (w.idf, w.heavy))
    texts = files.where("path is not null").select("path", text_or_empty().alias("text")).where(F.arrays_overlap(word_column(text_or_empty()), heavy))
    lines = texts.select("path", F.explode(F.concat(F.regexp_extract_all("text", F.lit(_LINE), F.lit(0)), F.split("text", _PARAGRAPHS), F.array("text"))).alias("line"))
    known = F.array(F.array_intersect(F.col("words"), vocabulary))
    lines = lines.select("path", F.explode(F.array(word_column(F.col("line")))).alias("words"))
    lines = lines.where(F.arrays_overlap("words", heavy)).where(F.exists(known, lambda found: F.exists(every, lambda t: weighs(found, t["m"], threshold))))
    # windows: cut a text's words, take each heavy word with its neighbours, and lay the templates over it
    side = w.longest - 1
    chunks = F.transform(F.array(word_column(F.col("text"))), lambda ws: F.transform(F.sequence(F.lit(0), F.size(ws), F.lit(CHUNK)), lambda s: F.struct(F.least(s, F.lit(side)).alias("skip"), F.slice(ws, F.greatest(s - side, F.lit(0)) + 1, F.least(s, F.lit(side)) + CHUNK + side).alias("words"))))[0]
    chunk = texts.select("path", F.explode(chunks).alias("c")).select("path", "c.skip", "c.words").where(F.arrays_overlap("words", heavy))
    spots = F.filter(F.sequence(F.lit(0), F.lit(CHUNK - 1)), lambda i: F.array_contains(heavy, F.get(F.col("words"), F.col("skip") + i)))
    near = F.transform(spots, lambda i: F.struct(F.get(F.col("words"), F.col("skip") + i).alias("word"), F.least(F.col("skip") + i, F.lit(side)).alias("at"), F.slice("words", F.greatest(F.col("skip") + i - side, F.lit(0)) + 1, F.least(F.col("skip") + i, F.lit(side)) + side + 1).alias("around")))
    near = chunk.select("path", F.explode(near).alias("s")).select("path", "s.word", "s.at", "s.around")
    anchors = fixed(spark, [(*a, [{"word": word, "mass": x} for word, x in masses[a[1:3]]]) for a in w.anchors], "word string, license string, template int, offset int, n int, masses array<struct<word:string,mass:double>>")
    laid = near.join(F.broadcast(anchors), "word").where((F.col("at") >= F.col("offset")) & (F.col("at") - F.col("offset") + F.col("n") <= F.size("around")))
    laid = laid.select("path", F.slice("around", F.col("at") - F.col("offset") + 1, F.col("n")).alias("words"), "license", "template", "masses").where(weighs(F.col("words"), F.col("masses"), threshold))
    return lines.select("path", "words", F.lit(None).cast("string").alias("license"), F.lit(None).cast("int").alias("template")).union(laid.drop("masses"))


def headers(files: DataFrame, threshold: float = 0.75, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows (path, license, cosine): the best template of each file whose best candidate reaches the threshold; cosine in 1/10000, rounded.

    Ties go to the smaller identifier. Null and empty texts have no words; rows that repeat a path count as one file.
    """
    spark = prepare(files.sparkSession)
    w = Weights(templates or TEMPLATES, threshold)
    vectors = F.broadcast(fixed(spark, [(name, k, word, x) for name, k, v in w.vectors for word, x in v.items()], "license string, template int, word string, weight double"))
    idf = F.broadcast(fixed(spark, sorted(w.idf.items()), "word string, idf double"))
    found = candidates(files, w, threshold).withColumn("line", F.xxhash64("words", "license", "template"))
    found = found.groupBy("path", "line").agg(F.first("words").alias("words"), F.first("license").alias("only"), F.first("template").alias("only_k"))
    terms = found.select("path", "line", "only", "only_k", F.explode("words").alias("word")).groupBy("path", "line", "only", "only_k", "word").agg(F.count("*").alias("tf"))
    terms = terms.join(idf, "word", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(w.unseen)))
    norms = terms.groupBy("path", "line").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = terms.join(vectors, "word").where(F.col("only").isNull() | ((F.col("only") == F.col("license")) & (F.col("only_k") == F.col("template"))))
    dots = dots.groupBy("path", "line", "license", "template").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"), F.count("*").alias("shared")).where("shared > 1")
    cosine = dots.join(norms, ["path", "line"]).select("path", "license", F.round(F.col("dot") / F.col("norm") * 10000).cast("long").alias("cosine"))
    best = cosine.where(F.col("cosine") >= round(threshold * 10000)).groupBy("path").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"))
    return best.select("path", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"))


def directories(path: Column) -> Column:
    """All directories above a path, nearest last; the root is the empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(files: DataFrame, threshold: float = 0.75, templates: dict[str, list[str]] | None = None, file_names: str = FILE_NAMES) -> DataFrame:
    """Adds to files (path, text, ...) license, cosine, origin (header, inherited or none) and license_path, and drops text; cosine is 0 without an own header.

    Clashing columns are replaced. Of several licence files of a directory the smallest path speaks. Null paths have no
    license.
    """
    files = files.drop("license", "cosine", "origin", "license_path")
    own = headers(files, threshold, templates).checkpoint()
    paths = files.select("path").where("path is not null").distinct()
    givers = own.where(F.col("path").rlike(file_names)).select(F.element_at(directories(F.col("path")), -1).alias("dir"), F.struct("path", "license").alias("g")).groupBy("dir").agg(F.min("g").alias("g"))
    # inheritance over distinct directories: ancestors are joined by path, the deepest giver wins
    dirs = paths.select(F.element_at(directories(F.col("path")), -1).alias("own")).distinct()
    above = dirs.select("own", F.explode(F.when(F.col("own") == "", F.array(F.lit(""))).otherwise(F.array_append(directories(F.col("own")), F.col("own")))).alias("dir"))
    nearest = above.join(small_or_shuffled(givers), "dir").groupBy("own").agg(F.max(F.struct(F.length("dir").alias("l"), "g")).alias("b")).select("own", F.col("b.g.license").alias("given"), F.col("b.g.path").alias("giver"))
    kept = files.drop("text").columns
    out = files.drop("text").select(F.struct(*kept).alias("row"), F.col("path").alias("path"), F.element_at(directories(F.col("path")), -1).alias("own"))
    out = out.join(small_or_shuffled(own), "path", "left").join(small_or_shuffled(nearest), "own", "left")
    origin = F.when(F.col("license").isNotNull(), "header").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    giver = F.when(F.col("license").isNotNull(), F.col("path")).otherwise(F.col("giver"))
    return out.select("row.*", F.coalesce("license", "given").alias("license"), F.coalesce("cosine", F.lit(0)).alias("cosine"), origin.alias("origin"), giver.alias("license_path"))


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, source, lang) as files (doc_id, path, text): source/lang/doc_id.txt.

    The first document of a source is its LICENSE, and the first of a language in a source is that folder's, if it isn't
    the source's; whether they hold a licence is for the scan to find.
    """
    part = [F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")).alias(c) for c in ("source", "lang")]
    named = docs.select("doc_id", "text", *part)
    of_source = named.groupBy("source").agg(F.min("doc_id").alias("first"))
    of_lang = named.groupBy("source", "lang").agg(F.min("doc_id").alias("first_of_lang"))
    named = named.join(small_or_shuffled(of_source), "source").join(small_or_shuffled(of_lang), ["source", "lang"])
    folder = F.concat_ws("/", "source", "lang")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    path = F.when(F.col("doc_id") == F.col("first"), F.concat("source", F.lit("/LICENSE"))).when(F.col("doc_id") == F.col("first_of_lang"), F.concat(folder, F.lit("/LICENSE"))).otherwise(F.concat(folder, F.lit("/"), name, F.lit(".txt")))
    return named.select("doc_id", path.alias("path"), "text")
