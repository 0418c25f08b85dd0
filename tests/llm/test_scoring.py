import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sidetrace.llm import decontam, licenses, lm, toxicity
from tests.llm.helpers import HARD, documents, prose

BAD = ["grumph", "snarkel", "blaggard"]


def labelled(spark, n=400):
    texts = [prose(i, 60) + (" " + " ".join(BAD[(i + k) % 3] + "!" for k in range(1 + i % 3)) + " " + prose(i + 5000, 20) if i % 5 == 0 else "") for i in range(n)]
    docs = documents(spark, texts + HARD).withColumn("p_toxic", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, n, 2)] + [(None, 1), (1, None), (99999, 1)], "doc_id long, toxic int")
    return docs, labels, n


def test_toxicity_on_held_out_rows(spark):
    docs, labels, n = labelled(spark)
    rows = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [i for i in range(1, n, 2)]
    assert sum(rows[i].toxic == (i % 5 == 0) for i in held) / len(held) > 0.98
    assert len(rows) == n + len(HARD) and not any(rows[n + k].toxic for k in range(len(HARD)))
    assert all(0 <= r.expected_severity <= 3 and r.p_toxic >= 0 for r in rows.values())
    mild, bad = (np.mean([rows[i].expected_severity for i in held if i % 5 == 0 and i % 3 == k]) for k in (0, 2))
    assert mild < bad
    none = toxicity.toxicity(docs, labels.limit(0))
    assert none.where("toxic").count() == 0 and toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_thresholds_are_ordered_and_weights_shared():
    r = np.random.default_rng(1)
    grade = r.integers(0, 4, 600)
    rows = [np.arange(g) for g in grade]
    w, theta = toxicity.fit_cumulative(rows, grade, 3)
    assert (np.diff(theta) > 0).all() and (w > 0).all()


def test_lm_equals_a_plain_count(spark):
    texts = [prose(i, 40, ["aa", "bb", "cc"] if i % 3 == 0 else ["aa", "dd", "ee"]) for i in range(60)] + [None, "", "aaaa"]
    docs = documents(spark, texts).withColumn("target", F.lit("clash"))
    targets = spark.createDataFrame([(i,) for i in range(0, 60, 3)] + [(None,), (0,), (12345,)], "doc_id long")
    v = 12
    rows = {r.doc_id: r for r in lm.cross_entropy_difference(docs, targets, v).collect()}
    words = [(t or "").lower().split() for t in texts]
    good = set(range(0, 60, 3))
    count = Counter(w for ws in words for w in ws)
    cut = sorted(count.values(), reverse=True)[:v][-1]
    if list(count.values()).count(cut) + sum(c > cut for c in count.values()) == v:  # no tie at the cut
        known = {w for w, c in count.items() if c >= cut}
        size = len(known) + 1
        ids = [[w if w in known else None for w in ws] for ws in words]
        loss = {}
        for flag in (True, False):
            part = [x for i, x in enumerate(ids) if (i in good) == flag]
            one, two = Counter(w for x in part for w in x), Counter(p for x in part for p in zip(x, x[1:], strict=False))
            after = Counter(a for x in part for a in x[:-1])
            n = sum(one.values())

            def p1(w, one=one, n=n):
                return (one[w] + lm.ADDED) / (n + lm.ADDED * size)

            def p2(a, w, two=two, after=after, p1=p1):
                return lm.BIGRAM * two[a, w] / after[a] + (1 - lm.BIGRAM) * p1(w) if after[a] else p1(w)

            loss[flag] = [-(math.log(p1(x[0])) + sum(math.log(p2(a, w)) for a, w in zip(x, x[1:], strict=False))) if x else 0.0 for x in ids]
        for i, x in enumerate(ids):
            assert rows[i].cross_entropy_difference == pytest.approx((loss[True][i] - loss[False][i]) / max(1, len(x)), abs=1e-4)
    assert rows[60].n_tokens == rows[61].n_tokens == 0 and len(rows) == 63
    assert np.mean([rows[i].cross_entropy_difference for i in range(0, 60, 3)]) < np.mean([rows[i].cross_entropy_difference for i in range(1, 60, 3)])
    assert lm.cross_entropy_difference(docs.limit(0), targets).count() == 0
    assert lm.cross_entropy_difference(docs, targets.limit(0)).count() == 63


def test_lm_tells_all_words_apart(spark):
    """More words than any fixed vocabulary, in rare words alone; over several blocks and shards."""
    texts = [" ".join(f"w{(i * 37 + k * k) % 9000}" for k in range(40)) for i in range(600)]
    rows = {r.doc_id: r for r in lm.cross_entropy_difference(documents(spark, texts), spark.range(0, 600, 3).toDF("doc_id")).collect()}
    words = [t.split() for t in texts]
    vocabulary = len({w for ws in words for w in ws})
    assert vocabulary > 4001
    loss = {}
    for flag in (True, False):
        part = [x for i, x in enumerate(words) if (i % 3 == 0) == flag]
        one, two, after = Counter(w for x in part for w in x), Counter(p for x in part for p in zip(x, x[1:], strict=False)), Counter(a for x in part for a in x[:-1])
        p1 = {w: (one[w] + lm.ADDED) / (sum(one.values()) + lm.ADDED * (vocabulary + 1)) for ws in words for w in ws}
        loss[flag] = [-math.log(p1[x[0]]) - sum(math.log(lm.BIGRAM * two[a, w] / after[a] + (1 - lm.BIGRAM) * p1[w] if after[a] else p1[w]) for a, w in zip(x, x[1:], strict=False)) for x in words]
    for i, x in enumerate(words):
        assert rows[i].cross_entropy_difference == pytest.approx((loss[True][i] - loss[False][i]) / len(x), abs=2e-6)


ITEMS = ["A train runs 120 km in 3 hours from Paris to Lyon. How many km does the train of Anna run in 5 hours?", "Quiet rivers carry silver leaves beyond the broken mill while nobody counts them at dusk.", "short one here"]


def test_leaks(spark):
    filler = lambda i: prose(i, 80)
    texts = [
        filler(1), filler(2) + ".\n" + ITEMS[1] + "\n" + filler(3), filler(4) + ". " + ITEMS[1].upper() + " " + filler(5),
        filler(6) + ". " + ITEMS[0].replace("120", "75").replace("3 hours", "4 hours").replace("5", "9").replace("Paris", "Rome").replace("Lyon", "Turin").replace("Anna", "Maria"),
        ITEMS[0].replace("How many km does the train of Anna run in 5", "How many km does the train of Anna run in 120").replace("120 km in 3", "75 km in 3").replace("Paris to", "Rome to"),
        " ".join(ITEMS[1].split()[:6]) + " " + filler(7), "we saw a short one here today", ITEMS[2], None, "", "9 9 9 9 9 9 9 9 9 9", ITEMS[1] + " " + ITEMS[1],
    ]
    docs = documents(spark, texts + HARD).withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(i, t) for i, t in enumerate(ITEMS)] + [(7, None), (8, ""), (9, "5 6 7"), (None, "x y"), (1, ITEMS[1])], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contamination(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 0), (4, 0), (6, 2), (7, 2), (11, 1)}
    assert got[3, 0].n_changed >= 5 and got[4, 0].n_changed < got[3, 0].n_changed + 1 and got[1, 1].n_matched == got[1, 1].n_windows
    assert decontam.contamination(docs.limit(0), items).count() == decontam.contamination(docs, items.limit(0)).count() == 0


def test_line_breaks_and_letter_case_hide_no_copy(spark):
    items = spark.createDataFrame([(0, "What is the capital of France?"), (1, "In May Anna Berg met Carl Dahl and Eva Falk near the old Riga bridge with her friend Gus")], "item_id long, text string")
    one, two = "What is the capital of France?", "In May Anna Berg met Carl Dahl and Eva Falk near the old Riga bridge with her friend Gus"
    docs = documents(spark, ["Quiz\n" + one, "Quiz | " + one, two.upper(), "so. " + two.lower() + " " + prose(1, 30), prose(2, 60), "what was the capital"])
    assert sorted((r.doc_id, r.item_id) for r in decontam.contamination(docs, items).collect()) == [(0, 0), (1, 0), (2, 1), (3, 1)]


def test_slots_must_agree(spark):
    item = "The sum of 4 and 4 and 4 and then 7 is what number we want to know now"
    items = spark.createDataFrame([(0, item)], "item_id long, text string")
    docs = documents(spark, [item.replace("4", "9"), item.replace("4 and 4 and 4", "1 and 2 and 3"), item])
    assert sorted(r.doc_id for r in decontam.contamination(docs, items).collect()) == [0, 2]


def test_a_very_long_document_is_cut_into_windows(spark):
    item = "the red fox met the old hen near the barn and they spoke of rain"
    items = spark.createDataFrame([(0, item)], "item_id long, text string")
    docs = documents(spark, [prose(1, 200_000) + " " + item + " " + prose(2, 100_000), prose(3, 100_000)])
    assert [(r.doc_id, r.n_matched, r.n_windows) for r in decontam.contamination(docs, items).collect()] == [(0, 8, 8)]


def test_the_fit_is_a_minimum_of_the_plain_likelihood():
    r = np.random.default_rng(3)
    rows = [np.flatnonzero(r.random(4) < 0.5) for _ in range(300)]
    score = np.array([sum((1.5, -1.0, 0.5, 0.0)[k] for k in row) for row in rows])
    grades = np.digitize(score + r.logistic(size=300), [0.0, 1.0, 2.0])
    weights, thresholds = toxicity.fit_cumulative(rows, grades, 4, rounds=3000)

    def loss(x, steps):
        total = 0.0
        for row, g in zip(rows, grades, strict=True):  # one row at a time, from the definition
            s = sum(x[k] for k in row)
            above = [1.0, *(1 / (1 + math.exp(t - s)) for t in steps), 0.0]
            total -= math.log(above[g] - above[g + 1])
        return total / len(rows) + 0.5e-5 * sum(v * v for v in x)

    best = loss(weights, thresholds)
    for k in range(7):
        for step in (-0.05, 0.05):
            x = np.r_[weights, thresholds]
            x[k] += step
            assert loss(x[:4], x[4:]) > best - 1e-6
    assert (np.diff(thresholds) > 0).all()


FILES = [
    ("a/LICENSE", "Released under the MIT License.\nmore words"), ("a/b/x.txt", "plain text"), ("a/b/y.txt", "# Licensed under the Apache License, Version 2.0.\ncode"), ("c/z.txt", None), ("c/d/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
    ("c/d/e/f.txt", ""), ("top.txt", "this file is by us and free to use under the sun"), ("a/b/c/LICENSE", "nothing to see"), ("a/b/c/w.txt", "x"), (None, "Released under the MIT License."), ("a/b/x.txt", "plain text"),
]


def test_licenses(spark):
    df = spark.createDataFrame(FILES, "path string, text string").withColumn("license", F.lit("clash"))
    got = {r.path: (r.license, r.origin, r.license_path) for r in licenses.scan(df).collect()}
    assert got["a/b/x.txt"] == ("MIT", "inherited", "a/LICENSE") and got["a/b/c/w.txt"] == ("MIT", "inherited", "a/LICENSE")
    assert got["a/b/y.txt"] == ("Apache-2.0", "header", "a/b/y.txt") and got["c/d/e/f.txt"] == ("GPL-3.0", "inherited", "c/d/COPYING.txt")
    assert got["c/z.txt"] == got["top.txt"] == (None, "none", None) and got[None][1] == "none"
    assert licenses.scan(df).count() == len(FILES) and licenses.scan(df.limit(0)).count() == 0


def brute_force_header(w, text, threshold=7500):
    """The best (cosine, licence) of all lines, paragraphs, the whole text, and windows over heavy words, one by one."""
    parts = [*re.split("[\n\r]+", text), *re.split(licenses._PARAGRAPHS, text), text]
    every, found = licenses.words(text), []

    def score(c, name, t):
        v = {x: n * w.idf.get(x, w.unseen) for x, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        if sum(x in t for x in v) > 1:
            found.append((-round(sum(v.get(x, 0) * y for x, y in t.items()) / norm * 10000), name))

    for name, k, t in w.vectors:
        for p in parts:
            score(Counter(licenses.words(p)), name, t)
        for word, name2, k2, at, n in w.anchors:
            if (name2, k2) == (name, k):
                for i, x in enumerate(every):
                    if x == word and i >= at and i - at + n <= len(every):
                        score(Counter(every[i - at : i - at + n]), name, t)
    best = min(found, default=(0, None))
    return (best[1], -best[0]) if -best[0] >= threshold else None


def test_cosine_equals_brute_force_and_nothing_is_passed_over(spark, monkeypatch):
    monkeypatch.setattr(licenses, "CHUNK", 50)
    w = licenses.Weights(licenses.TEMPLATES, 0.75)
    lines = [t for ts in licenses.TEMPLATES.values() for t in ts]
    lines += [" ".join(t.split()[k:]) + " " + prose(k, 3) for t in lines for k in (0, 1, 2)] + [prose(i, 12) for i in range(30)]
    lines += [prose(i, 20 * i) + "\n# " + t.replace(" ", "\n# ", i) + " " + prose(i, 7) for i, t in enumerate(lines[:40])]
    lines += ["Mit.\nMit", "MIT", "the \u212Aelvin license", "", "...", "version 3 of the license " * 60]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(lines)], "path string, text string")
    got = {r.path: (r.license, r.cosine) for r in licenses.headers(df).collect()}
    for i, t in enumerate(lines):
        wanted = brute_force_header(w, t)
        assert got.get(str(i), (None, 0))[0] == (wanted or (None,))[0] and abs(got.get(str(i), (None, 0))[1] - (wanted or (0, 0))[1]) <= 1, t


HEADS = {
    "Apache-2.0": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n",
    "MIT": "Copyright (c) 2020 A B\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\n",
    "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n",
    "GPL-2.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.,\n",
    "LGPL-3.0": "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n  This version of the GNU Lesser General Public License incorporates\nthe terms and conditions of version 3 of the GNU General Public\nLicense, supplemented by the additional permissions listed below.\n",
    "LGPL-2.1": "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n",
    "AGPL-3.0": "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n",
    "MPL-2.0": "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n",
    "BSD-2-Clause": "Copyright (c) 2020, A B\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"\nAND ANY EXPRESS OR IMPLIED WARRANTIES",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software",
}
NOTICES = {
    "Apache-2.0": '// Licensed under the Apache License, Version 2.0 (the "License");\n// you may not use this file except in compliance with the License.\n// You may obtain a copy of the License at\n',
    "GPL-2.0": "/* This file is part of X.\n *\n * X is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version. */\n",
    "GPL-3.0": "# X is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n",
    "LGPL-3.0": "# X is free software: you can redistribute it and/or modify it under the\n# terms of the GNU Lesser General Public License as published by the\n# Free Software Foundation, either version 3 of the License, or\n",
    "AGPL-3.0": "# This program is free software: you can redistribute it and/or modify it\n# under the terms of the GNU Affero General Public License as published\n# by the Free Software Foundation, either version 3 of the License\n",
    "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\n",
}


def test_usual_heads_notices_and_identifiers(spark):
    texts = {f"h/{k}": (t, k) for k, t in HEADS.items()} | {f"n/{k}": (t + prose(3, 300), k) for k, t in NOTICES.items()}
    texts |= {f"s/{k}": (f"#!/bin/sh\n# SPDX-License-Identifier: {k}\n" + prose(4, 50), v) for k, v in (("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("GPL-3.0-only", "GPL-3.0"), ("GPL-2.0-or-later", "GPL-2.0"), ("LGPL-2.1-or-later", "LGPL-2.1"), ("AGPL-3.0-only", "AGPL-3.0"), ("BSD-2-Clause", "BSD-2-Clause"), ("BSD-3-Clause", "BSD-3-Clause"), ("ISC", "ISC"), ("MPL-2.0", "MPL-2.0"), ("Zlib", None))}
    df = spark.createDataFrame([(p, t) for p, (t, _) in texts.items()], "path string, text string")
    got = {r.path: r.license for r in licenses.headers(df).collect()}
    assert {p: got.get(p) for p in texts} == {p: k for p, (_, k) in texts.items()}


def test_scan_keeps_clashing_columns(spark):
    df = spark.createDataFrame([("a/LICENSE", "Released under the MIT License", 1, "x"), ("a/b.c", None, 2, "y")], "path string, text string, own int, given string").withColumns({"dir": F.lit(3), "row": F.lit(4), "_dir": F.lit(5)})
    got = licenses.scan(df).collect()
    assert {(r.path, r.license, r.own, r.given, r.dir, r.row, r["_dir"]) for r in got} == {("a/LICENSE", "MIT", 1, "x", 3, 4, 5), ("a/b.c", "MIT", 2, "y", 3, 4, 5)}


def test_licences_of_several_lines_and_of_a_part_of_a_line(spark):
    texts = {
        "m/LICENSE": "Copyright (c) 2020 Ann Example\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell",
        "m/src/a.c": "int main;",
        "b/a.c": "/*\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:\n */\n" + prose(1, 400),
        "g/a.c": prose(2, 200) + "\n# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n" + prose(3, 200),
        "s/a.txt": "This work is licensed under the GNU General Public License, version 3. See the docs folder for the many details that every reader and every author should know.",
        "n/a.txt": "We modify the software and use the general forms.\nA copy of the binary conditions follows.\n" + prose(4, 300),
    }
    got = {r.path: r.license for r in licenses.scan(spark.createDataFrame(list(texts.items()), "path string, text string")).collect()}
    assert got == {"m/LICENSE": "MIT", "m/src/a.c": "MIT", "b/a.c": "BSD-3-Clause", "g/a.c": "GPL-3.0", "s/a.txt": "GPL-3.0", "n/a.txt": None}


def test_items_of_symbols(spark):
    items = spark.createDataFrame([(0, "12 + 7 = ?"), (1, "the sum 3 × 4 = 12 of both")], "item_id long, text string")
    docs = documents(spark, [prose(1, 30) + " 31 + 8 = ? " + prose(2, 30), "the sum 5 × 6 = 30 of both", "12 - 7", "a + b = c", prose(3, 50)])
    assert sorted((r.doc_id, r.item_id) for r in decontam.contamination(docs, items).collect()) == [(0, 0), (1, 1)]
