"""License scans: scores, thresholds, inheritance."""

import math
import re
from collections import Counter

import pytest

from tracewarden.llm import licences


def cosine(line: str) -> dict:
    rows, idf, other = licences.weights()
    tf = Counter(re.findall(licences.WORD, line.lower()))
    norm = math.sqrt(sum((n * idf.get(w, other)) ** 2 for w, n in tf.items())) or 1
    out: dict = {}
    for name, i, w, x in rows:
        out[name, i] = out.get((name, i), 0) + tf[w] * idf.get(w, other) * x / norm
    best: dict = {}
    for (name, _), x in out.items():
        best[name] = max(best.get(name, 0), x)
    return best


def test_inheritance(spark):
    mit, gpl = licences.TEMPLATES["MIT"][0], licences.TEMPLATES["GPL-3.0"][0]
    rows = [
        ("LICENSE", f"\n{mit}\n"), ("a/x.py", "code"), ("a/COPYING.txt", gpl + " Really."), ("a/b/c/y.py", "more\n"), ("ab/z.py", None),
        ("a/b/own.py", "# top\n# " + licences.TEMPLATES["Apache-2.0"][0] + "\nbody"), ("a/b/license.md", "nothing to see"),
        ("d/notice", "\n".join([mit, gpl])), ("d/e", ""), ("d/e", "x"), ("top.txt", "the license of the mit and more words in between"), (None, mit),
    ]
    frame = spark.createDataFrame([(*r, 1, "l") for r in rows], "path string, text string, score int, licence string")
    got = {r.path: r for r in licences.scanned(frame).collect()}
    how = {p: (r.licence, r.how, r.from_folder) for p, r in got.items()}
    assert how == {
        "LICENSE": ("MIT", "own", None), "a/x.py": ("GPL-3.0", "inherited", "a"), "a/COPYING.txt": ("GPL-3.0", "own", None),
        "a/b/c/y.py": ("GPL-3.0", "inherited", "a"), "ab/z.py": ("MIT", "inherited", ""), "a/b/own.py": ("Apache-2.0", "own", None),
        "a/b/license.md": ("GPL-3.0", "inherited", "a"), "d/notice": ("GPL-3.0", "own", None), "d/e": ("GPL-3.0", "inherited", "d"),
        "top.txt": ("MIT", "inherited", ""),
    }
    assert got["a/COPYING.txt"].score == pytest.approx(cosine(gpl + " Really.")["GPL-3.0"], abs=1e-6)


def test_key_words_lose_nothing():
    keys = set(licences.key_words())
    for texts in licences.TEMPLATES.values():
        for t in texts:
            rest = " ".join(w for w in re.findall(licences.WORD, t.lower()) if w not in keys)
            assert max(cosine(rest).values(), default=0) < licences.THRESHOLD


def test_nothing(spark):
    assert licences.scanned(spark.createDataFrame([], "path string, text string")).count() == 0


def test_odd_documents(odd, kept_texts):
    out = licences.scanned(licences.as_files(odd))
    assert out.count() == len(kept_texts)


def test_wrapped_and_embedded_notices(spark):
    free = ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU %sGeneral Public License as published by\n"
            "the Free Software Foundation, either version %d of the License, or\n(at your option) any later version.\n\nThis program is distributed")
    texts = {
        "bsd.c": ("BSD-3-Clause", "/*\n * Copyright (c) Somebody.\n * Redistribution and use in source and binary forms, with or without\n * modification, are "
                  "permitted provided that the following conditions\n * are met:\n */\nint x;"),
        "mit.js": ("MIT", "x\n" + licences.TEMPLATES["MIT"][2] + ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy'),
        "see.py": ("MIT", "# Copyright 2020 Some One and contributors. Released under the MIT License. See the file next to this one for the details of it."),
        "long.py": ("Apache-2.0", "All of the code in this folder and below is ours and it is Licensed under the Apache License, Version 2.0. Ask before you copy pictures."),
        "gpl3.c": ("GPL-3.0", free % ("", 3)), "gpl2.c": ("GPL-2.0", free % ("", 2)), "agpl.c": ("AGPL-3.0", free.replace("\n", "\n# ") % ("Affero ", 3)),
        "a/LICENSE": ("Apache-2.0", "\n      Apache License\n   Version 2.0, January 2004\n http://www.apache.org/licenses/\n\n TERMS AND CONDITIONS FOR USE"),
        "b/COPYING": ("GPL-3.0", "  GNU GENERAL PUBLIC LICENSE\n     Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc."),
        "prose.txt": (None, "the license of this work is not known\nand the terms of the offer are free of charge, to any person\nwho is subject to the terms of it"),
    }
    inherits = {"a/x/y.py": ("Apache-2.0", "a"), "b/z.c": ("GPL-3.0", "b")}
    frame = spark.createDataFrame([(p, t) for p, (_, t) in texts.items()] + [(p, "code") for p in inherits], "path string, text string")
    got = {r.path: r for r in licences.scanned(frame).collect()}
    assert {p: got[p].licence for p in texts} == {p: n for p, (n, _) in texts.items()}
    assert {p: (got[p].licence, got[p].from_folder) for p in inherits} == inherits
    assert all(got[p].how == "own" and got[p].score >= licences.THRESHOLD for p, (n, _) in texts.items() if n)
