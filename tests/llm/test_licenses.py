"""License scan and inheritance against brute force."""

import math
import random
import re
from collections import Counter

from catalux.llm import licenses


def brute_scan(texts, templates, least):
    n = len(templates)
    df = Counter(w for _, t in templates for w in set(licenses.terms_of(t)))
    idf = lambda w: math.log((1 + n) / (1 + df[w])) + 1
    vec = lambda t: {w: (1 + math.log(k)) * idf(w) for w, k in Counter(licenses.terms_of(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = {}
    for i, t in texts:
        best = None
        for k, line in enumerate((t or "").split("\n")):
            v = vec(line)
            for name, text in templates if v else ():
                u = vec(text)
                s = round(sum(x * u.get(w, 0) for w, x in v.items()) / norm(v) / norm(u), 6)
                if s >= least and (best is None or (-s, k, name) < best):
                    best = (-s, k, name)
        if best:
            out[i] = (best[2], best[1])
    return out


TEXTS = [
    "prose\nReleased under the MIT License.", "released under the mit licence and more", "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.",
    "the work is under the license of the general public", None, "", "This work is licensed under the GNU General Public License, version 3!", "x" * 100, "MIT MIT MIT License", "public license v 2.0 mozilla source code form is subject to the terms of",
]


def test_scan(spark):
    rows = list(enumerate(TEXTS)) + [(0, TEXTS[0]), (None, TEXTS[0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, text string, term int")
    for least in (0.3, 0.75):
        got = {r.id: (r.license, r.line) for r in licenses.scan(df.select("id", "text"), least=least).collect()}
        assert got == brute_scan(rows[: len(TEXTS)], licenses.TEMPLATES, least)


def test_inheritance(spark):
    mit, gpl = TEXTS[0], TEXTS[6]
    files = [(1, "LICENSE", mit), (2, "a/b/c/x.py", ""), (3, "a/b/COPYING.txt", gpl), (4, "a/y.py", "none"), (5, "a/b/z.py", mit), (6, None, ""), (7, "a/b/c/d/e/q", None), (8, "u/license", "nothing")]
    df = spark.createDataFrame(files, "id long, path string, text string")
    got = {r.id: (r.license, r.origin, r.from_dir) for r in licenses.license_files(df).collect()}
    assert got[2] == ("GPL-3.0", "inherited", "a/b") and got[4] == ("MIT", "inherited", "") and got[5] == ("MIT", "own", None)
    assert got[6] == (None, None, None) and got[7] == ("GPL-3.0", "inherited", "a/b") and got[8] == ("MIT", "inherited", "") and got[1][1] == "own"
    assert licenses.license_files(df.limit(0)).count() == 0 and licenses.scan(df.select("id", "text"), []).count() == 0


def test_anchors_are_lossless():
    w = licenses.Weights(list(licenses.TEMPLATES), licenses.LEAST)
    assert all(re.fullmatch("[a-z0-9]+", a) for a in w.anchors)  # whole terms, so of any length


def test_short_lines_reach_the_threshold(spark):
    texts = ["The MIT License", "prose\nThe MIT License (MIT)"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: (r.license, r.line) for r in licenses.scan(df).collect()}
    assert got == brute_scan(list(enumerate(texts)), licenses.TEMPLATES, 0.7) == {0: ("MIT", 0), 1: ("MIT", 1)}


def brute_units(text, templates, least):
    w = licenses.Weights([(f"{i}\n{n}", t) for i, (n, t) in enumerate(templates)], least)
    v = {t: (1 + math.log(n)) * w.idf.get(t, w.other) for t, n in Counter(licenses.terms_of(text)).items()}
    dot = Counter()
    for key, t, share in w.rows:
        dot[key] += v.get(t, 0) * share
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {k.split("\n")[1]: round(x / norm, 6) for k, x in sorted(dot.items(), key=lambda x: x[1]) if norm and round(x / norm, 6) >= least}


def test_headers_and_full_texts(spark):
    apache = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n\nimport os"
    mit = dict(licenses.FULL)["MIT"].split("\n\n")
    files = [
        (0, "a.txt", "MIT License", "MIT"), (1, "a.txt", "Apache License", "Apache-2.0"), (2, "a.txt", "GNU GENERAL PUBLIC LICENSE", "GPL"), (3, "a.txt", "SPDX-License-Identifier: MIT", "MIT"),
        (4, "a.txt", apache, "Apache-2.0"), (5, "a.txt", "some prose by us\nLicensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), (6, "a.py", gpl, "GPL-3.0"), (7, "a.txt", "prose here with this\nand by that", None),
        (8, "m/LICENSE", "\n\n".join(mit[1:]), "MIT"), (9, "c/LICENSE", "Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        *[(20 + i, f"d{i}/COPYING", re.sub(r"(\S+)\s+", r"\1\n\n", t), n) for i, (n, t) in enumerate(licenses.FULL)],
    ]
    df = spark.createDataFrame([x[:3] for x in files] + [(10, "c/x", "nothing"), (11, "m/y", None), (None, "z", "MIT License")], "id long, path string, text string")
    got = {r.id: (r.license, r.origin) for r in licenses.license_files(df).collect()}
    assert {i: got[i][0] for i, *_ in files} == {i: x for i, _, _, x in files}
    assert got[10] == ("CC-BY-NC-4.0", "inherited") and got[11] == ("MIT", "inherited")


def test_units_against_brute_force(spark):
    r = random.Random(4)
    pool = [t for _, t in licenses.HEADERS]
    texts = []
    for _ in range(120):
        words = r.choice(pool).split()
        for _ in range(r.randrange(len(words))):
            words[r.randrange(len(words))] = r.choice(["prose", "by", "this", "license", "of"])
        texts.append(" ".join(words + ["more"] * r.randrange(3)))
    units = spark.createDataFrame([(i, "line", 0, t.lower()) for i, t in enumerate(texts)], "id long, unit string, no int, s string")
    got = {}
    for x in licenses._best(units, licenses.HEADERS, 0.7).collect():
        got.setdefault(x.id, {})[x.license] = max(x.score, got.get(x.id, {}).get(x.license, 0))
    assert got == {i: x for i, t in enumerate(texts) if (x := brute_units(t, licenses.HEADERS, 0.7))}


def test_texts_of_one_id_are_separate_files(spark):
    df = spark.createDataFrame([(1, "a/x", "Released under the MIT License."), (1, "a/y", "some other text of the same id"), (2, "a/z", None)], "id long, path string, text string")
    got = {r.path: r.license for r in licenses.license_files(df).collect()}
    assert got == {"a/x": "MIT", "a/y": None, "a/z": None}
