"""License scans: sparse TF-IDF cosine to templates, and inheritance from the nearest ancestor directory.

DataFrame functions only. Units of comparison are the lines of a file, whatever their place (``scan``, to ``TEMPLATES``), and,
to ``HEADERS``, its lines, its blocks (lines up to a blank one), the run of comments at its head and, of a licence file, the whole
text; that also to ``FULL`` texts. The best of these is the file's own licence. Terms are runs of letters and digits, lower-cased; weights are (1 + ln count) * idf with idf = ln((1 + T) / (1 + df)) + 1 over the T templates, so
terms of no template have the largest idf. A line's licence is the template with the highest cosine, ties by name,
if that is ``LEAST`` or more; a file's is that of its best line, ties by line number.

Only units that can reach ``LEAST`` are scored: for each template its longest terms (those that are anchors already come first)
are *anchors* until the rest alone has a norm below LEAST of the template's, so a unit without an anchor stays below. Texts without any anchor
are left out first, and no text is shuffled. A unit is exploded only if its terms of no template are few enough for ``LEAST``.

A directory's licence is that of its licence files (LICENSE, LICENCE, COPYING, NOTICE, with or without an ending),
the best by cosine, then name, then path. A file without a licence of its own takes that of the nearest directory above it: the
directories on each distinct path are joined with the licensed ones.

Null or empty texts have no licence of their own. Null path: nothing to inherit. Repeated rows have equal results; texts of one id are
separate files. No files or templates: no rows, or no licences. Very long texts are looked at whole; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read

LEAST = 0.7
#: Most bytes of all templates: their terms and weights are literals of the plan.
TEMPLATE_BYTES = 1 << 20
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice)(\..*)?$"

#: Short forms of common licences (fixed texts).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_GPL = "{} is free software: you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_NO_WARRANTY = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} License for more details. You should have received a copy of the GNU {0} License along with this program. If not, see https://www.gnu.org/licenses/."
_GNU = (("GPL-2.0", "General Public", "2"), ("GPL-3.0", "General Public", "3"), ("LGPL-2.1", "Lesser General Public", "2.1"), ("LGPL-3.0", "Lesser General Public", "3"), ("AGPL-3.0", "Affero General Public", "3"))
_CC = (("BY", "Attribution"), ("BY-NC", "Attribution-NonCommercial"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
_TEXTS = {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}

#: Titles, notices and identifiers as they head files; a licence has several. An unversioned GNU title is "GPL".
HEADERS = (
    ("Apache-2.0", "Apache License"), ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"), ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE + ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-3-Clause", _TEXTS["BSD-3-Clause"]),
    ("GPL", "GNU General Public License"), ("GPL-2.0", "GNU General Public License Version 2, June 1991"), ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"), ("MIT", "MIT License"), ("MIT", "The MIT License (MIT)"), ("MIT", _TEXTS["MIT"]), ("MIT", _TEXTS["MIT"].split("\n\n")[1]),
    ("MPL-2.0", "Mozilla Public License Version 2.0"), ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *[(i, f"GNU {x} License version {v}") for i, x, v in _GNU],
    *[(i, _GPL.format("This program", x, v) + t) for i, x, v in _GNU for t in ("", _NO_WARRANTY.format(x))],
    *[(f"CC-{i}-4.0", t) for i, x in _CC for t in (f"Licensed under CC {i} 4.0.", f"Creative Commons {x} 4.0 International Public License", f"This work is licensed under a Creative Commons {x} 4.0 International License. http://creativecommons.org/licenses/{i.lower()}/4.0/")],
    *[(i, f"SPDX-License-Identifier: {i}") for i in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MIT", "MPL-2.0", *[x[0] for x in _GNU], *[f"CC-{x[0]}-4.0" for x in _CC])],
)
#: Full texts of licences.
FULL = tuple(_TEXTS.items())
#: Lines of the run of comments at the head of a file.
COMMENT = r"^\s*($|#|//|/\*|\*|--|;|%|<!--)"


#: Words that ordinary texts have: they become anchors only where a template has hardly any others.
COMMON = frozenset("a an and any as at be by can do for free from have in is it its may not of on or that the this to under with without you your".split())


def terms_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


class Weights:
    """idf of template terms, of other terms, and each template's weights, norm and anchors."""

    def __init__(self, templates: list[tuple[str, str]], least: float) -> None:
        if sum(len(t.encode()) for _, t in templates) > TEMPLATE_BYTES:
            raise ValueError("the templates are larger than TEMPLATE_BYTES; scan with parts of them and keep the best")
        n = len(templates)
        df = Counter(w for _, t in templates for w in set(terms_of(t)))
        self.other = math.log(1 + n) + 1
        self.idf = {w: math.log((1 + n) / (1 + k)) + 1 for w, k in df.items()}
        self.rows, anchors = [], set()
        for name, text in templates:
            count = Counter(terms_of(text))
            weight = {w: (1 + math.log(k)) * self.idf[w] for w, k in count.items()}
            norm = math.sqrt(sum(x * x for x in weight.values()))
            self.rows += [(name, w, x / norm) for w, x in sorted(weight.items())]
            rest = dict(weight)
            for w in sorted(weight, key=lambda w: (w in COMMON, w not in anchors, -len(w), w)):  # long words are rare in other texts
                if math.sqrt(sum(x * x for x in rest.values())) < least * norm * (1 - 1e-9):
                    break
                anchors.add(w)
                del rest[w]
        self.anchors = sorted(anchors)


def _terms(c: str | Column) -> Column:
    return F.split(c, "[^a-z0-9]+")


def _list(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _words(c: str, w: Weights, least: float) -> Column:
    """The terms of a unit that has an anchor and may reach ``least``, exploded; else a null.

    Of the squared norm of a unit within reach, terms of templates have a share of least ** 2 or more. With n of a term,
    (1 + ln n) ** 2 <= 1.5 n, so the distinct other terms are at most ``most`` times the terms of templates. Those of a low
    idf, the words that every text has, count as the share that they can have at most.
    """
    top = max(w.idf.values())
    weak = [t for t, x in w.idf.items() if x <= w.other / 2]
    strong = [t for t in w.idf if t not in set(weak)]
    most = 1.5 * (top / w.other) ** 2 * (1 / least**2 - 1) * (1 + 1e-9)
    share = max((w.idf[t] for t in weak), default=0.0) ** 2 / top**2

    def kept(x: Column) -> Column:
        other = F.size(F.array_except(x, _list([*w.idf, ""])))
        count = lambda words: F.size(F.filter(x, lambda t: t.isin(words))) if words else F.lit(0)
        return F.when(F.arrays_overlap(x, _list(w.anchors)) & (other <= (count(strong) + count(weak) * F.lit(share)) * F.lit(most)), F.filter(x, lambda t: t != ""))

    # bound to a variable, so that the text is split once only; the outer form has no filter inferred that would split it again
    return F.explode_outer(F.get(F.transform(F.array(_terms(c)), kept), F.lit(0))).alias("term")


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(id, license, score, line) of the files with a licence of their own. ``files`` has id and text."""
    spark, w = files.sparkSession, Weights(list(templates), least)
    if not w.anchors:
        return files.select("id").limit(0).selectExpr("id", "string(null) license", "double(null) score", "int(null) line")
    low = files.where("id is not null and text is not null").select("id", F.lower(F.col("text").cast("string")).alias("text"))
    line = low.select("id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    word = line.select("id", "line", _words("s", w, least)).where("term is not null")
    count = materialize(word.groupBy("id", "line", "term").agg(F.count("*").alias("n")), "license-lines")
    idf = F.create_map(*[F.lit(x) for p in w.idf.items() for x in p])
    count = count.withColumn("weight", (1 + F.log("n")) * F.coalesce(idf[F.col("term")], F.lit(w.other)))
    shares = spark.createDataFrame(w.rows, "license string, term string, share double")  # of bounded size, see TEMPLATE_BYTES
    norm = count.groupBy("id", "line").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dot = count.join(F.broadcast(shares), "term").groupBy("id", "line", "license").agg(F.sum(F.col("weight") * F.col("share")).alias("dot"))
    score = dot.join(norm, ["id", "line"]).select("id", "line", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= least)
    best = score.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("low"), "line", "license")).alias("x"))
    return best.select("id", F.col("x.license").alias("license"), (-F.col("x.low")).alias("score"), F.col("x.line").alias("line"))


def _units(files: DataFrame) -> DataFrame:
    """(id, unit, no, s) of texts in lower case: lines, blocks and heads of several lines, and whole licence files."""
    lines = F.split("text", "\n")
    code = F.array_position(F.transform(lines, lambda x: ~x.rlike(COMMENT)), F.lit(True)).cast("int")
    head = F.array_join(F.when(code > 0, F.slice(lines, 1, code - 1)).otherwise(lines), "\n")
    several = lambda xs: F.filter(xs, lambda x: F.contains(F.trim(x), F.lit("\n")))
    name = F.element_at(F.split("path", "/"), -1)
    kinds = {"line": lines, "block": several(F.split("text", r"\n\s*\n")), "head": several(F.array(head)), "file": F.when(name.rlike(LICENCE_FILE), F.array("text")).otherwise(F.array())}
    unit = lambda k: lambda s, i: F.struct(F.lit(k).alias("unit"), i.alias("no"), s.alias("s"))
    every = F.concat(*[F.transform(x, unit(k)) for k, x in kinds.items()])
    return files.select("id", F.explode_outer(every).alias("u")).select("id", "u.*").where("s is not null")


def _best(units: DataFrame, templates: list[tuple[str, str]], least: float) -> DataFrame:
    """(id, license, score, unit, no) of the units that reach ``least``. Of a licence with several templates each counts."""
    spark, w = units.sparkSession, Weights([(f"{i}\n{name}", text) for i, (name, text) in enumerate(templates)], least)
    word = units.select("id", "unit", "no", _words("s", w, least)).where("term is not null")
    count = materialize(word.groupBy("id", "unit", "no", "term").agg(F.count("*").alias("n")), "license-units")
    by_term: dict[str, list] = {t: [] for t in w.idf}
    for key, t, share in w.rows:
        by_term[t].append((key, share))
    terms = spark.createDataFrame([(t, w.idf[t], x) for t, x in by_term.items()], "term string, idf double, t array<struct<key: string, share: double>>")  # of bounded size
    count = count.join(F.broadcast(terms), "term", "left").withColumn("weight", (1 + F.log("n")) * F.coalesce("idf", F.lit(w.other)))
    unit = ["id", "unit", "no"]
    norm = count.groupBy(*unit).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dot = count.where("t is not null").select(*unit, "weight", F.inline("t")).groupBy(*unit, "key").agg(F.sum(F.col("weight") * F.col("share")).alias("dot"))
    return dot.join(norm, unit).select("id", F.substring_index("key", "\n", -1).alias("license"), F.round(F.col("dot") / F.col("norm"), 6).alias("score"), "unit", "no").where(F.col("score") >= least)


def own_licenses(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(id, t, license, score) of the files (id, path, text) with a licence of their own, by lines, headers or full text.

    ``t`` is the hash of the text: files of one id are told apart by it.

    Ties: by name. Without templates there are no licences.
    """
    low = files.where("id is not null and text is not null").select(F.struct("id", F.xxhash64("text").alias("t")).alias("id"), "path", F.lower(F.col("text").cast("string")).alias("text"))
    if not templates:
        return low.limit(0).selectExpr("id.id", "id.t", "string(null) license", "double(null) score")
    anchors = {a for x in (list(templates), [(f"{i}\n{name}", text) for i, (name, text) in enumerate(HEADERS)], [(f"{i}\n{name}", text) for i, (name, text) in enumerate(FULL)]) for a in Weights(x, least).anchors}
    low = materialize(low.where(F.arrays_overlap(_terms("text"), _list(sorted(anchors)))), "license-candidates")
    by_line = scan(low.select("id", "text"), templates, least).select("id", "license", "score")
    by_header = _best(_units(low), HEADERS, least)
    whole = low.where(F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE)).select("id", F.lit("file").alias("unit"), F.lit(0).alias("no"), F.col("text").alias("s"))
    every = by_line.unionByName(by_header.select("id", "license", "score")).unionByName(_best(whole, FULL, least).select("id", "license", "score"))
    best = every.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("low"), "license")).alias("x"))
    return materialize(best.select("id.id", "id.t", F.col("x.license").alias("license"), (-F.col("x.low")).alias("score")), "licenses")


def folders(path: Column) -> Column:
    """Array of the directories above a path, the nearest first; '' is the root."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.transform(F.sequence(n - 1, F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def license_files(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """Per row of ``files`` (id, path, text): id, path, license, origin ('own', 'inherited' or null), from_dir, score."""
    own = own_licenses(files, templates, least)
    named = files.select("id", "path", F.xxhash64("text").alias("t")).join(own, ["id", "t"], "left")
    name, folder = F.element_at(F.split("path", "/"), -1), F.regexp_replace("path", r"/?[^/]*$", "")
    licensed = named.where(F.col("license").isNotNull() & name.rlike(LICENCE_FILE))
    of_dir = licensed.groupBy(folder.alias("dir")).agg(F.min(F.struct((-F.col("score")).alias("low"), "license", "path")).alias("x")).select("dir", F.col("x.license").alias("dir_license"))
    dirs = files.where("path is not null").select(folder.alias("own_dir")).distinct()
    step = dirs.select("own_dir", F.posexplode(folders(F.concat("own_dir", F.lit("/x")))).alias("depth", "dir"))
    near = step.join(of_dir, "dir").groupBy("own_dir").agg(F.min(F.struct("depth", "dir", "dir_license")).alias("n")).select("own_dir", "n.dir", "n.dir_license")
    both = named.withColumn("own_dir", folder).join(near, "own_dir", "left")
    mine = F.col("license").isNotNull()
    return both.select(
        "id", "path", F.coalesce("license", "dir_license").alias("license"), F.when(mine, "own").when(F.col("dir_license").isNotNull(), "inherited").alias("origin"), F.when(~mine, F.col("dir")).alias("from_dir"), F.col("score")
    )


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source / thousands of the id / hundreds / name; one in a hundred is a licence file."""
    i = F.col("doc_id").cast("long")
    name = F.when(F.pmod(i, F.lit(100)) == 50, F.lit("LICENSE")).otherwise(F.concat(F.lit("f"), i.cast("string"), F.lit(".txt")))
    top = F.floor(i / 1000).cast("string")
    below = F.when(F.pmod(i, F.lit(1000)) < 100, F.concat(F.lit("m"), top)).otherwise(F.concat(F.lit("m"), top, F.lit("/p"), F.floor(F.pmod(i, F.lit(1000)) / 100).cast("string")))
    return docs.select(i.alias("id"), F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), below, F.lit("/"), name).alias("path"), "text")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, path, license, origin, from_dir, score in millionths."""
    found = license_files(document_files(read(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), "path", "license", "origin", "from_dir", F.round(F.col("score") * 1_000_000).cast("long").alias("score_ppm"))
