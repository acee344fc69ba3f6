"""Licences of files: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

DataFrame functions only. What is compared is a run of a file's text: its header (the comment lines that
it begins with), each paragraph, each run of up to ``RUN_LINES`` lines within it, and the file as a whole
if it is no longer than licences are. Signs that mark comments are no terms, so a statement may go over
several comment lines. The templates are statements, the usual headers and full texts.

Terms are weighted by their document frequency over all files; terms that no template has count as
rare as those of the templates on average, so a run about something else is not similar for a few words.
A run can only reach the least cosine if it has one of the heaviest terms of a template (the others
together are too light), so only files with such a term are cut into runs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotline.operators.skew import join_lookup
from lotline.storage import keep

LEAST_COSINE = 0.8
#: A file whose whole text is so similar to a template is a licence file, as is one with such a name that has a licence.
LICENCE_FILE_COSINE = 0.5
LICENCE_FILE_NAME = r"(?i)^(licen[cs]e|copying|unlicense)([._-].*)?$"
#: Lines that are looked at together besides headers and paragraphs.
RUN_LINES = 3
#: A whole file is compared up to so many times the terms of the longest template.
LONGEST = 2
COMMENT = r"^\s*(#|//|/\*|\*|;|--|%|<!--|\.\.|rem\s)"

# Statements by which files declare a licence, several for one.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_NO_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "


def _gnu(name: str, version: str, work: str = "program") -> str:
    return (
        f"This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, "
        f"either version {version} of the License, or (at your option) any later version. This {work} is distributed in the hope that it will be useful, but WITHOUT "
        f"ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. "
        f"You should have received a copy of the GNU {name} along with this {work}. If not, see <https://www.gnu.org/licenses/>."
    )


def _gnu_start(name: str, version: str, day: str, year: str) -> str:
    return (
        f"GNU {name} Version {version}, {day} {year} Copyright (C) {year} Free Software Foundation, Inc. <https://fsf.org/> "
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    )


_GENERAL, _LESSER, _AFFERO = "General Public License", "Lesser General Public License", "Affero General Public License"

# The usual headers, full texts of short licences, and how the long ones begin.
TEXTS = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
     "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
     "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
     "permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
     "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
     "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
     "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", _BSD + _AS_IS),
    ("BSD-3-Clause", _BSD + _NO_NAMES + _AS_IS),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD + _NO_NAMES),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
     "notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy "
     "of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is "
     "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
     "permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", _gnu(_GENERAL, "3")),
    ("GPL-2.0", _gnu(_GENERAL, "2")),
    ("LGPL-3.0", _gnu(_LESSER, "3", "library")),
    ("AGPL-3.0", _gnu(_AFFERO, "3")),
    ("GPL-3.0", _gnu_start(_GENERAL, "3", "29 June", "2007")),
    ("GPL-2.0", _gnu_start(_GENERAL, "2", "June", "1991")),
    ("LGPL-3.0", _gnu_start(_LESSER, "3", "29 June", "2007")),
    ("AGPL-3.0", _gnu_start(_AFFERO, "3", "19 November", "2007")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
     "You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
     "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)


def terms(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")


def _template_terms(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def _weights(files: DataFrame, templates: tuple[tuple[str, str], ...]) -> dict[str, float]:
    """Inverse document frequency of the templates' terms over all files: as many rows as the templates have terms."""
    known = sorted({t for _, text in templates for t in _template_terms(text)})
    found = F.array_intersect(terms(F.col("text")), F.array(*map(F.lit, known)))
    # The empty term counts the files.
    counted = files.select(F.explode(F.concat(F.array(F.lit("")), found)).alias("term")).groupBy("term").count().collect()
    df = {r.term: r["count"] for r in counted}
    # A term of every file still has a little weight, so that few files can be told apart too.
    return {t: math.log((df.get("", 0) + 1) / (df.get(t, 0) + 1)) + 0.1 for t in known}


def _vectors(templates: tuple[tuple[str, str], ...], idf: dict[str, float]) -> list[dict[str, float]]:
    """Each template as a vector of length 1; without weight it stays empty."""
    out = []
    for _, text in templates:
        parts = _template_terms(text)
        raw = {t: parts.count(t) * idf[t] for t in set(parts)}
        size = math.sqrt(sum(x * x for x in raw.values()))
        out.append({t: x / size for t, x in raw.items() if x > 0} if size else {})
    return out


def heavy_terms(vector: dict[str, float], least: float) -> list[str]:
    """The fewest heaviest terms without which no vector has a cosine of ``least``."""
    ordered = sorted(vector.items(), key=lambda x: (-x[1], x[0]))
    left = sum(x * x for _, x in ordered)
    chosen = []
    for term, x in ordered:
        if left < least * least * (1 - 1e-9):
            break
        chosen.append(term)
        left -= x * x
    return chosen


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _ancestors(directory: Column) -> Column:
    """The directory and all above it, the root (an empty name) included."""
    parts = F.split(directory, "/")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))


def _has(text: Column, words: list[str]) -> Column:
    """Whether a text has one of some terms."""
    return F.coalesce(F.lower(text), F.lit("")).rlike("(?<![a-z0-9])(" + "|".join(words) + ")(?![a-z0-9])")


def _among(text: Column, words: list[str]) -> Column:
    """The same for whole texts: to split a long text is less work than to try each of its places."""
    return F.arrays_overlap(terms(text), F.array(*map(F.lit, words)))


def _runs(files: DataFrame, heavy: list[str], heavy_whole: list[str], longest: int) -> DataFrame:
    """``path, run, whole``: the runs of the files' texts that have a heavy term."""
    lines = F.split("text", "\n")
    # The header ends before the first line that is no comment.
    other = F.array_position(F.transform(lines, lambda line: line.rlike(COMMENT)), False)
    header = F.array_join(F.slice(lines, 1, F.when(other > 0, other - 1).otherwise(F.size(lines)).cast("int")), "\n")
    paragraphs = F.split("text", r"\n[^A-Za-z0-9\n]*\n")
    few = F.transform(
        F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: _has(F.array_join(F.slice(lines, i, RUN_LINES), "\n"), heavy)),
        lambda i: F.transform(F.sequence(F.lit(1), F.lit(RUN_LINES)), lambda n: F.array_join(F.slice(lines, i, n), "\n")),
    )
    some = files.where(_among(F.col("text"), heavy)).select(
        "path", F.explode(F.array_distinct(F.concat(F.array(header), paragraphs, F.flatten(few)))).alias("run"), F.lit(False).alias("whole")
    )
    short = F.size(terms(F.col("text"))) <= longest * LONGEST
    whole = files.where(short & _among(F.col("text"), heavy_whole)).select("path", F.col("text").alias("run"), F.lit(True).alias("whole"))
    return some.where(_has(F.col("run"), heavy)).unionByName(whole)


def declared(files: DataFrame, templates: tuple[tuple[str, str], ...], least: float) -> DataFrame:
    """``path, license, similarity, whole`` of files with a run that reaches ``least``, or that are similar as a
    whole: the best run, the first name of ties; ``whole`` tells whether the file itself is a licence."""
    spark = files.sparkSession
    idf = _weights(files, templates)
    vectors = _vectors(templates, idf)
    heavy, heavy_whole = (sorted({t for v in vectors for t in heavy_terms(v, bound)}) for bound in (least, min(least, LICENCE_FILE_COSINE)))
    if not heavy:
        return spark.createDataFrame([], "path string, license string, similarity double, whole boolean")
    runs = _runs(files, heavy, heavy_whole, max(len(_template_terms(text)) for _, text in templates))
    # Written once: files are cut into runs a single time.
    keyed = keep(runs.select("path", "whole", "run", F.sha2("run", 256).alias("key")))
    # Equal runs of many files are scored once.
    once = keyed.groupBy("key").agg(F.any_value("run").alias("run"))
    weights = F.broadcast(spark.createDataFrame(list(idf.items()), "term string, idf double"))  # as long as the templates
    counted = once.select("key", F.explode(terms(F.col("run"))).alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias("n"))
    other = sum(idf.values()) / len(idf)
    tf = counted.join(weights, "term", "left").select("key", "term", (F.col("n") * F.coalesce("idf", F.lit(other))).alias("x"))
    entries = [(k, templates[k][0], t, x) for k, v in enumerate(vectors) for t, x in v.items()]
    table = F.broadcast(spark.createDataFrame(entries, "template int, license string, term string, y double"))
    size = tf.groupBy("key").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    dots = tf.join(table, "term").groupBy("key", "template", "license").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    cosine = dots.join(size, "key").select("key", "license", F.round(F.col("dot") / F.col("size"), 9).alias("similarity"))
    order = F.struct(-F.col("similarity"), F.col("license"))
    best = cosine.where(F.col("similarity") >= min(least, LICENCE_FILE_COSINE)).groupBy("key").agg(F.min_by(F.struct("license", "similarity"), order).alias("b"))
    of_run = join_lookup(keyed.select("path", "whole", "key"), best.select("key", "b.license", "b.similarity"), ["key"])
    enough = of_run.where(F.col("whole") | (F.col("similarity") >= least))
    return (
        enough.groupBy("path")
        .agg(F.min_by(F.struct("license", "similarity"), order).alias("b"), F.bool_or("whole").alias("whole"))
        .select("path", "b.license", "b.similarity", "whole")
    )


def scan(
    files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES + TEXTS, least: float = LEAST_COSINE, path_col: str = "path", text_col: str = "text"
) -> DataFrame:
    """``path, license, similarity, origin, from_path``, one row per row of ``files``.

    ``origin`` is ``file`` for a licence file (similar as a whole, or by its name), ``header`` for another
    file with a licence in its header, a paragraph or a few of its lines, ``inherited`` for one that has none
    but lies at or below the directory of a licence file (the nearest; in one directory the best match,
    then the first path), else null. Null and empty texts
    declare nothing. Rows with the same path are one file with all their runs; a null path declares
    for itself only and inherits nothing. Empty tables give no rows; other columns are not read.
    """
    rows = files.select(F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    # Null paths get a key of their own each text, which is no directory's.
    key = F.coalesce(F.col("path"), F.concat(F.lit("\u0000"), F.sha2(F.coalesce("text", F.lit("")), 256)))
    keyed = rows.select("path", key.alias("key"), "text")
    found = declared(keyed.select(F.col("key").alias("path"), "text"), templates, least).withColumnRenamed("path", "key")
    name = F.regexp_extract("path", "[^/]*$", 0)
    each = keyed.select("path", "key", name.alias("name"), _directory(F.col("path")).alias("directory"))
    is_file = F.col("path").isNotNull() & F.coalesce(F.col("whole"), F.lit(False)) | F.coalesce(F.col("name").rlike(LICENCE_FILE_NAME), F.lit(False))
    own = join_lookup(each, found, ["key"], "left").withColumn("is_file", is_file).drop("name", "whole")
    by_directory = (
        own.where("license IS NOT NULL AND is_file")
        .groupBy("directory")
        .agg(F.min_by(F.struct("license", "similarity", "path"), F.struct(-F.col("similarity"), F.col("path"))).alias("given"))
        .withColumnRenamed("directory", "ancestor")
    )
    # Directories, not files, look their ancestors up.
    above = own.where("path IS NOT NULL").select("directory").distinct().select("directory", F.explode(_ancestors(F.col("directory"))).alias("ancestor"))
    nearest = join_lookup(above, by_directory, ["ancestor"]).groupBy("directory").agg(F.max_by("given", F.length("ancestor")).alias("given"))
    all_rows = join_lookup(own, nearest, ["directory"], "left")
    declared_here = F.col("license").isNotNull()
    origin = F.when(declared_here & F.col("is_file"), "file").when(declared_here, "header").when(F.col("given").isNotNull(), "inherited")
    return all_rows.select(
        "path",
        F.coalesce("license", "given.license").alias("license"),
        F.coalesce("similarity", "given.similarity").alias("similarity"),
        origin.alias("origin"),
        F.when(declared_here, F.col("path")).otherwise(F.col("given.path")).alias("from_path"),
    )
