import math
import random
import re

from lotline.llm import licenses
from tests.llm.data import documents, texts

MIT, GPL = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."


def brute_runs(text):
    """Headers, paragraphs, runs of one to three lines, by plain loops."""
    lines = text.split("\n")
    header = []
    for line in lines:
        if not re.match(licenses.COMMENT, line):
            break
        header.append(line)
    runs, block = ["\n".join(header)], []
    for line in [*lines, ""]:
        if any(c.isascii() and c.isalnum() for c in line):
            block.append(line)
        else:
            runs.append("\n".join(block))
            block = []
    return runs + ["\n".join(lines[i : i + n]) for i in range(len(lines)) for n in range(1, 4)]


def brute_scores(files, templates=licenses.TEMPLATES + licenses.TEXTS):
    """The best licence and cosine of each file's runs, every run against every template, and whether it is a licence as a whole."""
    parts = licenses._template_terms
    known = {t for _, text in templates for t in parts(text)}
    df = {t: sum(t in parts(x or "") for _, x in files) for t in known}
    idf = {t: math.log((len(files) + 1) / (df[t] + 1)) + 0.1 for t in known}
    other = sum(idf.values()) / len(idf)
    vector = lambda text: {t: parts(text).count(t) * idf.get(t, other) for t in set(parts(text))}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    longest = max(len(parts(t)) for _, t in templates)
    out = {}
    for path, text in files:
        text = text or ""
        runs = [(r, licenses.LEAST_COSINE) for r in brute_runs(text)]
        if len(parts(text)) <= licenses.LONGEST * longest:
            runs.append((text, licenses.LICENCE_FILE_COSINE))
        for run, least in runs:
            u = vector(run)
            for name, template in templates:
                v = vector(template)
                if u and v:
                    cosine = round(sum(x * v.get(t, 0) for t, x in u.items()) / size(u) / size(v), 9)
                    if cosine >= least:
                        best, whole = out.get(path, ((0, ""), False))
                        out[path] = min(best, (-cosine, name)), whole or least == licenses.LICENCE_FILE_COSINE
    return out


LONG = " ".join(["some other words of a long file that declares nothing"] * 12)
FILES = [
    ("a/LICENSE", MIT + "\n" + LONG),
    ("a/x.txt", LONG),
    ("a/b/c/y.txt", LONG),
    ("a/b/notice", f"words\n{GPL.upper()}"),
    ("a/b/z.txt", f"{LONG}\n# {GPL}\n{LONG}"),
    ("d/e.txt", f"{LONG}\nlicensed under the apache license version 2"),
    ("d/f.txt", None),
    ("d/g.txt", ""),
    ("top.txt", "the license of the work is not said here, version 7"),
    ("aa/x.txt", LONG),
    ("a/b/copying", "Licensed under CC BY-NC 4.0."),
]


def brute_scan(files, scores):
    """``{path: (license, origin, from_path)}``: the nearest directory upwards that has a licence file."""
    name = lambda p: p.rsplit("/", 1)[-1]
    above = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""
    is_file = {p for p, (_, whole) in scores.items() if whole or re.match(licenses.LICENCE_FILE_NAME, name(p))}
    out = {}
    for path, _ in files:
        if path in scores:
            out[path] = scores[path][0][1], "file" if path in is_file else "header", path
            continue
        directory = above(path)
        while True:
            given = sorted((scores[p][0][0], p) for p in is_file if above(p) == directory)
            if given or not directory:
                break
            directory = above(directory)
        out[path] = (scores[given[0][1]][0][1], "inherited", given[0][1]) if given else (None, None, None)
    return out


def test_declared_and_inherited(spark):
    rng = random.Random(6)
    folders = ["a", "a/b", "a/b/c", "d", "d/e/f", "a/b/c/d/e"]
    texts_of = [MIT, GPL, LONG, LONG, "", "Licensed under CC BY-NC 4.0.", licenses.TEXTS[0][1], f"{LONG}\n{GPL}"]
    more = [(f"{folder}/{k}".lstrip("/"), rng.choice(texts_of)) for folder in folders for k in range(5)]
    files = FILES + more
    docs = spark.createDataFrame(files + [(None, MIT), (None, LONG)], "path string, text string")
    got = licenses.scan(docs.selectExpr("path AS p", "text", "'odd' AS path", "'odd' AS key", "'odd' AS license", "'odd' AS whole"), path_col="p").collect()
    rows = {r.path: r for r in got if r.path is not None}
    scores = brute_scores(files + [("\0", MIT), ("\0\0", LONG)])
    want = brute_scan(files, {p: x for p, x in scores.items() if "\0" not in p})
    assert {p: (r.license, r.origin, r.from_path) for p, r in rows.items()} == want
    assert all(rows[p].similarity == -scores[p][0][0] for p in rows if p in scores)
    assert {o for _, o, _ in want.values()} == {"file", "header", "inherited", None}
    assert rows["a/LICENSE"].origin == "file" and rows["a/b/z.txt"].origin == "header"
    assert sorted((r.license or "", r.origin or "") for r in got if r.path is None) == [("", ""), ("MIT", "header")]
    assert len(got) == len(files) + 2


GPL_HEADER = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
#
# You should have received a copy of the GNU General Public License
# along with this program.  If not, see <https://www.gnu.org/licenses/>.
import sys
"""
APACHE_HEADER = """/*
 * Copyright 2019 Somebody
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 */
package x;
"""


def test_usual_headers_and_full_texts(spark):
    text_of = lambda name, k=0: [t for n, t in licenses.TEXTS if n == name][k]

    def wrapped(text, before="", width=70):
        out, line = [], ""
        for word in text.split():
            if len(line) + len(word) > width:
                out.append(before + line)
                line = ""
            line = f"{line} {word}".strip()
        return "\n".join([*out, before + line])

    files = [
        ("h/gpl.py", GPL_HEADER + LONG, "GPL-3.0", "header"),
        ("h/apache.java", APACHE_HEADER + LONG, "Apache-2.0", "header"),
        ("h/gpl_broken.c", f"int x;\n// This work is licensed under the GNU General\n// Public License, version 3.\n{LONG}", "GPL-3.0", "header"),
        ("h/bsd_broken.go", "// Copyright 2009 The Authors. All rights reserved.\n// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\n\n" + LONG, "BSD-3-Clause", "header"),
        ("h/mit_line.txt", f"{LONG}\nReleased under the MIT License.\n{LONG}", "MIT", "header"),
        ("m/terms", "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + wrapped(text_of("MIT")), "MIT", "file"),
        ("b3/terms", "Copyright (c) 2020, Somebody\nAll rights reserved.\n\n" + wrapped(text_of("BSD-3-Clause")), "BSD-3-Clause", "file"),
        ("b2/terms", "Copyright (c) 2020, Somebody\nAll rights reserved.\n\n" + wrapped(text_of("BSD-2-Clause")), "BSD-2-Clause", "file"),
        ("ap/LICENSE", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n" + LONG, "Apache-2.0", "file"),
        ("g3/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n" + wrapped(text_of("GPL-3.0", 1).split("2007 ", 1)[1]) + "\n\n" + LONG, "GPL-3.0", "file"),
        *((f"other/{i}", LONG + f"\nsome word {i} and another license word", None, None) for i in range(30)),
    ]
    got = {r.path: (r.license, r.origin) for r in licenses.scan(spark.createDataFrame([f[:2] for f in files], "path string, text string")).collect()}
    assert got == {path: (name, origin) for path, _, name, origin in files}


def test_heavy_terms_lose_nothing():
    vector = {"a": 0.8, "b": 0.5, "c": 0.33, "d": 0.05}
    heavy = licenses.heavy_terms(vector, 0.8)
    assert heavy == ["a"] and math.sqrt(sum(x * x for t, x in vector.items() if t not in heavy)) < 0.8


def test_repeats_empty_and_native(spark):
    rows = documents(spark, texts(31, 25)).selectExpr("concat('p/', doc_id) AS path", "text")
    found = licenses.scan(rows.union(rows))
    assert found.count() == 50 and found.where("license IS NOT NULL").count() == 0
    assert licenses.scan(rows.limit(0)).collect() == []
    twice = spark.createDataFrame([("a/x", MIT), ("a/x", LONG)], "path string, text string")
    full = licenses.scan(twice)
    assert {r.license for r in full.collect()} == {"MIT"}
    plan = full._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
