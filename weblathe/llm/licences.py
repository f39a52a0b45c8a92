"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along paths.

What a file says of its licence is read in units of three kinds: the whole file, where its name or a
phrase that opens licence texts tells that it may be one; its paragraphs (parted by lines without
letters and digits, so comment signs don't matter) that name a licence, claim or grant rights; and its
single lines that do. Each distinct unit becomes a sparse TF-IDF vector (document frequencies over all
units of the corpus, repeats counted) and is matched to the template of greatest cosine, if that
reaches ``THRESHOLD``. A file's own licence is that of its matched unit of the widest kind, then of the
greatest cosine: a notice over several lines comes before a line of it. A file is a licence file, and
licenses its directory, by its name or if its matched unit is at least ``FILE_SHARE`` of its words;
files without an own licence inherit from the nearest ancestor directory that has one, found by
joining the prefixes of their path.

DataFrame operations only. Units repeated in very many files are counted before any vector is made;
the licence of a unit and of a directory are written tables, so Spark broadcasts them where they are
small and splits skewed keys (a line or a directory of very many files) where they aren't. Only the
table of templates, a constant, is broadcast by hint.

Rows that share a path are one file. Null texts have no units; null parts of a path are "_".
Equal cosines: the first licence by name. Directories whose licence files disagree take the licence
of most files, then the first by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

THRESHOLD = 0.6
FILE_SHARE = 0.2  # words of the matched unit / words from which a file counts as a licence file
OPENING = r"(?i)permission is hereby granted|permission to use, copy, modify|redistribution and use in source|free and unencumbered software|general public license|apache license|mozilla public license"
CUE = r"(?i)licen[sc]|copyright|rights reserved|creative commons|public domain|permission is hereby granted|permission to use|redistribution and use|free software|names of its contributors"
BLANK = r"\n[^a-zA-Z0-9\n]*\n"
TERM = r"[a-z0-9]+(\.[0-9]+)?"
WORD = r"[^\x20\x09-\x0D]+"
FILE_NAME = r"(?i)^(licen[sc]e|copying|unlicense)([._-].*)?$"

# The wording of licence texts.
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
MIT_DISCLAIMER = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
ISC_TEXT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
    "permission notice appear in all copies."
)
APACHE_NOTICE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
    "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
GNU_NOTICE = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; "
    "either version {} of the License, or (at your option) any later version."
)
MPL_NOTICE = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
UNLICENSE_TEXT = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
    "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)

# Licence names and the wording of their statements, notices and texts.
TEMPLATES = (
    ("all-rights-reserved", "All rights reserved"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", APACHE_NOTICE),
    ("apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("bsd-2-clause", f"{BSD_GRANT} 1. {BSD_SOURCE} 2. {BSD_BINARY} {BSD_DISCLAIMER}"),
    ("bsd-3-clause", "Released under the BSD 3-Clause License"),
    ("bsd-3-clause", BSD_NAMES),
    ("bsd-3-clause", f"{BSD_GRANT} 1. {BSD_SOURCE} 2. {BSD_BINARY} 3. {BSD_NAMES} {BSD_DISCLAIMER}"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-2.0", GNU_NOTICE.format("", 2)),
    ("gpl-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", GNU_NOTICE.format("", 3)),
    ("gpl-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("isc", ISC_TEXT),
    ("lgpl-2.1", GNU_NOTICE.format("Lesser ", 2.1)),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("lgpl-3.0", GNU_NOTICE.format("Lesser ", 3)),
    ("mit", "Released under the MIT License"),
    ("mit", MIT_GRANT),
    ("mit", f"{MIT_GRANT} {MIT_NOTICE} {MIT_DISCLAIMER}"),
    ("mpl-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0"),
    ("mpl-2.0", MPL_NOTICE),
    ("unlicense", UNLICENSE_TEXT),
)


def templates(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(i).alias("template"), F.lit(name).alias("licence"), F.lit(text).alias("line")) for i, (name, text) in enumerate(TEMPLATES)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def terms(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, term, tf) of each line."""
    words = lines.select(*keys, F.explode(F.regexp_extract_all(F.lower("line"), F.lit(TERM), F.lit(0))).alias("term"))
    return words.groupBy(*keys, "term").agg(F.count("*").alias("tf"))


WHOLE, PARAGRAPH, LINE = 0, 1, 2


def statements(files: DataFrame) -> DataFrame:
    """(path, dir, named, n_words, kind, unit, line): every unit of every file that has one; from (path, text)."""
    cued = lambda parts: F.filter(parts, lambda part: part.rlike(CUE))
    named = F.element_at(F.split("path", "/"), -1).rlike(FILE_NAME)
    lines = F.split("text", "\n")
    said = F.aggregate(cued(lines), F.lit(0), lambda n, line: n + F.regexp_count(line, F.lit(WORD)))
    n_words = F.regexp_count("text", F.lit(WORD))
    whole = named | F.col("text").rlike(OPENING) | (said >= n_words * FILE_SHARE)
    unit = lambda kind, line: F.struct(F.lit(kind).alias("kind"), line.alias("line"))
    units = F.concat(
        F.when(whole, F.array(unit(WHOLE, F.col("text")))).otherwise(F.array().cast("array<struct<kind: int, line: string>>")),
        F.transform(cued(F.split("text", BLANK)), lambda part: unit(PARAGRAPH, part)),
        F.transform(cued(lines), lambda line: unit(LINE, line)),
    )
    found = files.where(F.col("text").rlike(CUE)).select("path", parent("path").alias("dir"), named.alias("named"), n_words.alias("n_words"), F.inline(units))
    return found.withColumn("unit", F.md5(F.col("line").cast("binary")))


def parent(path: str) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def classify(lines: DataFrame, total: int) -> DataFrame:
    """(unit, licence, score, words) of each distinct unit (unit, line, n; ``total`` is the sum of n) that reaches the threshold."""
    spark = lines.sparkSession
    known = templates(spark)
    line_terms = terms(lines, "unit", "n")
    frequency = line_terms.groupBy("term").agg(F.sum("n").alias("df"))
    weigh = F.log(F.lit(1.0 + total) / (1 + F.coalesce("df", F.lit(0)))) + 1
    mine = line_terms.join(frequency, "term").select("unit", "term", (F.col("tf") * weigh).alias("w"))
    theirs = terms(known, "template", "licence").join(frequency, "term", "left")
    theirs = theirs.select("template", "licence", "term", (F.col("tf") * weigh).alias("v"))
    theirs = theirs.withColumn("v_norm", F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("template"))))
    norms = mine.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("w_norm"))
    dots = mine.join(F.broadcast(theirs), "term").groupBy("unit", "template", "licence", "v_norm").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = dots.join(norms, "unit").select("unit", "licence", F.round(F.col("dot") / (F.col("w_norm") * F.col("v_norm")), 6).alias("score"))
    best = scored.where(F.col("score") >= THRESHOLD).groupBy("unit").agg(F.min_by(F.struct("licence", "score"), F.struct(-F.col("score"), "licence")).alias("best"))
    return best.select("unit", "best.licence", "best.score")


def directory_licences(own: DataFrame) -> DataFrame:
    """(dir, licence) from the licence files in ``own`` (path, dir, is_file, licence)."""
    votes = own.where("is_file").groupBy("dir", "licence").agg(F.count("*").alias("n"))
    return votes.groupBy("dir").agg(F.min_by("licence", F.struct(-F.col("n"), "licence")).alias("licence"))


def nearest(dirs: DataFrame, licensed: DataFrame) -> DataFrame:
    """For each directory the licence of its nearest licensed ancestor, itself included: (dir, licence, from)."""
    parts = F.split("dir", "/")
    steps = dirs.select("dir", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
    ancestors = steps.withColumn("from", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    found = ancestors.join(licensed.withColumnRenamed("dir", "from"), "from")
    deepest = found.groupBy("dir").agg(F.max_by(F.struct("licence", "from"), "depth").alias("best"))
    return deepest.select("dir", "best.licence", "best.from")


def scan_licences(files: DataFrame) -> DataFrame:
    """``files`` (path, text and any other columns, text left out) with own_licence, own_score, licence, inherited_from."""
    names = ("own_licence", "own_score", "licence", "inherited_from")
    rest = files.drop("text", *names)
    said = statements(files.select("path", "text"))
    distinct = written(said.groupBy("unit").agg(F.any_value("line").alias("line"), F.count("*").alias("n")), "units")
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    matched = written(classify(distinct, total), "matched")
    words = F.regexp_count("line", F.lit(WORD))
    place = said.select("path", "dir", "named", "kind", "unit", (words >= F.col("n_words") * FILE_SHARE).alias("much"))
    hits = place.join(matched, "unit").groupBy("path", "dir", "named")
    best = hits.agg(F.min_by(F.struct("licence", "score", "much"), F.struct("kind", -F.col("score"), "licence")).alias("best"))
    own = written(best.select("path", "dir", (F.col("named") | F.col("best.much")).alias("is_file"), "best.licence", "best.score"), "own")
    placed = rest.withColumn("dir", parent("path")) if "dir" not in rest.columns else rest.withColumnRenamed("dir", "_dir").withColumn("dir", parent("path"))
    near = nearest(placed.select("dir").distinct(), directory_licences(own))
    near = written(near.select("dir", F.col("licence").alias("_near"), F.col("from").alias("_from")), "near")
    mine = own.select("path", F.col("licence").alias("own_licence"), F.col("score").alias("own_score"))
    out = placed.join(mine, "path", "left").join(near, "dir", "left")
    inherits = F.col("own_licence").isNull()
    columns = [F.col("_dir").alias("dir") if c == "dir" else F.col(c) for c in rest.columns]
    return out.select(
        *columns, "own_licence", "own_score", F.coalesce("own_licence", "_near").alias("licence"), F.when(inherits, F.col("_from")).alias("inherited_from")
    )


def document_path() -> Column:
    """Documents as files: /source/lang/thousands of the id/id.txt."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    shelf = F.coalesce(F.expr("cast(doc_id div 1000 as string)"), F.lit("_"))
    return F.concat(F.lit("/"), part("source"), F.lit("/"), part("lang"), F.lit("/"), shelf, F.lit("/"), part("doc_id"), F.lit(".txt"))


def licence_report(docs: DataFrame) -> DataFrame:
    """doc_id, path, own_licence, own_score, licence and inherited_from of every document."""
    return scan_licences(docs.select("doc_id", document_path().alias("path"), "text"))
