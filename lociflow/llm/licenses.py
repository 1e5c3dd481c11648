"""Licence scans: Dice coefficient over word bigrams against licence templates. DataFrame functions only.

A text's segments are its lines, the sentences of lines of several, where it has blank lines its paragraphs, and runs of
neighbouring lines up to the whole text. A sentence counts only if its line doesn't match as a whole. A segment and a template are lower-cased (A-Z), runs of other characters than letters and digits of ASCII become blanks, and their sets of
word bigrams are compared. Dice of at least t asks for sizes between t / (2 - t) and (2 - t) / t of the
template's, so the join is an equi-join on the size, and a segment meets only templates that fit. Before
that, a segment must hold one of the templates' anchors: words that touch more of a template's bigrams than
a match may lack.

Runs of lines (lines without a word left out) are only formed in texts that hold as many of a template's bigrams as
a match needs; they begin where a bigram of the template does and have at most twice as many words as the largest
admissible size, repeated ones included. Of matching lines and runs that overlap the best one stands for
the passage (ties: fewer lines, licence, template, the first), then the best of those that don't overlap it, and so on; a run counts if it is one
of them and no paragraph. Lines and paragraphs count anyhow.

Defined results: null and empty texts, and segments of one word, match nothing; several segments of one licence
count together with the best one's values; a tie between templates goes to the smaller (licence, template);
repeated doc_ids count as one document; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociflow.llm.common import LOWER, UPPER, Scratch, ascii_lower

LEAST = 0.8
#: Words that are no anchors if others do.
COMMON = {"a", "and", "at", "by", "for", "in", "is", "of", "on", "or", "the", "this", "to", "with", "you"}
#: Lines of a block in which runs begin, and the mark for a line that no run can hold.
BLOCK, END = 256, "|"
SENTENCE_END = "[.!?;][ \t]+"
#: A template table with more (template, size) rows than this is joined without a broadcast.
BROADCAST_ROWS = 100_000

# Notices and paragraphs of public licences, (licence, template, text).
TEMPLATES = [
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "project", "This project is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header-1", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", "header-2", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "project", "This project is licensed under the MIT License."),
    ("MIT", "grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", "condition", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "warranty", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "header", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL", "warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-3.0", "notice", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "notice", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD", "grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "names", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "notice", "Released under the BSD 3-Clause License."),
    ("ISC", "grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("Unlicense", "grant", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "work", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "work", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "work", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("MIT", "spdx", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "spdx", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "spdx-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "spdx-later", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-3.0", "spdx-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "spdx-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("MPL-2.0", "spdx", "SPDX-License-Identifier: MPL-2.0"),
    ("BSD-2-Clause", "spdx", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "spdx", "SPDX-License-Identifier: BSD-3-Clause"),
    ("ISC", "spdx", "SPDX-License-Identifier: ISC"),
    ("Unlicense", "spdx", "SPDX-License-Identifier: Unlicense"),
    ("CC-BY-4.0", "spdx", "SPDX-License-Identifier: CC-BY-4.0"),
    ("CC-BY-SA-4.0", "spdx", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    ("Proprietary", "rights", "Copyright. All rights reserved."),
]


def words_of(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.translate(str.maketrans(UPPER, LOWER))).split()


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def anchors(text: str, least: float) -> list[str]:
    """The longest words, common ones last, whose bigrams are more than a match may lack: every match holds one of them."""
    bigrams = bigrams_of(text)
    lack = len(bigrams) - math.ceil(least / (2 - least) * len(bigrams) - 1e-9)
    chosen: list[str] = []
    for word in sorted(set(words_of(text)), key=lambda w: (w in COMMON, -len(w), w)):
        chosen.append(word)
        if sum(any(c in b.split() for c in chosen) for b in bigrams) > lack:
            break
    return chosen


def segments(docs: DataFrame, anchor: list[str]) -> DataFrame:
    """(doc_id, segment, sentence, words): the normalised words of each line and of each paragraph of several lines that hold an
    anchor, and of their sentences where there are several (0 is the whole)."""
    lines = F.split("text", "\n")
    paragraphs = F.filter(F.split("text", "\n[ \t\r]*\n"), lambda p: F.contains(p, F.lit("\n")))
    blank_lines = F.col("text").rlike("\n[ \t\r]*\n")
    parts = docs.select("doc_id", F.posexplode(F.when(blank_lines, F.concat(lines, paragraphs)).otherwise(lines)).alias("segment", "part"))
    likely = F.arrays_overlap("words", F.array(*map(F.lit, anchor)))
    parts = parts.withColumn("words", F.split(_plain(F.col("part")), " ")).filter(likely)
    sentences = F.split(F.when(~F.contains("part", F.lit("\n")), F.col("part")).otherwise(""), SENTENCE_END)
    pieces = F.when(F.size(sentences) > 1, F.transform(sentences, lambda x: F.split(_plain(x), " "))).otherwise(F.array().cast("array<array<string>>"))
    return parts.select("doc_id", "segment", F.posexplode(F.concat(F.array("words"), pieces)).alias("sentence", "words")).filter(likely)


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(text), "[^a-z0-9]+", " "))


def _bigrams(words: Column) -> Column:
    after = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, 1, after), F.slice(words, 2, after), lambda a, b: F.concat_ws(" ", a, b)))


def runs(docs: DataFrame, templates: DataFrame, anchor: list[str], all_bigrams: list[str], least: float, most_bigrams: int) -> DataFrame:
    """(doc_id, segment, d, license_id, template_id): matching runs of lines that are better than what they overlap.

    A text's lines go to blocks of BLOCK lines, each with as many lines more as a run can have, so no row holds more than that, however
    long the text. A line with more words than any run is in none: it stands as a mark where runs end.
    """
    longest = 2 * most_bigrams + 1
    plain = F.transform(F.split("text", "\n"), _plain)
    lines = F.filter(plain, lambda x: x != "")
    short = F.transform(lines, lambda x: F.when(F.length(x) - F.length(F.translate(x, " ", "")) < longest, x).otherwise(END))
    rows = docs.filter(F.contains("text", F.lit("\n"))).select("doc_id", F.xxhash64("text").alias("t"), short.alias("lines")).filter(F.size("lines") > 1)
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / BLOCK).cast("int")), lambda b: F.struct((b * BLOCK).alias("base"), F.slice("lines", b * BLOCK + 1, BLOCK + longest).alias("lines")))
    blocks = rows.select("doc_id", "t", F.explode(cut).alias("block")).select("doc_id", "t", "block.*")
    blocks = blocks.withColumn("words", F.split(F.array_join("lines", " "), " ")).filter(F.arrays_overlap("words", F.array(*map(F.lit, anchor))))
    known = F.array_intersect(_bigrams(F.col("words")), F.array(*map(F.lit, all_bigrams)))
    blocks = blocks.withColumn("known", known).drop("words").filter(F.size("known") > 0)
    need = F.ceil(least / (2 - least) * F.size("template") - 1e-9)
    most = F.floor((2 - least) / least * F.size("template") + 1e-9).cast("int")
    held = blocks.join(F.broadcast(templates), F.size(F.array_intersect("known", "template")) >= need).drop("known").withColumn("most", most)
    two = lambda i: _bigrams(F.split(F.array_join(F.slice("lines", i, F.lit(2)), " "), " "))
    begins = F.filter(F.sequence(F.lit(1), F.least(F.lit(BLOCK), F.size("lines"))), lambda i: F.arrays_overlap(two(i), F.col("template")))
    begun = held.withColumn("i", F.explode(begins)).withColumn("ahead", F.slice("lines", F.col("i"), 2 * F.col("most") + 1)).withColumn("i", F.col("base") + F.col("i")).drop("lines", "base")
    end = F.array_position("ahead", END).cast("int")
    begun = begun.withColumn("ahead", F.when(end > 0, F.slice("ahead", F.lit(1), end - 1)).otherwise(F.col("ahead"))).filter(F.size("ahead") > 0)
    start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"))
    reach = F.aggregate("ahead", start, lambda a, x: F.struct((a["k"] + F.when(a["n"] + F.size(F.split(x, " ")) <= 2 * F.col("most") + 1, 1).otherwise(0)).alias("k"), (a["n"] + F.size(F.split(x, " "))).alias("n")))["k"]
    run = begun.withColumn("k", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), reach)))).withColumn("run", F.array_join(F.slice("ahead", F.lit(1), F.col("k")), " ")).drop("ahead")
    run = run.withColumn("bigrams", _bigrams(F.split("run", " "))).filter(F.size("bigrams") <= F.col("most"))
    dice = F.lit(2.0) * F.size(F.array_intersect("bigrams", "template")) / (F.size("bigrams") + F.size("template"))
    met = run.withColumn("dice", dice).filter(F.col("dice") >= least)
    hit = F.struct((-F.col("dice")).alias("d"), "k", "license_id", "template_id", "i").alias("hit")
    scratch = Scratch(docs.sparkSession, "licence-runs")
    text = F.struct("doc_id", "t").alias("at")  # equal also where doc_id is null
    met = scratch.write("met", met.select(text, hit, "run").distinct())
    best = None
    left = met.select("at", "hit")
    while not left.isEmpty():
        judged = scratch.write(f"round-{uuid.uuid4().hex}", _judged(left))
        chosen = judged.filter("chosen")
        best = chosen if best is None else best.unionByName(chosen)
        left = judged.filter("NOT chosen AND NOT covered").select("at", "hit")
    if best is None:
        return met.select("at.doc_id", F.lit("").alias("segment"), "hit.d", "hit.license_id", "hit.template_id").limit(0)
    # A line or a paragraph of its own is counted as such.
    paragraphs = F.filter(F.split("text", "\n[ \t\r]*\n"), lambda p: F.contains(p, F.lit("\n")) & F.col("text").rlike("\n[ \t\r]*\n"))
    counted = docs.filter(F.contains("text", F.lit("\n"))).select("doc_id", F.xxhash64("text").alias("t"), F.explode(paragraphs).alias("p"))
    counted = counted.select(text, _plain(F.col("p")).alias("run"))
    own = best.filter("hit.k > 1").join(met, ["at", "hit"]).join(counted, ["at", "run"], "left_anti")
    return own.select("at.doc_id", F.concat_ws("+", F.col("hit.i") - 1, "hit.k").alias("segment"), "hit.d", "hit.license_id", "hit.template_id")


def _judged(hits: DataFrame) -> DataFrame:
    """(at, hit, chosen, covered): a hit is chosen if it is the best on each of its lines, covered if a chosen one is on any."""
    line, own = Window.partitionBy("at", "line"), Window.partitionBy("at", "hit")
    lines = hits.withColumn("line", F.explode(F.sequence(F.col("hit.i"), F.col("hit.i") + F.col("hit.k") - 1)))
    lines = lines.withColumn("least", F.min("hit").over(line)).withColumn("chosen", F.min(F.col("least") == F.col("hit")).over(own))
    lines = lines.withColumn("taken", F.max("chosen").over(line))
    return lines.groupBy("at", "hit").agg(F.max("chosen").alias("chosen"), F.max("taken").alias("covered"))


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """(doc_id, license_id, template_id, dice, n_segments): licences found in documents, with their best template."""
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    rows, whole, anchor = [], [], set()
    for licence, template, text in templates:
        bigrams = bigrams_of(text)
        if bigrams:
            anchor.update(anchors(text, least))
            whole.append((licence, template, bigrams))
            low, high = math.ceil(least / (2 - least) * len(bigrams) - 1e-9), math.floor((2 - least) / least * len(bigrams) + 1e-9)
            rows += [(n, licence, template, bigrams) for n in range(max(1, low), high + 1)]
    known = spark.createDataFrame(rows, "n int, license_id string, template_id string, template array<string>")
    # One pass over all words finds the texts with an anchor; all further work is on those.
    held = F.arrays_overlap(F.split(_plain(F.col("text")), " "), F.array(*map(F.lit, sorted(anchor)))) if anchor else F.lit(False)
    docs = Scratch(spark, "licences").write("likely", docs.select("doc_id", "text").filter(held))
    likely = segments(docs, sorted(anchor) or [""])
    pairs = F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat_ws(" ", a, b))
    sized = likely.filter(F.size("words") > 1).select("doc_id", "segment", "sentence", F.array_distinct(pairs).alias("bigrams")).withColumn("n", F.size("bigrams"))
    met = sized.join(F.broadcast(known) if len(rows) <= BROADCAST_ROWS else known, "n")
    shared = F.size(F.array_intersect("bigrams", "template"))
    met = met.withColumn("dice", F.lit(2.0) * shared / (F.col("n") + F.size("template"))).filter(F.col("dice") >= least)
    order = F.struct((-F.col("dice")).alias("d"), "license_id", "template_id")
    best = met.groupBy("doc_id", "segment", "sentence").agg(F.min(order).alias("best"))
    # A line that matches as a whole stands for its sentences.
    each = F.collect_list(F.struct("sentence", "best"))
    best = best.groupBy("doc_id", "segment").agg(F.array_sort(each).alias("each"))
    best = best.select("doc_id", "segment", F.explode(F.when(F.col("each")[0]["sentence"] == 0, F.slice("each", 1, 1)).otherwise(F.col("each"))).alias("one"))
    best = best.select("doc_id", F.concat_ws(".", "segment", "one.sentence").alias("segment"), "one.best.*")
    if whole:
        entire = spark.createDataFrame(whole, "license_id string, template_id string, template array<string>")
        more = runs(docs.select("doc_id", "text"), entire, sorted(anchor), sorted({b for _, _, t in whole for b in t}), least, max(n for n, *_ in rows))
        more = more.groupBy("doc_id", "segment").agg(F.min(F.struct("d", "license_id", "template_id")).alias("best"))
        best = best.unionByName(more.select("doc_id", "segment", "best.*"))
    found = best.groupBy("doc_id", "license_id").agg(F.min(F.struct("d", "template_id")).alias("best"), F.count(F.lit(1)).alias("n_segments"))
    return found.select("doc_id", "license_id", "best.template_id", F.round(-F.col("best.d"), 6).alias("dice"), "n_segments")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_PLAIN = "trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))"
OP9_SQL = (
    "WITH k(license_id, template_id, text) AS (VALUES "
    + ", ".join(f"({', '.join(map(_quoted, row))})" for row in TEMPLATES)
    + "),\nkw AS (SELECT license_id, template_id, string_split("
    + _PLAIN.format("text")
    + ", ' ') AS w FROM k),\n"
    "kb AS (SELECT license_id, template_id, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS t FROM kw),\n"
    "p AS (SELECT doc_id, list_concat(string_split(text, chr(10)), CASE WHEN regexp_matches(text, '\\n[ \\t\\r]*\\n') THEN\n"
    "        [x FOR x IN string_split_regex(text, '\\n[ \\t\\r]*\\n') IF contains(x, chr(10))] ELSE [] END) AS parts FROM documents),\n"
    "s AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS segment, unnest(parts) AS part FROM p),\n"
    "u AS (SELECT doc_id, segment, 0 AS sentence, part FROM s UNION ALL\n"
    "      SELECT doc_id, segment, unnest(range(1, len(x) + 1)) AS sentence, unnest(x) AS part\n"
    "      FROM (SELECT doc_id, segment, string_split_regex(part, '[.!?;][ \\t]+') AS x FROM s WHERE NOT contains(part, chr(10))) WHERE len(x) > 1),\n"
    "w AS (SELECT doc_id, segment, sentence, string_split("
    + _PLAIN.format("part")
    + ", ' ') AS w FROM u),\n"
    "b AS (SELECT doc_id, segment, sentence, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS b FROM w WHERE len(w) > 1),\n"
    "m AS (SELECT doc_id, segment, sentence, license_id, template_id, 2.0::DOUBLE * len(list_intersect(b, t)) / (len(b) + len(t)) AS dice\n"
    "      FROM b JOIN kb ON len(b) BETWEEN ceil(len(t) / 1.5 - 1e-9) AND floor(len(t) * 1.5 + 1e-9)),\n"
    "f AS (SELECT * FROM m WHERE dice >= 0.8\n"
    "      QUALIFY row_number() OVER (PARTITION BY doc_id, segment, sentence ORDER BY dice DESC, license_id, template_id) = 1),\n"
    "z AS (SELECT * FROM f QUALIFY sentence = 0 OR min(sentence) OVER (PARTITION BY doc_id, segment) > 0)\n"
    "SELECT doc_id, license_id, arg_min(template_id, struct_pack(d := -dice, t := template_id)) AS template_id,\n"
    "       round(max(dice), 6) AS dice, count(*) AS n_segments FROM z GROUP BY doc_id, license_id"
)
