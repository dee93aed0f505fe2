"""Licence scan: sparse TF-IDF cosine of text blocks to templates, then inheritance from directories.

All of it is DataFrame code. Blocks of a file are its lines, its paragraphs (the header is the first of them) and its whole text,
so statements, headers that run over several lines and licence files are all compared with templates of their kind. Document
frequencies are counted over all lines of all files. A cosine is at most the length of the template's part that the text has
words for, whatever the text's other words weigh; files, then blocks, that stay under the limit by that for every template are passed over.
A file's own licence is that of its best block. A directory's licence is the one that most licence
files in it declare (files named licence, license or copying; without any, all its files);
files without their own licence take that of the nearest directory above them that has one.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import _bounded, written

#: Licence names, the statements by which files refer to them, and the standard headers and texts.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, BSD 3-Clause License"),
    ("CC-BY-4.0", "Licensed under Creative Commons Attribution 4.0 International"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Proprietary", "All rights reserved"),
    *[(name, f"SPDX-License-Identifier: {name}") for name in ("Apache-2.0", "BSD-3-Clause", "CC-BY-4.0", "GPL-3.0", "MIT", "MPL-2.0", "ISC")],
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
        LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    ),
    (
        "GPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the
        hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along
        with this program. If not, see https://www.gnu.org/licenses/.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    ),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
        the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
        LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
]
BUCKETS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(c: Column) -> Column:
    """Runs of ASCII letters and digits, A-Z as a-z."""
    return F.array_remove(F.split(spaced(c, r"\P{Alnum}+"), " "), "")


def spaced(c: Column, others: str) -> Column:
    """c with a space for each run of `others`, A-Z as a-z. Java looks \\p{Alnum} up in a table; of a class of ranges it tries one after the other, which takes ten times as long."""
    return F.lower(F.regexp_replace(c, others, " "))


def bucket(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(BUCKETS))


def _weights(counted: DataFrame, idf: DataFrame, by: str, none: Column) -> DataFrame:
    """(by, word, weight of length 1 in total) from (by, word, n)."""
    weighed = counted.join(idf, "word", "left").withColumn("weight", F.col("n") * F.coalesce("idf", none))
    norm = weighed.groupBy(by).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return weighed.join(norm, by).select(by, "word", (F.col("weight") / F.col("norm")).alias("weight"))


def _blocks(text: Column) -> Column:
    """Lines, paragraphs and the whole of a text, each text once."""
    return F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, r"\n\s*\n"), F.array(text)))


def reaching(weights: dict[tuple[str, str], float], places: dict[str, int], least: float) -> Callable[[Column], Column]:
    """Whether a text with these words may have a cosine of `least` to any template: by Cauchy and Schwarz the cosine is at most the
    root of the squared weights of those words of the template that the text has.

    weights: (template, word) -> weight, of length 1 for each template. places: the bucket of each word.
    """
    keys = sorted({k for k, _ in weights})
    squares: dict[str, list[float]] = {w: [0.0] * len(keys) for w in places}
    for (k, w), v in weights.items():
        squares[w][keys.index(k)] += v * v
    buckets: list[dict[str, list[float]]] = [{} for _ in range(BUCKETS)]
    for w, x in squares.items():
        buckets[places[w]][w] = x
    table = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,array<double>>>")  # a constant, worked out once
    mine = F.split(F.lit(" ".join(sorted(squares))), " ")
    none = F.array_repeat(F.lit(0.0), len(keys))

    def may(c: Column) -> Column:
        of = lambda w: F.try_element_at(F.get(table, bucket(w)), w)
        sums = F.aggregate(F.array_intersect(c, mine), none, lambda a, w: F.zip_with(a, of(w), lambda x, y: x + y))
        return F.array_max(sums) >= least * least - 1e-5  # cosines are rounded to six digits

    return may


def own_licenses(files: DataFrame, templates: DataFrame, least: float = 0.6) -> DataFrame:
    """(file, license, cosine) of the files (file, text) that have a block with a cosine of at least `least` to a template.

    templates: (license, template), a licence may have several. Of several blocks and templates the best counts, of equals the first by name.
    Null texts have no blocks.
    """
    lines = files.select(F.explode(F.split(spaced(F.col("text"), r"[^\p{Alnum}\n]+"), "\n")).alias("line")).filter(F.trim("line") != "")
    # the space before a line gives it the empty word, once
    counted = lines.select(F.explode(F.array_distinct(F.split(F.concat(F.lit(" "), "line"), " "))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    counted = written(counted, "frequencies")  # the empty word stands for all lines
    total = next((r["df"] for r in counted.filter("word = ''").collect()), 0)
    idf = counted.filter("word <> ''").select("word", (F.log((F.lit(total) + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))
    none = F.log(F.lit(total) + 1.0) + 1.0
    terms = templates.select(F.concat_ws("|", "license", "template").alias("key"), F.explode(words(F.col("template"))).alias("word")).groupBy("key", "word").agg(F.count("*").alias("n"))
    known = idf.join(F.broadcast(terms.select("word").distinct()), "word", "left_semi")  # the words of the templates
    weights = [(r["key"], r["word"], r["weight"], r["place"]) for r in _weights(terms, known, "key", none).withColumn("place", bucket(F.col("word"))).collect()]
    if not weights:
        return files.select("file", F.lit(None).cast("string").alias("license"), F.lit(None).cast("double").alias("cosine")).limit(0)
    may = reaching({(k, w): v for k, w, v, _ in weights}, {w: p for _, w, _, p in weights}, least)
    blocks = files.filter(may(words(F.col("text")))).select("file", F.explode(_blocks(F.col("text"))).alias("block")).select("file", words(F.col("block")).alias("words"))
    chosen = written(blocks.filter(may(F.col("words"))).select("file", F.array_join("words", " ").alias("block")).withColumn("id", F.monotonically_increasing_id()), "chosen")
    # blocks are dealt once, by number: all that follows is grouped by it
    counted = chosen.repartition("id").select("id", F.explode(F.split("block", " ")).alias("word")).groupBy("id", "word").agg(F.count("*").alias("n"))
    used = written(idf.join(chosen.select(F.explode(F.array_distinct(F.split("block", " "))).alias("word")).distinct(), "word"), "used")  # words of blocks are words of lines
    keys = sorted({k for k, _, _, _ in weights})
    vectors: dict[str, list[float]] = {}
    for k, w, v, _ in weights:
        vectors.setdefault(w, [0.0] * len(keys))[keys.index(k)] = v
    right = F.broadcast(files.sparkSession.createDataFrame(list(vectors.items()), "word string, others array<double>"))  # the words of the templates
    weighed = counted.join(_bounded(used), "word").join(right, "word", "left").withColumn("weight", F.col("n") * F.col("idf"))
    sums = weighed.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"), *[F.sum(F.col("weight") * F.get("others", F.lit(i))).alias(f"t{i}") for i in range(len(keys))])
    each = F.array(*[F.struct((-F.round(F.col(f"t{i}") / F.col("norm"), 6)).alias("m"), F.lit(k.split("|")[0]).alias("license")) for i, k in enumerate(keys)])
    top = F.array_min(F.filter(each, lambda x: x["m"] <= -least))
    best = sums.select("id", top.alias("top")).filter("top IS NOT NULL").select("id", (-F.col("top.m")).alias("cosine"), "top.license")
    found = chosen.select("id", "file").join(best, "id")
    return found.groupBy("file").agg(F.min_by("license", F.struct(-F.col("cosine"), F.col("license"))).alias("license"), F.max("cosine").alias("cosine"))


def scan_licenses(files: DataFrame, templates: DataFrame, file: str = "file", path: str = "path", text: str = "text", least: float = 0.6) -> DataFrame:
    """(file, dir, own_license, cosine, license, license_dir) for each file.

    dir is the path up to its last slash. license is the file's own, else that of the nearest
    directory at or above dir which has one (license_dir); null if there is none. Null
    or empty texts have no licence of their own; a null path has a null dir and inherits nothing. Rows that share a file id share their own
    licence. No files give no rows. Other columns of files aren't kept.
    """
    files = files.select(F.col(file).alias("file"), F.col(path).alias("path"), F.col(text).alias("text"))
    own = written(own_licenses(files.select("file", "text"), templates, least), "own")  # read for the directories and for the files
    placed = files.select("file", F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.translate(F.regexp_extract("path", "[^/]*$", 0), UPPER, LOWER).rlike("^(license|licence|copying)").alias("named"))
    scanned = placed.join(own.withColumnRenamed("license", "own_license"), "file", "left")
    declared = scanned.filter("own_license IS NOT NULL AND dir IS NOT NULL").groupBy("dir", "own_license").agg(F.max("named").alias("named"), F.count("*").alias("n"))
    of_dir = declared.groupBy("dir").agg(F.min_by("own_license", F.struct(~F.col("named"), -F.col("n"), F.col("own_license"))).alias("found"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("at")))
    ancestors = scanned.filter("dir IS NOT NULL").select("dir").distinct().select("dir", F.explode(above).alias("x")).select("dir", "x.depth", "x.at")
    nearest = ancestors.join(of_dir.withColumnRenamed("dir", "at"), "at").groupBy("dir").agg(F.max_by(F.struct("found", "at"), "depth").alias("near"))
    out = scanned.join(nearest, "dir", "left")
    missing = F.col("own_license").isNull()
    return out.select(
        F.col("file").alias(file),
        "dir",
        "own_license",
        "cosine",
        F.coalesce("own_license", "near.found").alias("license"),
        F.when(missing, F.col("near.at")).alias("license_dir"),
    )


_IN = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in TEMPLATES)
_TR = f"'{UPPER}', '{LOWER}'"
_FIND = "regexp_extract_all(translate({}, " + _TR + "), '[a-z0-9]+')"
SQL = f"""
WITH templates(license, template) AS (VALUES {_IN}),
files AS (SELECT page_id, coalesce(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '') AS path, regexp_replace(html, '<[^>]*>', chr(10), 'g') AS text FROM pages),
lines AS (SELECT {_FIND.format("line")} AS words FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM files)),
full_ AS (SELECT * FROM lines WHERE len(words) > 0),
blocks AS (SELECT page_id, {_FIND.format("block")} AS words FROM (SELECT page_id, unnest(list_distinct(string_split(text, chr(10)) || string_split_regex(text, '\\n\\s*\\n') || [text])) AS block FROM files)),
total AS (SELECT count(*) AS t FROM full_),
idf AS (SELECT word, ln((t + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM (SELECT unnest(list_distinct(words)) AS word FROM full_), total GROUP BY word, t),
terms AS (SELECT license, key, word, count(*) AS n FROM (SELECT license, license || '|' || template AS key, unnest({_FIND.format("template")}) AS word FROM templates) GROUP BY ALL),
tw AS (SELECT license, key, word, n * coalesce(idf, ln(t + 1.0) + 1.0) AS w FROM terms LEFT JOIN idf USING (word), total),
tn AS (SELECT license, key, word, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS w FROM tw),
chosen AS (SELECT DISTINCT page_id, array_to_string(words, ' ') AS block FROM blocks WHERE len(words) > 0),
counted AS (SELECT block, word, count(*) AS n FROM (SELECT block, unnest(string_split(block, ' ')) AS word FROM (SELECT DISTINCT block FROM chosen)) GROUP BY ALL),
bw AS (SELECT block, word, n * idf AS w FROM counted JOIN idf USING (word)),
bn AS (SELECT block, word, w / sqrt(sum(w * w) OVER (PARTITION BY block)) AS w FROM bw),
cosines AS (SELECT block, license, round(sum(bn.w * tn.w), 6) AS cosine FROM bn JOIN tn USING (word) GROUP BY block, license, key HAVING round(sum(bn.w * tn.w), 6) >= 0.6),
own AS (SELECT page_id, first(license ORDER BY cosine DESC, license) AS own_license, max(cosine) AS cosine FROM chosen JOIN cosines USING (block) GROUP BY page_id),
scanned AS (SELECT page_id, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_matches(translate(regexp_extract(path, '[^/]*$'), {_TR}), '^(license|licence|copying)') AS named, own_license, cosine FROM files LEFT JOIN own USING (page_id)),
declared AS (SELECT dir, own_license, max(named) AS named, count(*) AS n FROM scanned WHERE own_license IS NOT NULL GROUP BY ALL),
of_dir AS (SELECT dir AS above, first(own_license ORDER BY named DESC, n DESC, own_license) AS found FROM declared GROUP BY dir),
ancestors AS (SELECT dir, depth, array_to_string(string_split(dir, '/')[1:depth], '/') AS above FROM (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS depth FROM (SELECT DISTINCT dir FROM scanned))),
nearest AS (SELECT dir, first(found ORDER BY depth DESC) AS found, first(above ORDER BY depth DESC) AS above FROM ancestors JOIN of_dir USING (above) GROUP BY dir)
SELECT page_id, dir, own_license, cosine, coalesce(own_license, found) AS license, CASE WHEN own_license IS NULL THEN above END AS license_dir
FROM scanned LEFT JOIN nearest USING (dir)
"""
