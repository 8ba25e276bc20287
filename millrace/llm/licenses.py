"""Operator 9: license scans by an exact set-similarity join with templates.

Phrases that name a license are found where their words stand consecutively.
License texts and notices are found by their words as sets: a text block matches
a template if it has `threshold` of the template's distinct words. A block is a
fourth longer than its template and starts at every fourth of the template's
length, so that a notice at any place lies within one, and words scattered over
more than that make no match.

The join is exact and needs few comparisons. The templates' words are ordered
by the number of documents that have them, rarest first. A block that shares
enough words with a template has one of the template's first
size - needed + 1 words (prefix filter), has `needed` of the templates' words
at all (length filter), and from a shared word on, both still have enough words
to come (positional filter). Documents without any prefix word, nearly all, go
no further than the first test. Templates of about one length share their
blocks.

What is counted comes to the driver only for the templates' own words, and the
words and templates are what is broadcast: both are bounded by the template
list, whatever the documents are. The plan itself holds the prefixes alone.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, row_key, table

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_GPL_END = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."""
#: License texts, and notices by which licenses are applied.
TEMPLATES = [
    ("gpl", "This work is licensed under the GNU General Public License version 3"),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", _GPL.format(name="GNU General Public License", version=3) + _GPL_END.format(name="GNU General Public License")),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("lgpl", _GPL.replace("program", "library").format(name="GNU Lesser General Public License", version="2.1") + _GPL_END.replace("program", "library").format(name="GNU Lesser General Public License")),
    ("agpl", _GPL.format(name="GNU Affero General Public License", version=3) + _GPL_END.format(name="GNU Affero General Public License")),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    (
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT license"),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. """
        + _AS_IS
        + """ IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", _BSD_TWO + _BSD_END),
    ("bsd", _BSD_TWO + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software.""",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ),
]
THRESHOLD = 0.9
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_words(text: str) -> list[str]:
    """The words of a template, as joined_words() would give them."""
    return re.sub(NO_WORD, " ", text.translate({c: c + 32 for c in range(65, 91)})).split()


def block_of(words: int) -> tuple[int, int]:
    """Width and step of the blocks for a template of so many words."""
    step = max(1, words // 4)
    return words + step, step


def joined_words(text: str) -> Column:
    """The words of a text with one space between them; lower() is safe here, as no letter beyond ASCII becomes one within a phrase."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), NO_WORD, " "))


def spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def split_words(said: str) -> Column:
    return F.when(F.col(said) == "", F.array().cast("array<string>")).otherwise(F.split(F.col(said), " "))


def phrases(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, n_words, n_base, first_word, last_word, base (labels): one row for each row of docs."""
    said = docs.select(row_key(docs, key, text).alias("row"), F.col(key).alias("doc_id"), joined_words(text).alias("said"))
    any_phrase = None
    for p in PHRASES:
        any_phrase = F.col("said").contains(p) if any_phrase is None else any_phrase | F.col("said").contains(p)
    pattern = F.lit("(?<= )(" + "|".join(PHRASES) + ")(?= )")
    padded = F.concat(F.lit(" "), F.col("said"), F.lit(" "))
    said = said.withColumn("n_words", F.when(F.col("said") == "", 0).otherwise(spaces(F.col("said")) + 1).cast("long"))
    # No phrase begins as another ends, so the places from left to right are all places.
    said = said.withColumn("hits", F.when(any_phrase, F.regexp_extract_all(padded, pattern, F.lit(1))).otherwise(F.array().cast("array<string>")))
    n = F.size("hits")
    parts = F.split(padded, pattern, -1)
    first = F.when(n > 0, spaces(F.get(parts, 0)) - 1).cast("long")
    last = F.when(n > 0, F.col("n_words") - (spaces(F.element_at("hits", -1)) + 1) - (spaces(F.element_at(parts, -1)) - 1)).cast("long")
    names = F.create_map(*[F.lit(x) for pair in PHRASES.items() for x in pair])
    return said.select("row", "doc_id", "n_words", n.cast("long").alias("n_base"), first.alias("first_word"), last.alias("last_word"), F.array_distinct(F.transform("hits", lambda h: F.element_at(names, h))).alias("base"))


def matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every block that has `threshold` of a template's distinct words: row, first_word, template (its place in the list), label, containment.

    Empty and null texts have no blocks; repeated rows have theirs once, as
    `row` is a digest of key and text. No rows, or no templates, give none.
    """
    spark = docs.sparkSession
    listed = [template_words(t) for _, t in templates]
    sets = [sorted(set(w)) for w in listed]
    vocabulary = sorted({w for s in sets for w in s})
    words = docs.select(row_key(docs, key, text).alias("row"), joined_words(text).alias("said")).select("row", split_words("said").alias("words"))
    known = F.broadcast(spark.createDataFrame([(w,) for w in vocabulary], "word string"))
    counted = words.select(F.explode(F.array_distinct("words")).alias("word")).join(known, "word").groupBy("word").count()
    often = {r["word"]: r["count"] for r in counted.collect()}  # the templates' words at most
    by_rank = sorted(vocabulary, key=lambda w: (often.get(w, 0), w))
    rank = {w: i for i, w in enumerate(by_rank)}
    ranked = [sorted(rank[w] for w in s) for s in sets]
    needed = [math.ceil(threshold * len(s) - 1e-9) for s in sets]
    rows, first_words = [], {}
    for i, (r, n) in enumerate(zip(ranked, needed, strict=True)):
        first_words.setdefault(len(listed[i]), set()).update(by_rank[x] for x in r[: len(r) - n + 1])
        rows += [(i, len(listed[i]), x, at, r, n, templates[i][0]) for at, x in enumerate(r[: len(r) - n + 1])]
    prefix = F.broadcast(spark.createDataFrame(rows, "template int, length int, rank int, at int, ranks array<int>, needed int, label string"))
    ranks = F.broadcast(spark.createDataFrame([(w, i) for w, i in rank.items()], "word string, rank int"))

    # Templates of one length have their blocks in common; a document takes part with those of whose first words it has one.
    any_first = F.lit(sorted({w for s in first_words.values() for w in s}) or [""])
    kinds = [(n, *block_of(n), min(k for k, w in zip(needed, listed, strict=True) if len(w) == n), sorted(s)) for n, s in sorted(first_words.items())]
    kind = F.array(*[F.when(F.arrays_overlap("words", F.lit(s)), F.struct(F.lit(n).alias("length"), F.lit(width).alias("width"), F.lit(step).alias("step"), F.lit(least).alias("least"))) for n, width, step, least, s in kinds])
    kind = kind if kinds else F.array().cast("array<struct<length: int, width: int, step: int, least: int>>")
    blocks = words.where(F.arrays_overlap("words", any_first)).select("row", "words", F.explode(F.filter(kind, lambda k: k.isNotNull())).alias("kind"))
    # The last block is that which reaches the end.
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - F.col("kind.width") + F.col("kind.step") - 1), F.col("kind.step"))
    blocks = blocks.select("row", "words", "kind", F.explode(starts).alias("first_word"))
    blocks = blocks.select("row", "kind", "first_word", F.array_distinct(F.slice("words", F.col("first_word") + 1, F.col("kind.width"))).alias("block")).where(F.size("block") >= F.col("kind.least"))
    has_first = None
    for n, *_, s in kinds:
        has = (F.col("kind.length") == n) & F.arrays_overlap("block", F.lit(s))
        has_first = has if has_first is None else has_first | has
    blocks = blocks.where(has_first if kinds else F.lit(False))
    told = blocks.select("row", F.col("kind.length").alias("length"), F.col("kind.least").alias("least"), "first_word", F.explode("block").alias("word")).join(ranks, "word")
    told = told.groupBy("row", "length", "least", "first_word").agg(F.array_sort(F.collect_set("rank")).alias("block")).where(F.size("block") >= F.col("least"))  # a block's words at most
    found = told.select("*", F.posexplode("block").alias("j", "rank")).join(prefix, ["length", "rank"]).where(F.size("block") >= F.col("needed"))
    to_come = F.least("at", "j") + F.least(F.size("ranks") - F.col("at"), F.size("block") - F.col("j"))
    shared = F.size(F.array_intersect("block", "ranks"))
    found = found.where(to_come >= F.col("needed")).withColumn("shared", shared).where(F.col("shared") >= F.col("needed"))
    return found.groupBy("row", "first_word", "template", "label").agg((F.max("shared") / F.max(F.size("ranks"))).alias("containment"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is 1 where a phrase stands, else the greatest containment of a
    template that was found, else 0. Empty and null texts have no words, no
    labels (empty strings) and the score 0. Repeated rows come out as often as
    they went in; an empty table gives no rows; other columns do not matter.
    """
    base = phrases(docs, key, text)
    best = matches(docs, templates, threshold, key, text).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("most"))  # a set of labels of the list at most
    best = checkpoint(best)  # kept apart from the join, so that Spark can split a row that very many others repeat
    all_labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0)))
    return base.join(best, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(all_labels, ",").alias("labels"), score.alias("score")
    )


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def _sql() -> str:
    values = ", ".join(f"({i}, '{label}', '{' '.join(template_words(said))}')" for i, (label, said) in enumerate(TEMPLATES))
    phrases_sql = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS said FROM documents),
worded AS (SELECT r, doc_id, CASE WHEN said = '' THEN []::VARCHAR[] ELSE string_split(said, ' ') END AS w FROM docs),
phrases(p, label) AS (VALUES {phrases_sql}),
places AS (
  SELECT r, i AS place, label FROM (SELECT r, w, unnest(range(len(w))) AS i FROM worded), phrases
  WHERE w[i + 1] = string_split(p, ' ')[1] AND w[i + 1 : i + len(string_split(p, ' '))] = string_split(p, ' ')),
base AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS base FROM places GROUP BY r),
templates(t, label, said) AS (VALUES {values}),
sets AS (SELECT label, list_distinct(string_split(said, ' ')) AS ws, len(string_split(said, ' ')) AS n FROM templates),
asked AS (SELECT label, ws, ceil({THRESHOLD} * len(ws) - 1e-9) AS needed, greatest(1, n // 4) AS step, n + greatest(1, n // 4) AS width FROM sets),
whole AS (SELECT r, w, asked.* FROM worded, asked WHERE len(list_intersect(ws, w)) >= needed),
starts AS (SELECT *, unnest(range(0, greatest(0, CAST(len(w) AS BIGINT) - width + step - 1) + 1, step)) AS i FROM whole),
blocks AS (SELECT r, label, needed, ws, w[i + 1 : i + width] AS b FROM starts),
found AS (SELECT r, label, len(list_intersect(ws, b)) / len(ws) AS c FROM blocks WHERE len(list_intersect(ws, b)) >= needed),
best AS (SELECT r, list(DISTINCT label) AS more, max(c) AS most FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels,
  CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE round(coalesce(most, 0.0), 6) END AS DOUBLE) AS score
FROM worded LEFT JOIN base USING (r) LEFT JOIN best USING (r)
"""


QUERIES = {"op9_licenses": op9_licenses}
ORACLES = {"op9_licenses": _sql()}
