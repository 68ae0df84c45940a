"""Licence scans by Dice coefficient over word bigrams, in DataFrame functions alone.

Units of a document are its whole text, each of its lines, and windows of consecutive
lines, such as a licence that is wrapped within a longer text. A unit is normalised (lower
case, every run of other characters than a-z and 0-9 one space) and has the set of its
distinct word bigrams. With a of them, and m in a template, the Dice coefficient is
2 |common| / (a + m), which can reach ``threshold`` t only if
m t / (2 - t) <= a <= m (2 - t) / t. Templates outside these bounds are pruned before
any bigram is compared. Templates are a constant of the plan; there is no join with them.

Windows are sized by the bounds of each template: those whose words make as many pairs as a
may be. A template whose bigrams the whole text lacks too many of has no windows in it: with c of
them common, c >= m t / (2 - t) for any unit. A window begins with a line that one of the
template's bigrams begins in and ends with one that one ends in; any other lines before or after
only lower its coefficient.

Defined cases: a null or empty text, or one without words, has no licence; units of one
word have no bigrams and match nothing; ties go to the whole text, then to the unit of fewest lines, to
the earlier one, and then to the template's name; rows that share a ``doc_id`` are told
apart only by their text's lines, so each such row gets the id's best match; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

_PERMISSION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_SOURCE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY
OF SUCH DAMAGE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""

#: Name and text of each template: whole licences, file headers and one-line notices.
TEMPLATES = [
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", " ".join((_PERMISSION, _SOURCE, _BINARY, _DISCLAIMER))),
    ("BSD-3-Clause", " ".join((_PERMISSION, _SOURCE, _BINARY, _NAMES, _DISCLAIMER))),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", _GPL.format(2)),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", _GPL.format(3)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", _ISC),
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("all-rights-reserved", "All rights reserved."),
]


def template_bigrams(text: str) -> list[tuple[str, str]]:
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(zip(words, words[1:])))


def bounds(m: int, threshold: float) -> tuple[float, float]:
    """The least and the largest number of bigrams that can reach ``threshold`` with a template of ``m``."""
    slack = 1e-9
    return m * threshold / (2 - threshold) - slack, m * (2 - threshold) / threshold + slack


def words_of(unit: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(unit), "[^a-z0-9]+", " ")), " ")


def _templates(templates: list[tuple[str, str]], threshold: float) -> tuple[Column, float]:
    rows, least = [], float("inf")
    for name, text in templates:
        pairs = template_bigrams(text)
        lo, hi = bounds(len(pairs), threshold)
        least = min(least, lo)
        hashes = F.array(*[F.xxhash64(F.lit(a), F.lit(b)) for a, b in pairs])
        rows.append(F.struct(F.lit(name).alias("name"), hashes.alias("bigrams"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")))
    return F.array(*rows), least


def _pairs(words: str) -> Column:
    """Hashes of the pairs of neighbouring words of a column."""
    return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(F.col(words), i + 1)))


def _dice(common: Column, a: Column, m: Column) -> Column:
    return F.round(2.0 * common / (a + m), 6)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, lines: of each line with words its number and its words."""
    lines = F.transform(F.split(F.col("text").cast("string"), "\n"), lambda x, i: F.struct(i.alias("i"), words_of(x).alias("w")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.filter(lines, lambda x: F.get(x["w"], F.lit(0)) != "").alias("lines"))


def _held(rows: DataFrame, **columns: Column) -> DataFrame:
    """doc_id and ``columns``, worked out once: what is planned next can't put them into its lambdas, to work them out for each element."""
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("held")
    return rows.select("doc_id", one).select("doc_id", *[f"held.{n}" for n in columns])


def _windows(rows: DataFrame, known: Column, least: float, every: Column, threshold: float) -> DataFrame:
    """Hits of windows of two lines and more: doc_id, first, last, licence, dice. ``rows``: doc_id, lines; ``every``: all templates' bigrams."""
    rows = _held(rows.filter(F.size("lines") > 1), lines=F.col("lines"), words=F.flatten("lines.w"))
    rows = _held(rows, lines=F.col("lines"), words=F.col("words"), met=F.array_intersect(_pairs("words"), every)).filter(F.size("met") >= F.lit(least))
    fits = F.filter(known, lambda t: F.size(F.array_intersect("met", t["bigrams"])) >= t["lo"])
    rows = rows.select("doc_id", "lines", "words", F.explode(fits).alias("t"))
    flat = F.flatten(F.transform("lines", lambda x: F.transform(x["w"], lambda w, q: F.struct(x["i"].alias("i"), q.alias("q"), F.size(x["w"]).alias("n")))))
    rows = _held(rows, t=F.col("t"), flat=flat, pairs=_pairs("words"))
    # places of the template's bigrams: where the line of the first word begins, and where that of the second ends
    word = lambda k: F.get("flat", k)
    place = lambda k: F.struct((k - word(k)["q"]).alias("from"), word(k)["i"].alias("first"), (k + word(k + 1)["n"] - word(k + 1)["q"]).alias("to"), word(k + 1)["i"].alias("last"))
    places = F.filter(F.sequence(F.lit(0), F.size("pairs") - 1), lambda k: F.array_contains("t.bigrams", F.get("pairs", k)))
    rows = _held(rows, t=F.col("t"), pairs=F.col("pairs"), at=F.transform(places, place))
    starts = F.array_distinct(F.transform("at", lambda x: F.struct(x["from"].alias("from"), x["first"].alias("first"))))
    ends = F.array_distinct(F.transform("at", lambda x: F.struct(x["to"].alias("to"), x["last"].alias("last"))))
    rows = _held(rows, t=F.col("t"), pairs=F.col("pairs"), starts=starts, ends=ends)
    rows = rows.select("doc_id", "t", "pairs", "ends", F.explode("starts").alias("s"))
    size = lambda e: e["to"] - F.col("s.from")  # noqa: E731  pairs in the window
    ends = F.filter("ends", lambda e: (e["last"] > F.col("s.first")) & (size(e) >= F.col("t.lo")) & (size(e) <= F.col("t.hi")))
    rows = rows.select("doc_id", "t", "pairs", "s", F.explode(ends).alias("e"))
    rows = _held(rows, t=F.col("t"), first=F.col("s.first"), last=F.col("e.last"), bigrams=F.array_distinct(F.slice("pairs", F.col("s.from") + 1, size(F.col("e")))))
    dice = _dice(F.size(F.array_intersect("bigrams", "t.bigrams")), F.size("bigrams"), F.size("t.bigrams"))
    return rows.select("doc_id", "first", "last", F.col("t.name").alias("licence"), dice.alias("dice")).filter(F.col("dice") >= threshold)


def licence_hits(docs: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Each unit that reaches the threshold: doc_id, first and last (its lines, numbered from 0; -1: the whole text), licence, dice."""
    known, least = _templates(templates, threshold)
    every = F.array(*[F.xxhash64(F.lit(a), F.lit(b)) for a, b in dict.fromkeys(p for _, t in templates for p in template_bigrams(t))])
    rows = _lines(docs)
    whole = F.struct(F.lit(-1).alias("i"), F.flatten("lines.w").alias("w"))
    units = rows.select("doc_id", F.explode(F.concat(F.array(whole), "lines")).alias("u")).select("doc_id", F.col("u.i").alias("first"), F.col("u.w").alias("words"))
    units = units.filter(F.size("words") - 1 >= F.lit(least))
    units = units.select("doc_id", "first", F.array_distinct(_pairs("words")).alias("bigrams"))
    # size bounds, before any comparison
    fits = F.filter(known, lambda t: (F.size("bigrams") >= t["lo"]) & (F.size("bigrams") <= t["hi"]))
    units = units.select("doc_id", "first", "bigrams", F.explode(fits).alias("t"))
    dice = _dice(F.size(F.array_intersect("bigrams", "t.bigrams")), F.size("bigrams"), F.size("t.bigrams"))
    units = units.select("doc_id", "first", F.col("first").alias("last"), F.col("t.name").alias("licence"), dice.alias("dice")).filter(F.col("dice") >= threshold)
    return units.unionByName(_windows(rows, known, least, every, threshold))


def licence_scan(docs: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """For each row of ``docs``: doc_id, licence (the best match or null), dice, unit and last_line (its lines; -1: the whole text, -2: none), licences (all names, comma-separated)."""
    hits = licence_hits(docs, threshold, templates)
    order = F.struct((-F.col("dice")).alias("d"), (F.col("first") >= 0).alias("part"), (F.col("last") - F.col("first")).alias("lines"), "first", "licence")
    best = hits.groupBy("doc_id").agg(F.min(order).alias("b"), F.concat_ws(",", F.array_sort(F.collect_set("licence"))).alias("licences"))
    best = best.select(F.col("doc_id").alias("hit_id"), F.col("b.licence").alias("licence"), (-F.col("b.d")).alias("dice"), F.col("b.first").alias("unit"), (F.col("b.first") + F.col("b.lines")).alias("last_line"), "licences")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    out = ids.join(best, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
    return out.select("doc_id", "licence", "dice", F.coalesce("unit", F.lit(-2)).alias("unit"), F.coalesce("last_line", F.lit(-2)).alias("last_line"), "licences")


def oracle(threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES) -> str:
    """The same over all windows of lines, each against all templates whose bounds it is in."""
    rows = ",\n  ".join("('" + name + "', [" + ", ".join(f"'{a} {b}'" for a, b in template_bigrams(text)) + "])" for name, text in templates)
    most = max(bounds(len(template_bigrams(text)), threshold)[1] for _, text in templates)
    return rf"""
WITH t(licence, tb) AS (VALUES
  {rows}
), l AS (
  SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
), n AS (
  SELECT doc_id, line, string_split(trim(regexp_replace(lower(body), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM l
), p AS (
  SELECT doc_id, line, w, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY line) AS upto FROM n WHERE w[1] <> ''
), s AS (
  SELECT a.doc_id, a.line AS first, b.line AS last FROM p a JOIN p b ON b.doc_id = a.doc_id AND b.line > a.line AND b.upto - a.upto + len(a.w) - 1 <= {most}
), u AS (
  SELECT doc_id, -1 AS first, -1 AS last, flatten(list(w ORDER BY line)) AS w FROM p GROUP BY doc_id
  UNION ALL
  SELECT doc_id, line, line, w FROM p
  UNION ALL
  SELECT s.doc_id, first, last, flatten(list(w ORDER BY line)) FROM s JOIN p ON p.doc_id = s.doc_id AND line BETWEEN first AND last GROUP BY ALL
), b AS (
  SELECT doc_id, first, last, len(w) - 1 AS pairs, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM u WHERE len(w) > 1
), h AS (
  SELECT doc_id, first, last, licence, round(2.0 * len(list_intersect(b, tb)) / (len(b) + len(tb)), 6) AS dice
  FROM b JOIN t ON 2.0 * least(len(b), len(tb)) / (len(b) + len(tb)) >= {threshold} - 1e-9
  AND (first = last OR 2.0 * least(pairs, len(tb)) / (pairs + len(tb)) >= {threshold} - 1e-9)
), g AS (
  SELECT * FROM h WHERE dice >= {threshold}
), r AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, first >= 0, last - first, first, licence) AS n FROM g
)
SELECT d.doc_id, r.licence, CAST(r.dice AS DOUBLE) AS dice, CAST(coalesce(r.first, -2) AS INTEGER) AS unit, CAST(coalesce(r.last, -2) AS INTEGER) AS last_line, s.licences
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND r.n = 1
LEFT JOIN (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences FROM g GROUP BY 1) s ON d.doc_id = s.doc_id
"""
