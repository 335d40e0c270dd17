"""Operator 8: licence scan by the Dice coefficient over word bigrams; DataFrame functions only.

Texts and templates are normalised alike: lower case, all but letters and digits become spaces. A
segment (each line of a document, and the whole document) matches a template if twice the shared
distinct bigrams are at least THRESHOLD of both counts together. Dice d needs bigram counts whose
ratio is at least d / (2 - d), so most segments meet no template at all and the rest only those of
about their size. Bigrams find the templates that have them by a join with the constant table of
template bigrams (a few hundred rows, broadcast), so only segments that share a bigram are counted.

A licence that no segment has is looked for in windows of the whole word sequence, across line
breaks. The best window starts and ends at a template bigram, since other ends only add to its size;
so from every such start one pass over the longest window allowed counts the distinct bigrams. A
window of Dice d has at least d / (2 - d) of the template's bigrams: documents without so many, and
starts without so many ahead, are passed over, with no loss. Windows also meet FULL_TEXTS.

Defined results: null and empty texts match nothing; a segment or template of one word has no
bigrams and matches nothing; a document gives one row for each licence, that of its best segment
(the earliest on ties; the whole document counts as line 0), or else of its best window, at the line
of the window's first word; a repeated doc_id is one document, its smallest text; rows without
doc_id are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.core import keyed

THRESHOLD = 0.8
#: Notices and short licence texts, as they are published. Fixed values.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
)

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_OPENING = {licence: text for licence, text in TEMPLATES if licence in ("MIT", "BSD", "ISC")}
#: Whole licence texts without their copyright lines, for windows.
FULL_TEXTS = (
    ("MIT", f"{_OPENING['MIT']} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_WARRANTY}"),
    ("BSD", f"{_OPENING['BSD']} {_BSD} {_BSD_WARRANTY}"),
    ("BSD", f"{_OPENING['BSD']} {_BSD} {_BSD_NAMES} {_BSD_WARRANTY}"),
    ("ISC", f"{_OPENING['ISC']} {_ISC_WARRANTY}"),
)


def bigrams_of(text: str) -> list[str]:
    words = re.sub(r"[^\w]|_", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def words_of(text: Column) -> Column:
    """Words of a text in lower case."""
    return F.array_remove(F.split(text, r"[^\p{L}\p{N}]+"), "")


def pairs(words: Column) -> Column:
    return F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat_ws(" ", a, b))


def bigrams(words: Column) -> Column:
    return F.array_distinct(pairs(words))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def best_window(t: Column, words: Column, line_of: Column) -> Column:
    """(dice, back: minus the line) of the best window of words for template t."""

    def marked(grams: Column) -> Column:
        """For each bigram in the text's order: where it stood before (else -1), and whether t has it."""
        before = lambda s, k: F.get(s, k - 1)
        row = lambda s, x, k: F.struct(x["i"].alias("i"), F.when(before(s, k)["g"] == x["g"], before(s, k)["i"]).otherwise(-1).alias("prev"), F.array_contains(t["grams"], x["g"]).alias("hit"))
        ordered = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.array_sort(once(ordered, lambda s: F.transform(s, lambda x, k: row(s, x, k))))

    def tried(seen: Column, p: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            new = (x["prev"] < p).cast("int")
            d, s = acc["d"] + new, acc["s"] + F.when(x["hit"], new).otherwise(0)
            return F.struct(d.alias("d"), s.alias("s"), F.greatest(acc["best"], 2 * s / (d + t["n"])).alias("best"))

        start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("s"), F.lit(0.0).alias("best"))
        return F.aggregate(F.slice(seen, p + 1, t["longest"]), start, step, lambda acc: acc["best"])

    def search(seen: Column) -> Column:
        hits = F.transform(F.filter(seen, lambda x: x["hit"]), lambda x: x["i"])
        starts = once(hits, lambda at: F.filter(at, lambda p, k: F.get(at, k + t["need"] - 1) < p + t["longest"]))
        return F.array_max(F.transform(starts, lambda p: F.struct(tried(seen, p).alias("dice"), (-F.get(line_of, p)).alias("back"))))

    return once(marked(pairs(words)), search)


def windows(rows: DataFrame, templates: tuple[tuple[str, str], ...], threshold: float) -> DataFrame:
    """doc_id, licence, dice and back (minus the line) of the best window of each template in each of rows (doc_id, text)."""
    ratio = threshold / (2 - threshold)
    known = [(licence, grams) for licence, text in templates if (grams := bigrams_of(text))]
    array = lambda grams: F.array(*(F.lit(g) for g in grams))
    least = lambda grams: math.ceil(len(grams) * ratio - 1e-9)
    table = F.array(*(F.struct(F.lit(licence).alias("licence"), F.lit(len(g)).alias("n"), F.lit(least(g)).alias("need"), F.lit(int(len(g) / ratio + 1e-9)).alias("longest"), array(g).alias("grams")) for licence, g in known))
    every = sorted({g for _, grams in known for g in grams})
    have = lambda h: F.filter(table, lambda t: (t["need"] <= F.size(h)) & (F.size(F.array_intersect(h, t["grams"])) >= t["need"]))
    met = F.array_distinct(F.filter(pairs(F.col("words")), lambda g: g.isin(every)))
    # outer generators as in scan(): words, then the templates of which the document has enough
    rows = rows.select("doc_id", "text", F.explode_outer(F.array(words_of(F.lower("text")))).alias("words"))
    rows = rows.select("doc_id", "text", "words", F.explode_outer(once(met, have)).alias("t")).where("t IS NOT NULL")
    line_of = F.flatten(F.transform(F.split(F.lower("text"), "\n"), lambda l, i: F.array_repeat(i + 1, F.size(words_of(l)))))
    best = once(line_of, lambda l: best_window(F.col("t"), F.col("words"), l))
    return rows.select("doc_id", "t.licence", F.explode_outer(F.array(best)).alias("best")).where(F.col("best.dice") >= threshold).select("doc_id", "licence", "best.dice", "best.back")


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, texts: tuple[tuple[str, str], ...] = FULL_TEXTS) -> DataFrame:
    """doc_id, licence, dice and line of the best match of each licence in each document."""
    known = [(licence, grams) for licence, text in templates if (grams := bigrams_of(text))]
    ratio = threshold / (2 - threshold)
    low, high = min(len(g) for _, g in known) * ratio, max(len(g) for _, g in known) / ratio
    # Each generator's output is computed once, and no filter moves below an outer one: words, then bigrams.
    lines = F.transform(F.split(F.lower("text"), "\n"), words_of)
    whole = lambda l: F.when(F.size(l) > 1, F.flatten(l)).otherwise(F.array().cast("array<string>"))
    segments = F.transform(F.array(lines), lambda l: F.concat(F.array(whole(l)), l))
    texted = keyed(docs, "text").where("text <> ''")
    rows = texted.select("doc_id", F.explode_outer(segments).alias("segments"))
    rows = rows.select("doc_id", F.posexplode_outer(F.transform("segments", bigrams)).alias("line", "grams")).where(F.size("grams").between(low, high))
    # templates stand in the plan as constants; each bigram finds the templates that have it
    values = ", ".join(f"({i}, '{licence}', {len(grams)}, '{g}')" for i, (licence, grams) in enumerate(known) for g in grams)
    table = docs.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(template, licence, n, gram)")
    size = F.size("grams").alias("size")
    met = rows.select("doc_id", "line", size, F.explode("grams").alias("gram")).join(F.broadcast(table), "gram")
    met = met.where((F.col("size") >= F.col("n") * ratio) & (F.col("size") * ratio <= F.col("n")))
    shared = met.groupBy("doc_id", "line", "template").agg(F.first("licence").alias("licence"), (2 * F.count("*") / F.first(F.col("size") + F.col("n"))).alias("dice"))
    found = shared.where(F.col("dice") >= threshold).select("doc_id", "licence", F.lit(True).alias("segment"), "dice", (-F.col("line")).alias("back"))
    found = found.unionByName(windows(texted, (*templates, *texts), threshold).withColumn("segment", F.lit(False)))
    found = found.groupBy("doc_id", "licence").agg(F.max(F.struct("segment", "dice", "back")).alias("best"))
    return found.select("doc_id", "licence", F.round("best.dice", 6).alias("dice"), (-F.col("best.back")).alias("line"))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: licences that documents carry."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    values = ", ".join("('{}', [{}])".format(licence, ", ".join(f"'{g}'" for g in bigrams_of(text))) for licence, text in TEMPLATES)
    return rf"""
WITH t(licence, grams) AS (VALUES {values}), seg AS (
  SELECT doc_id, 0 AS line, text AS s FROM documents WHERE contains(text, chr(10))
  UNION ALL SELECT doc_id, i, string_split(text, chr(10))[i] FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text <> '')
), w AS (
  SELECT doc_id, line, list_filter(regexp_split_to_array(lower(s), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ws FROM seg
), g AS (
  SELECT doc_id, line, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS grams FROM w WHERE len(ws) >= 2
), d AS (
  SELECT doc_id, line, licence, 2 * len(list_intersect(g.grams, t.grams)) / CAST(len(g.grams) + len(t.grams) AS DOUBLE) AS dice FROM g, t
)
SELECT doc_id, licence, round(max(dice), 6) AS dice, CAST(arg_min(line, (-dice, line)) AS INTEGER) AS line FROM d WHERE dice >= {THRESHOLD} GROUP BY doc_id, licence
"""


ORACLE_SQL = _oracle()
