r"""Licence scan: lines, whole texts and windows of words against licence templates, by the Dice coefficient over word bigrams.

A text is normalised to lower-case runs of letters and digits. A Dice coefficient of t or more needs
t/(2-t) to (2-t)/t times a template's number of distinct bigrams, so templates out of these bounds are never
compared, and only units that share a bigram with some template are compared at all.

Units are lines and the whole text. A notice that is neither (one wrapped over lines, or amid a line or a longer text) is found by
windows of as many words as the template has, wherever they start: of a template that no unit of a text matches, the best window
(ties: the first) is compared. Windows that do not start with a bigram of the template are left out, as a later one is no
worse; so are texts and windows that hold less than t/(2-t) of the template's bigrams, as they cannot match. How many a window
holds is told by the places of the template's bigrams in the text, which are looked for once.

A match holds 2/3 (at a threshold of 0.8) of a template's bigrams, so it has one of any words that more than 1/3 of these contain.
Texts without any of such words are left out before they are split.

Everything is an expression over one row: no shuffle, no Python.

Edge cases: null, empty and one-word texts have no bigrams and match nothing; a unit may match several templates and
each match is a row; a text of a single line is reported as line 0 only; rows that repeat are reported once
each; a null doc_id is carried along; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

THRESHOLD = 0.8
WHOLE, WINDOW = -1, -2

#: The words of common licences, without names and years.
MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
BSD_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_RETAIN = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."

#: Notices by which common licences are declared, and the short licences themselves.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "bsd-2-text": f"{BSD_CONDITIONS} {BSD_RETAIN} {BSD_DISCLAIMER}",
    "bsd-3-text": f"{BSD_CONDITIONS} {BSD_RETAIN} {BSD_ENDORSE} {BSD_DISCLAIMER}",
    "bsd-conditions": BSD_CONDITIONS,
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-text": ISC,
    "mit": "Released under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "mit-text": MIT,
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib-text": ZLIB,
}


def template_bigrams(text: str) -> list[str]:
    return sorted(set(text_bigrams(text)))


def text_bigrams(text: str) -> list[str]:
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def _need(bigrams: list[str], least: float) -> int:
    """How many of a template's bigrams a match holds at least."""
    return max(1, math.ceil(least * len(bigrams) - 1e-9))


def telling_words(templates: dict[str, str], least: float, letters: int = 6) -> list[str]:
    """Words one of which is in every text that holds the share least of some template's bigrams: of each template, fewer bigrams than
    that contain none of them. Those that most bigrams contain come first, short ones only where no others are left."""
    left = {k: set(template_bigrams(t)) for k, t in templates.items()}
    need = {k: _need(b, least) for k, b in left.items()}
    words = sorted({w for b in left.values() for x in b for w in x.split()})
    out: list[str] = []
    while any(len(b) >= need[k] for k, b in left.items()):
        gain = {w: sum(min(len(b) - need[k] + 1, sum(w in x for x in b)) for k, b in left.items() if len(b) >= need[k]) for w in words}
        some = [w for w in words if gain[w]]
        out.append(max([w for w in some if len(w) >= letters] or some, key=lambda w: (gain[w], len(w), w)))
        left = {k: {x for x in b if out[-1] not in x} for k, b in left.items()}
    return out


def _pairs(w: Column) -> Column:
    each = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
    return F.when(F.size(w) > 1, each).otherwise(F.array().cast("array<string>"))


def _given(value: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.transform(F.array(value), f)[0]


def _once(df: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """df's kept columns and new ones. As rows of a generator, they are made once: what uses them is not moved below it.
    (explode_outer, as for explode the optimizer would add a filter that builds the array a second time.)"""
    made = F.explode_outer(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))).alias("__new")
    return df.select(*keep, made).select(*keep, *(F.col(f"__new.{k}").alias(k) for k in columns))


def _dice(common: Column, size: Column, n: Column) -> Column:
    return 2 * common / (size + n)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, line (0 is the first, WHOLE the whole text, WINDOW a window), word (a window's first, else null), template, dice for
    all with dice >= threshold."""
    known = {k: t for k, t in sorted(templates.items()) if template_bigrams(t)}
    strings = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    every = strings(sorted({b for t in known.values() for b in template_bigrams(t)}))
    least = threshold / (2 - threshold)
    table_ = F.array(*[
        F.struct(F.lit(k).alias("template"), strings(b).alias("bigrams"), F.lit(len(b)).alias("n"), F.lit(len(text_bigrams(t))).alias("length"), F.lit(_need(b, least)).alias("need"))
        for k, t, b in ((k, t, template_bigrams(t)) for k, t in known.items())
    ])

    def unit(u: Column) -> Column:
        of = lambda g, d: F.struct(u["line"].alias("line"), g.alias("g"), d.alias("d"), F.array_intersect(d, every).alias("hits"))
        words = F.array_remove(F.split(F.lower(u["unit"]), r"[^\p{L}\p{N}]+"), "")
        return _given(words, lambda w: _given(_pairs(w), lambda g: _given(F.array_distinct(g), lambda d: of(g, d))))

    def of_unit(u: Column) -> Column:
        size = F.size(u["d"])
        fits = F.filter(table_, lambda t: (size >= least * t["n"] - 1e-9) & (least * size <= t["n"] + 1e-9))
        dice = lambda t: _dice(F.size(F.array_intersect(u["hits"], t["bigrams"])), size, t["n"])
        return F.filter(F.transform(fits, lambda t: row(u["line"], F.lit(None), t, dice(t))), lambda x: x["dice"] >= threshold)

    def row(line, word, t, dice):
        return F.struct(line.cast("int").alias("line"), word.cast("int").alias("word"), t["template"].alias("template"), dice.alias("dice"))

    def window(g: Column, t: Column) -> Column:
        dice = lambda w: _dice(F.size(F.array_intersect(w, t["bigrams"])), F.size(w), t["n"])
        places = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.array_contains(t["bigrams"], F.get(g, i)))

        def dense(p):
            """Places that begin a window with as many hits as the threshold takes: by where the last of these is."""
            order = F.when(F.size(p) >= t["need"], F.sequence(F.lit(0), F.size(p) - t["need"])).otherwise(F.array().cast("array<int>"))
            return F.transform(F.filter(order, lambda j: F.get(p, j + t["need"] - 1) - F.get(p, j) < t["length"]), lambda j: F.get(p, j))

        score = lambda i: F.struct(_given(F.array_distinct(F.slice(g, i + 1, t["length"])), dice).alias("dice"), (-i).alias("minus"))
        return _given(F.array_max(F.transform(_given(places, dense), score)), lambda best: F.when(best.isNotNull(), row(F.lit(WINDOW), -best["minus"], t, best["dice"])))

    telling = strings(telling_words(known, least))
    told = _given(F.lower("text"), lambda x: F.exists(telling, lambda w: F.contains(x, w)))
    lines = docs.where(told).select("doc_id", "text", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    whole = F.array(F.struct(F.lit(WHOLE).alias("line"), F.col("text").alias("unit")))
    units = F.when(F.size("lines") > 1, F.concat(whole, _numbered())).otherwise(_numbered())
    each = _once(lines, "doc_id", units=F.transform(units, unit)).where(F.exists("units", lambda u: F.size(u["hits"]) > 0))
    found = _once(each, "doc_id", "units", found=F.flatten(F.transform(F.filter("units", lambda u: F.size(u["hits"]) > 0), of_unit)))
    text = F.col("units")[0]
    rest = F.filter(table_, lambda t: (F.size(F.array_intersect(text["hits"], t["bigrams"])) >= least * t["n"] - 1e-9) & ~F.exists("found", lambda x: x["template"] == t["template"]))
    windows = F.filter(F.transform(rest, lambda t: window(text["g"], t)), lambda x: x["dice"] >= threshold)
    out = _once(found, "doc_id", all=F.concat("found", windows)).select("doc_id", F.explode_outer("all").alias("x"))
    return out.where("x.template is not null").select("doc_id", "x.line", "x.word", "x.template", "x.dice")


def _numbered() -> Column:
    return F.transform("lines", lambda x, i: F.struct(i.alias("line"), x.alias("unit")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _values() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quote(k)}, {quote(t)})" for k, t in TEMPLATES.items())


ORACLE = rf"""
WITH t AS (SELECT * FROM (VALUES {_values()}) v(template, text)),
u AS (
  SELECT 'd' AS side, doc_id AS id, CAST(i AS INTEGER) AS line, '' AS template, lines[i + 1] AS text, len(lines) = 1 AS whole
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
  UNION ALL SELECT 'd', doc_id, {WHOLE}, '', text, true FROM documents WHERE text LIKE '%' || chr(10) || '%'
  UNION ALL SELECT 't', 0, 0, template, text, false FROM t),
w AS (SELECT *, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM u),
g AS (SELECT side, id, line, template, whole, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM w WHERE len(w) > 1),
b AS (SELECT side, id, line, template, unnest(list_distinct(g)) AS b FROM g),
n AS (SELECT side, id, line, template, count(*) AS n FROM b GROUP BY ALL),
m AS (SELECT d.id, d.line, x.template, count(*) AS common FROM b d JOIN b x ON d.b = x.b AND d.side = 'd' AND x.side = 't' GROUP BY ALL),
f AS (SELECT m.id AS doc_id, m.line, m.template, 2 * m.common / (d.n + x.n)::DOUBLE AS dice
  FROM m JOIN n d ON d.side = 'd' AND d.id = m.id AND d.line = m.line JOIN n x ON x.side = 't' AND x.template = m.template
  WHERE 2 * m.common / (d.n + x.n)::DOUBLE >= {THRESHOLD}),
p AS (SELECT d.id, d.g, x.template, x.g AS tg, unnest(range(1, len(d.g) + 1)) AS i FROM g d, g x WHERE d.side = 'd' AND d.whole AND x.side = 't'),
s AS (SELECT id, template, i, list_distinct(g[i:i + len(tg) - 1]) AS s, list_distinct(tg) AS tg FROM p WHERE list_contains(tg, g[i])),
o AS (SELECT id, template, i - 1 AS word, 2 * len(list_intersect(s, tg)) / (len(s) + len(tg))::DOUBLE AS dice FROM s)
SELECT doc_id, line, NULL::INTEGER AS word, template, dice FROM f
UNION ALL
SELECT id, {WINDOW}, word::INTEGER, template, dice FROM o WHERE dice >= {THRESHOLD} AND NOT EXISTS (FROM f WHERE f.doc_id = o.id AND f.template = o.template)
QUALIFY row_number() OVER (PARTITION BY id, template ORDER BY dice DESC, word) = 1
"""
