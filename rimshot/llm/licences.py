"""Operator 2 (native): licence scan by the Dice coefficient over word bigrams.

A unit is a line of a text, or a whole text of several lines. Its words (letters and digits, lower case) give a
bag of bigrams, which is compared to those of the templates. Two bags of sizes a and b can only reach a Dice
coefficient t if t / (2 - t) <= a / b <= (2 - t) / t, so a unit meets few templates, and most units none. One
narrow projection: no shuffle, no Python.

``scan_windows`` looks below and across lines: as many consecutive words as a template has, laid where one of its
rare bigrams stands at its place. Equal bags of size n reach t only with at least t n bigrams in common, so more than
(1 - t) n rare bigrams of a template are needed for every such window to hold one.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rimshot.llm.registry import query, table

# Notices and opening paragraphs of public licences.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except '
                   "in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
            "of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the "
                "License, or any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Proprietary", "All rights reserved."),
)
_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
          "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
          "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
          "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
          "DEALINGS IN THE SOFTWARE.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.")
_BSD_NAME = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
             "promote products derived from this software without specific prior written permission.")
_BSD_AS_IS = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
              "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
              "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
              "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
              "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
              "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
              "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
              "POSSIBILITY OF SUCH DAMAGE.")
_COPIES = ("Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not "
           "allowed.")
# The templates of windows. Short licences in full; of the licences of many pages how they open.
NOTICES: tuple[tuple[str, str], ...] = TEMPLATES + (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software. " + _AS_IS),
    ("BSD-2-Clause", f"{_BSD} {_BSD_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_NAME} {_BSD_AS_IS}"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies. THE "
            "SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
            "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
            "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
            "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
            "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
             "held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
             "this software for any purpose, including commercial applications, and to alter it and redistribute it "
             "freely, subject to the following restrictions"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                  "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
                  "binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
                   "implied. See the License for the specific language governing permissions and limitations under the "
                   "License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, "
                   "REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                "option) any later version."),
    ("GPL-2.0", f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. {_COPIES}"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. "
                f"<https://fsf.org/> {_COPIES}"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. "
                 f"<https://fsf.org/> {_COPIES}"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, "
                 f"Inc. <https://fsf.org/> {_COPIES}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
                "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
# Words that do not make a bigram rare.
_COMMON = frozenset("a all and any are as at be by for from in is it not of on or other that the this to with you".split())
_SPLIT = r"[^\p{L}\p{N}]+"


def template_bigrams(text: str) -> Counter:
    """Bag of bigrams of a template, by the rule of ``bigrams``."""
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    return Counter(f"{a} {b}" for a, b in zip(words, words[1:]))


def bounds(size: int, least_dice: float) -> tuple[int, int]:
    """Least and greatest bag size that can reach the coefficient with a bag of ``size``."""
    return (math.ceil(size * least_dice / (2 - least_dice) - 1e-9),
            math.floor(size * (2 - least_dice) / least_dice + 1e-9))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPLIT), lambda w: w != "")


def bigrams(found: Column) -> Column:
    """Bigrams of an array of at least two words, in order, repeats included."""
    return F.transform(F.sequence(F.lit(0), F.size(found) - 2),
                       lambda i: F.concat(F.get(found, i), F.lit(" "), F.get(found, i + 1)))


def _template_column(templates: tuple[tuple[str, str], ...], least_dice: float) -> Column:
    rows = []
    for number, (name, text) in enumerate(templates):
        bag = template_bigrams(text)
        size = sum(bag.values())
        low, high = bounds(size, least_dice)
        keys = sorted(bag)
        rows.append(F.struct(
            F.lit(number).alias("number"), F.lit(name).alias("name"), F.lit(size).alias("size"),
            F.lit(low).alias("low"), F.lit(high).alias("high"), F.array(*map(F.lit, keys)).alias("bigrams"),
            F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*[F.lit(bag[k]) for k in keys])).alias("count")))
    return F.array(*rows)


def _best(found: Column, templates: Column) -> Column:
    """(dice, template number) of the template with the largest coefficient, the first of equals; null if none is
    of a size that could match."""
    size = F.size(found) - 1
    near = F.filter(templates, lambda t: (size >= t["low"]) & (size <= t["high"]) & (size > 0))

    def dice(bag: Column, t: Column) -> Column:
        shared = F.aggregate(F.array_intersect(bag, t["bigrams"]), F.lit(0), lambda total, b: total + F.least(
            F.get(F.map_values(F.map_filter(t["count"], lambda k, _: k == b)), F.lit(0)),
            F.size(F.filter(bag, lambda x: x == b))))
        return 2.0 * shared / (F.size(bag) + t["size"])

    scored = F.get(F.transform(F.array(bigrams(found)), lambda bag: F.array_max(F.transform(
        near, lambda t: F.struct(dice(bag, t).alias("dice"), (-t["number"]).alias("order"), t["name"].alias("name"))))),
        F.lit(0))
    return F.when(F.exists(templates, lambda t: (size >= t["low"]) & (size <= t["high"]) & (size > 0)), scored)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         templates: tuple[tuple[str, str], ...] = TEMPLATES, least_dice: float = 0.7) -> DataFrame:
    """(doc_id, unit, licence, dice): every unit with a template of at least ``least_dice``, its best template.

    ``unit`` is the line's number from 1, or 0 for the whole text. Of equal coefficients the first template counts.
    Null and empty texts have no finding; null ids stay null; repeated rows repeat their findings.
    """
    if not 0 < least_dice <= 1:
        raise ValueError("least_dice must be in (0, 1]")
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lines = F.transform(F.split("text", "\n", -1), lambda l, i: F.struct((i + 1).alias("unit"), words(l).alias("words")))
    whole = F.when(F.contains(F.col("text"), F.lit("\n")), F.array(F.struct(F.lit(0).alias("unit"), words(F.col("text")).alias("words"))))
    units = F.concat(F.coalesce(whole, F.filter(lines, lambda _: F.lit(False))), lines)
    known = _template_column(templates, least_dice)
    judged = F.transform("units", lambda u: F.struct(u["unit"].alias("unit"), _best(u["words"], F.col("known")).alias("best")))
    hits = F.filter(judged, lambda j: j["best"]["dice"] >= least_dice)
    return (source.select("doc_id", units.alias("units"), known.alias("known"))
            .select("doc_id", F.explode(hits).alias("hit"))
            .select("doc_id", F.col("hit.unit").cast("long").alias("unit"), F.col("hit.best.name").alias("licence"),
                    F.col("hit.best.dice").alias("dice")))


def anchors(text: str, least_dice: float) -> list[tuple[str, int]]:
    """(bigram, place) of the rarest bigrams of a template: so many that no window of its size that reaches the
    coefficient is without one. Rare is what has few common words, then what is long."""
    found = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    pairs = [(f"{a} {b}", i, len({a, b} & _COMMON)) for i, (a, b) in enumerate(zip(found, found[1:]))]
    need = math.floor((1 - least_dice) * len(pairs) + 1e-9) + 1
    chosen = {b for b, _, _ in sorted(pairs, key=lambda p: (p[2], -len(p[0]), p[1]))[:need]}
    return [(b, i) for b, i, _ in pairs if b in chosen]


def scan_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 templates: tuple[tuple[str, str], ...] = NOTICES, least_dice: float = 0.7) -> DataFrame:
    """(doc_id, first_word, first_line, last_line, licence, dice): windows of a text that match a template.

    A window has as many consecutive words as the template, across line breaks (or all words of a shorter text). It
    is laid wherever one of the template's ``anchors`` stands at its place, moved into the text at the ends. Of
    windows that share more than half of the shorter one, the one with the most bigrams in common stays, then the
    larger coefficient, the earlier, the first template. Words count from 0, lines from 1. Null and empty texts have
    no finding; null ids stay null; repeated rows repeat their findings.
    """
    if not 0 < least_dice <= 1:
        raise ValueError("least_dice must be in (0, 1]")
    known, table_rows, names = [], [], set()
    for number, (name, text) in enumerate(templates):
        bag = template_bigrams(text)
        often = [(b, n) for b, n in sorted(bag.items()) if n > 1]
        known.append(F.struct(
            F.lit(name).alias("name"), F.lit(sum(bag.values())).alias("size"), F.array(*map(F.lit, sorted(bag))).alias("bigrams"),
            F.array(*[F.struct(F.lit(b).alias("b"), F.lit(n).alias("n")) for b, n in often or [("", 0)]]).alias("often")))
        for b, i in anchors(text, least_dice):
            names.add(b)
            table_rows.append(F.struct(F.lit(b).alias("b"), F.lit(number).alias("number"), F.lit(i).alias("at"),
                                       F.lit(sum(bag.values()) + 1).alias("words")))
    known, places = F.array(*known), F.array(*table_rows)
    n = F.size("w")

    def pair(i: Column) -> Column:
        return F.concat(F.get(F.col("w"), i), F.lit(" "), F.get(F.col("w"), i + 1))

    def judged(c: Column) -> Column:
        t, last = F.get(known, c["number"]), F.least(c["start"] + c["words"], n) - 2
        def shared(bag: Column) -> Column:
            again = F.aggregate(t["often"], F.lit(0), lambda total, o: total + F.greatest(
                F.lit(0), F.least(o["n"], F.size(F.filter(bag, lambda x: x == o["b"]))) - 1))
            return F.size(F.array_intersect(bag, t["bigrams"])) + again
        one = F.transform(F.array(F.transform(F.sequence(c["start"], last), pair)), lambda bag: F.struct(
            shared(bag).alias("shared"), F.size(bag).alias("size")))
        return F.get(F.transform(one, lambda x: F.struct(
            (-x["shared"]).alias("order"), (-2.0 * x["shared"] / (x["size"] + t["size"])).alias("less"), c["start"].alias("start"),
            c["number"].alias("number"), (x["size"] + 1).alias("words"))), F.lit(0))

    def overlap(a: Column, b: Column) -> Column:
        shared = F.least(a["start"] + a["words"], b["start"] + b["words"]) - F.greatest(a["start"], b["start"])
        return 2 * shared > F.least(a["words"], b["words"])

    def line(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("total"), F.lit(1).alias("line"))
        return F.aggregate("sizes", start, lambda a, size: F.struct(
            (a["total"] + size).alias("total"), (a["line"] + F.when(a["total"] + size <= at, 1).otherwise(0)).alias("line")))["line"]

    # every explode of one element keeps what it made from being made again in each place of use
    texts = (df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
             .select("doc_id", F.explode(F.array(F.transform(F.split("text", "\n", -1), words))).alias("lines"))
             .select("doc_id", F.transform("lines", F.size).alias("sizes"), F.explode(F.array(F.flatten("lines"))).alias("w")))
    opened = (texts.filter(n > 1)
              .select("doc_id", "sizes", "w", F.explode(F.array(F.filter(
                  F.sequence(F.lit(0), n - 2), lambda i: pair(i).isin(sorted(names))))).alias("at"))
              .filter(F.size("at") > 0))
    laid = F.array_distinct(F.flatten(F.transform("at", lambda p: F.transform(
        F.filter(places, lambda a: a["b"] == pair(p)),
        lambda a: F.struct(a["number"], F.greatest(F.lit(0), F.least(p - a["at"], n - a["words"])).alias("start"), a["words"])))))
    found = (opened.select("doc_id", "sizes", "w", F.explode(F.array(laid)).alias("laid"))
             .select("doc_id", "sizes", F.explode(F.array(F.array_sort(F.filter(
                 F.transform("laid", judged), lambda x: -x["less"] >= least_dice)))).alias("found")))
    kept = F.aggregate("found", F.filter("found", lambda _: F.lit(False)), lambda k, x: F.when(
        F.exists(k, lambda y: overlap(x, y)), k).otherwise(F.concat(k, F.array(x))))
    return (found.select("doc_id", "sizes", F.explode(kept).alias("x"))
            .select("doc_id", F.col("x.start").cast("long").alias("first_word"), line(F.col("x.start")).cast("long").alias("first_line"),
                    line(F.col("x.start") + F.col("x.words") - 1).cast("long").alias("last_line"),
                    F.get(F.array(*[F.lit(name) for name, _ in templates]), F.col("x.number")).alias("licence"),
                    (-F.col("x.less")).alias("dice")))


def _oracle(least_dice: float = 0.7) -> str:
    rows, sizes = [], []
    for number, (name, text) in enumerate(TEMPLATES):
        bag = template_bigrams(text)
        sizes.append(f"({number}, '{name}', {sum(bag.values())})")
        rows += [f"({number}, '{b}', {n})" for b, n in sorted(bag.items())]
    return rf"""
with sizes(number, name, size) as (values {', '.join(sizes)}),
tb(number, bigram, n) as (values {', '.join(rows)}),
u as (select doc_id, row_number() over () as rid, text, string_split(text, chr(10)) as lines from documents where text is not null),
units as (select doc_id, rid, unnest(range(1, len(lines) + 1)) as unit, unnest(lines) as line from u
          union all select doc_id, rid, 0, text from u where len(lines) > 1),
w as (select doc_id, rid, unit, list_filter(string_split_regex(lower(line), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as words from units),
b as (select doc_id, rid, unit, len(words) - 1 as size, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) as bigram
      from w where len(words) between 2 and 200),
bc as (select doc_id, rid, unit, size, bigram, count(*) as n from b group by all),
s as (select doc_id, rid, unit, number, any_value(size) as size, sum(least(bc.n, tb.n)) as shared
      from bc join tb using (bigram) group by doc_id, rid, unit, number),
d as (select doc_id, rid, unit, name, number, 2.0::double * shared / (s.size + sizes.size) as dice from s join sizes using (number)),
r as (select *, row_number() over (partition by rid, unit order by dice desc, number) as rn from d where dice >= {least_dice}::double)
select doc_id, unit::bigint as unit, name as licence, dice from r where rn = 1
"""


@query("op2_licences", _oracle())
def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


@query("licence_windows")
def licence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_windows(table(spark, sf_dir, "documents"))
