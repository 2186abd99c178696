"""Licence scans: units of text against licence templates by the Dice coefficient of their word bigrams.

A unit is a line, up to ``WRAP`` lines that follow one another (notices are wrapped, and stand in other text), a paragraph
(what stands between blank lines) or the whole text; units are normalised to lower-case words. A match has one at least of
a few telling bigrams, so texts without any are not split, and only lines near one are joined.
Sizes prune: a unit is
compared with a template only if the two sizes allow the least coefficient, and units whose word count alone rules out
every template never become bigrams. Templates are a bounded list of literals, so the scan is one narrow pass; only units
that match are shuffled.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole

THRESHOLD = 0.8
#: Lines that are read as one unit.
WRAP = 24

# Public licence notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "all-rights-reserved": "All rights reserved.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-conditions": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "Apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a normalised text, in order."""
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def size_bounds(n: int, threshold: float) -> tuple[float, float]:
    """Sizes m with 2 min(n, m) / (n + m) >= threshold, with some slack for rounding."""
    return n * threshold / (2 - threshold) - 1e-9, n * (2 - threshold) / threshold + 1e-9


def telling_bigrams(sets: dict[str, list[str]], threshold: float) -> list[str]:
    """Bigrams of which a text that matches any template has one at least.

    A match shares n * threshold / (2 - threshold) of a template's n bigrams at least, so it lacks the others at most:
    one more of a template's bigrams than that are taken, those with the longest words, which prose has least.
    """
    chosen: set[str] = set()
    for pairs in sets.values():
        lacks = len(pairs) - math.ceil(size_bounds(len(pairs), threshold)[0])
        chosen.update(sorted(pairs, key=lambda p: (-len(p), p))[: lacks + 1])
    return sorted(chosen)


def pattern_of(bigrams_: list[str]) -> str:
    """Finds one of the bigrams in normalised text with a blank at both ends."""
    follow: dict[str, list[str]] = {}
    for a, b in (p.split() for p in bigrams_):
        follow.setdefault(a, []).append(b)
    return " (?:" + "|".join(f"{a} (?:{'|'.join(b)})" for a, b in follow.items()) + ") "


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _units(text: Column, pattern: str, wrap: int, most: int) -> Column:
    """Distinct normalised units of a text that may match; lines without words aren't counted as lines.

    Lines are joined around one with a telling bigram, and not beyond a line that has more than ``most`` words by itself.
    """
    blank, at_least = F.lit(" "), lambda places, i: F.array_min(F.filter(places, lambda t: t >= i))

    def of(lines: Column) -> Column:
        at = lambda i: F.coalesce(F.try_element_at(lines, i.cast("int")), F.lit(""))
        before = lambda i: F.when(i > 1, F.substring_index(at(i - 1), " ", -1)).otherwise("")
        around = lambda i: F.concat(blank, before(i), blank, at(i), blank, F.substring_index(at(i + 1), " ", 1), blank)
        every = F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1)))
        marked = F.struct(
            F.filter(every, lambda i: around(i).rlike(pattern)).alias("near"),
            F.filter(every, lambda i: F.size(F.array_distinct(F.split(at(i), " "))) > most).alias("long"),
        )

        def joined(m: Column) -> Column:
            starts = F.array_distinct(F.flatten(F.transform(m["near"], lambda i: F.sequence(F.greatest(i - (wrap - 1), F.lit(1)), i))))

            def from_(i: Column) -> Column:
                first = at_least(m["near"], i) - i + 1
                last = F.least(F.lit(wrap), F.size(lines) - i + 1, at_least(m["long"], i) - i)
                sizes = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
                return F.transform(sizes, lambda n: F.array_join(F.slice(lines, i, n), " "))

            return F.concat(F.flatten(F.transform(starts, from_)), F.array(F.array_join(lines, " ")))

        return F.element_at(F.transform(F.array(marked), joined), 1)

    lines = F.filter(F.transform(F.split(text, r"\r?\n"), _normal), lambda x: x != "")
    paragraphs = F.transform(F.split(text, r"\r?\n[ \t]*\r?\n"), _normal)
    return F.array_distinct(F.concat(F.element_at(F.transform(F.array(lines), of), 1), paragraphs))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", wrap: int = WRAP) -> DataFrame:
    """One row for each row of docs and template that some unit of its text matches: doc_id, license_id, dice, n_units.

    dice is the best coefficient, n_units the distinct normalised units that reach the threshold. Null, empty and one-word texts
    have no bigrams and match nothing; a template without a bigram matches nothing. Texts that match no template have no
    row. Repeated rows give their rows each. An empty table gives an empty result.
    """
    sets = {k: b for k, t in sorted((templates or TEMPLATES).items()) if (b := bigrams(t))}
    bounds = {k: size_bounds(len(b), threshold) for k, b in sets.items()}
    least, most = min((lo for lo, _ in bounds.values()), default=1), max((hi for _, hi in bounds.values()), default=0)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), whole(F.col(f"`{text_col}`")).alias("text"))
    pattern = pattern_of(telling_bigrams(sets, threshold))
    rows = rows.where(F.concat(F.lit(" "), _normal(F.col("text")), F.lit(" ")).rlike(pattern))
    units = rows.select("doc_id", "row", F.explode(_units(F.col("text"), pattern, wrap, int(most) + 1)).alias("unit"))
    words = F.split("unit", " ")
    units = units.select("doc_id", "row", words.alias("words")).where(F.size("words") > least)
    units = units.where(F.size(F.array_distinct("words")) <= most + 1)  # distinct bigrams are as many less one, at least
    pairs = F.array_distinct(F.zip_with(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1), lambda a, b: F.concat_ws(" ", a, b)))
    units = units.select("doc_id", "row", pairs.alias("pairs"))
    names = list(sets)
    fitting = [[i for i, k in enumerate(names) if bounds[k][0] <= n <= bounds[k][1]] for n in range(int(most) + 1)]
    literal = lambda rows, kind: F.array(*[F.array(*map(F.lit, r)).cast(f"array<{kind}>") for r in rows])
    sized = units.where(F.size("pairs") <= most)  # candidates by size: a table of literals
    near = sized.select("doc_id", "row", "pairs", F.explode(F.element_at(literal(fitting, "int"), F.size("pairs") + 1)).alias("t"))
    theirs = F.element_at(literal(sets.values(), "string"), F.col("t") + 1)
    dice = 2.0 * F.size(F.array_intersect("pairs", theirs)) / (F.size("pairs") + F.size(theirs))
    found = near.select("doc_id", "row", F.element_at(F.array(*map(F.lit, names)), F.col("t") + 1).alias("license_id"), dice.alias("dice"))
    found = found.where(F.col("dice") >= threshold)
    best = found.groupBy("row", "doc_id", "license_id").agg(F.max("dice").alias("dice"), F.count(F.lit(1)).alias("n_units"))
    return best.select("doc_id", "license_id", "dice", "n_units")
