"""License scans: Dice coefficient over word bigrams against licence templates, in SQL expressions only.

Texts are cut into lines, paragraphs and the whole document; each unit is normalised (lower case, runs of anything
but letters and digits are one space). Dice >= t needs ``t / (2 - t) <= |A| / |B| <= (2 - t) / t``, so only templates of a fitting
size are compared. It also needs at least ``t / (2 - t)`` of a template's bigrams in the unit, so a document without any of
a few telling words that cover more than the rest of every template is not cut up at all; nothing is lost by it.

Runs of two or more lines (so of paragraphs too) are units as well. Only templates with ``t / (2 - t)`` of their bigrams in the
document are looked for, only lines where one of these starts begin a run, and a run ends only where it gains one: any
other run is no better than one of these.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code "
    "must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list "
    "of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF "
    "ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
    "version {0} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
)
#: Public licence texts and the notices that stand for them.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", _MIT_GRANT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", _BSD_2 + _BSD_END),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _BSD_END),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", _GPL.format(2)),
    ("GPL-3.0", _GPL.format(3)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


#: Words too common in prose to tell a licence by, unless a template has no others.
COMMON = set("a all also an and any are as at be been but by can do for from had has have he his if in is it its may new no not of on one or other she so some that the their there they this to was we were which will with you your 0 1 2 3 4".split())


def words_of(text: str) -> list[str]:
    return re.sub(r"[^\w]+|_+", " ", text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def telling_words(templates: list[tuple[str, str]], threshold: float) -> list[str]:
    """Words such that every unit similar to some template holds one: in each, too few bigrams to be similar avoid them."""
    chosen: list[str] = []
    for _, text in sorted(templates, key=lambda t: len(t[1])):
        grams = [g.split() for g in bigrams_of(text)]
        free = [g for g in grams if not set(g) & set(chosen)]
        least = math.ceil(threshold / (2 - threshold) * len(grams) - 1e-9)
        while len(free) >= least:
            best = max({w for g in free for w in g}, key=lambda w: (w not in COMMON, min(len(w), 7) * sum(w in g for g in free), w))
            chosen.append(best)
            free = [g for g in free if best not in g]
    return chosen


def _bigrams(words: Column) -> Column:
    n = F.size(words)
    pairs = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1)))
    return F.when(n >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"(?U)[^\w]+|_+", " "), " "), lambda w: w != "")


def _once(df: DataFrame, keep: list[str], name: str, x: Column) -> DataFrame:
    """explode(array(x)) keeps x computed once: the optimiser would push later filters down and copy every step into them."""
    return df.select(*keep, F.explode(F.array(x)).alias(name))


def _runs(rough: DataFrame, sized: list[tuple[str, list[str]]], threshold: float) -> DataFrame:
    """Rows of scan() for runs of lines."""
    low, high = threshold / (2 - threshold) - 1e-12, (2 - threshold) / threshold + 1e-12
    number = lambda c: c.cast("int")
    distinct = lambda grams: F.size(F.array_distinct(grams))
    kept = ["doc_id"]
    step = _once(rough.filter(F.contains("text", F.lit("\n"))), kept, "l", F.split("text", "\n"))
    blank = F.array_compact(F.transform("l", lambda t, i: F.when(t.rlike(r"^[ \t\r]*\z"), number(i))))
    step = step.select("doc_id", blank.alias("blank"), F.transform("l", _words).alias("l"))
    kept += ["blank"]
    # of each word: the word, its line, its place in the line, the line's words
    placed = F.flatten(F.transform("l", lambda ws, i: F.transform(ws, lambda w, k: F.struct(w.alias("w"), number(i).alias("line"), number(k).alias("k"), F.size(ws).alias("n")))))
    step = _once(step, kept, "w", placed).filter(F.size("w") >= 2)
    kept += ["w"]
    at = lambda i: F.get("w", i)
    step = _once(step, kept, "g", F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat(at(i)["w"], F.lit(" "), at(i + 1)["w"])))
    kept += ["g"]
    every = sorted({x for _, b in sized for x in b})
    # a hit, at word p, goes from line a, whose first word is number ``first``, to line b, whose last is number ``last``
    place = lambda x, p: F.struct(
        x.alias("x"), number(p).alias("p"), at(p)["line"].alias("a"), number(p - at(p)["k"]).alias("first"), at(p + 1)["line"].alias("b"), number(p - at(p + 1)["k"] + at(p + 1)["n"]).alias("last")
    )
    step = _once(step, kept, "h", F.array_compact(F.transform("g", lambda x, p: F.when(x.isin(every), place(x, p)))))
    known = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(name).alias("license"), F.array(*map(F.lit, b)).alias("b"), F.lit(math.ceil(low * len(b))).alias("least")) for k, (name, b) in enumerate(sized)))
    there = F.filter(known, lambda t: F.size(F.array_intersect(F.col("h")["x"], t["b"])) >= t["least"])
    step = _once(step, [*kept, "h"], "t", there).filter(F.size("t") > 0)
    step = _once(step, kept, "t", F.transform("t", lambda t: F.struct(t["k"].alias("k"), t["license"].alias("license"), t["least"].alias("least"), F.size(t["b"]).alias("n"), F.filter("h", lambda h: F.array_contains(t["b"], h["x"])).alias("m"))))

    def from_line(t: Column, start: Column) -> Column:
        """Runs that start at the line of a hit; beyond a window with too many bigrams for the template none reaches the threshold."""
        s, wide = start["h"], number(F.ceil(t["n"] * F.lit(2 * high)))
        # transform(array(x)) keeps x computed once
        over = F.array(distinct(F.slice("g", s["p"] + 1, wide)) > t["n"] * F.lit(high))
        within = lambda o: F.when(o, F.filter(F.slice(t["m"], start["i"] + 1, wide), lambda h: h["p"] < s["p"] + wide)).otherwise(F.slice(t["m"], start["i"] + 1, F.size(t["m"])))
        inside = F.transform(over, within)

        def runs(i: Column) -> Column:
            gains = F.transform(F.array_distinct(i["x"]), lambda x, k: F.struct((number(k) + 1).alias("same"), F.get(i, number(F.array_position(i["x"], x)) - 1).alias("h")))
            return F.transform(
                F.filter(gains, lambda e: e["same"] >= t["least"]),
                lambda e: F.struct(
                    (-2.0 * e["same"] / (t["n"] + distinct(F.slice("g", s["first"] + 1, e["h"]["last"] - s["first"])))).alias("d"),
                    t["license"].alias("license"), s["a"].alias("a"), e["h"]["b"].alias("b"), t["k"].alias("k"),
                ),
            )

        return F.filter(F.flatten(F.transform(inside, runs)), lambda r: r["d"] <= -threshold + 1e-12)

    first_hit = lambda t, h, i: (i == 0) | (F.get(t["m"], i - 1)["a"] != h["a"])
    starts = lambda t: F.array_compact(F.transform(t["m"], lambda h, i: F.when(first_hit(t, h, i), F.struct(h.alias("h"), number(i).alias("i")))))
    every_run = F.flatten(F.transform("t", lambda t: F.flatten(F.transform(starts(t), lambda s: from_line(t, s)))))
    step = _once(step, [*kept, "t"], "r", F.array_sort(every_run)).filter(F.exists("r", lambda r: r["a"] < r["b"]))
    # best first; one line is a unit of its own and only keeps worse runs of its template away
    meets = lambda o, r: (o["a"] <= r["b"]) & (r["a"] <= o["b"]) & ((o["a"] < o["b"]) | (o["k"] == r["k"]))
    apart = F.aggregate("r", F.filter("r", lambda _: F.lit(False)), lambda got, r: F.when(F.exists(got, lambda o: meets(o, r)), got).otherwise(F.concat(got, F.array(r))))
    step = _once(step, [*kept, "t"], "r", F.filter(apart, lambda r: r["a"] < r["b"])).select(*kept, "t", F.explode("r").alias("r"))
    # left out where the paragraph or the document around it has a row by this template
    before = F.coalesce(F.array_max(F.filter("blank", lambda i: i <= F.col("r.a"))), F.lit(-1))
    after = F.coalesce(F.array_min(F.filter("blank", lambda i: i > F.col("r.a"))), F.lit(2**31 - 1))
    step = _once(step, ["doc_id", "w", "g", "r"], "e", F.struct(F.filter("t", lambda t: t["k"] == F.col("r.k"))[0].alias("t"), before.alias("before"), after.alias("after")))
    step = step.select("doc_id", "w", "g", "r", "e.t", "e.before", "e.after")
    dice = lambda hits, grams, n: 2.0 * distinct(hits["x"]) / (n + distinct(grams))
    n = F.col("t.n")
    around = F.filter("g", lambda _, p: (at(p)["line"] > F.col("before")) & (at(p + 1)["line"] < F.col("after")))
    paragraph = dice(F.filter("t.m", lambda h: (h["a"] > F.col("before")) & (h["b"] < F.col("after"))), around, n)
    found = step.filter((F.col("r.b") > F.col("after")) | (paragraph < threshold - 1e-12)).filter(dice(F.col("t.m"), F.col("g"), n) < threshold - 1e-12)
    return found.select("doc_id", F.lit("lines").alias("unit"), F.col("r.a").cast("long").alias("position"), "r.license", F.round(-F.col("r.d"), 6).alias("dice"))


def scan(docs: DataFrame, threshold: float = 0.8, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, unit, position, license, dice), one row per unit whose best template reaches the threshold.

    ``unit`` is line, paragraph, document or lines and ``position`` its number in the text, from 0 (of lines, the first line's);
    a text of one paragraph or line gives no row for the larger unit. Lines are a run of two or more, across blank ones too:
    of runs that overlap the best one, unless its paragraph or the document reaches the threshold by the same template. Ties go to the licence named first in the alphabet. Null and empty texts and
    units of less than two words give no row; repeated rows give theirs each; a null id stays null.
    """
    templates = TEMPLATES if templates is None else templates
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    telling = "|".join(sorted(telling_words(templates, threshold)))
    rough = base.filter(F.col("text").rlike(rf"(?iU)(?<![^\W_])(?:{telling})(?![^\W_])"))
    lines, parts = F.split("text", "\n"), F.split("text", r"\n[ \t\r]*\n")
    unit = lambda kind, texts: F.transform(texts, lambda t, i: F.struct(F.lit(kind).alias("unit"), i.alias("position"), t.alias("t")))
    none = F.filter(unit("line", F.array("text")), lambda _: F.lit(False))
    units = F.concat(unit("line", lines), F.when(F.size(parts) > 1, unit("paragraph", parts)).otherwise(none), F.when(F.size(lines) > 1, unit("document", F.array("text"))).otherwise(none))
    cut = rough.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.unit", "u.position", F.col("u.t").alias("t"))
    cut = cut.filter(F.col("t").rlike(rf"(?iU)(?<![^\W_])(?:{telling})(?![^\W_])"))
    unit_key = ["doc_id", "unit", "position"]
    grams = _once(_once(cut, unit_key, "w", _words(F.col("t"))), unit_key, "a", _bigrams(F.col("w")))
    sized = [(name, b) for name, text in templates if (b := bigrams_of(text))]
    sizes = [len(b) for _, b in sized]
    low, high = threshold / (2 - threshold) - 1e-12, (2 - threshold) / threshold + 1e-12
    grams = grams.filter(F.size("a").between(math.ceil(low * min(sizes)), math.floor(high * max(sizes))))
    dices = []
    for name, b in sized:
        fits = (F.size("a") >= low * len(b)) & (F.size("a") <= high * len(b))
        dice = 2.0 * F.size(F.array_intersect("a", F.array(*map(F.lit, b)))) / (F.size("a") + F.lit(len(b)))
        dices.append(F.when(fits, F.struct((-dice).alias("d"), F.lit(name).alias("license"))))
    best = F.array_min(F.array(*dices))  # nulls are left out
    found = _once(grams, unit_key, "best", best).filter(F.col("best.d") <= -threshold + 1e-12)
    found = found.select("doc_id", "unit", F.col("position").cast("long").alias("position"), "best.license", F.round(-F.col("best.d"), 6).alias("dice"))
    return found.unionAll(_runs(rough, sized, threshold))
