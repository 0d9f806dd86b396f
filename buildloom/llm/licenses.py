"""License scan: running words against license templates by Dice over word bigrams, in DataFrame functions alone.

A text's words are lower-cased runs of letters, digits and inner full stops, whatever lies between
them, so notices match across line ends, comment marks and inside longer sentences.  A window of n
bigrams and a template of m share k of them, as often as both have each; its Dice is 2 k / (n + m).
To reach Dice d a window must share at least m * d / (2 - d) and have no more than m * (2 - d) / d
bigrams: these size bounds leave out texts, templates and stretches before any window is compared.

First, every window that can match holds one of a few telling words (`ANCHORS`, worked out from the
templates so that what is left of any of them without these words is too little); texts without
one are left out at once.  Then a template is looked for only in stretches, as long as its
longest window, that hold enough of its bigrams together with the next one.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

LEAST = 0.8

# Sentences of public license notices, by SPDX identifier.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the 3-clause BSD license."),
    ("BSD-2-Clause", "Released under the 2-clause BSD license."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0-or-later", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
]


# Common words, which leave out few texts.
COMMON = """
the of and to a in is it that was for on are with as be at by this from or an have not had but were which their has any all no if may can its
without under version subject source received provided other such out either see you your must use used do so more than also only shall above whole
""".split()


def _split(text: str) -> list[str]:
    return re.sub(r"\.+(?= |$)", "", re.sub("[^a-z0-9.]+", " ", text.lower()).strip()).split()


def _pairs(text: str) -> list[str]:
    w = _split(text)
    return [f"{a} {b}" for a, b in zip(w, w[1:])]


def bounds(m: int, least: float = LEAST) -> tuple[int, int]:
    """The fewest bigrams that a match shares with a template of m, and the most that its window has."""
    return math.ceil(m * least / (2 - least) - 1e-9), math.floor(m * (2 - least) / least + 1e-9)


def anchors(least: float = LEAST) -> list[str]:
    """Words of which every window that matches a template holds one: picked until each template has fewer bigrams without them than a match shares.

    The word that helps the most templates the furthest comes first; short and common ones last."""
    worth = lambda w: 1e-4 if w in COMMON else 0.01 if len(w) <= 5 else 1.0
    left = {i: (_pairs(t), bounds(len(_pairs(t)), least)[0]) for i, (_, t) in enumerate(TEMPLATES)}
    chosen: list[str] = []
    while True:
        over = {i: len(bare) - need + 1 for i, (pairs, need) in left.items() if len(bare := [p for p in pairs if not set(p.split()) & set(chosen)]) >= need}
        if not over:
            return sorted(chosen)
        gain: Counter = Counter()
        for i, much in over.items():
            seen = Counter(w for p in left[i][0] if not set(p.split()) & set(chosen) for w in set(p.split()))
            for w, n in seen.items():
                gain[w] += worth(w) * min(n, much)
        chosen.append(max(gain, key=lambda w: (gain[w], len(w), w)))


ANCHORS = anchors()


def _templates(spark: SparkSession, least: float) -> DataFrame:
    """(template, license, bigram, times, size, need, most) rows: as many as the list above has bigrams."""
    rows = []
    for i, (k, t) in enumerate(TEMPLATES):
        pairs = _pairs(t)
        need, most = bounds(len(pairs), least)
        rows += [(i, k, p, n, len(pairs), need, most) for p, n in Counter(pairs).items()]
    cells = ", ".join("({}, '{}', '{}', {}, {}, {}, {})".format(*r) for r in rows)
    return spark.sql(f"select * from values {cells} as t(template, license, bigram, times, size, need, most)")


def _words(text: Column) -> Column:
    """Runs of a-z, 0-9 and inner full stops, lower case."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9.]+", " "), r"\.+(?= |$)", "")
    return F.filter(F.split(clean, " +"), lambda w: w != "")


def _hits(rows: DataFrame, least: float) -> DataFrame:
    """(row, template, license, times, size, need, most, pos, bigram) of each bigram of a text that a template has."""
    words = rows.where(F.lower("text").rlike("|".join(map(re.escape, ANCHORS) if least >= LEAST else [".*"]))).select("row", _words(F.col("text")).alias("words"))
    pairs = F.transform("words", lambda w, i: F.concat(w, F.lit(" "), F.get("words", i + 1)))
    return words.select("row", F.posexplode(pairs).alias("pos", "bigram")).where("bigram is not null").join(F.broadcast(_templates(rows.sparkSession, least)), "bigram")


def _windows(hits: DataFrame, least: float) -> DataFrame:
    """(row, license, first, last, dice): for each bigram that may begin a window, and each template, the best window from it that reaches `least`."""
    stretch = F.floor(F.col("pos") / F.col("most")).cast("int")
    homes = hits.withColumn("at", stretch).withColumn("home", F.explode(F.array("at", F.col("at") - 1)))
    key = ["row", "template", "home"]
    full = homes.withColumn("seen", F.count("*").over(Window.partitionBy(*key))).where("seen >= need")
    begin = full.where("at = home").select(*key, F.col("pos").alias("first"))
    pairs = full.join(begin, key).where("pos >= first and pos < first + most")
    again = F.row_number().over(Window.partitionBy("row", "template", "first", "bigram").orderBy("pos"))
    upto = Window.partitionBy("row", "template", "first").orderBy("pos")
    pairs = pairs.withColumn("counts", (again <= F.col("times")).cast("int")).withColumn("shared", F.sum("counts").over(upto))
    dice = F.lit(2.0) * F.col("shared") / (F.col("pos") - F.col("first") + 1 + F.col("size"))
    good = pairs.withColumn("dice", dice).where(F.col("dice") >= least)
    best = good.groupBy("row", "license", "template", "first").agg(F.min(F.struct((-F.col("dice")).alias("minus"), F.col("pos").alias("last"))).alias("x"))
    return best.select("row", "license", "first", "x.last", (-F.col("x.minus")).alias("dice"))


def _places(windows: DataFrame) -> DataFrame:
    """(row, license, first, last, dice): the best window of each run of overlapping ones of a license, unless another license does better there; ties go to the earlier window and the smaller identifier."""
    before = F.max("last").over(Window.partitionBy("row", "license").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1))
    number = F.sum("opens").over(Window.partitionBy("row", "license").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, 0))
    # windows of one begin and end are alike but for their dice
    one = windows.groupBy("row", "license", "first", "last").agg(F.max("dice").alias("dice"))
    runs = one.withColumn("opens", F.coalesce(F.col("first") > before, F.lit(True)).cast("int")).withColumn("run", number)
    best = runs.groupBy("row", "license", "run").agg(F.min(F.struct((-F.col("dice")).alias("minus"), "first", "last")).alias("x")).select("row", "license", "x.first", "x.last", (-F.col("x.minus")).alias("dice"))
    other = best.select("row", *(F.col(c).alias(f"{c}_") for c in ("license", "first", "last", "dice")))
    better = (F.col("license") != F.col("license_")) & (F.col("first") <= F.col("last_")) & (F.col("first_") <= F.col("last")) & ((F.col("dice_") > F.col("dice")) | ((F.col("dice_") == F.col("dice")) & (F.col("license_") < F.col("license"))))
    beaten = best.join(other, "row").where(better).select("row", "license", "first").distinct()
    return best.join(beaten, ["row", "license", "first"], "left_anti")


def license_scan(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word, words, license, dice): each place of a text that a template matches by `least` or more.

    word is the place's first word and words how many it has.  Null, empty and license-free texts
    give no row.  A row that occurs twice is scanned twice and gives its rows twice; null ids stay;
    an empty table gives an empty result; other columns are not read.  The templates, a fixed list,
    are broadcast."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    # the id goes with the row; the texts are read once, for windows are made of the few hits twice
    hits = written(_hits(rows.withColumn("row", F.struct("row", "id")), least), "hits")
    found = _places(_windows(hits, least))
    return found.select(F.col("row.id").alias(id_col), F.col("first").cast("long").alias("word"), (F.col("last") - F.col("first") + 2).cast("long").alias("words"), "license", F.round("dice", 6).alias("dice"))


def oracle_sql(least: float = LEAST) -> str:
    """The same over documents in DuckDB: every window that begins and ends with a bigram of a template, of all texts."""
    quoted = ", ".join("({}, '{}', '{}')".format(i, k, t.replace("'", "''")) for i, (k, t) in enumerate(TEMPLATES))
    words = lambda c: f"list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9.]+', ' ', 'g'), '\\.+ ', ' ', 'g'), '\\.+$', '')), ' '), lambda w: w <> '')"
    pairs = "list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])"
    return f"""
with tw as (select t, license, {words("text")} as words from (values {quoted}) v(t, license, text)), tp as (select t, license, len(words) - 1 as size, {pairs} as pairs from tw),
tb as (select t, license, size, bigram, count(*) times from (select t, license, size, unnest(pairs) bigram from tp) group by all),
dw as (select row_number() over () as r, doc_id, {words("text")} as words from documents where text is not null), dp as (select r, doc_id, {pairs} as pairs from dw where len(words) > 1),
db as (select r, doc_id, unnest(pairs) bigram, unnest(range(0, len(pairs))) pos from dp), h as (select * from db join tb using (bigram)), en as (select r, t from h group by 1, 2 having count(*) >= any_value(size) * {least} / (2 - {least}) - 1e-9),
hh as (select h.* from h join en using (r, t)), w as (select a.r, a.doc_id, a.t, a.license, a.size, a.pos as f, b.pos as l, row_number() over (partition by a.r, a.t, a.pos, b.bigram order by b.pos) <= b.times as c from hh a join hh b on a.r = b.r and a.t = b.t and b.pos >= a.pos and b.pos < a.pos + a.size * (2 - {least}) / {least} + 1e-9),
s as (select *, sum(c::int) over (partition by r, t, f order by l) as shared from w), d as (select *, 2.0 * shared / (l - f + 1 + size) as dice from s), g as (select r, doc_id, license, t, f, max(dice) as dice, arg_min(l, struct_pack(a := -dice, b := l)) as l from d where dice >= {least} group by all),
o as (select r, doc_id, license, f, l, max(dice) dice from g group by all), p as (select *, coalesce(f > max(l) over (partition by r, license order by f, l rows between unbounded preceding and 1 preceding), true)::int as opens from o),
q as (select *, sum(opens) over (partition by r, license order by f, l rows unbounded preceding) as run from p), z as (select r, doc_id, license, run, max(dice) dice, arg_min(f, struct_pack(a := -dice, b := f, c := l)) f, arg_min(l, struct_pack(a := -dice, b := f, c := l)) l from q group by all)
select doc_id, f as word, l - f + 2 as words, license, round(dice, 6) as dice from z x where not exists (select 1 from z y where y.r = x.r and y.license <> x.license and y.f <= x.l and x.f <= y.l and (y.dice > x.dice or (y.dice = x.dice and y.license < x.license)))"""
