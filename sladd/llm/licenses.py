"""Licence scan by the Dice coefficient over word bigrams, in DataFrame functions only.

A text is normalised (lower case, everything but letters and digits becomes one space, line ends stay) and cut into units: each
line, each paragraph and the whole text. A unit is compared with a template only if the numbers of their distinct bigrams
allow the threshold: ``2 min(a, b) / (a + b) >= threshold``. Before that, units without any marker word are left out. The
markers of a template cover so many of its bigrams that a unit without all of them cannot reach the threshold, so no match is lost.
The few units that are left meet the templates by their bigrams in a broadcast table of fixed size; only ids are shuffled.

A notice inside a unit or over several units is found by word windows as long as a template: for each licence that no unit of
the text gives, the windows of the whole text that begin with one of the template's bigrams, or end with the text, are compared
in the same way. A window that reaches the threshold has at least ``t b / (2 - t)`` bigrams of the template, so only such windows
are read. Each licence that is found so counts as one unit more. Only texts with such a window are shuffled.

Cases: null, empty and one-word texts match nothing; the best unit counts, ties go to the first template; a notice that is
repeated counts once; repeated rows are judged each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sladd.llm.common import fingerprint, written

THRESHOLD = 0.8
#: Names, titles and versions of a family whose notices differ in these alone.
GNU_VERSIONS = (("GPL-3.0", "GNU General Public License", "3"), ("GPL-2.0", "GNU General Public License", "2"), ("LGPL-3.0", "GNU Lesser General Public License", "3"),
                ("LGPL-2.1", "GNU Lesser General Public License", "2.1"), ("AGPL-3.0", "GNU Affero General Public License", "3"))
#: Wordings of their notices.
GNU_NOTICES = (
    "This work is licensed under the {title}, version {version}.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the {title} as published by "
    "the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
    "This program is free software; you can redistribute it and/or modify it under the terms of the {title} version {version} as published by "
    "the Free Software Foundation.",
)
#: Every wording for every version: whatever else a text changes costs all versions the same, so the bigrams in which they differ decide.
GNU = tuple((name, wording.format(title=title, version=version)) for wording in GNU_NOTICES for name, title, version in GNU_VERSIONS)
#: Names and texts of public licence notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
     "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
     "See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
     "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
     "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
     "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
     "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
     "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
     "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
     "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
     "above copyright notice and this permission notice appear in all copies."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Released under the BSD License."),
    *GNU,
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
     "file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Words that make poor markers.
COMMON = frozenset("a all an and any are as at be by can for from if in is it no not of on one or that the this to under was with you work use".split())


#: A table of templates may have this many rows; they go into the plan.
MOST_TEMPLATES = 1000


def template_table(rows: DataFrame) -> tuple:
    """Templates out of a table ``license, body`` in the order of its rows' names and texts; raises beyond MOST_TEMPLATES rows.

    Rows without a name or with fewer than two words are left out, repeated ones count once.
    """
    held = rows.select("license", "body").where("license is not null and body is not null").distinct().limit(MOST_TEMPLATES + 1).collect()
    if len(held) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    return tuple(sorted((r.license, r.body) for r in held if bigrams(r.body)))


def plain_words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def bigrams(text: str) -> list[str]:
    found = plain_words(text)
    return sorted({f"{a} {b}" for a, b in zip(found, found[1:])})


def markers(text: str, threshold: float) -> set[str]:
    """Words of which every unit that reaches the threshold has one."""
    grams = bigrams(text)
    # dice >= t needs an overlap of t (a + b) / 2 with a >= overlap, so overlap >= t b / (2 - t)
    missing = len(grams) - math.ceil(threshold * len(grams) / (2 - threshold) - 1e-9)
    chosen: set[str] = set()
    left = list(grams)
    while len(grams) - len(left) <= missing:
        known = [w for g in left for w in g.split()]
        word = max(set(known) - chosen, key=lambda w: (w not in COMMON, known.count(w), w))
        chosen.add(word)
        left = [g for g in left if word not in g.split()]
    return chosen


def normalised(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}\n]+", " "))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``key, license, dice, n_units``: the best template, its coefficient, and how many units reach the threshold.

    ``templates`` are pairs of a name and a text, as :func:`template_table` reads them from a table.
    """
    spark = docs.sparkSession
    known = sorted(reduce(set.union, (markers(t, threshold) for _, t in templates), set()))
    marked = F.array(*[F.lit(w) for w in known])
    has = lambda words: F.arrays_overlap(F.split(words, " "), marked)
    base = docs.select(F.col(key).alias("id"), fingerprint(text).alias("fp"), F.col(text).alias("text"))
    norm = base.select("id", "fp", normalised(F.col("text")).alias("norm")).filter(has(F.translate("norm", "\n", " ")))
    norm = written(norm)  # texts with a marker word, which are read three times
    cut = F.concat(F.split("norm", "\n"), F.split("norm", r"\n ?(?:\n ?)+"), F.array("norm"))
    units = norm.select("id", "fp", F.explode(cut).alias("unit")).select("id", "fp", F.trim(F.regexp_replace("unit", r"[ \n]+", " ")).alias("unit"))
    units = units.filter(has("unit")).distinct()
    pairs = units.withColumn("w", F.split("unit", " ")).filter(F.size("w") > 1)
    grams = pairs.withColumn("grams", F.array_distinct(F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w")), lambda a, b: F.concat_ws(" ", a, b))))
    # the templates are a fixed table of a few thousand short rows
    rows = [(at, name, len(bigrams(body)), gram) for at, (name, body) in enumerate(templates) for gram in bigrams(body)]
    postings = F.broadcast(spark.createDataFrame(rows, "at int, license string, b int, gram string"))
    n, b = F.col("n"), F.col("b")
    bounds = 2 * F.least(n, b) >= F.lit(threshold) * (n + b)
    sizes = sorted({len(bigrams(body)) for _, body in templates})
    possible = reduce(lambda x, y: x | y, [2 * F.least(n, F.lit(k)) >= F.lit(threshold) * (n + k) for k in sizes])
    open_ = grams.withColumn("n", F.size("grams")).filter(possible).select("id", "fp", "unit", "n", F.explode("grams").alias("gram"))
    met = open_.join(postings, "gram").filter(bounds).groupBy("id", "fp", "unit", "n", "at", "license", "b").agg(F.count("*").alias("both"))
    scored = met.withColumn("dice", 2.0 * F.col("both") / (n + b)).filter(F.col("dice") >= threshold)
    scored = scored.select("id", "fp", "unit", "at", "license", "dice")
    inner = _windows(norm, scored, templates, threshold)
    best = scored.unionByName(inner).groupBy("id", "fp").agg(F.max(F.struct("dice", -F.col("at"), "license")).alias("top"), F.countDistinct("unit").alias("n_units"))
    ids = base.select("id", "fp").alias("d")
    out = ids.join(best.alias("m"), F.col("d.id").eqNullSafe(F.col("m.id")) & (F.col("d.fp") == F.col("m.fp")), "left")
    return out.select(F.col("d.id").alias(key), F.col("top.license").alias("license"), F.col("top.dice").alias("dice"), F.coalesce("n_units", F.lit(0).cast("long")).alias("n_units"))


def _windows(norm: DataFrame, scored: DataFrame, templates, threshold: float) -> DataFrame:
    """``id, fp, unit, at, license, dice`` of the best window of each licence that no unit in ``scored`` gives."""
    spark = norm.sparkSession
    rows = [(at, name, max(1, len(plain_words(body)) - 1), bigrams(body)) for at, (name, body) in enumerate(templates)]
    # a row a template; ``long`` is the length of a window in bigrams
    known = F.broadcast(spark.createDataFrame(rows, "at int, license string, long int, own array<string>"))
    postings = F.broadcast(known.select("at", "license", "long", F.size("own").alias("b"), F.explode("own").alias("gram")))
    w = F.filter(F.split(F.translate("norm", "\n", " "), " "), lambda x: x != "")
    pairs = norm.select("id", "fp", w.alias("w")).filter(F.size("w") > 1)
    grams = pairs.select("id", "fp", F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w")), lambda a, b: F.concat_ws(" ", a, b)).alias("grams"))
    each = grams.select("id", "fp", F.size("grams").alias("n"), F.posexplode("grams").alias("p", "gram"))
    met = each.join(postings, "gram").filter(F.col("n") >= F.col("long"))
    met = met.groupBy("id", "fp", "n", "at", "license", "long", "b").agg(F.array_sort(F.collect_set("p")).alias("ps"))
    need = F.lit(threshold / (2 - threshold)) * F.col("b") - 1e-9
    met = met.filter(F.size("ps") >= need)
    # the k-th position from a start tells whether its window has enough of the template's bigrams
    k = F.ceil(need).cast("int")
    first = F.transform(F.slice("ps", 1, F.greatest(F.lit(0), F.size("ps") - k + 1)), lambda p, i: F.when(F.element_at("ps", i + k) < p + F.col("long"), F.least(p, F.col("n") - F.col("long"))))
    met = met.withColumn("starts", F.array_distinct(F.filter(first, lambda x: x.isNotNull()))).filter(F.size("starts") > 0)
    found = scored.select(F.col("id").alias("i"), F.col("fp").alias("f"), F.col("license").alias("l")).distinct()
    met = met.join(found, F.col("id").eqNullSafe(F.col("i")) & (F.col("fp") == F.col("f")) & (F.col("license") == F.col("l")), "left_anti")
    met = met.select(F.col("id").alias("i"), F.col("fp").alias("f"), "at", "starts")
    # repeated rows have the same windows and are one text here
    open_ = grams.join(met, F.col("id").eqNullSafe(F.col("i")) & (F.col("fp") == F.col("f"))).select("id", "fp", "grams", "at", F.explode("starts").alias("start"))
    cut = open_.join(known, "at").select("id", "fp", "at", "license", "own", F.array_distinct(F.slice("grams", F.col("start") + 1, F.col("long"))).alias("cut"))
    dice = 2.0 * F.size(F.array_intersect("cut", "own")) / (F.size("cut") + F.size("own"))
    good = cut.select("id", "fp", "at", "license", dice.alias("dice")).filter(F.col("dice") >= threshold)
    top = good.groupBy("id", "fp", "license").agg(F.max(F.struct("dice", -F.col("at"))).alias("top"))
    return top.select("id", "fp", F.concat(F.lit("\n"), F.col("license")).alias("unit"), (-F.col("top.col2")).alias("at"), "license", F.col("top.dice").alias("dice"))
