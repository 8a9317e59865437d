"""License scans in DataFrame functions alone: MinHash bands over overlapping word windows, then exact containment.

A template of N words is looked for in windows of 3N words that start at every multiple of N, so that any passage of up
to 2N words, a copy with as much inserted as it has itself, lies whole within one window. Template and window are sets of
five-word shingles. Signatures of ``bands_for(...)`` minima, one row a band, retrieve the templates of a window: a window
that holds enough of a template has a Jaccard similarity J of about a quarter with it, and misses all B bands with
probability (1 - J)^B, which the number of bands keeps below MISS for the worst template and containment. What is
retrieved is verified by the exact share of the template's shingles that the window holds.

Windows that hold no shingle of any template of their size have similarity 0 with all of them, so no band can retrieve
anything there; a join of the shingles with those of the templates tells which windows are left to be signed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

SHINGLE, CONTAINMENT, MISS = 5, 0.8, 1e-9
#: Words in a window for each word of its template.
WIDE = 3
#: Rows of templates, their bands or the windows found up to which they are sent to every executor; beyond, Spark joins
#: them as any table.
FEW = 200_000
#: Shingles of a text that are handled together when its windows are signed.
PIECE = 2048

# Notices as the licenses' publishers word them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        # All of it stands in the license of three clauses too, which then is found besides, by the clause that it adds.
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        'that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR '
        "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
)


def words_in(text: str) -> list[str]:
    """The words of a text for this scan: runs of ASCII letters and digits, A-Z lower-cased."""
    return re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def bands_for(lengths: Sequence[int], containment: float = CONTAINMENT, miss: float = MISS) -> int:
    """Bands of one row that keep the chance of missing a window with this containment of its template below miss."""
    need = 1
    for n in lengths:
        own = n - SHINGLE + 1
        held = math.ceil(containment * own)
        j = held / (WIDE * n - SHINGLE + 1 + own - held)
        need = max(need, math.ceil(math.log(miss) / math.log1p(-j)) if j < 1 else 1)
    return need


def _once(value: Column, fn) -> Column:
    """fn(value) with value worked out once, however often fn names it and wherever Catalyst moves the whole."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _words(text: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.split(F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), upper, lower), "[^a-z0-9]+", " ")), " ")


def _shingles(words: Column) -> Column:
    """A hash of each run of five words, in order; the array is empty where there are fewer."""
    at = F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(0), F.size(words) - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(SHINGLE)]))


def _bands(shingles: Column, n: int) -> Column:
    """The minimum of each of n hash functions over a set of shingles."""
    return _once(shingles, lambda s: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.array_min(F.transform(s, lambda x: F.xxhash64(x, j)))))


def _template_table(spark: SparkSession, templates: Sequence[tuple[str, str]], n_bands: int) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(" ".join(words_in(t))).alias("text")) for k, t in templates])
    one = spark.range(1).select(F.explode_outer(rows).alias("t")).select("t.*").withColumn("w", F.split("text", " "))
    return one.select("license", F.size("w").alias("n"), F.array_distinct(_once(F.col("w"), _shingles)).alias("t_shingles")).withColumn("t_bands", _bands(F.col("t_shingles"), n_bands))


def scan_licenses(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    containment: float = CONTAINMENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, license, containment, first_word): for each row and license that some window holds with this containment or
    more, the greatest share of a template's shingles in one window (6 decimals) and the first word of the earliest
    such window.

    templates: (license, text) pairs, of five words at least; several may name one license. Null and empty texts match
    nothing. Rows that share an id, also a null id, count as one document. Other columns are ignored.

    One pass hashes every shingle of every text and joins them with the templates' own, which tells the windows that can
    hold anything; they are written to the shared folder. A second pass signs these windows of the texts that have any.
    Templates and windows are broadcast behind a count of their rows or windows, and joined by shuffles beyond FEW of them;
    the texts are never sent more than once. A text is cut into pieces once, and a window takes its shingles from its piece, so
    the work is linear in a text's length however many licenses it names.
    """
    spark = docs.sparkSession
    lengths = {t: len(words_in(t)) for _, t in templates}
    if min(lengths.values()) < SHINGLE:
        raise ValueError(f"a template needs {SHINGLE} words at least")
    n_bands = bands_for(sorted(set(lengths.values())), containment)
    table = _template_table(spark, templates, n_bands)
    few = lambda df, n: F.broadcast(df) if n <= FEW else df

    own = table.select("n", F.explode_outer("t_shingles").alias("shingle")).distinct()
    own = few(own, sum(lengths.values()))
    each = docs.select(F.col(id_col).alias("_id"), F.posexplode(_once(_words(F.col(text_col)), _shingles)).alias("i", "shingle"))
    starts = F.array(*[F.floor(F.col("i") / F.col("n")) - j for j in range(WIDE)])
    inside = F.filter(starts, lambda k: (k >= 0) & (F.col("i") + SHINGLE <= (k + WIDE) * F.col("n")))
    hits = each.join(own, "shingle").select("_id", "n", F.explode(inside).alias("k")).distinct()
    # Texts are cut into pieces of PIECE shingles and as many more as a window that begins there can hold, once.
    widest = WIDE * max(lengths.values())
    at = stored(hits.withColumn("piece", F.floor(F.col("k") * F.col("n") / PIECE)).groupBy("_id", "piece").agg(F.collect_list(F.struct("n", "k")).alias("at")).withColumnsRenamed({"_id": "_at", "piece": "_piece"}))
    n_at, ids = at.agg(F.sum(F.size("at"))).first()[0] or 0, at.select("_at").distinct()

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(few(ids, n_at), F.expr("_id <=> _at")).drop("_at")
    count = lambda s: F.sequence(F.lit(0), F.floor(F.greatest(F.size(s) - 1, F.lit(0)) / PIECE).cast("int"))
    cut = F.posexplode(_once(_once(_words(F.col("_t")), _shingles), lambda s: F.transform(count(s), lambda j: F.slice(s, j * PIECE + 1, F.lit(PIECE + widest)))))
    pieces = texts.select("_id", cut.alias("piece", "s")).join(few(at, n_at), F.expr("_id <=> _at AND piece = _piece"))
    first = lambda w: w["k"] * w["n"]
    within = F.filter("at", lambda w: first(w) - F.col("piece") * PIECE < F.size("s"))
    made = F.transform(within, lambda w: F.struct(w["n"].alias("n"), first(w).alias("first"), F.slice("s", (first(w) - F.col("piece") * PIECE + 1).cast("int"), (WIDE * w["n"] - (SHINGLE - 1)).cast("int")).alias("win")))
    windows = pieces.select("_id", F.explode(made).alias("w")).select("_id", "w.n", "w.first", "w.win")
    banded = windows.select("_id", "n", "first", "win", F.posexplode_outer(_bands(F.col("win"), n_bands)).alias("band", "least"))

    keyed = table.select("license", "n", "t_shingles", F.posexplode_outer("t_bands").alias("band", "least"))
    share = F.size(F.array_intersect("win", "t_shingles")) / F.size("t_shingles")
    found = banded.join(few(keyed, n_bands * len(templates)), ["n", "band", "least"]).select("_id", "license", "first", F.round(share, 6).alias("share"), share.alias("exact"))
    found = found.where(F.col("exact") >= containment)
    return found.groupBy("_id", "license").agg(F.max("share").alias("containment"), F.min("first").cast("long").alias("first_word")).withColumnRenamed("_id", id_col)


def oracle(templates: Sequence[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> str:
    """DuckDB SQL for the rows of ``scan_licenses`` over documents, by exact containment in all windows."""
    values = ", ".join(f"({i}, '{k}', '{' '.join(words_in(t))}')" for i, (k, t) in enumerate(templates))
    shingles = "unnest(list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')))"
    return f"""
WITH t AS (SELECT t_id, license, string_split(body, ' ') AS w FROM (VALUES {values}) AS v(t_id, license, body)),
ts AS (SELECT DISTINCT t_id, {shingles} AS sh FROM t),
tn AS (SELECT t.t_id, any_value(t.license) AS license, any_value(len(t.w)) AS n, count(*) AS own FROM t JOIN ts USING (t_id) GROUP BY t.t_id),
d AS (SELECT doc_id, string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
ds AS (SELECT doc_id, unnest(range(0, len(w) - 4)) AS i, {shingles} AS sh FROM d WHERE len(w) >= 5),
hit AS (SELECT ds.doc_id, ts.t_id, ds.i, ds.sh FROM ds JOIN ts USING (sh)),
win AS (SELECT DISTINCT doc_id, t_id, i // n - j AS k, sh FROM hit JOIN tn USING (t_id), range(0, {WIDE}) AS r(j) WHERE i // n >= j AND i + 5 <= (i // n - j + {WIDE}) * n),
share AS (SELECT doc_id, t_id, k, count(DISTINCT sh) AS held FROM win GROUP BY ALL)
SELECT doc_id, license, max(round(CAST(held AS DOUBLE) / own, 6)) AS containment, min(CAST(k * n AS BIGINT)) AS first_word
FROM share JOIN tn USING (t_id) WHERE CAST(held AS DOUBLE) / own >= {containment} GROUP BY doc_id, license
"""
