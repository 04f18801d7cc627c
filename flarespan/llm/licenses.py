"""License scans in DataFrame operations only.

Texts become hashed words, these five-word shingles.  Documents that hold no shingle of the library
at all are set aside first: none of their windows could meet a template.  In the others a window is
WINDOW consecutive shingles and one starts every STRIDE words, so windows overlap and every shingle is
in two.  A window has BANDS bands of two minima each.  Templates of at least LONG shingles have windows
at every offset, so each window of a text that lies inside a copy meets the window at its place.

How sure that is.  A window without a change inside a copy always collides with its twin, and 17 untouched
shingles in a row always hold such a window.  A changed word spoils five shingles: a copy with 0.8 of a
template of n shingles has at most n / 25 changed words and so at most n / 25 + 1 untouched runs with
0.8 n shingles, of which one has 17 for every n above 100.  It is never missed.  An inserted word spoils
four, and runs of 16 are possible, which hold a whole window in five of six alignments; a window with one
change still shares 7 of the 17 shingles of both and collides in a band with probability
1 - (1 - (7 / 17) ** 2) ** BANDS = 0.67, so the 14 windows and more of a copy would all miss with a
probability below 1e-6.  A template is taken as long from LONG shingles on.

In a shorter notice a window would hold mostly other text: its windows are single shingles, whose
minimum is the shingle itself, and it is never missed.  What is retrieved is verified on exact
shingles of the whole text: the share of the template's shingles that the text holds.

A template of fewer than five words is one shingle of all its words.  It is looked for in the whole
text directly, without bands, so it is never missed.  A template without words is an error.

Null and empty texts hold no template; long texts are searched whole.  Equal texts have equal
findings; repeated rows give one finding for each doc_id; rows with a null doc_id are searched like
any other, as one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, sized, stored

SHINGLE, WINDOW, STRIDE, BANDS, LONG = 5, 12, 6, 6, 101
CONTAINED = 0.8
SPLIT = r"[^\p{L}\p{N}]+"

#: Notices and license texts that are searched for.
TEMPLATES = {
    "rights-line": "All rights reserved.",
    "mit-line": "Released under the MIT License.",
    "apache-line": "Licensed under the Apache License, Version 2.0.",
    "gpl3-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "apache-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense-notice": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-line": "Licensed under CC BY-SA 4.0.",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd-3-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions
of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names
of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS
AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment
in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software. 3. This notice may not be removed or altered from any source distribution.""",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file",
}


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda w: w != "")


def shingle_texts(w: Column) -> Column:
    """All shingles of a word array, as texts, in order."""
    starts = F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1))
    return F.when(F.size(w) >= SHINGLE, F.transform(starts, lambda i: F.concat_ws(" ", F.slice(w, i, SHINGLE)))).otherwise(F.array().cast("array<string>"))


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def shingled(rows: DataFrame, stride: int, n: int, *keys: str) -> DataFrame:
    """``keys`` and h0, h1, ..: the hashes of ``n`` shingles from every ``stride``-th word on, null beyond the end.

    ``rows`` has the hashed words as ``_words``.  Stretches of words become rows before shingles are
    hashed, so hashing runs in generated code.
    """
    w = F.col("_words")
    starts = F.sequence(F.lit(0), F.size(w) - SHINGLE, F.lit(stride))
    names = [f"_w{k}" for k in range(n + SHINGLE - 1)]
    cut = F.transform(starts, lambda i: F.struct(*[F.get(w, i + k).alias(x) for k, x in enumerate(names)]))
    each = rows.select(*keys, F.inline(F.when(F.size(w) >= SHINGLE, cut)))
    return each.select(*keys, *[F.when(F.col(names[k + SHINGLE - 1]).isNotNull(), F.xxhash64(*names[k : k + SHINGLE])).alias(f"h{k}") for k in range(n)])


def band_rows(windows: DataFrame, key: str) -> DataFrame:
    """``key``, low: the bands of windows of ``shingled``; the minima are of one hash under different exclusive-or masks.

    Give it a stored table: hashing and minima together, or all minima at once, would be a generated
    method too long for the JVM to compile (8,000 bytes), so the bands are made in two scans.
    """
    low = [F.least(*[F.col(f"h{k}").bitwiseXOR(F.lit(mask)) for k in range(WINDOW)]) for mask in MASKS]
    bands = [F.xxhash64(low[2 * k], low[2 * k + 1], F.lit(k)) for k in range(BANDS)]
    return looked_up(windows, *bands[: BANDS // 2], key=key).unionByName(looked_up(windows, *bands[BANDS // 2 :], key=key))


#: Fixed 64-bit masks, made by rule.
MASKS = [(k * 0x9E3779B97F4A7C15 + 0x7F4A7C15F39CC060) % (1 << 64) - (1 << 63) for k in range(1, 2 * BANDS + 1)]


def looked_up(each: DataFrame, *columns: str | Column, key: str) -> DataFrame:
    return each.select(key, F.explode(F.array_compact(F.array(*columns))).alias("low"))


def template_lows(known: DataFrame) -> DataFrame:
    """template, low: bands of every whole window of the long templates, every shingle of the others."""
    rows = known.select("template", F.transform("_words", lambda w: F.xxhash64(w)).alias("_words"))
    long = F.size("_words") >= LONG + SHINGLE - 1
    whole = stored(shingled(rows.where(long), 1, WINDOW, "template").where(F.col(f"h{WINDOW - 1}").isNotNull()), "template-windows")
    return band_rows(whole, "template").unionByName(looked_up(shingled(rows.where(~long), 1, 1, "template"), "h0", key="template")).distinct()


def holders(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id of the documents that hold a shingle of the library; every shingle is hashed once."""
    rows = known.select("template", F.transform("_words", lambda w: F.xxhash64(w)).alias("_words"))
    library = stored(looked_up(shingled(rows, 1, 1, "template"), "h0", key="template").select("low").distinct(), "library")
    each = shingled(docs.select("doc_id", word_hashes(F.col("text")).alias("_words")), STRIDE, STRIDE, "doc_id")
    return looked_up(each, *[f"h{k}" for k in range(STRIDE)], key="doc_id").join(sized(library), "low", "left_semi").select("doc_id").distinct()


def candidates_of(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, template of the pairs that meet in a band."""
    some = stored(holders(docs, known).withColumnRenamed("doc_id", "_id"), "holders")
    near = docs.join(sized(some), docs["doc_id"].eqNullSafe(some["_id"]), "left_semi").select("doc_id", word_hashes(docs["text"]).alias("_words"))
    windows = stored(shingled(near, STRIDE, WINDOW, "doc_id"), "windows")
    lows = looked_up(windows, *[f"h{k}" for k in range(STRIDE)], key="doc_id").unionByName(band_rows(windows, "doc_id"))
    met = stored(lows.join(sized(stored(template_lows(known), "lows")), "low").select("doc_id", "template").distinct(), "candidates")
    forget(some, windows)
    return met


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    rows = spark.createDataFrame(sorted(templates.items()), "template string, body string")
    return rows.withColumn("_words", words(F.col("body")))


def short_findings(docs: DataFrame, short: list[tuple[str, list[str]]]) -> DataFrame:
    """doc_id, template, for templates of fewer words than a shingle; a row for each finding.

    A text is cut into words only where all words of some template are in it as strings.
    """
    lower = F.lower(F.col("text"))
    likely = F.lit(False)
    for _, w in short:
        all_in = F.lit(True)
        for x in w:
            all_in = all_in & F.contains(lower, F.lit(x))
        likely = likely | all_in
    spaced = docs.where(likely).select("doc_id", F.concat(F.lit(" "), F.array_join(words(F.col("text")), " "), F.lit(" ")).alias("_spaced"))
    names = F.array(*[F.when(F.contains(F.col("_spaced"), F.lit(f" {' '.join(w)} ")), F.lit(t)) for t, w in short])
    return spaced.select("doc_id", F.explode(F.array_compact(names)).alias("template")).distinct()


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, contained: float = CONTAINED) -> DataFrame:
    """doc_id, template, n_found, n_shingles (of the template), containment; a row for each finding.

    The template tables are as large as the given library, not as the data, and broadcast if they are small.
    """
    known = template_table(docs.sparkSession, templates or TEMPLATES)
    sizes = {r["template"]: r["_words"] for r in known.select("template", "_words").collect()}
    if empty := sorted(t for t, w in sizes.items() if not w):
        raise ValueError(f"templates without words: {', '.join(empty)}")
    candidates = candidates_of(docs, known)
    parts = known.select("template", F.array_distinct(shingle_texts(F.col("_words"))).alias("_parts"))
    parts = parts.select("template", F.size("_parts").cast("long").alias("n_shingles"), F.explode("_parts").alias("_part"))
    wanted = candidates.select(F.col("doc_id").alias("_id")).distinct()
    near = docs.select("doc_id", "text").join(sized(wanted), docs["doc_id"].eqNullSafe(wanted["_id"]), "left_semi")
    held = near.select("doc_id", words(F.col("text")).alias("_words")).select("doc_id", F.explode(F.array_distinct(shingle_texts(F.col("_words")))).alias("_part")).join(sized(parts), "_part")
    counts = held.groupBy("doc_id", "template", "n_shingles").agg(F.count_distinct("_part").alias("n_found"))
    counts = counts.where(F.col("n_found") >= contained * F.col("n_shingles"))
    pair = candidates.withColumnsRenamed({"doc_id": "_id", "template": "_template"})
    both = counts.join(pair, counts["doc_id"].eqNullSafe(pair["_id"]) & (counts["template"] == pair["_template"]), "left_semi")
    found = both.select("doc_id", "template", "n_found", "n_shingles", (F.col("n_found") / F.col("n_shingles")).alias("containment"))
    short = sorted((t, w) for t, w in sizes.items() if len(w) < SHINGLE)
    if not short:
        return found
    one = F.lit(1).cast("long")
    return found.unionByName(short_findings(docs, short).select("doc_id", "template", one.alias("n_found"), one.alias("n_shingles"), F.lit(1.0).alias("containment")))


def sql(templates: dict[str, str] | None = None, contained: float = CONTAINED) -> str:
    """The same findings by comparing every text with every template."""
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted((templates or TEMPLATES).items()))
    shingle = "list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)])"
    cut = r"[x FOR x IN regexp_split_to_array(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+') IF x <> '']"
    return f"""
        WITH t AS (SELECT template, {cut.format("body")} AS w FROM (VALUES {rows}) AS v(template, body)),
        p AS (SELECT template, {shingle} AS parts FROM t WHERE len(w) >= 5),
        tp AS (SELECT template, len(parts)::BIGINT AS n_shingles, unnest(parts) AS part FROM p),
        d AS (SELECT doc_id, {cut.format("text")} AS w FROM documents),
        dp AS (SELECT DISTINCT doc_id, unnest({shingle}) AS part FROM d WHERE len(w) >= 5)
        SELECT doc_id, template, count(*)::BIGINT AS n_found, n_shingles, count(*) / n_shingles AS containment
        FROM dp JOIN tp USING (part) GROUP BY doc_id, template, n_shingles HAVING count(*) >= {contained} * n_shingles
        UNION ALL SELECT DISTINCT doc_id, template, 1::BIGINT, 1::BIGINT, 1::DOUBLE FROM d, t
        WHERE len(t.w) < 5 AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(t.w, ' ') || ' ')"""
