"""Licences of documents, in DataFrame operations only.

A text's lines, its paragraphs (between lines without a letter or digit) and the whole
of it are compared with licence templates by the cosine of sparse TF-IDF vectors
over their words: one-line notices, file headers, the headings of long
licences and whole short licences.  Inverse frequencies are counted over all texts;
words outside the templates weigh as the rarest, common function words nothing.  No
vector leaves its row unless the template words in it could make up the least
cosine.  A document takes the best template of its parts.

A document is a licence file if the whole of it resembles a template, if it opens
with the heading of a licence, or if licence parts hold half of its words.  Its
directory, and those below, inherit its licence, the nearest one first, by joins on
directory paths.

Defined cases: null and wordless texts have no parts; a null path inherits nothing; of
templates with one cosine (ties), and of several files in a directory, the first by
name stands; texts and lines of any length are compared whole; rows that repeat a
doc_id are one document, of all their parts, at each of their paths; a null doc_id has
no licence of its own but may inherit; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Function words, which no vector holds.
STOP = tuple("a an and any are as at be by for from in is it no not of on or that the this to under with you".split())

# Notices, headers and licence texts by their SPDX names.
_GPL_HEADER = "{what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
_PERMISSION = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_INCLUDED = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_UNLICENSE = "This is free and unencumbered software released into the public domain."
TEMPLATES = (
    ("AGPL-3.0", "notice", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "header", _GPL_HEADER.format(what="This program", name="Affero General Public License", version=3)),
    ("AGPL-3.0", "heading", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "heading", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", "notice", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "file", " ".join((_REDISTRIBUTION, _SOURCE, _BINARY, _DISCLAIMER))),
    ("BSD-3-Clause", "notice", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "header", _NAMES),
    ("BSD-3-Clause", "file", " ".join((_REDISTRIBUTION, _SOURCE, _BINARY, _NAMES, _DISCLAIMER))),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "heading", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "heading", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "heading", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "notice", "Released into the public domain under CC0 1.0 Universal."),
    ("CC0-1.0", "heading", "Creative Commons CC0 1.0 Universal"),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "header", _GPL_HEADER.format(what="This program", name="General Public License", version=2)),
    ("GPL-2.0", "heading", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "header", _GPL_HEADER.format(what="This program", name="General Public License", version=3)),
    ("GPL-3.0", "heading", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "notice", "Released under the ISC License."),
    ("ISC", "file", " ".join((_ISC, _ISC_AS_IS))),
    ("ISC", "header", _ISC),
    ("LGPL-3.0", "notice", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "header", _GPL_HEADER.format(what="This library", name="Lesser General Public License", version=3)),
    ("LGPL-3.0", "heading", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "header", _PERMISSION),
    ("MIT", "file", " ".join((_PERMISSION, _INCLUDED, _AS_IS))),
    ("MPL-2.0", "header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "heading", "Mozilla Public License Version 2.0"),
    ("Unlicense", "notice", "Released into the public domain by the Unlicense."),
    ("Unlicense", "heading", _UNLICENSE),
)


BREAK = r"[^\p{L}0-9]+"  # between words
GAP = r"\n[^\p{L}0-9]*\n"  # between paragraphs


def template_rows() -> list[tuple[int, str, str, str, int]]:
    """(template, licence, kind, word, count) of the words in templates that are no function words."""
    out = []
    for k, (licence, kind, text) in enumerate(TEMPLATES):
        counts = Counter(w for w in re.findall("[a-z0-9]+", text.lower()) if w not in STOP)
        out += [(k, licence, kind, w, n) for w, n in sorted(counts.items())]
    return out


ROWS = template_rows()
VOCABULARY = sorted({w for _, _, _, w, _ in ROWS})


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), BREAK, -1), "")


def _held(tokens: Column, share: dict[str, float]) -> Column:
    """The most that the template words among `tokens` can hold of any template's squared size."""
    shares = F.map_from_arrays(F.array(*[F.lit(w) for w in share]), F.array(*[F.lit(x) for x in share.values()]))
    met = F.array_intersect(tokens, F.array(*[F.lit(w) for w in VOCABULARY]))
    return F.when(F.size(met) >= 2, F.aggregate(met, F.lit(0.0), lambda a, w: a + F.element_at(shares, w))).otherwise(0.0)


def licences(docs: DataFrame, path, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(doc_id, path, licence, cosine, origin) for every row of docs.

    path: column of a /-separated path.  origin: own, file (a licence file),
    inherited, or null without a licence; cosine: of the best own part, 6 places.
    A part matches with two words of a template at least.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), path.alias("path"), F.col(text_col).alias("text"))
    texts = rows.where("doc_id is not null and text is not null").select("doc_id", "text")

    # how many texts hold each word of the templates
    known = F.array(*[F.lit(w) for w in VOCABULARY])
    seen = texts.select(F.explode(F.array_intersect(_tokens(F.col("text")), known)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    df = {r["word"]: r["df"] for r in seen.collect()}  # the vocabulary at most
    total = texts.count()
    idf = {w: math.log((1 + total) / (1 + df.get(w, 0))) + 1 for w in VOCABULARY}
    rarest = math.log(1 + total) + 1
    size: dict[int, float] = {}
    for k, _, _, w, n in ROWS:
        size[k] = size.get(k, 0.0) + (n * idf[w]) ** 2
    share = {w: 0.0 for w in VOCABULARY}
    for k, _, _, w, n in ROWS:
        share[w] = max(share[w], (n * idf[w]) ** 2 / size[k])

    # the parts of texts in which template words could make up the least cosine
    least = threshold**2 - 1e-6
    body = F.regexp_replace("text", rf"^{BREAK}", "")
    near = texts.where(_held(_tokens(F.col("text")), share) >= least).select("doc_id", F.xxhash64("text").alias("text_id"), body.alias("text"), F.size(_tokens(F.col("text"))).alias("n_text"))
    level = lambda name, parts: F.transform(parts, lambda x: F.struct(F.lit(name).alias("level"), x.alias("part")))
    parts = F.concat(level("text", F.array("text")), level("paragraph", F.split("text", GAP, -1)), level("line", F.split("text", "\n", -1)))
    part = near.select("doc_id", "text_id", "n_text", F.posexplode(parts).alias("k", "p")).select("doc_id", "text_id", "n_text", "k", "p.level", _tokens(F.col("p.part")).alias("tokens"))
    part = part.where(_held(F.col("tokens"), share) >= least)

    # exact cosines of those parts; the first paragraph is part 1
    key = ["doc_id", "text_id", "n_text", "k", "level", "n"]
    values = ", ".join(f"({k}, '{licence}', '{kind}', '{w}', {n * idf[w]!r}D, {math.sqrt(size[k])!r}D)" for k, licence, kind, w, n in ROWS)
    template = F.broadcast(spark.sql(f"select * from values {values} as t(template, licence, kind, word, weight, size)"))
    weights = F.map_from_arrays(known, F.array(*[F.lit(idf[w]) for w in VOCABULARY]))
    token = part.select("doc_id", "text_id", "n_text", "k", "level", F.size("tokens").alias("n"), F.explode("tokens").alias("word")).where(~F.col("word").isin(*STOP))
    token = token.groupBy(*key, "word").agg(F.count("*").alias("tf")).withColumn("own_weight", F.col("tf") * F.coalesce(F.try_element_at(weights, F.col("word")), F.lit(rarest)))
    own_size = token.groupBy("doc_id", "text_id", "k").agg(F.sqrt(F.sum(F.col("own_weight") * F.col("own_weight"))).alias("own"))
    dot = token.join(template, "word").groupBy(*key, "template", "licence", "kind", "size").agg(F.sum(F.col("own_weight") * F.col("weight")).alias("dot"), F.count("*").alias("met"))
    match = dot.where("met >= 2").join(own_size, ["doc_id", "text_id", "k"]).withColumn("cosine", F.round(F.col("dot") / F.col("size") / F.col("own"), 6)).where(F.col("cosine") >= threshold)
    best_part = match.groupBy(*key).agg(F.min(F.struct((-F.col("cosine")).alias("less"), "licence", "kind")).alias("best"))
    held = best_part.groupBy("doc_id", "text_id", "n_text").agg(
        F.min("best").alias("best"),
        F.max((F.col("level") == "text") | ((F.col("k") == 1) & (F.col("best.kind") == "heading"))).alias("whole"),
        F.coalesce(F.sum(F.when(F.col("level") == "paragraph", F.col("n"))), F.lit(0)).alias("paragraphs"),
        F.coalesce(F.sum(F.when(F.col("level") == "line", F.col("n"))), F.lit(0)).alias("lines"),
    )
    is_file = F.col("whole") | (2 * F.greatest("paragraphs", "lines") >= F.col("n_text"))
    own = held.groupBy("doc_id").agg(F.min("best").alias("best"), F.max(is_file).alias("is_file"))

    placed = rows.select("doc_id", "path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir")).join(own, "doc_id", "left")
    given = placed.where("is_file and path is not null").groupBy(F.col("dir").alias("up")).agg(F.min(F.struct("best", "doc_id")).alias("from")).select("up", F.col("from.best.licence").alias("handed"))
    steps = F.split("dir", "/")
    above = placed.where("path is not null").select("dir").distinct().select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))).alias("up"))
    nearest = above.join(given, "up").groupBy("dir").agg(F.max_by("handed", F.length("up")).alias("handed"))
    found = placed.join(nearest, "dir", "left")
    return found.select(
        "doc_id",
        "path",
        F.coalesce("best.licence", "handed").alias("licence"),
        (-F.col("best.less")).alias("cosine"),
        F.when(F.col("best").isNotNull(), F.when(F.col("is_file"), "file").otherwise("own")).when(F.col("handed").isNotNull(), "inherited").alias("origin"),
    )
