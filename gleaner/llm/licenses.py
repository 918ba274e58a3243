"""License scans: sparse TF-IDF cosine of headers and license files to templates, then inheritance by path.

Texts are cut into segments: lines, sentences within them, and paragraphs, so that a notice which is
wrapped over the lines of a comment is met whole. A license file is also one segment as a whole. A segment that can reach the threshold is compared with each template: term counts times
inverse document frequencies, which are counted over all documents for the templates' terms; any
other term weighs as one that no document has. A document has the license of its best segment, if
the cosine reaches the threshold.

What can reach it is bounded without loss: by Cauchy-Schwarz a cosine is at most the root of the
squared weights, in the template's unit vector, of the terms that segment and template share. So of
each template, a segment must share one of the heaviest terms without which the rest falls short;
first whole texts are asked for one of these, then the segments of those that have one.

A directory's license is that of a license file in it. A document without a license of its own
inherits from its nearest ancestor directory that has one: distinct directories are joined with
their ancestors' paths, and documents with their directory.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import read_table, small_or_not, stored

_NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"
)
#: License notices and, of short licenses, the whole text; one or more a license.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _NO_WARRANTY,
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, either version 2.1 of the License"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "Dedicated to the public domain under the CC0 1.0 Universal waiver"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD License"),
    ("BSD-3-Clause", _BSD_START + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END),
    ("BSD-2-Clause", "Licensed under the Simplified BSD License, with two clauses."),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "This software is provided as-is, without any express or implied warranty; permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Artistic-2.0", "Licensed under the Artistic License 2.0."),
)
THRESHOLD = 0.6
#: For rounding: scores have six places.
MARGIN = 1e-5
SEGMENT_ENDS = r"[.!?][ \t\r]+|\n"
#: A line without anything but marks of comments: paragraphs of several lines are compared whole, with marks and line ends between their terms.
PARAGRAPH_ENDS = r"\n[ \t\r*#/;%-]*\n"
TERM_ENDS = "[^a-z0-9]+"


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), TERM_ENDS), "")


def _templates(spark: SparkSession) -> DataFrame:
    """(template, license, term, n)."""
    rows = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(TEMPLATES)], "template int, license string, text string")
    return rows.select("template", "license", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "license", "term").agg(F.count(F.lit(1)).alias("n"))


def _idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs + 1) / (df + 1)) + 1


def term_weights(docs: DataFrame) -> DataFrame:
    """(term, idf) of the templates' terms, from all of `docs`; and the idf of a term that no document has as term ''."""
    vocabulary = sorted({t for _, text in TEMPLATES for t in _python_terms(text)})
    known = F.array(*[F.lit(t) for t in vocabulary])
    has = F.array_intersect(terms(F.coalesce("text", F.lit(""))), known)
    # The empty term is in every document: its count is theirs.
    seen = stored(docs.select(F.explode(F.concat(has, F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    n = seen.where("term = ''").select("df").scalar()
    every = docs.sparkSession.createDataFrame([(t,) for t in [*vocabulary, ""]], "term string").join(seen, "term", "left")
    return every.select("term", _idf(F.coalesce(n, F.lit(0)), F.when(F.col("term") == "", 0).otherwise(F.coalesce("df", F.lit(0)))).alias("idf"))


def _python_terms(text: str) -> list[str]:
    return [t for t in re.split(TERM_ENDS, text.lower()) if t]


def similarities(segments: DataFrame, idf: DataFrame) -> DataFrame:
    """segments (segment, distinct) -> (segment, license, score): the best template of each, at any score above 0; a tie goes to the first name."""
    spark = segments.sparkSession
    idf = F.broadcast(idf)  # one row a term of TEMPLATES
    unknown = idf.where("term = ''").select("idf").scalar()
    weighted = _templates(spark).join(idf, "term").select("template", "license", "term", (F.col("n") * F.col("idf")).alias("x"))
    norms = weighted.groupBy("template").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    templates = F.broadcast(weighted.join(norms, "template").select("license", "template", "term", (F.col("x") / F.col("norm")).alias("x")))
    # A segment may be long: sums go by its digest, not by its text.
    keyed = segments.select("segment", F.sha2(F.col("segment").cast("binary"), 256).alias("key"))
    counted = keyed.select("key", F.explode(terms(F.col("segment"))).alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias("n"))
    vectors = counted.join(idf, "term", "left").select("key", "term", (F.col("n") * F.coalesce(F.col("idf"), unknown)).alias("y"))
    lengths = vectors.groupBy("key").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("length"))
    dots = vectors.join(templates, "term").groupBy("key", "license", "template").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    scored = dots.join(lengths, "key").select("key", "license", F.round(F.col("dot") / F.col("length"), 6).alias("score"))
    best = scored.groupBy("key").agg(F.max("score").alias("score"), F.min_by("license", F.struct(-F.col("score"), "license")).alias("license"))
    return keyed.join(best, "key").select("segment", "score", "license")


def _squares(idf: DataFrame) -> list[dict[str, float]]:
    """Of each template: the squared weight of each term in its unit vector."""
    weight = {r["term"]: r["idf"] for r in idf.collect()}  # one row a term of TEMPLATES
    out = []
    for _, text in TEMPLATES:
        raw = {t: (n * weight[t]) ** 2 for t, n in Counter(_python_terms(text)).items()}
        out.append({t: x / sum(raw.values()) for t, x in raw.items()})
    return out


def _needed(squares: list[dict[str, float]], least: float) -> Column:
    """Terms of which a segment has one if its cosine to a template is the root of `least` or more."""
    needed: set[str] = set()
    for square in squares:
        rest = sum(square.values())
        for t in sorted(square, key=lambda t: (-square[t], t)):
            if rest < least:
                break
            needed.add(t)
            rest -= square[t]
    return F.array(*[F.lit(t) for t in sorted(needed)])


def can_reach(segments: DataFrame, squares: list[dict[str, float]], threshold: float) -> DataFrame:
    """The `segments` (segment, ...) that can have a cosine of `threshold` to a template; all that have one."""
    least = max(threshold - MARGIN, 0.0) ** 2
    weights = segments.sparkSession.createDataFrame([({t: [square.get(t, 0.0) for square in squares] for t in sorted({t for square in squares for t in square})},)], "w map<string, array<double>>")
    # A map of the templates' terms, one value a template: its size is fixed, and few segments come to it.
    some = segments.where(F.arrays_overlap(terms(F.col("segment")), _needed(squares, least))).withColumn("_w", weights.scalar())
    none = F.array_repeat(F.lit(0.0), len(squares))
    shared = F.aggregate(F.array_intersect(terms(F.col("segment")), F.map_keys("_w")), none, lambda sums, t: F.zip_with(sums, F.element_at("_w", t), lambda a, x: a + x))
    return some.where(F.exists(shared, lambda x: x >= least)).drop("_w")


def _dense(segment: Column, idf: Column, least: float) -> Column:
    """Whether enough of a segment's weight is in the templates' terms: no cosine of the root of `least` without it.

    By Cauchy-Schwarz a cosine's square is at most the share of the templates' terms in the squared
    length of the segment; each of its other words adds the square of an unknown term's weight.
    """
    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    total = lambda array, f: F.aggregate(array, F.lit(0.0), lambda a, x: a + f(x))

    def judged(words: Column, counts: Column) -> Column:
        square = total(counts, lambda x: F.pow(x["n"] * F.element_at(idf, x["t"]), F.lit(2.0)))
        other = F.size(words) - total(counts, lambda x: x["n"])
        return let(square, lambda s: s >= F.lit(least) * (s + other * F.pow(F.element_at(idf, F.lit("")), F.lit(2.0))))

    def counted(words: Column) -> Column:
        return F.transform(F.array_intersect(words, F.map_keys(idf)), lambda t: F.struct(t.alias("t"), F.size(F.filter(words, lambda y: y == t)).alias("n")))

    return let(terms(segment), lambda words: let(counted(words), lambda counts: judged(words, counts)))


def _candidates(docs: DataFrame, squares: list[dict[str, float]], weight: dict[str, float], threshold: float) -> DataFrame:
    """(doc_id, path, segment): segments that can reach the threshold."""
    least = max(threshold - MARGIN, 0.0) ** 2
    # One row, one value a term of TEMPLATES.
    idf = docs.sparkSession.createDataFrame([(weight,)], "w map<string, double>")
    asked = docs.where(F.arrays_overlap(terms(F.col("text")), _needed(squares, least))).withColumn("_idf", idf.scalar())
    whole = F.when(F.coalesce("is_license_file", F.lit(False)), F.array("text")).otherwise(F.array().cast("array<string>"))
    paragraphs = F.filter(F.split(F.col("text"), PARAGRAPH_ENDS), lambda x: F.contains(x, F.lit("\n")) & _dense(x, F.col("_idf"), least))
    # No array is empty; `explode` would compute each once more to leave out those that are.
    segments = asked.select("doc_id", "path", F.explode_outer(F.concat(F.split(F.col("text"), SEGMENT_ENDS), paragraphs, whole)).alias("segment"))
    return can_reach(segments, squares, threshold).distinct()


def licenses(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row (doc_id, path, license, score, origin, from_dir) for each doc_id and path of `docs` (doc_id, path, is_license_file, text).

    origin: `own`, `inherited` or `none`; from_dir: the directory inherited from. `score` is the
    cosine of the document's best segment if it reaches the threshold, and else 0. A license file
    also counts for its own directory. If several license files of a directory disagree, the highest
    score decides, then the first name. A null text has no license; a null path inherits nothing; a
    null is_license_file is false. Rows that share doc_id and path are one document. Very long texts
    are cut and compared like any. Other columns are not looked at. Empty input: no rows.
    """
    docs = docs.select("doc_id", "path", "is_license_file", "text")
    idf = stored(term_weights(docs))
    weight = {r["term"]: r["idf"] for r in idf.collect()}  # one row a term of TEMPLATES
    candidates = stored(_candidates(docs, _squares(idf), weight, threshold))
    scores = similarities(candidates.select("segment").distinct(), idf)
    candidates = candidates.join(scores, "segment").where(F.col("score") >= threshold)
    best = candidates.groupBy(F.col("doc_id").alias("_id"), F.col("path").alias("_path")).agg(F.max("score").alias("score"), F.min_by("license", F.struct(-F.col("score"), "license")).alias("license"))
    directory = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", ""))
    slim = docs.groupBy("doc_id", "path").agg(F.max("is_license_file").alias("is_license_file"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("path").eqNullSafe(F.col("_path"))
    own = stored(slim.join(best, same, "left").select("doc_id", "path", "is_license_file", directory.alias("dir"), F.coalesce("score", F.lit(0.0)).alias("score"), "license"))
    rooted = own.where("is_license_file and license is not null and dir is not null").groupBy(F.col("dir").alias("up")).agg(F.min_by("license", F.struct(-F.col("score"), "license")).alias("found"))
    parts = F.split("dir", "/")
    ups = own.select("dir").where("dir is not null").distinct().select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("up"))
    nearest = ups.join(rooted, "up").groupBy("dir").agg(F.max_by(F.struct("up", "found"), F.length("up")).alias("near")).select("dir", F.col("near.up").alias("from_dir"), F.col("near.found").alias("inherited"))
    joined = own.join(small_or_not(stored(nearest), 200), "dir", "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    return joined.select("doc_id", "path", F.coalesce("license", "inherited").alias("license"), "score", origin.alias("origin"), F.when(origin == "inherited", F.col("from_dir")).alias("from_dir"))


#: Documents have no path: one is made of source, language and id, 40 documents a folder and ten folders a parent; ids that 40 divides are the folder's license file.
FOLDER = 40


def with_paths(docs: DataFrame) -> DataFrame:
    name = F.when(F.col("doc_id") % FOLDER == 0, "LICENSE").otherwise(F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.expr(f"cast(doc_id div {FOLDER * 10} as string)"), F.expr(f"cast(doc_id div {FOLDER} as string)"), name)
    return docs.select("doc_id", path.alias("path"), (F.col("doc_id") % FOLDER == 0).alias("is_license_file"), "text")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(with_paths(read_table(spark, sf_dir, "documents")))


_ROWS = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(TEMPLATES))  # none has a single quote
LICENSES_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') || '/' || coalesce(lang, '') || '/' || (doc_id // {FOLDER * 10}) || '/' || (doc_id // {FOLDER}) AS dir,
         CASE WHEN doc_id % {FOLDER} = 0 THEN 'LICENSE' ELSE 'doc' || doc_id END AS name, doc_id % {FOLDER} = 0 AS is_file, coalesce(text, '') AS text FROM documents),
tt AS (SELECT template, license, term, count(*) AS n FROM (SELECT template, license, unnest(list_filter(string_split_regex(lower(text), '{TERM_ENDS}'), lambda x: x <> '')) AS term
       FROM (VALUES {_ROWS}) t(template, license, text)) GROUP BY ALL),
vocab AS (SELECT DISTINCT term FROM tt),
dt AS (SELECT DISTINCT doc_id, name, dir, unnest(string_split_regex(lower(text), '{TERM_ENDS}')) AS term FROM d),
df AS (SELECT term, count(*) AS df FROM dt JOIN vocab USING (term) GROUP BY term),
idf AS (SELECT term, ln(((SELECT count(*) FROM d) + 1)::DOUBLE / (coalesce(df, 0) + 1)) + 1 AS idf FROM vocab LEFT JOIN df USING (term)),
unk AS (SELECT ln(((SELECT count(*) FROM d) + 1)::DOUBLE) + 1 AS u),
tv AS (SELECT template, license, term, n * idf AS x FROM tt JOIN idf USING (term)),
tn AS (SELECT template, sqrt(sum(x * x)) AS norm FROM tv GROUP BY template),
cand AS (SELECT DISTINCT doc_id, dir, name, segment FROM (
  SELECT doc_id, dir, name, unnest(string_split_regex(text, '[.!?][ \\t\\r]+|\\n')) AS segment FROM d
  UNION ALL SELECT doc_id, dir, name, unnest(list_filter(string_split_regex(text, '{PARAGRAPH_ENDS}'), lambda x: contains(x, chr(10)))) FROM d
  UNION ALL SELECT doc_id, dir, name, text FROM d WHERE is_file)),
seg AS (SELECT DISTINCT segment FROM cand),
sc AS (SELECT segment, term, count(*) AS n FROM (SELECT segment, unnest(list_filter(string_split_regex(lower(segment), '{TERM_ENDS}'), lambda x: x <> '')) AS term FROM seg) GROUP BY ALL),
sv AS (SELECT segment, term, n * coalesce(idf, (SELECT u FROM unk)) AS y FROM sc LEFT JOIN idf USING (term)),
sl AS (SELECT segment, sqrt(sum(y * y)) AS len FROM sv GROUP BY segment),
dots AS (SELECT segment, license, template, sum(x / norm * y) AS dot FROM sv JOIN tv USING (term) JOIN tn USING (template) GROUP BY ALL),
scored AS (SELECT segment, license, round(dot / len, 6) AS score FROM dots JOIN sl USING (segment)),
best AS (SELECT doc_id, dir, name, license, score FROM cand JOIN scored USING (segment) WHERE score >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id, dir, name ORDER BY score DESC, license) = 1),
own AS (SELECT d.doc_id, d.dir, d.name, d.is_file, coalesce(score, 0) AS score, license FROM d LEFT JOIN best USING (doc_id, dir, name)),
rooted AS (SELECT dir AS up, license AS found FROM own WHERE is_file AND license IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) = 1),
near AS (SELECT o.dir, up, found FROM (SELECT DISTINCT dir FROM own) o JOIN rooted ON o.dir = up OR starts_with(o.dir, up || '/') QUALIFY row_number() OVER (PARTITION BY o.dir ORDER BY length(up) DESC) = 1)
SELECT doc_id, own.dir || '/' || name AS path, coalesce(license, found) AS license, score,
       CASE WHEN license IS NOT NULL THEN 'own' WHEN found IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, CASE WHEN license IS NULL AND found IS NOT NULL THEN up END AS from_dir
FROM own LEFT JOIN near ON own.dir = near.dir
"""
