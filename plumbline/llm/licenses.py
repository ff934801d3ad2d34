"""Licence scan: sparse TF-IDF cosine of notices to templates, then inheritance by directory.

A document's notices are its lines and sentences with a licence cue and, with their lines joined,
its paragraphs with one; paragraphs end at lines that are empty but for comment marks. Each distinct
notice is a sparse TF-IDF vector, matched to the templates (phrases, whole paragraphs of licences and
the headings of long ones) over the terms they share; the most similar template at or above the
threshold is the notice's licence. A document is the licence file of its directory when matched lines
or matched paragraphs hold most of its words, or when its first paragraph is the heading of a long
licence. Documents without a licence of their own take that of the nearest directory above them that
has a file.

Defined results: null and empty texts have no notice; a null path has no directory and inherits
nothing; ties go to the licence first by name; of several files in a directory the most similar
notice counts, then the name; rows that repeat are scanned each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import read, stored, words

SIMILARITY = 0.6
#: Share of a document's words in notices from which it is a licence file.
FILE_SHARE = 0.5

# What a notice mentions, and the usual notices by licence.
CUES = ("licen", "copyright", "rights reserved", "redistribution and use", "hereby granted", "public domain", "creative commons")
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0"),
    ("all-rights-reserved", "All rights reserved"),
    ("all-rights-reserved", "Copyright. All rights reserved"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-2-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("CC0-1.0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
# Headings of licences too long to stand among the templates.
HEADINGS = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)
ALL_TEMPLATES = tuple((name, words, False) for name, words in TEMPLATES) + tuple((name, words, True) for name, words in HEADINGS)
#: A licence of which another is a part: where both are found, it is the one.
WHOLE_OF = ("BSD-3-Clause", "BSD-2-Clause")
VERSION = "version ([0-9]+(?:\\.[0-9]+)*)"
TERM = "[a-z0-9]+(?:\\.[0-9]+)*"
BREAK = "\\n|(?<=[.!?])[ \\t]+"
#: What ends a paragraph: a line that is empty but for comment marks.
PARAGRAPH_BREAK = "\\n[ \\t\\r/#*;-]*\\n"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _version(text: Column) -> Column:
    """The first version that a text names, without a last .0; empty if it names none."""
    return F.regexp_replace(F.regexp_extract(F.lower(text), VERSION, 1), "\\.0$", "")


def _has_cue(text: Column) -> Column:
    found = F.contains(text, F.lit(CUES[0]))
    for cue in CUES[1:]:
        found = found | F.contains(text, F.lit(cue))
    return found


def notices(text: Column) -> Column:
    """(notice, paragraph, head) of the lines, sentences and paragraphs that mention a cue; the head is the text's first paragraph."""

    def pieces(pattern: str, paragraph: bool) -> Column:
        parts = F.filter(F.split(text, pattern), lambda p: F.rlike(p, F.lit("[A-Za-z0-9]")))
        head = (lambda i: i == 0) if paragraph else (lambda i: F.lit(False))
        marked = F.transform(parts, lambda p, i: F.struct(p.alias("notice"), F.lit(paragraph).alias("paragraph"), head(i).alias("head")))
        return F.filter(marked, lambda p: _has_cue(F.lower(p["notice"])))

    none = F.array().cast("array<struct<notice:string,paragraph:boolean,head:boolean>>")
    return F.when(_has_cue(F.lower(text)), F.concat(pieces(BREAK, False), pieces(PARAGRAPH_BREAK, True))).otherwise(none)


def match_templates(found: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """From (digest, notice) with repeats to distinct (digest, license, heading, score), for notices like a template."""
    spark = found.sparkSession
    distinct = stored(found.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.first("notice").alias("notice")).withColumn("version", _version(F.col("notice"))), "notices")
    templates = spark.createDataFrame([(i, *x) for i, x in enumerate(ALL_TEMPLATES)], "template int, license string, words string, heading boolean").withColumn("t_version", _version(F.col("words")))
    t_terms = templates.select("template", "license", "heading", "t_version", F.explode(_terms(F.col("words"))).alias("term")).groupBy("template", "license", "heading", "t_version", "term").agg(F.count(F.lit(1)).alias("tf"))
    n_terms = distinct.select("digest", "n", F.explode(_terms(F.col("notice"))).alias("term")).groupBy("digest", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    n_terms = stored(n_terms, "notice-terms")
    total = (distinct.agg(F.sum("n")).first()[0] or 0) + len(ALL_TEMPLATES)
    counts = n_terms.select("term", F.col("n").alias("c")).unionByName(t_terms.select("term", F.lit(1).cast("bigint").alias("c"))).groupBy("term").agg(F.sum("c").alias("df"))
    idf = counts.select("term", (F.log(F.lit(1.0 + total) / (1 + F.col("df"))) + 1).alias("idf"))
    t_vec = t_terms.join(idf, "term").select("template", "license", "heading", "t_version", "term", (F.col("tf") * F.col("idf")).alias("t_w"))
    n_vec = n_terms.join(idf, "term").select("digest", "term", (F.col("tf") * F.col("idf")).alias("n_w"))
    t_norm = t_vec.groupBy("template").agg(F.sqrt(F.sum(F.col("t_w") * F.col("t_w"))).alias("t_norm"))
    n_norm = n_vec.groupBy("digest").agg(F.sqrt(F.sum(F.col("n_w") * F.col("n_w"))).alias("n_norm")).join(distinct.select("digest", "version"), "digest")
    dots = n_vec.join(t_vec, "term").groupBy("digest", "template", "license", "heading", "t_version").agg(F.sum(F.col("n_w") * F.col("t_w")).alias("dot"))
    scored = dots.join(t_norm, "template").join(n_norm, "digest").withColumn("score", F.round(F.col("dot") / (F.col("t_norm") * F.col("n_norm")), 6))
    # a version that is named outranks the words around it
    scored = scored.where((F.col("version") == "") | (F.col("t_version") == "") | (F.col("version") == F.col("t_version")))
    best = scored.where(F.col("score") >= similarity).groupBy("digest").agg(F.min(F.struct((-F.col("score")).alias("s"), "license", "heading")).alias("b"))
    return best.select("digest", F.col("b.license").alias("license"), F.col("b.heading").alias("heading"), (-F.col("b.s")).alias("score"))


def _parent(path: Column) -> Column:
    """The directory of a path, with its slash; empty at the top."""
    return F.regexp_extract(path, "^(.*/)[^/]*$", 1)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", similarity: float = SIMILARITY, file_share: float = FILE_SHARE) -> DataFrame:
    """id_col, path_col, license, score, origin (header, file, inherited, none) and license_dir of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(path_col).alias("_path"), _parent(F.col(path_col)).alias("_dir"), notices(text).alias("notices"), text.alias("_t"))
    # words are only counted where there is a notice
    n_words = F.when(F.size("notices") > 0, F.size(words(F.col("_t")))).otherwise(0)
    rows = stored(rows.withColumn("n_words", n_words).drop("_t").withColumn("_row", F.monotonically_increasing_id()), "license-notices")
    each = rows.where(F.size("notices") > 0).select("_row", "n_words", F.inline("notices")).withColumn("digest", F.unhex(F.md5("notice")))
    told = each.select("_row", "n_words", "digest", "paragraph", "head", F.size(words(F.col("notice"))).alias("w"))
    matched = told.join(match_templates(each.select("digest", "notice"), similarity), "digest")
    covered = F.greatest(F.sum(F.when(F.col("paragraph"), F.col("w")).otherwise(0)), F.sum(F.when(F.col("paragraph"), 0).otherwise(F.col("w"))))
    own = matched.groupBy("_row", "n_words").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"), covered.alias("covered"), F.bool_or(F.col("head") & F.col("heading")).alias("headed"), F.bool_or(F.col("license") == WHOLE_OF[0]).alias("whole")
    )
    is_file = F.col("headed") | (F.col("covered") >= file_share * F.col("n_words"))
    told = F.when(F.col("whole") & (F.col("b.license") == WHOLE_OF[1]), WHOLE_OF[0]).otherwise(F.col("b.license"))
    own = own.select("_row", told.alias("license"), (-F.col("b.s")).alias("score"), is_file.alias("is_file"))
    marked = stored(rows.select("_row", "_id", "_path", "_dir").join(own, "_row", "left").drop("_row"), "license-own")
    files = marked.where("is_file and _dir is not null").groupBy("_dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    # every directory with its ancestors: one row a directory and level, not a document and level
    dirs = marked.where("license is null and _dir is not null").select("_dir").distinct()
    depth = F.size(F.split("_dir", "/")) - 1
    levels = dirs.select("_dir", F.explode(F.sequence(F.lit(0), depth)).alias("level"))
    above = levels.select("_dir", "level", F.when(F.col("level") == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(F.split("_dir", "/"), F.lit(1), F.col("level")), "/"), F.lit("/"))).alias("at"))
    nearest = above.join(files.withColumnRenamed("_dir", "at"), "at").groupBy("_dir").agg(F.max_by(F.struct("at", "b"), "level").alias("x"))
    inherited = nearest.select(F.col("_dir").alias("_d"), F.col("x.at").alias("license_dir"), F.col("x.b.license").alias("up_license"), (-F.col("x.b.s")).alias("up_score"))
    # stored, so that Spark sees both sizes and can split a directory that holds much of the table
    inherited = stored(inherited, "license-above")
    joined = marked.join(inherited, (F.col("_dir") == F.col("_d")) & F.col("license").isNull(), "left")
    origin = F.when(F.col("is_file"), "file").when(F.col("license").isNotNull(), "header").when(F.col("up_license").isNotNull(), "inherited").otherwise("none")
    return joined.select(
        F.col("_id").alias(id_col), F.col("_path").alias(path_col), F.coalesce("license", "up_license").alias("license"), F.coalesce("score", "up_score").alias("score"), origin.alias("origin"), "license_dir"
    )


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lie at source/lang/doc_id."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    return scan_licenses(docs).select("doc_id", "license", F.round("score", 4).alias("score"), "origin", "license_dir")


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TEMPLATE_ROWS = ", ".join(f"({i}, {_sql(name)}, {_sql(text)}, {str(heading).lower()})" for i, (name, text, heading) in enumerate(ALL_TEMPLATES))
_CUE = "|".join(CUES)
OP9_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, concat_ws('/', source, lang, doc_id::VARCHAR) AS path FROM documents),
r AS (SELECT doc_id, regexp_extract(path, '^(.*/)[^/]*$', 1) AS dir, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n_words,
  string_split(regexp_replace(regexp_replace(t, '([.!?])[ \t]+', '\1' || chr(1), 'g'), '\n', chr(1), 'g'), chr(1)) AS ls,
  list_filter(string_split(regexp_replace(t, '\n[ \t\r/#*;-]*\n', chr(1), 'g'), chr(1)), lambda p: regexp_matches(p, '[A-Za-z0-9]')) AS ps FROM d),
e AS (SELECT * FROM (SELECT doc_id, n_words, false AS paragraph, false AS head, unnest(ls) AS notice FROM r
  UNION ALL SELECT doc_id, n_words, true, i = 1, ps[i] FROM r, unnest(range(1, len(ps) + 1)) AS x(i)) WHERE regexp_matches(lower(notice), '{_CUE}')),
u AS (SELECT notice, count(*) AS n, regexp_replace(regexp_extract(lower(notice), '{VERSION}', 1), '\.0$', '') AS version FROM e GROUP BY notice),
tpl(template, license, body, heading) AS (VALUES {_TEMPLATE_ROWS}),
tt AS (SELECT template, license, heading, term, count(*) AS tf FROM (SELECT template, license, heading, unnest(regexp_extract_all(lower(body), '[a-z0-9]+(?:\.[0-9]+)*')) AS term FROM tpl) GROUP BY ALL),
nt AS (SELECT notice, n, term, count(*) AS tf FROM (SELECT notice, n, unnest(regexp_extract_all(lower(notice), '[a-z0-9]+(?:\.[0-9]+)*')) AS term FROM u) GROUP BY ALL),
df AS (SELECT term, sum(c) AS df FROM (SELECT term, n AS c FROM nt UNION ALL SELECT term, 1 FROM tt) GROUP BY term),
idf AS (SELECT term, ln((1.0 + (SELECT coalesce(sum(n), 0) FROM u) + {len(ALL_TEMPLATES)})::DOUBLE / (1 + df)::DOUBLE) + 1 AS idf FROM df),
tv AS (SELECT template, license, heading, term, tf * idf AS w FROM tt JOIN idf USING (term)),
nv AS (SELECT notice, term, tf * idf AS w FROM nt JOIN idf USING (term)),
s AS (SELECT notice, license, heading, round(dot / (tn.x * nn.x), 6) AS score FROM (SELECT nv.notice, tv.template, tv.license, tv.heading, sum(nv.w * tv.w) AS dot FROM nv JOIN tv USING (term) GROUP BY ALL) q
  JOIN (SELECT template, sqrt(sum(w * w)) AS x FROM tv GROUP BY template) tn USING (template) JOIN (SELECT notice, sqrt(sum(w * w)) AS x FROM nv GROUP BY notice) nn USING (notice) JOIN u USING (notice)
  JOIN (SELECT template, regexp_replace(regexp_extract(lower(body), '{VERSION}', 1), '\.0$', '') AS t_version FROM tpl) tq USING (template) WHERE version = '' OR t_version = '' OR version = t_version),
m AS (SELECT notice, license, heading, score FROM s WHERE score >= {SIMILARITY} QUALIFY row_number() OVER (PARTITION BY notice ORDER BY score DESC, license, heading) = 1),
o AS (SELECT doc_id, n_words, coalesce(sum(len(regexp_extract_all(notice, '[^\x20\x09-\x0D]+'))) FILTER (paragraph), 0) AS p_words, coalesce(sum(len(regexp_extract_all(notice, '[^\x20\x09-\x0D]+'))) FILTER (NOT paragraph), 0) AS l_words,
  bool_or(head AND heading) AS headed, bool_or(license = '{WHOLE_OF[0]}') AS whole, min({{'s': -score, 'license': license}}) AS b FROM e JOIN m USING (notice) GROUP BY ALL),
k AS (SELECT r.doc_id, r.dir, CASE WHEN whole AND o.b.license = '{WHOLE_OF[1]}' THEN '{WHOLE_OF[0]}' ELSE o.b.license END AS license, -o.b.s AS score, coalesce(headed OR greatest(p_words, l_words) >= {FILE_SHARE} * o.n_words, false) AS is_file FROM r LEFT JOIN o USING (doc_id)),
f AS (SELECT dir AS at_dir, min({{'s': -score, 'license': license}}) AS b FROM k WHERE is_file GROUP BY dir),
a AS (SELECT dir, at_dir, b, row_number() OVER (PARTITION BY dir ORDER BY length(at_dir) DESC) AS rn FROM (SELECT DISTINCT dir FROM k) JOIN f ON starts_with(dir, at_dir)),
n AS (SELECT dir, at_dir, b FROM a WHERE rn = 1)
SELECT k.doc_id, coalesce(k.license, n.b.license) AS license, round(coalesce(k.score, -n.b.s), 4) AS score,
  CASE WHEN is_file THEN 'file' WHEN k.license IS NOT NULL THEN 'header' WHEN n.b.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN k.license IS NULL THEN n.at_dir END AS license_dir
FROM k LEFT JOIN n ON k.dir = n.dir
"""
