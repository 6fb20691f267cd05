"""License scan: TF-IDF cosine of lines to license templates, then inheritance from ancestor folders.

DataFrame functions only.  Templates are one-sentence notices, standard file
headers and whole short licence texts.  The parts of a text that meet them are
its lines, its paragraphs (headers wrapped over lines; lines of comment marks
alone are blank), its sentences (a notice inside a long line), all over the
text, and the whole text of a licence file.  A part shares a term with a
template or its cosine is zero, so parts without a template term are left out
by a pattern and nothing is lost.  Document frequencies are counts of lines
with a template term over all texts.  From the template terms' weights alone
follows a bound of a part's cosine, as any other word weighs one at least; only
parts whose bound reaches ``THRESHOLD`` travel, and equal ones are scored once.
A text's own license is its best part at ``THRESHOLD`` or above.

A licence file (by its name) declares its license for its folder.  A text
without a license of its own takes that of the nearest ancestor folder that
declares one: distinct folders, not files, are joined with their ancestors.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm import common

THRESHOLD = 0.6

# License ids with the notices, standard headers and short licence texts they are given by.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""
_GNU = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}
General Public License as published by the Free Software Foundation; either version {version} of the License, or (at your
option) any later version."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("BSD-2-Clause", f"{_BSD_2} {_BSD_END}"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSD-3-Clause", f"{_BSD_2} {_BSD_3} {_BSD_END}"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GNU.format(kind="", version=2)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU.format(kind="", version=3)),
    ("ISC", _ISC),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _GNU.format(kind="Lesser", version=3)),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", _MPL),
    ("Proprietary", "All rights reserved."),
]
# Function words, which are no terms.
STOP_WORDS = """a all an and any are as at be but can for from if in is it its may no not of on one or other shall such
that the this to under was which who whom with without you""".split()
#: What parts paragraphs, and sentences.
PARAGRAPH = r"\n([ \t\r#*;%/-]*\n)+"
SENTENCE = r"[.!?]+[ \t\r\n]+"
WORD = "[a-z0-9]+([.+-][a-z0-9]+)*"
FILE_NAME = "(?i)^(licen[cs]e|copying|notice)([.].*)?$"


def _words(text: str) -> list[str]:
    return [m.group(0) for m in re.finditer(WORD, text)]


def template_terms() -> list[str]:
    """Distinct terms of the templates, stop words left out."""
    found = {w for _, text in TEMPLATES for w in _words(text.lower())}
    return sorted(found - set(STOP_WORDS))


def line_pattern() -> str:
    """Any template term as a word; terms are grouped by their first two characters, so few are tried at a place."""
    groups: dict[str, dict[str, list[str]]] = {}
    for t in template_terms():
        rest = t[2:].replace(".", "[.]").replace("+", "[+]")
        groups.setdefault(t[0], {}).setdefault(t[1:2], []).append(rest)
    first = [c + "(?:" + "|".join(f"{d}(?:{'|'.join(ends)})" for d, ends in seconds.items()) + ")"
             for c, seconds in groups.items()]
    return f"(?i)(?:^|[^a-z0-9])(?:{'|'.join(first)})(?:$|[^a-z0-9])"


def parts(text: Column, path: Column) -> Column:
    """The distinct lines, paragraphs and sentences of a text with a template term, and a licence file as a whole."""
    def with_term(x: Column) -> Column:
        return x.rlike(line_pattern())

    paragraphs = F.filter(F.split(text, PARAGRAPH), with_term)
    pieces = F.flatten(F.transform(paragraphs, lambda p: F.concat(F.filter(
        F.array_distinct(F.concat(F.split(p, "\n"), F.split(p, SENTENCE))), with_term), F.array(p))))
    name = F.coalesce(F.regexp_extract(path, "[^/]*$", 0), F.lit(""))
    whole = F.when(name.rlike(FILE_NAME), F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(pieces, whole))


def _terms(line: Column) -> Column:
    """Lower-cased words of a line, stop words left out."""
    words = F.regexp_extract_all(F.lower(line), F.lit(f"({WORD})"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS))


def term_counts(lines: DataFrame) -> DataFrame:
    """term, df: in how many lines each term occurs; the empty term counts the lines."""
    terms = F.concat(F.array(F.lit("")), F.array_distinct(_terms(F.col("line"))))
    return lines.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hopeful(found: Column, seen: DataFrame) -> Column:
    """The array ``found`` of parts without those whose cosine to every template is below the threshold for certain.

    The dot product and a part of the squared length need the counts and weights
    of template terms only; a word that is none adds one to the length at least.
    All of it is one expression: as columns of their own, the steps would be
    copied into the filter that follows and run anew for each word.
    """
    notices = [Counter(w for w in _words(text.lower()) if w not in STOP_WORDS) for _, text in TEMPLATES]
    terms = template_terms()
    df = dict(seen.where(F.col("term").isin("", *terms)).collect())  # a constant number of terms
    idf = {t: math.log((1 + df.get("", 0)) / (1 + df.get(t, 0))) + 1 for t in terms}
    norms = [math.sqrt(sum((n * idf[t]) ** 2 for t, n in notice.items())) for notice in notices]
    weights = {t: [idf[t] ** 2, *(n[t] * idf[t] ** 2 / norm for n, norm in zip(notices, norms, strict=True))] for t in terms}
    weights = F.from_json(F.lit(json.dumps(weights)), "map<string,array<double>>")  # one literal, not thousands
    none = F.array_repeat(F.lit(0.0), len(TEMPLATES) + 1)

    def counted(known: Column) -> Column:
        """Each distinct template term's number of times, squared weight and shares of the dot products."""
        return F.transform(F.array_distinct(known), lambda w: F.struct(
            (F.size(known) - F.size(F.array_remove(known, w))).cast("double").alias("n"),
            F.element_at(weights, w).alias("weights")))

    def reaches(terms: Column, others: Column) -> Column:
        length = F.aggregate(terms, F.lit(0.0), lambda x, t: x + t["n"] * t["n"] * t["weights"][0])
        dots = F.aggregate(terms, none, lambda total, t: F.zip_with(total, t["weights"], lambda x, y: x + t["n"] * y))
        best = F.array_max(F.slice(dots, 2, len(TEMPLATES)))  # the first sum is none
        least = THRESHOLD - 1e-5
        return _let(length, lambda known: (known >= least * least * (known + others))
                    & (best >= least * F.sqrt(known + others)))

    def hope(part: Column) -> Column:
        return _let(_terms(part), lambda words: _let(F.filter(words, lambda w: w.isin(terms)), lambda known: _let(
            counted(known), lambda each: reaches(each, F.size(words) - F.size(known)))))

    return F.filter(found, hope)


def line_scores(lines: DataFrame, seen: DataFrame) -> DataFrame:
    """mark, license, score of the best template of each distinct part that reaches the threshold.

    ``seen`` is ``term_counts`` of all lines, ``lines`` the parts to be scored,
    each with its digest as ``mark``: terms and sums travel with that, not with the text.
    """
    spark = lines.sparkSession
    words = (lines.select("mark", "line").distinct().select("mark", F.explode(_terms(F.col("line"))).alias("term"))
             .groupBy("mark", "term").agg(F.count("*").alias("tf")))
    total = seen.agg(F.coalesce(F.sum(F.when(F.col("term") == "", F.col("df"))), F.lit(0)).alias("total"))
    weight = F.log((1 + F.col("total")) / (1 + F.coalesce("df", F.lit(0)))) + 1
    templates = spark.createDataFrame([(k, *t) for k, t in enumerate(TEMPLATES)],
                                      "template int, license string, notice string")  # a constant list
    wanted = (templates.select("template", "license", F.explode(_terms(F.col("notice"))).alias("term"))
              .groupBy("template", "license", "term").agg(F.count("*").alias("tf")).join(seen, "term", "left")
              .join(F.broadcast(total))  # one row
              .select("template", "license", "term", (F.col("tf") * weight).alias("t")))
    wanted_norm = wanted.groupBy("template").agg(F.sqrt(F.sum(F.col("t") * F.col("t"))).alias("t_norm"))
    mine = (words.join(seen, "term", "left").join(F.broadcast(total))  # one row
            .select("mark", "term", (F.col("tf") * weight).alias("w")))
    norm = mine.groupBy("mark").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = (mine.join(F.broadcast(wanted), "term")  # the templates' terms, a constant number
           .groupBy("mark", "template", "license").agg(F.sum(F.col("w") * F.col("t")).alias("dot")))
    score = F.round(F.col("dot") / (F.col("norm") * F.col("t_norm")), 6)
    best = F.max(F.struct("score", F.col("license"))).alias("best")
    return (dot.join(norm, "mark").join(F.broadcast(wanted_norm), "template").withColumn("score", score)
            .where(F.col("score") >= THRESHOLD).groupBy("mark").agg(best)
            .select("mark", F.col("best.license").alias("license"), F.col("best.score").alias("score")))


def folder_of(path: Column) -> Column:
    """The folder of a path, empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, path, license, evidence, score, folder for every row of ``docs`` (doc_id, path, text).

    ``evidence`` is own, inherited or none; ``folder`` is where an inherited
    license comes from.  Of several parts, or several licence files of one
    folder, the best score wins, then the last license by name.  Null and empty
    texts have no license of their own; a null path inherits nothing; rows that
    share doc_id and path share their parts.  Other columns are not read.
    """
    docs = docs.select("doc_id", "path", "text")
    keys = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("path", F.lit(""))]
    able = docs.where(F.col("text").rlike(line_pattern()))
    seen = common.cut(term_counts(able.select(
        F.explode(F.filter(F.split("text", "\n"), lambda x: x.rlike(line_pattern()))).alias("line"))))
    lines = common.cut(able.select(F.struct(*(k.alias(n) for k, n in zip(keys, "ip", strict=True))).alias("key"),
                                   F.explode(hopeful(parts(F.col("text"), F.col("path")), seen)).alias("line"))
                       .withColumn("mark", F.unhex(F.sha2("line", 256))))
    own = (lines.select("key", "mark").join(line_scores(lines, seen), "mark")
           .groupBy("key").agg(F.max(F.struct("score", "license")).alias("own")))
    rows = docs.select("doc_id", "path", F.struct(*(k.alias(n) for k, n in zip(keys, "ip", strict=True))).alias("key"),
                       folder_of(F.col("path")).alias("at"))
    rows = common.cut(rows.join(own, "key", "left").drop("key"))
    files = rows.where(F.regexp_extract("path", "[^/]*$", 0).rlike(FILE_NAME) & F.col("own").isNotNull())
    declared = files.groupBy(F.col("at").alias("folder")).agg(F.max("own").alias("given"))
    names = F.split("folder_path", "/")
    above = F.concat(F.transform(F.sequence(F.lit(1), F.size(names)),
                                 lambda n: F.array_join(F.slice(names, 1, n), "/")), F.array(F.lit("")))
    folders = rows.where(F.col("own").isNull() & F.col("at").isNotNull()).select(F.col("at").alias("folder_path")).distinct()
    nearest = (folders.select("folder_path", F.explode(F.array_distinct(above)).alias("folder")).join(declared, "folder")
               .groupBy("folder_path").agg(F.max_by(F.struct("folder", "given"), F.length("folder")).alias("near")))
    found = rows.join(nearest, rows["at"] == nearest["folder_path"], "left")
    evidence = F.when(F.col("own").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    return found.select(
        "doc_id", "path", F.coalesce("own.license", "near.given.license").alias("license"), evidence.alias("evidence"),
        F.coalesce("own.score", "near.given.score").alias("score"),
        F.when(F.col("own").isNull(), F.col("near.folder")).alias("folder"))


def document_path(doc_id: Column, source: Column, lang: Column) -> Column:
    """Where the query places a document: a folder for each hundred ids under source and language.

    Every twentieth document is its folder's licence file, every hundredth that of the folder above.
    """
    hundred = F.floor(doc_id / 100).cast("string")
    top = F.concat_ws("/", F.coalesce(source, F.lit("unknown")), F.coalesce(lang, F.lit("unknown")))
    return (F.when(doc_id % 100 == 0, F.concat_ws("/", top, F.lit("LICENSE")))
            .when(doc_id % 20 == 0, F.concat_ws("/", top, hundred, F.lit("LICENSE")))
            .otherwise(F.concat_ws("/", top, hundred, F.concat(doc_id.cast("string"), F.lit(".txt")))))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    path = document_path(F.col("doc_id"), F.col("source"), F.col("lang"))
    return scan(docs.select("doc_id", path.alias("path"), "text"))


def _sql() -> str:
    values = ", ".join("({}, '{}', '{}')".format(k, i, t.replace("'", "''")) for k, (i, t) in enumerate(TEMPLATES))
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    pattern = line_pattern().replace("'", "''")
    terms = "list_filter(regexp_extract_all(lower({}), '({})', 1), lambda w: w NOT IN ({}))"
    return f"""
WITH docs AS (
  SELECT doc_id, text, coalesce(source, 'unknown') || '/' || coalesce(lang, 'unknown') AS top,
         CAST(doc_id // 100 AS VARCHAR) AS hundred FROM documents),
placed AS (
  SELECT doc_id, text, CASE WHEN doc_id % 100 = 0 THEN top || '/LICENSE'
                            WHEN doc_id % 20 = 0 THEN top || '/' || hundred || '/LICENSE'
                            ELSE top || '/' || hundred || '/' || CAST(doc_id AS VARCHAR) || '.txt' END AS path FROM docs),
lines AS (
  SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM placed)
  WHERE regexp_matches(line, '{pattern}')),
paragraphs AS (
  SELECT doc_id, paragraph FROM (SELECT doc_id, unnest(string_split_regex(text, '{PARAGRAPH}')) AS paragraph FROM placed)
  WHERE regexp_matches(paragraph, '{pattern}')),
pieces AS (
  SELECT doc_id, unnest(string_split(paragraph, chr(10))) AS piece FROM paragraphs
  UNION SELECT doc_id, unnest(string_split_regex(paragraph, '{SENTENCE}')) FROM paragraphs
  UNION SELECT doc_id, paragraph FROM paragraphs
  UNION SELECT doc_id, text FROM placed WHERE regexp_matches(path, '(^|/)LICENSE$')),
line_terms AS (
  SELECT doc_id, row_number() OVER () AS seg, {terms.format('piece', WORD, stop)} AS terms FROM pieces
  WHERE regexp_matches(piece, '{pattern}')),
tf AS (SELECT seg, term, count(*) AS tf FROM (SELECT seg, unnest(terms) AS term FROM line_terms) GROUP BY seg, term),
idf AS (SELECT term, count(*) AS df FROM
        (SELECT unnest(list_distinct({terms.format('line', WORD, stop)})) AS term FROM lines) GROUP BY term),
total AS (SELECT count(*) AS total FROM lines),
vec AS (SELECT seg, tf.term, tf * (ln((1 + total) / (1 + coalesce(df, 0))) + 1) AS w
        FROM tf LEFT JOIN idf USING (term) CROSS JOIN total),
norm AS (SELECT seg, sqrt(sum(w * w)) AS norm FROM vec GROUP BY seg),
templates(template, license, notice) AS (VALUES {values}),
t_tf AS (SELECT template, license, term, count(*) AS tf FROM
         (SELECT template, license, unnest({terms.format('notice', WORD, stop)}) AS term FROM templates) GROUP BY ALL),
t_vec AS (SELECT template, license, t_tf.term, tf * (ln((1 + total) / (1 + coalesce(df, 0))) + 1) AS t
          FROM t_tf LEFT JOIN idf USING (term) CROSS JOIN total),
t_norm AS (SELECT template, sqrt(sum(t * t)) AS t_norm FROM t_vec GROUP BY template),
scores AS (SELECT seg, license, round(sum(w * t) / (any_value(norm) * any_value(t_norm)), 6) AS score
           FROM vec JOIN t_vec USING (term) JOIN norm USING (seg) JOIN t_norm USING (template) GROUP BY seg, template, license),
own AS (SELECT doc_id, max(struct_pack(score := score, license := license)) AS own
        FROM scores JOIN line_terms USING (seg) WHERE score >= {THRESHOLD} GROUP BY doc_id),
located AS (SELECT p.doc_id, p.path, regexp_replace(p.path, '/[^/]*$', '') AS dir, own.own
            FROM placed p LEFT JOIN own USING (doc_id)),
declared AS (SELECT dir AS folder, max(own) AS given FROM located
             WHERE regexp_matches(path, '(^|/)LICENSE$') AND own IS NOT NULL GROUP BY dir),
near AS (SELECT l.doc_id, max(struct_pack(n := length(folder), folder := folder, given := given)) AS near
         FROM located l JOIN declared ON l.dir = folder OR starts_with(l.dir, folder || '/')
         WHERE own IS NULL GROUP BY l.doc_id)
SELECT l.doc_id, l.path, coalesce(l.own.license, near.given.license) AS license,
       CASE WHEN l.own IS NOT NULL THEN 'own' WHEN near IS NOT NULL THEN 'inherited' ELSE 'none' END AS evidence,
       coalesce(l.own.score, near.given.score) AS score, near.folder AS folder
FROM located l LEFT JOIN near USING (doc_id)"""


SQL = _sql()
