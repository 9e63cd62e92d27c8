"""License scans: passages against licence templates by the Dice coefficient over word bigrams.

Passages are the lines of a text, its paragraphs of several lines (blank lines part them), and the sentences of its paragraphs, which may
run over lines.  Text is normalised (ASCII letters and digits, lower case); a passage and a template are
sets of word bigrams, and Dice = 2 * shared / (size a + size b).  For a coefficient of t or more the sizes can differ by a
factor of (2 - t) / t at most: passages outside every template's bounds go before any bigram is compared, and the bounds of each template are part of
the join on bigrams.  Templates are the paragraphs of whole licences, their headers and short notices: a fixed, bounded table.
DataFrame functions alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fixed, table

THRESHOLD = 0.8

#: Notices and paragraphs of common licences, as published: (name, text).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL", "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-3-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

NORMAL, BLANK, SENTENCE = r"[^a-z0-9]+", r"\n[ \t\r]*\n", r"[.!?]+[ \t\r\n]+"


def with_bigrams(df: DataFrame, column: str, least: float = 1) -> DataFrame:
    """Adds `grams`, the distinct bigrams of a column's words ([] for fewer than two words); rows with fewer than `least` bigrams at most go before any is made."""
    df = fixed(df, "_w", F.filter(F.split(F.lower(column), NORMAL), lambda w: w != "")).withColumn("_n", F.size("_w")).where(F.col("_n") - 1 >= least)
    pairs = F.transform(F.sequence(F.lit(0), F.col("_n") - 2), lambda i: F.concat(F.get("_w", i), F.lit(" "), F.get("_w", i + 1)))
    return fixed(df, "grams", F.when(F.col("_n") > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))).drop("_w", "_n")


def templates(spark: SparkSession, rows=TEMPLATES) -> DataFrame:
    df = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(rows)], "template_id int, license string, template string")
    return with_bigrams(df, "template").withColumn("tn", F.size("grams"))


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, row, kind, place, passage: lines; paragraphs of several lines; sentences of paragraphs of several sentences."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    paragraphs = F.split("text", BLANK)
    several = F.filter(
        F.transform(paragraphs, lambda p, i: F.struct(F.lit("paragraph").alias("kind"), i.cast("long").alias("place"), p.alias("passage"))), lambda p: F.trim(p["passage"], F.lit("\n")).contains("\n")
    )
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.lit("line").alias("kind"), i.cast("long").alias("place"), x.alias("passage")))
    whole = F.filter(F.transform(paragraphs, lambda p: F.split(p, SENTENCE)), lambda s: F.size(s) > 1)
    sentences = F.transform(F.flatten(whole), lambda x, i: F.struct(F.lit("sentence").alias("kind"), i.cast("long").alias("place"), x.alias("passage")))
    return base.where("text is not null").select("doc_id", "row", F.inline(F.concat(lines, several, sentences)))


def license_hits(docs: DataFrame, threshold: float = THRESHOLD, rows=TEMPLATES) -> DataFrame:
    """doc_id, kind, place, license, dice: for each passage that reaches the threshold with a template, each licence with its best coefficient.

    Null and empty texts and passages of less than two words have no hits; repeated rows give repeated hits.  An empty table gives none; other columns are not read.
    """
    t = templates(docs.sparkSession, rows)
    sizes = [r[0] for r in t.select("tn").collect()]  # a row a template
    low, high = min(sizes) * threshold / (2 - threshold), max(sizes) * (2 - threshold) / threshold
    # A passage of k bigrams has 2 k + 1 characters at least: short ones go before they are split into words.
    some = passages(docs).where(F.length("passage") > 2 * low)
    grams = with_bigrams(some, "passage", low).withColumn("n", F.size("grams")).where(F.col("n").between(low, high))
    each = grams.select("doc_id", "row", "kind", "place", "n", F.explode("grams").alias("gram"))
    of_template = F.broadcast(t.select("template_id", "license", "tn", F.explode("grams").alias("tgram")))  # bounded: the fixed templates' bigrams
    bounds = (F.col("n") * (2 - threshold) >= F.col("tn") * threshold) & (F.col("tn") * (2 - threshold) >= F.col("n") * threshold)
    shared = each.join(of_template, (F.col("gram") == F.col("tgram")) & bounds).groupBy("doc_id", "row", "kind", "place", "n", "template_id", "license", "tn").agg(F.count("*").alias("shared"))
    dice = shared.withColumn("dice", F.round(2 * F.col("shared") / (F.col("n") + F.col("tn")), 6)).where(F.col("dice") >= threshold)
    return dice.groupBy("doc_id", "row", "kind", "place", "license").agg(F.max("dice").alias("dice")).drop("row")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_hits(table(spark, sf_dir, "documents"))


def _values() -> str:
    return ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(TEMPLATES))


ORACLE = rf"""
WITH raw_t(template_id, license, template) AS (VALUES {_values()}),
tw AS (SELECT template_id, license, list_filter(string_split_regex(lower(template), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM raw_t),
tg AS (SELECT template_id, license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM tw),
d AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split_regex(text, '\n[ \t\r]*\n') AS ps FROM documents WHERE text IS NOT NULL),
s AS (SELECT rid, doc_id, flatten(list_filter(list_transform(ps, lambda p: string_split_regex(p, '[.!?]+[ \t\r\n]+')), lambda x: len(x) > 1)) AS ss FROM d),
passages AS (
  SELECT rid, doc_id, 'line' AS kind, unnest(range(0, len(ls))) AS place, unnest(ls) AS passage FROM (SELECT rid, doc_id, string_split(text, chr(10)) AS ls FROM d)
  UNION ALL SELECT * FROM (SELECT rid, doc_id, 'paragraph', unnest(range(0, len(ps))), unnest(ps) AS passage FROM d) WHERE contains(trim(passage, chr(10)), chr(10))
  UNION ALL SELECT rid, doc_id, 'sentence', unnest(range(0, len(ss))), unnest(ss) FROM s),
lw AS (SELECT rid, doc_id, kind, place, list_filter(string_split_regex(lower(passage), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM passages),
lg AS (SELECT rid, doc_id, kind, place, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM lw WHERE len(w) >= 2),
pairs AS (SELECT lg.rid, lg.doc_id, lg.kind, lg.place, tg.license, round(2.0 * len(list_intersect(lg.g, tg.g)) / (len(lg.g) + len(tg.g)), 6) AS dice
  FROM lg JOIN tg ON len(lg.g) * {2 - THRESHOLD} >= len(tg.g) * {THRESHOLD} AND len(tg.g) * {2 - THRESHOLD} >= len(lg.g) * {THRESHOLD})
SELECT doc_id, kind, place::BIGINT AS place, license, max(dice) AS dice FROM pairs WHERE dice >= {THRESHOLD} GROUP BY rid, doc_id, kind, place, license
"""
