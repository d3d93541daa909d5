"""License scan by canonical digest lookup.

A text is brought to a canonical form (case, punctuation, copyright lines, equivalent spellings)
and its SHA-256 is joined with the digests of known licence texts. The main path is DataFrame
expressions only.
"""

from __future__ import annotations

import re
import textwrap
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence identifier, whether reuse is permissive, and a text or notice that grants it.
KNOWN = [
    ("Apache-2.0", True, "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", True, 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", True, "Released under the MIT License."),
    ("MIT", True, "Licensed under the MIT License."),
    ("MIT", True, 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", True, 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("GPL-3.0-only", False, "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", False, "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", False, "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", False, "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", True, "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", True, "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", False, "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", True, "Released under CC0 1.0."),
]

# Spellings that count as equal, as (pattern over lower-case text, spelling).
SPELLINGS = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("non-infringement", "noninfringement"),
    ("organisation", "organization"),
    ("merchantibility", "merchantability"),
    ("https:", "http:"),
    ("&", " and "),
]
# A line that only states who holds the copyright, or that all rights are reserved.
COPYRIGHT_LINE = r"(^|\n)[ \t]*((copyright|©|\(c\))[^\n]*|all rights reserved[. \t]*)"
PUNCTUATION = r"[^\p{L}\p{N}]+"

# Title lines that a complete text may come with or without.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause Simplified License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause New or Revised License"],
    "Zlib": ["zlib License", "The zlib License"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "Unlicense": ["The Unlicense"],
}
# Complete texts that grant use without copyleft; the other files' texts do not.
PERMISSIVE = {*TITLES, "Apache-2.0", "CC0-1.0"}
# Texts up to this length are listed in every layout.
SHORT = 3000


def _layouts(text: str) -> list[str]:
    """A text as given, with a line a paragraph, and, if short, in all layouts that differ in canonical form.

    Lines that begin with the word copyright are not canonical, so that breaks matter.
    """
    paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n", text.strip())]
    found = [text, "\n\n".join(paragraphs)]
    if len(text) <= SHORT:
        for indent in ("", "   "):
            for width in range(60, 121):
                found.append("\n\n".join(textwrap.fill(p, width, subsequent_indent=indent, break_on_hyphens=False) for p in paragraphs))
    seen: dict[str, str] = {}
    for one in found:
        seen.setdefault(" ".join(re.findall(r"[^\W_]+", re.sub(COPYRIGHT_LINE, r"\1", one.lower()))), one)
    return list(seen.values())


def complete_texts() -> list[tuple[str, bool, str]]:
    """Complete licences from ``license_texts``: ``ID.txt``, and ``ID~2.txt`` for a second edition."""
    out = []
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        name = path.stem.split("~")[0]
        text = path.read_text(encoding="utf-8")
        bodies = [text]
        if name.startswith("BSD-"):
            bodies += [b.replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR") for b in bodies]
            bodies += [re.sub(r"(?m)^\d\. ", "* ", b) for b in bodies]
        for body in bodies:
            for layout in _layouts(body):
                titled = [f"{title}\n\n{layout}" for title in TITLES.get(name, [])]
                out += [(name, name in PERMISSIVE, t) for t in (layout, *titled)]
    return out


KNOWN += complete_texts()
# The paragraph that grants the rights, by which a text inside a longer one is noticed.
KNOWN += [(i, True, t.split("\n\n")[0]) for i, _, t in KNOWN if i in ("MIT", "ISC") and t.startswith("Permission") and "\n\n" in t]


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, one spelling, words parted by one blank."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "$1")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, PUNCTUATION, " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, bool, str]] | None = None) -> DataFrame:
    rows = spark.createDataFrame(known or KNOWN, "license_id string, permissive boolean, text string")
    return rows.select("license_id", "permissive", digest(F.col("text")).alias("digest")).distinct()


def scan(docs: DataFrame, known: list[tuple[str, bool, str]] | None = None) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``.

    ``text_digest`` is the digest of the entire canonical text; ``license_id`` is set when the
    entire text is a known licence. ``notice_ids`` are the licences of which a whole line or a
    whole paragraph (lines up to a blank one) is a known text, sorted, and ``permissive`` says
    whether all found ones are (null if none was found). Null text counts as empty and finds
    nothing. Rows that share a doc_id share their notices; a null doc_id is an id like any other.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    # as many rows as the list given, whatever the input: the one table that may be broadcast
    lookup = F.broadcast(known_digests(spark, known))
    lines = F.split("text", "\n")
    paragraphs = F.when(F.col("text").rlike(r"\n[ \t]*\n"), F.split("text", r"\n[ \t]*\n")).otherwise(F.array("text"))
    units = docs.select("doc_id", F.explode(F.array_distinct(F.concat(lines, paragraphs))).alias("unit"))
    found = (
        units.select("doc_id", digest(F.col("unit")).alias("digest"))
        .join(lookup, "digest")
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_set("license_id")).alias("notice_ids"), F.min("permissive").alias("permissive"))
    )
    whole = docs.select("doc_id", digest(F.col("text")).alias("digest")).join(
        lookup.groupBy("digest").agg(F.min("license_id").alias("license_id")).hint("broadcast"), "digest", "left"
    )
    hits = found.withColumnRenamed("doc_id", "hit_id")
    return whole.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left").select(
        "doc_id",
        F.col("digest").alias("text_digest"),
        "license_id",
        F.array_join(F.coalesce("notice_ids", F.array().cast("array<string>")), ",").alias("notice_ids"),
        "permissive",
    )


def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{COPYRIGHT_LINE}', '\\1', 'g')"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return f"trim(regexp_replace({out}, '{PUNCTUATION}', ' ', 'g'))"


def oracle() -> str:
    values = ", ".join("('{}', {}, '{}')".format(i, str(p).lower(), t.replace("'", "''")) for i, p, t in KNOWN)
    return rf"""
        WITH known AS (
          SELECT DISTINCT license_id, permissive, sha256({_sql_canonical("t")}) AS digest
          FROM (VALUES {values}) v(license_id, permissive, t)),
        docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        units AS (
          SELECT doc_id, unnest(list_distinct(list_concat(string_split(text, chr(10)), string_split_regex(text, '\n[ \t]*\n')))) AS unit
          FROM docs),
        found AS (
          SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notice_ids, bool_and(permissive) AS permissive
          FROM units JOIN known ON sha256({_sql_canonical("unit")}) = digest GROUP BY doc_id),
        whole AS (SELECT doc_id, sha256({_sql_canonical("text")}) AS text_digest FROM docs)
        SELECT w.doc_id, w.text_digest, k.license_id, coalesce(f.notice_ids, '') AS notice_ids, f.permissive
        FROM whole w LEFT JOIN (SELECT digest, min(license_id) AS license_id FROM known GROUP BY 1) k ON k.digest = w.text_digest
             LEFT JOIN found f ON f.doc_id = w.doc_id"""
