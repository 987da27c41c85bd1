"""License scans by canonical digest.

A text's lines are lower-cased, equivalent spellings made one, punctuation and
white space made single spaces, and copyright and empty lines dropped.  The
digest of what remains is looked up among the digests of the known licences,
made in the same way.  Whole texts are looked up, and single lines too, which
finds notices that stand in a longer text.  A licence's title line belongs to
its text, so ``license_texts`` has the texts with and without their titles.

Defined results: null and empty texts, and those of copyright lines only, have
no digest and no licence; equal texts with two licence ids report the smaller;
repeated rows are scanned alike; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from squadron.llm.license_texts import texts
from squadron.session import stage_table

#: Bytes of digests and licence ids up to which every task gets the whole table.
SENT_BYTES = 8 << 20

# Licence texts and notices (whole texts and single lines are both looked up).
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    *texts(),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""),
]

# Equivalent spellings (in lower case, within words).
EQUIVALENT = [("licence", "license"), ("organisation", "organization"), ("favour", "favor"),
              ("modelled", "modeled"), ("whilst", "while"), ("https://", "http://")]
_COPYRIGHT = r"^\s*(copyright|\(c\)|©|all rights reserved)"


def canonical_lines(text: Column) -> Column:
    """Normalised lines of a text, without copyright and empty ones."""
    def normal(line: Column) -> Column:
        for a, b in EQUIVALENT:
            line = F.replace(line, F.lit(a), F.lit(b))
        return F.trim(F.regexp_replace(line, r"[^\p{L}\p{N}]+", " "))

    lines = F.filter(F.split(F.lower(text), "\n"), lambda s: ~s.rlike(_COPYRIGHT))
    return F.filter(F.transform(lines, normal), lambda s: s != "")


def digest(lines: Column) -> Column:
    """The digest of normalised lines; line breaks count as spaces; null if none."""
    return F.when(F.size(lines) > 0, F.sha2(F.array_join(lines, " "), 256))


def known_digests(licenses: DataFrame) -> DataFrame:
    """(digest, license_id) of a table with license_id and text."""
    return (licenses.select("license_id", digest(canonical_lines(F.col("text"))).alias("digest"))
            .filter("digest is not null").groupBy("digest").agg(F.min("license_id").alias("license_id")))


def sent(known: DataFrame) -> DataFrame:
    """The digest table, with the broadcast hint where its bytes allow it."""
    known = stage_table(known, "license-digests")
    size = known.agg(F.sum(F.length("digest") + F.length("license_id"))).first()[0] or 0
    return F.broadcast(known) if size <= SENT_BYTES else known


def scan(docs: DataFrame, licenses: DataFrame | None = None, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """doc_id, digest, license_id (of the whole text), n_notices (lines that are
    a known text) and notices (their distinct licence ids, sorted array)."""
    if licenses is None:
        licenses = docs.sparkSession.createDataFrame(KNOWN, "license_id string, text string")
    known = sent(known_digests(licenses))
    rows = (docs.select(F.col(id_col).alias("doc_id"), canonical_lines(F.col(text_col).cast("string")).alias("lines"))
            .select("doc_id", "lines", digest(F.col("lines")).alias("text_digest")))
    lines = F.coalesce(F.transform("lines", lambda s: F.sha2(s, 256)), F.array().cast("array<string>"))
    # Place 0 is the whole text, so each row stays whatever is found in it.
    found = stage_table(
        rows.select("doc_id", "text_digest",
                    F.posexplode(F.concat(F.array("text_digest"), lines)).alias("place", "digest"))
        .join(known, "digest", "left").filter("place = 0 or license_id is not null")
        .select("doc_id", "text_digest", "place", "license_id"), "license-hits")
    # Rows that repeat an id and a text have the same line numbers, so each counts its own.
    hits = (found.filter("place > 0").groupBy("doc_id", "text_digest")
            .agg(F.count_distinct("place").alias("n_notices"),
                 F.sort_array(F.collect_set("license_id")).alias("notices")))
    whole = found.filter("place = 0").select("doc_id", F.col("text_digest").alias("digest"), "license_id")
    return (whole.join(hits, whole["doc_id"].eqNullSafe(hits["doc_id"]) & (whole["digest"] == hits["text_digest"]),
                       "left")
            .select(whole["doc_id"], "digest", "license_id", F.coalesce("n_notices", F.lit(0)).alias("n_notices"),
                    F.coalesce("notices", F.array().cast("array<string>")).alias("notices")))
