"""License scan by canonical digests.

A text is brought to a canonical form (case, punctuation, copyright lines and
equivalent spellings leave no trace), and the SHA-256 of the form is looked up
among those of known licenses: for the whole text, and for each line, since
short notices stand on lines of their own. Known texts go through the same
form, so a change of the form needs no new table; the long texts of which only
digests are kept (`license_digests`) are the exception.

The form of a whole text that is made of the forms of its lines depends on
where the lines break. So the license of a whole text is looked up by its
flowed form: copyright statements (not the lines that begin with the word) are
taken out, the lines are joined, and the spellings apply to the whole.

All steps are built-in functions on one row; the table of known digests is
fixed and small, and is broadcast. Defined results: a null or empty text has
the empty form, which matches nothing; repeated rows give equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapflow.llm.license_digests import FULL_DIGESTS
from tapflow.llm.reputation import LOWER, UPPER

# Equivalent spellings, applied in order to lower-case words with single spaces.
SPELLINGS = [
    ("licenc", "licens"),
    ("sub licens", "sublicens"),
    ("non infring", "noninfring"),
    ("is(e|ed|es|ing|ation|ations)( |$)", "iz$1$2"),
    ("(judg|acknowledg)ement", "$1ment"),
    ("our( |$)", "or$1"),
    ("copyright (?:owner|holder)s?", "copyright holder"),
    ("(^| )(?:the )?version ([0-9])", "$1v$2"),
]
COPYRIGHT_LINE = r"^[^0-9a-z]*(copyright([^0-9a-z]|$)|\(c\)|©|all rights reserved)"

# Copyright statements in a text with single spaces: a mark with a sign, year
# or name, up to the end of the line or what licenses go on with on that line.
# '(c)' alone also numbers clauses, so it needs a year or a line of names.
_YEAR = r"(?:[0-9]{4}|[<\[{]?(?:year|yyyy)(?![0-9a-z]))"
_SIGNED = (rf"(?:copyright[ :,]*(?:\(c\)|©)|©|(?:copyright|\(c\))[ :,]*{_YEAR}"
           rf"|\(c\) copyright[ :,]*(?:{_YEAR}|(?-i:[A-Z])))")
_NAMED = (r"(?:copyright(?: by| of)? (?!(?:notices?|holders?|owners?|laws?|licen[cs]es?|licensors?|statements?|interests?"
          r"|treaty|treaties|acts?|directive|office|disclaimer|protection|and|or|in|is|are|as|to|for|by|of|on|the)(?![0-9a-z]))"
          r"(?:(?-i:[A-Z])|(?=(?:[^ \n]+ ?){1,5}(?:\n|\z)))|\(c\)(?=(?-i:(?: (?:[A-Z][^ \n]*|and|of|the)){1,8}) ?(?:\n|\z)))")
_GO_ON = (r"permission (?:is hereby|is granted|to use)|redistribution and use|this software is|the software is provided"
          r"|this program|licensed under|everyone is permitted|all rights reserved|mit license|isc license|zlib license")
_END = rf"(?:[^\n]{{0,200}}?(?=(?<![0-9a-z])(?:{_GO_ON})|\n|\z))?"
STATEMENTS = [rf"(?i)(?<![^\n])[^0-9a-z\n]*?(?:{_SIGNED}|{_NAMED}){_END}",
              rf"(?i)(?<![0-9a-z]){_SIGNED}[^\n]{{0,200}}?(?=(?<![0-9a-z])(?:{_GO_ON}))",
              r"(?i)(?<![0-9a-z])all rights reserved(?![0-9a-z])"]

# Known full texts (fixed values, public licenses), and notices by a rule.
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
    "of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
    "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
ISC_TEXT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
    "IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
    "USE OR PERFORMANCE OF THIS SOFTWARE.")
ZLIB_TEXT = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
    "liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
    "software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject "
    "to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim "
    "that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
    "documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as "
    "such, and must not be misrepresented as being the original software. 3. This notice may not be removed or "
    "altered from any source distribution.")
FULL_TEXTS = [("MIT", MIT_GRANT), ("MIT", "MIT License " + MIT_GRANT), ("MIT", "The MIT License (MIT) " + MIT_GRANT),
              ("ISC", ISC_TEXT), ("ISC", "ISC License " + ISC_TEXT), ("Zlib", ZLIB_TEXT),
              ("Zlib", "zlib License " + ZLIB_TEXT)]
NAMES = [
    ("MIT", ["MIT License", "MIT"]),
    ("Apache-2.0", ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0"]),
    ("GPL-3.0", ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3", "GPL-3.0"]),
    ("GPL-2.0", ["GNU General Public License, version 2", "GPLv2", "GPL-2.0"]),
    ("LGPL-3.0", ["GNU Lesser General Public License, version 3", "LGPL-3.0"]),
    ("AGPL-3.0", ["GNU Affero General Public License, version 3", "AGPL-3.0"]),
    ("BSD-3-Clause", ["BSD 3-Clause License", "BSD-3-Clause"]),
    ("BSD-2-Clause", ["BSD 2-Clause License", "BSD-2-Clause"]),
    ("MPL-2.0", ["Mozilla Public License, version 2.0", "MPL-2.0"]),
    ("ISC", ["ISC License"]),
    ("CC0-1.0", ["CC0 1.0"]),
    ("CC-BY-4.0", ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"]),
    ("CC-BY-SA-4.0", ["CC BY-SA 4.0"]),
    ("CC-BY-NC-4.0", ["CC BY-NC 4.0"]),
    ("CC-BY-ND-4.0", ["CC BY-ND 4.0"]),
]
TEMPLATES = ["Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}",
             "Distributed under the {}", "This work is licensed under {}", "This work is licensed under the {}",
             "SPDX-License-Identifier: {}"]


def known_texts() -> list[tuple[str, str]]:
    """(license, text) of all known full texts and notices."""
    return FULL_TEXTS + [(k, t.format(n)) for k, names in NAMES for n in names for t in TEMPLATES]


def canonical_line(line: Column) -> Column:
    """Canonical form of one line; '' for a copyright line."""
    form = F.translate(line, UPPER, LOWER)
    kept = F.when(form.rlike(COPYRIGHT_LINE), F.lit("")).otherwise(form)
    words = F.trim(F.regexp_replace(kept, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    for pattern, to in SPELLINGS:
        words = F.regexp_replace(words, pattern, to)
    return words


def canonical_lines(text: Column) -> Column:
    """Canonical forms of the lines of a text that leave something."""
    return F.filter(F.transform(F.split(F.coalesce(text.cast("string"), F.lit("")), "\n"), canonical_line),
                    lambda x: x != "")


def flowed(text: Column) -> Column:
    """Canonical form of a whole text, wherever its lines break."""
    form = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[ \t\x0B\f\r]+", " ")
    for pattern in STATEMENTS:
        form = F.regexp_replace(form, pattern, " ")
    form = F.trim(F.regexp_replace(F.translate(form, UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    for pattern, to in SPELLINGS:
        form = F.regexp_replace(form, pattern, to)
    return form


def digest(form: Column) -> Column:
    return F.sha2(form.cast("binary"), 256)


def known_digests(spark: SparkSession) -> DataFrame:
    """(digest, license) of the known texts, one row for each digest."""
    rows = spark.createDataFrame(known_texts(), "license string, text string")
    forms = rows.select("license", F.array_join(canonical_lines(F.col("text")), " ").alias("form"))
    return forms.select(digest(F.col("form")).alias("digest"), "license").groupBy("digest").agg(
        F.min("license").alias("license"))


def known_flows(spark: SparkSession) -> DataFrame:
    """(flow_digest, flow_license) of the known texts by their flowed forms, and
    of the complete texts known by digest."""
    kept = spark.createDataFrame([(d, k) for k, ds in FULL_DIGESTS.items() for d in ds],
                                 "flow_digest string, license string")
    rows = spark.createDataFrame(known_texts(), "license string, text string")
    flows = rows.select(digest(flowed(F.col("text"))).alias("flow_digest"), "license")
    return flows.unionByName(kept).groupBy("flow_digest").agg(F.min("license").alias("flow_license"))


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_license, text_digest, n_notice_lines, notice_licenses) for
    every row: the license that the whole text is, or null; the digest of its
    canonical form; the lines that are a license or notice, and the licenses
    that they name (sorted, distinct)."""
    known = known_digests(df.sparkSession)
    by_digest = F.create_map(*[F.lit(x) for r in known.collect() for x in (r["digest"], r["license"])])
    forms = df.select(F.col(id_col), canonical_lines(F.col(text_col)).alias("forms"),
                      digest(flowed(F.col(text_col))).alias("flow"))
    lines = F.filter(F.transform("forms", lambda f: by_digest[digest(f)]), lambda x: x.isNotNull())
    found = forms.select(id_col, "flow", digest(F.array_join("forms", " ")).alias("text_digest"), lines.alias("lines"))
    return (found
            .join(F.broadcast(known_flows(df.sparkSession)), F.col("flow") == F.col("flow_digest"), "left")
            .select(id_col, F.col("flow_license").alias("text_license"), "text_digest",
                    F.size("lines").cast("long").alias("n_notice_lines"),
                    F.array_sort(F.array_distinct("lines")).alias("notice_licenses")))
