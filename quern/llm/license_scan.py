"""License scans by canonical digest, in DataFrame functions only.

A text is made canonical: lower case, copyright lines out, equivalent spellings made one, everything but letters and digits
to single spaces. The SHA-256 of the whole canonical text, and of each of its lines, is looked up among the digests of known licence
texts and notices by a hash join. The known ones are made canonical by the same expressions.

A null or blank text has a null digest and no licence. A text that is only copyright lines is blank. Repeated rows come out as often as they go in.
Two known texts with the same canonical form count as one, the first by name. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common as c

#: Equivalent spellings: what is found, what it becomes (after lower-casing, between other characters than letters).
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("non-commercial", "noncommercial"), ("per cent", "percent"),
    ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("behaviour", "behavior"), ("favour", "favor"), ("fulfil", "fulfill"),
    ("organisation", "organization"), ("whilst", "while"), ("wilful", "willful"), ("noninfringement", "non-infringement"), ("v.", "version"), ("ver.", "version"), ("&", "and"), ("https", "http"),
]

#: Names of licences as notices give them, and their identifiers. Fixed values.
NAMES = {
    "MIT License": "MIT", "Apache License, Version 2.0": "Apache-2.0", "GNU General Public License, version 2": "GPL-2.0-only", "GNU General Public License, version 3": "GPL-3.0-only",
    "GNU Lesser General Public License, version 2.1": "LGPL-2.1-only", "GNU Lesser General Public License, version 3": "LGPL-3.0-only", "GNU Affero General Public License, version 3": "AGPL-3.0-only",
    "Mozilla Public License, version 2.0": "MPL-2.0", "Eclipse Public License, version 2.0": "EPL-2.0", "BSD 2-Clause License": "BSD-2-Clause", "BSD 3-Clause License": "BSD-3-Clause", "ISC License": "ISC", "zlib License": "Zlib",
    "Boost Software License, Version 1.0": "BSL-1.0", "Creative Commons Attribution 4.0 International License": "CC-BY-4.0", "CC BY 4.0": "CC-BY-4.0", "CC BY-SA 4.0": "CC-BY-SA-4.0", "CC BY-NC 4.0": "CC-BY-NC-4.0", "CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0",
    "CC BY-ND 4.0": "CC-BY-ND-4.0", "CC0 1.0": "CC0-1.0", "Unlicense": "Unlicense",
}
#: Sentences in which a notice names its licence.
NOTICES = ["Licensed under {}.", "Licensed under the {}.", "Released under {}.", "Released under the {}.", "This work is licensed under {}.", "This work is licensed under the {}.", "Distributed under the {}.", "This project is licensed under the {}.", "This file is part of a work licensed under the {}."]

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
#: Whole licence texts. Fixed values.
TEXTS = [
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n' + _AS_IS),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD3 + _BSD_END),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
]
#: Lines that stand above a whole text as its title. Fixed values.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "FreeBSD License", "BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Modified BSD License", "BSD License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License (0BSD)", "0BSD"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
}
#: What may follow "copyright" in a sentence; a line that goes on otherwise names an owner.
NOT_OWNERS = "notices?|holders?|owners?|laws?|licen[cs]e[sd]?|statements?|interests?|protect\\w*|acts?|and|or|in|to|is|are|was|of|for|on|as|at|from|with|under|grants?|infring\\w*|claims?|works?|treat\\w*|rights?|years?|below|above|may|shall|must|can|will|disclaimers?|terms?|permissions?|messages?|information|material|status|issues?|law's|violations?|policy|agents?|office|reserved|this|that|it"
#: Known texts up to this number are sent to all executors; more are joined by shuffling.
BROADCAST_ROWS = 100_000


def known(spark: SparkSession) -> DataFrame:
    """(license, text) of whole licence texts, notices, and identifier lines."""
    rows = list(TEXTS) + [(i, f"{title}\n{x}") for i, x in TEXTS for title in TITLES[i]] + [(i, n.format(name)) for name, i in NAMES.items() for n in NOTICES] + [(i, f"SPDX-License-Identifier: {i}") for i in sorted({*NAMES.values(), "0BSD"})]
    return spark.createDataFrame(rows, "license string, text string")


def canonical_lines(text: Column) -> Column:
    """The canonical text with its line breaks."""
    out = F.lower(F.translate(text, "\r‘’“”–— ", "\n''\"\"-- "))
    out = F.regexp_replace(out, r"(?m)^[^\p{L}\p{N}\n]*(?:copyright(?:ed)?\b[^\p{L}\p{N}\n]*(?:\(c\)|\d|©|by\b).*|copyright[ \t:,]+(?!(?:" + NOT_OWNERS + r")\b)(?:[^\n]*\b(?:19|20)\d\d\b[^\n]*|[^\s]+(?:[ \t]+[^\s]+){0,5}[ \t]*)|\(c\)[^\p{L}\n]*\d.*|©.*|all rights reserved\W*)$", "")
    # Most texts have none of the other spellings: one look spares them the replacements.
    found = "|".join(_quote(a) for a, _ in sorted(SPELLINGS, key=lambda x: -len(x[0])))
    changed = out
    for a, b in SPELLINGS:
        changed = F.regexp_replace(changed, r"(?<!\p{L})" + _quote(a) + (r"(?!\p{L})" if a[-1].isalpha() else ""), b)
    out = F.when(out.rlike(rf"(?<!\p{{L}})(?:{found})"), changed).otherwise(out)
    return F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")


def _quote(x: str) -> str:
    return "".join(ch if ch.isalnum() or ch == " " else "\\" + ch for ch in x)


def digests(lines: Column) -> Column:
    """Digests of the whole text (first) and of its lines; null for what is blank."""
    sha = lambda x: F.when(x != "", F.sha2(x, 256))
    whole = F.trim(F.regexp_replace(lines, r"[\n ]+", " "))
    return F.concat(F.array(sha(whole)), F.transform(F.split(lines, "\n"), lambda x: sha(F.trim(x))))


def scan(docs: DataFrame, licenses: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id_col, digest, license (of the whole text), line_licenses (sorted, of its lines)."""
    spark = docs.sparkSession
    names = licenses.select("license", digests(canonical_lines(F.col("text")))[0].alias("_d")).where("_d is not null").groupBy("_d").agg(F.min("license").alias("license"))
    names = c.cut(names, "licenses")
    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), F.col(text)).alias("_k1"), F.xxhash64(F.lit(1), F.col(text), F.col(id_col)).alias("_k2"), canonical_lines(F.col(text)).alias("_t"))
    own = base.select("_id", "_k1", "_k2", F.posexplode_outer(digests(F.col("_t"))).alias("_pos", "_d"))
    few = names.count() <= BROADCAST_ROWS
    hit = own.join(F.broadcast(names.withColumnRenamed("_d", "_n")) if few else names.withColumnRenamed("_d", "_n"), F.col("_d") == F.col("_n"), "left").where("license is not null or coalesce(_pos, 0) = 0")
    whole = F.coalesce(F.col("_pos"), F.lit(0)) == 0
    # A row with place 0 for each row of documents: equal rows are counted and dealt out again.
    out = hit.groupBy("_id", "_k1", "_k2").agg(F.max(F.when(whole, F.col("_d"))).alias("digest"), F.max(F.when(whole, F.col("license"))).alias("license"), F.array_sort(F.collect_set(F.when(~whole, F.col("license")))).alias("line_licenses"), F.sum(whole.cast("int")).cast("int").alias("_copies"))
    return out.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(F.col("_id").alias(id_col), "digest", "license", "line_licenses")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(c.read(spark, sf_dir, "documents"), known(spark)).select("doc_id", "digest", "license", F.array_join("line_licenses", ",").alias("line_licenses"))
