"""License scans by canonical digests.

A text is normalised (case, copyright lines, equivalent spellings, punctuation, white space) and its SHA-256 is joined to the
digests of known licence texts, normalised alike. What is looked up is always an entire text: a document as a whole, and
each of its lines, so that a notice that stands in a line of its own is found too.

Defined results: a null or empty text, and one of punctuation only, has no unit and matches nothing; repeated rows give a row
each; an empty catalogue matches nothing; a digest of two licences reports both.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Short licence texts and customary notices (SPDX id, text). The first five are the texts of whole files.
_SHORT = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)
_CLAUSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD3 = _SHORT[3][1].replace("THIS SOFTWARE IS PROVIDED BY", _CLAUSE + "THIS SOFTWARE IS PROVIDED BY")
#: The title lines that short texts customarily stand under.
_TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("Zero-Clause BSD", "BSD Zero Clause License", "0BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License"),
}
#: The names that one-line notices give a licence.
_NAMES = {
    "MIT": ("the MIT License", "MIT"),
    "ISC": ("the ISC License", "ISC"),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "Apache 2.0"),
    "BSD-2-Clause": ("the BSD 2-Clause License",),
    "BSD-3-Clause": ("the BSD 3-Clause License",),
    "Zlib": ("the zlib License",),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"),
    "GPL-2.0-only": ("the GNU General Public License, version 2",),
    "GPL-3.0-only": ("the GNU General Public License, version 3",),
    "LGPL-2.1-only": ("the GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0-only": ("the GNU Lesser General Public License, version 3",),
    "AGPL-3.0-only": ("the GNU Affero General Public License, version 3",),
    "EPL-2.0": ("the Eclipse Public License, version 2.0", "the Eclipse Public License 2.0"),
    "CC0-1.0": ("CC0 1.0",),
    **{f"CC-BY{x}-4.0": (f"CC BY{x} 4.0",) for x in ("", "-SA", "-NC", "-ND", "-NC-SA", "-NC-ND")},
}
_NOTICES = ("Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This project is licensed under {}.", "This software is licensed under {}.")


def _catalogue() -> tuple[tuple[str, str], ...]:
    """The short texts alone and under their titles, with and without a line of reserved rights; the texts of files, which have
    their titles; and the notices."""
    short = (*_SHORT[:5], ("BSD-3-Clause", _BSD3))
    headed = [(k, f"{title}\n{rights}\n{text}") for k, text in short for title in ("", *_TITLES[k]) for rights in ("", "All rights reserved.\n") if title or rights]
    files = [(f.name.removesuffix(".txt"), f.read_text()) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
    notices = [(k, form.format(name)) for k, names in _NAMES.items() for name in names for form in _NOTICES]
    notices += [(k, f"SPDX-License-Identifier: {k}") for k in sorted({*_NAMES, "0BSD", *(k for k, _ in files)})]
    return (*_SHORT, short[-1], *headed, *files, *notices)


#: The known texts (SPDX id, text). known_digests() takes any other table of them.
CATALOGUE = _catalogue()
#: Spellings that count as equal, from the SPDX matching guidelines.
SPELLINGS = (("licence", "license"), ("https://", "http://"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("labour", "labor"), ("organisation", "organization"), ("authorisation", "authorization"), ("copyright owner", "copyright holder"), ("&", " and "))
COPYRIGHT_LINE = r"(?m)^[ \t]*(?:copyright|\(c\)|©)[^\n]*$"
NOT_LETTERS = r"[^\p{L}\p{N}\n]+"


def normalise(text: Column) -> Column:
    """Normalised text whose line breaks are kept."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.regexp_replace(F.regexp_replace(out, NOT_LETTERS, " "), " ?\n ?", "\n")


def whole(normal: Column) -> Column:
    return F.trim(F.regexp_replace(normal, "\n+", " "))


def known_digests(spark: SparkSession, catalogue=CATALOGUE) -> DataFrame:
    known = spark.createDataFrame([tuple(x) for x in catalogue], "license string, text string")
    known = known.select("license", F.sha2(whole(normalise(F.col("text"))), 256).alias("digest"))
    return known.groupBy("digest").agg(F.array_sort(F.collect_set("license")).alias("licenses"))


def scan(docs: DataFrame, known: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_limit: int = 200_000) -> DataFrame:
    """doc_id, n_lines (that are not blank once normalised), n_license_lines, text_licenses (of the document as a whole),
    line_licenses (sorted arrays) of each row."""
    small = known.limit(broadcast_limit + 1).count() <= broadcast_limit
    mark = known.sparkSession.range(1).select(F.lit("").alias("digest"), F.array().cast("array<string>").alias("licenses"))
    known = known.unionByName(mark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("_text"), normalise(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    lines = F.filter(F.transform(F.split("t", "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.select("doc_id", "_text", whole(F.col("t")).alias("t"), lines.alias("lines"))
    unit = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("digest"))
    units = F.concat(F.array(unit("row", F.lit(""))), F.when(F.col("t") != "", F.array(unit("text", F.sha2("t", 256)))).otherwise(F.array().cast("array<struct<kind:string,digest:string>>")), F.transform("lines", lambda x: unit("line", F.sha2(x, 256))))
    rows = rows.select("doc_id", "_text", F.size("lines").alias("n"), F.explode(units).alias("u")).select("doc_id", "_text", "n", "u.*")
    hits = rows.join(F.broadcast(known) if small else known, on="digest", how="inner")
    of = lambda kind: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("kind") == kind, F.col("licenses"))))))
    out = hits.groupBy("doc_id", "_text").agg(
        F.max("n").cast("bigint").alias("n_lines"),
        F.sum(F.when(F.col("kind") == "line", 1).otherwise(0)).cast("bigint").alias("n_license_lines"),
        of("text").alias("text_licenses"),
        of("line").alias("line_licenses"),
        F.sum(F.when(F.col("kind") == "row", 1).otherwise(0)).cast("int").alias("_rows"),
    )
    out = out.withColumn("n_license_lines", (F.col("n_license_lines") / F.col("_rows")).cast("bigint"))
    out = out.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_rows"))))
    return out.select("doc_id", "n_lines", "n_license_lines", "text_licenses", "line_licenses")


def _sql_normal(column: str) -> str:
    out = f"regexp_replace(lower({column}), '{COPYRIGHT_LINE}', '', 'g')"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return rf"regexp_replace(regexp_replace({out}, '{NOT_LETTERS}', ' ', 'g'), ' ?\n ?', chr(10), 'g')"


_KNOWN = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in CATALOGUE)
SQL = rf"""
WITH k AS (SELECT sha256(trim(regexp_replace(t, '\n+', ' ', 'g'))) AS digest, license FROM (SELECT license, {_sql_normal("text")} AS t FROM (VALUES {_KNOWN}) v(license, text))),
d AS (SELECT row_number() OVER () AS n, doc_id, {_sql_normal("coalesce(text, '')")} AS t FROM documents),
l AS (SELECT n, doc_id, trim(regexp_replace(t, '\n+', ' ', 'g')) AS t, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM d),
u AS (SELECT n, 'line' AS kind, i, sha256(x) AS digest FROM (SELECT n, unnest(lines) AS x, unnest(range(len(lines))) AS i FROM l)
  UNION ALL SELECT n, 'text', 0, sha256(t) FROM l WHERE t <> ''),
h AS (SELECT n, kind, i, license FROM u JOIN k USING (digest)),
g AS (SELECT n, count(DISTINCT CASE WHEN kind = 'line' THEN i END) AS c, array_to_string(list_sort(list(DISTINCT license) FILTER (WHERE kind = 'text')), ',') AS text_ids,
  array_to_string(list_sort(list(DISTINCT license) FILTER (WHERE kind = 'line')), ',') AS line_ids FROM h GROUP BY n)
SELECT doc_id, len(lines)::BIGINT AS n_lines, coalesce(c, 0)::BIGINT AS n_license_lines, coalesce(text_ids, '') AS text_licenses, coalesce(line_ids, '') AS line_licenses
FROM l LEFT JOIN g USING (n)
"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look up every document and every line of it among the known licence texts."""
    out = scan(table(spark, sf_dir, "documents"), known_digests(spark))
    return out.withColumns({c: F.array_join(c, ",") for c in ("text_licenses", "line_licenses")})
