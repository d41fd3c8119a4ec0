"""Licence texts by canonical digest.

A text is brought to one form (case, copyright lines, equivalent spellings, punctuation,
white space), and the digest of the whole form is looked up among those of known licence
texts.  Two kinds of text are looked up: the whole document, and each of its lines, since
notices stand on lines of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Spellings that mean the same, as words of the canonical form, with two spaces between words.
SPELLINGS = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("copyrights", "copyright"), ("organisation", "organization"), ("favour", "favor"), ("https", "http"), ("merchantibility", "merchantability"), ("noncommercial", "non  commercial"), ("v2", "version  2"), ("v3", "version  3"), ("the", "")]
#: A line that only says who holds the copyright, and since when.
COPYRIGHT = r"(?m)^[ \t]*(?:copyright\b|\(c\)|©)[^\n]*"
#: What stands between words, line breaks apart.
BETWEEN = r"[^a-z0-9\n\p{L}\p{N}\p{M}]+"
#: Known digests up to this number are broadcast (60 bytes each); more are joined by a shuffle.
BROADCAST = 200_000

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

{more}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

#: (licence, known text): full texts of short licences, file headers and one-line notices.
KNOWN: list[tuple[str, str]] = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("BSD-2-Clause", _BSD2.format(more="")),
    ("BSD-3-Clause", _BSD2.format(more=_THIRD)),
    ("Zlib", _ZLIB),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", _GPL),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
]


#: (licence, digest of the canonical form) of the texts of long licences, as their publishers give them.
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "79dcd053122b6a384d991899cfeff71d"),
    ("Artistic-1.0-Perl", "f1bc1b69b34d3e6d04ab280b25280b5d"),
    ("CC0-1.0", "85b9fc191033cbf24d7942f5ed11fa53"),
    ("GFDL-1.2", "d35d680b01b818fd5b7f0e3f0631c430"),
    ("GFDL-1.3", "51639b875194f18a99cbf779dd7de555"),
    ("GPL-1.0", "3b2659fa1792c5274774c55153a6c835"),
    ("GPL-2.0", "a5d09c32bac04ee7d1b51823be3480de"),
    ("GPL-3.0", "3fd224aa0b77bddf813343721f3e517a"),
    ("LGPL-2.0", "699b498dba005aed7056d9ab5e36ed6e"),
    ("LGPL-2.1", "cf9fc208be0dd676a0a0b868934890fd"),
    ("LGPL-3.0", "5ea1be2e00890e15e83ba84c5d239237"),
    ("MPL-1.1", "1c327adb6d8603d39f271d629d954aae"),
    ("MPL-2.0", "86df599c1d8f67e6ba14c5abc31b69be"),
]


def canonical_lines(text: Column) -> Column:
    """The lines of a text, each in the form of texts that say the same: lower case words of any script, single spaces, no copyright lines.

    Words stand between spaces of their own until spellings are replaced, so that of two
    neighbours neither is missed.
    """
    t = F.regexp_replace(F.lower(text), COPYRIGHT, "")
    t = F.regexp_replace(t, BETWEEN, "  ")
    t = F.concat(F.lit(" "), F.replace(t, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for said, meant in SPELLINGS:
        t = F.replace(t, F.lit(f" {said} "), F.lit(f" {meant} " if meant else ""))
    return F.transform(F.split(F.replace(t, F.lit("  "), F.lit(" ")), "\n"), lambda x: F.trim(x))


def whole(lines: Column) -> Column:
    """The canonical form of the whole text from those of its lines."""
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def digests(spark: SparkSession, known: list[tuple[str, str]] | None = None, more: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license, digest) of known texts, and of further digests; a digest that two licences share is theirs both."""
    rows = spark.createDataFrame(KNOWN if known is None else known, "license string, text string")
    form = rows.select("license", whole(canonical_lines(F.col("text"))).alias("form")).where("form <> ''").select("license", F.md5("form").alias("digest"))
    given = (DIGESTS if known is None else []) if more is None else more
    return form.unionByName(spark.createDataFrame(given, "license string, digest string")).distinct()


def licensed(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, unit, line, license) of every document and every line that is a known licence text.

    ``unit`` is 'text' for the whole document, with line 0, or 'line', with its number
    from 1.  Null texts and texts or lines without a letter or digit match nothing.  Rows
    that repeat an id are looked up each; a document of one line may match as both.  Only
    digests are joined, so a very long text costs its own normalisation.  Other columns
    are left out.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    forms = rows.select("doc_id", canonical_lines(F.col("text")).alias("forms"))
    parts = forms.select("doc_id", F.posexplode(F.concat(F.array(whole(F.col("forms"))), F.col("forms"))).alias("line", "part")).where("part <> ''")
    looked = parts.select("doc_id", "line", F.md5("part").alias("digest"))
    unit = F.when(F.col("line") == 0, "text").otherwise("line")
    small = known.limit(BROADCAST + 1).count() <= BROADCAST
    return looked.join(F.broadcast(known) if small else known, "digest").select("doc_id", unit.alias("unit"), F.col("line").cast("int").alias("line"), "license")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and lines of the whole table that are known licence texts.

    Nulls, empty and long texts, repeated rows, empty tables and further columns are as
    in ``licensed``; a digest of several licences gives a row for each.
    """
    return licensed(table(spark, sf_dir, "documents"), digests(spark))


def _sql() -> str:
    def lines(x: str) -> str:
        t = f"regexp_replace(regexp_replace(lower({x}), '{COPYRIGHT}', '', 'g'), '{BETWEEN}', '  ', 'g')"
        t = f"' ' || replace({t}, chr(10), ' ' || chr(10) || ' ') || ' '"
        for said, meant in SPELLINGS:
            t = f"replace({t}, ' {said} ', '{f' {meant} ' if meant else ''}')"
        return f"list_transform(string_split(replace({t}, '  ', ' '), chr(10)), lambda x: trim(x))"

    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in KNOWN)
    given = ", ".join(f"({quoted(name)}, {quoted(d)})" for name, d in DIGESTS)
    join = "array_to_string(list_filter(forms, lambda x: x <> ''), ' ')"
    return f"""
WITH texts AS (SELECT license, {lines("text")} AS forms FROM (VALUES {known}) AS k(license, text)),
known AS (
  SELECT license, md5({join}) AS digest FROM texts WHERE {join} <> ''
  UNION SELECT license, digest FROM (VALUES {given}) AS g(license, digest)
),
docs AS (SELECT doc_id, {lines("text")} AS forms FROM documents WHERE text IS NOT NULL),
parts AS (
  SELECT doc_id, 'text' AS unit, 0 AS line, {join} AS part FROM docs
  UNION ALL
  SELECT doc_id, 'line' AS unit, i AS line, forms[i] AS part FROM (SELECT doc_id, forms, unnest(range(1, len(forms) + 1)) AS i FROM docs)
)
SELECT doc_id, unit, CAST(line AS INTEGER) AS line, license FROM parts JOIN known ON md5(part) = digest WHERE part <> ''
"""


OP8_SQL = _sql()
