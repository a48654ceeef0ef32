"""Operator 1: license scan by canonical digest.

A text is normalised (case, copyright lines, equivalent spellings, punctuation, white space) and
its SHA-256 looked up among the digests of known licence texts, normalised alike. Only built-in
functions run on documents; every pattern means the same to Java's and RE2's engines, so the
query has an SQL form. Letters and digits of all scripts stay, so that a rider in any of them
makes another text of a licence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of the normalisation in order: (pattern, replacement). Input is lower case.
STEPS = (
    ("[‘’“”\"'`«»]+", ""),  # quotation marks
    (
        "(?m)^[ \t*#/;-]*((copyright[ \t:]*(\\(c\\)|©|[\\[<{]?([0-9]{4}|year|yyyy))|copyright by |©|\\(c\\)[ \t]*[0-9]{4})[^\n]*"
        "|copyright( [^ \n]+){1,5} (authors|contributors|developers|foundation|project|team|inc|llc|ltd)[ \t.]*|all rights reserved[ \t.]*)$",
        "\n",
    ),  # notices, not lines of prose that wrapping starts with these words
    ("https?://", ""),
    ("&", " and "),
    ("\\b(licence)", "license"),
    ("\\b(sub)[- ](licen)", "sublicen"),
    ("\\b(non)[- ](infring|commercial)", "non$2"),
    ("\\b(favour)", "favor"),
    ("\\b(organis)", "organiz"),
    ("\\b(merchantib)", "merchantab"),
    ("\\b(version |v\\.?[ \t\n]*)([0-9])", "version $2"),
    ("[^\\p{L}\\p{M}\\p{N}]+", " "),  # punctuation, bullets and white space
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{kept}

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{names}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"

#: Known licence texts and notices: fixed values from the public licences.
KNOWN = {
    "0BSD": _ISC.format(kept="."),
    "Apache-2.0 notice": _APACHE,
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": _ISC.format(kept=", provided that the above copyright notice and this permission notice appear in all copies."),
    "MIT": _MIT,
    "MIT titled": "MIT License\n\n" + _MIT,
    "MIT line": "Released under the MIT License.",
    "Zlib": _ZLIB,
}

#: More whole texts.
FULL = {"BSD-2-Clause": _BSD.format(names=""), "BSD-3-Clause": _BSD.format(names=_NAMES)}
#: Digests of whole licences (the files of /usr/share/common-licenses, notices and appendices included).
DIGESTS = {
    "Apache-2.0": "2b05caf1be32f3ec76310918bef57fbcf0ef442ba1569e72494a754885873254",
    "Artistic-1.0-Perl": "e8b78262a838b2b19fcf6d45caae5ba4d7f93e5ed04dfe3c29f9d73d2c7a4e45",
    "BSD-3-Clause Regents": "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651",
    "CC0-1.0": "42e5c3e2dc951231f2f015709c4dce5e7c7b5cec0527b379b23e49bfafea1472",
    "GFDL-1.2": "3297b97ff6589a48f16176bb6a822884cf4f9193b51eb7cc46fa73fbda9d2249",
    "GFDL-1.3": "1e3a0e25ffeabb24a8c86c75d0149e428e525f494e2fe77daecbbd2d4b89103c",
    "GPL-1.0": "6a989e9e3800b7bc5300e632e9306911e14a7f4e0fddaae76ec5fb86a5b72225",
    "GPL-2.0": "852dfae4a45171f05a0954d9a132503513f97774e4fddc650064b0262b771170",
    "GPL-3.0": "20eb1f1a827f1427b349a911c6469e73ec0a37bef1069056ff07ce1f6803a946",
    "LGPL-2.0": "e6b557c836da67fa721172bd7f54e0cad02c6ffe1621ad4fd1d2823a1ed0cd29",
    "LGPL-2.1": "73f8771023a7bd97f99604cee25be5ea96b506e8a15023953726f00bcf5e8cf9",
    "LGPL-3.0": "91b5d3e9e307d305f7c91670699dcefa38a95bc0127f171027869fadcae9f986",
    "MPL-1.1": "ee33d6ea9be1711475c83a2f2c6a256c0eb791afe9f754638c0fc4ce0fafa111",
    "MPL-2.0": "e02c8531cfcb54c24d7713d3294c0f466e41c87210e8b8eca8d813d1f4056a23",
}


def canonical(text: Column) -> Column:
    """A text normalised; null reads as empty."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, to in STEPS:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def scan(docs: DataFrame, known: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, canonical_sha256, canonical_chars, license_id (null: none known) for each row of docs.

    A null, empty or all-punctuation text has the digest of the empty string and no licence; of
    known texts that normalise alike the first name stands. Repeated rows give repeated rows,
    other columns are not read, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame(sorted((KNOWN | FULL if known is None else known).items()), "license_id string, known_text string")
    whole = spark.createDataFrame(sorted(DIGESTS.items()) if known is None else [], "license_id string, canonical_sha256 string")
    # One row for each known licence: as small as the list given, whatever the corpus.
    digests = table.select("license_id", F.sha2(canonical(F.col("known_text")), 256).alias("canonical_sha256")).unionByName(whole).filter(F.col("canonical_sha256") != F.sha2(F.lit(""), 256)).groupBy("canonical_sha256").agg(F.min("license_id").alias("license_id"))
    rows = docs.select(F.col(id_col).alias("doc_id"), canonical(F.col(text_col)).alias("_c"))
    rows = rows.select("doc_id", F.sha2("_c", 256).alias("canonical_sha256"), F.length("_c").cast("long").alias("canonical_chars"))
    return rows.join(F.broadcast(digests), "canonical_sha256", "left").select("doc_id", "canonical_sha256", "canonical_chars", "license_id")


def scan_sql(known: dict[str, str] | None = None) -> str:
    """The query as DuckDB SQL."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def form(column: str) -> str:
        out = f"lower(coalesce({column}, ''))"
        for pattern, to in STEPS:
            out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(to.replace('$2', chr(92) + '2'))}, 'g')"
        return f"trim({out})"

    values = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted((KNOWN | FULL if known is None else known).items()))
    whole = " ".join(f"UNION ALL SELECT {quoted(v)}, {quoted(k)}" for k, v in sorted(DIGESTS.items())) if known is None else ""
    return f"""
WITH known(license_id, known_text) AS (VALUES {values}),
digests AS (SELECT canonical_sha256, min(license_id) AS license_id FROM
  (SELECT sha256({form("known_text")}) AS canonical_sha256, license_id FROM known WHERE {form("known_text")} <> '' {whole}) GROUP BY 1),
canon AS (SELECT doc_id, {form("text")} AS c FROM documents)
SELECT doc_id, sha256(c) AS canonical_sha256, CAST(length(c) AS BIGINT) AS canonical_chars, license_id
FROM canon LEFT JOIN digests ON sha256(c) = canonical_sha256"""
