"""Licence texts found by canonical digest.

A text is brought to a canonical form (letter case, punctuation, copyright claims, white space and
equivalent spellings aside) and its SHA-256 is looked up in the digests of known licence texts,
which are made canonical by the same expressions. Whole texts are compared: a text that contains
a licence among other words has another digest.

All of it is DataFrame functions; the table of digests has at most two rows for each text and tag
packed with the library (`license_texts`; a fixed number, under a thousand), so it is broadcast. Cases: null and empty texts, and texts of which nothing
is left, have the digest of the empty text and no licence; rows repeat as they are; an empty
table gives an empty one; other columns aren't looked at.
"""

from __future__ import annotations

from functools import cache
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that the licences' users write for one another.
SPELLINGS = [
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("favour", "favor"),
    ("noninfringement", "non infringement"),
    ("organisation", "organization"),
    ("programme", "program"),
    ("recognise", "recognize"),
    ("whilst", "while"),
]

# Texts of known licences.
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_MIT_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES '
    "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
LICENSES = {
    "0BSD": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_WARRANTY}",
    "BSD-2-Clause": _BSD_GRANT + _BSD_WARRANTY,
    "BSD-3-Clause": _BSD_GRANT + _BSD_NAMES + _BSD_WARRANTY,
    "ISC": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}",
    "MIT": f"{_MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_MIT_WARRANTY}",
    "MIT-0": f"{_MIT_GRANT}. {_MIT_WARRANTY}",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-4-Clause": (
        _BSD_GRANT + "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. "
        "4. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_WARRANTY.replace("HOLDERS AND CONTRIBUTORS", "HOLDER").replace("HOLDER OR CONTRIBUTORS", "HOLDER")
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, "
        "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: "
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
        "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. '
        "IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. "
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. "
        "For more information, please refer to <https://unlicense.org>"
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
    "MIT-notice": "SPDX-License-Identifier: MIT",
    "Apache-2.0-tag": "SPDX-License-Identifier: Apache-2.0",
}

#: What stands between words: all but letters and digits of any script.
OTHER = r"[^\p{L}\p{N}]+"

# Words that a grant, or what else comes behind a claim, begins with; abbreviations in holders' names.
GRANT = (
    r"(permission is (hereby )?granted|permission to use|this software is provided|redistributions? (and|of|in)|(licensed|released|distributed) under|(this|the) (work|software|program|library|file|source code|material)|this is free|everyone is permitted|"
    r"spdx-license-identifier|gnu (lesser |affero |library )?general public|apache license|mozilla public license|creative commons|(the )?(mit|isc) license|(the )?bsd [234]-clause|all rights reserved|you (may|can)|use of this)\b"
)
SHORT = r"(?<!\b(inc|ltd|llc|corp|dept|univ|assoc|bros|gmbh|est|etc))"
_MARK = r"(copyright ?(\(c\)|©|[0-9])|\(c\) ?[0-9]|©)"
#: Marker, years and holder: up to the words of a grant, a sentence's end (not an initial's or abbreviation's dot) or the line's.
_HOLDER = rf"{_MARK}[^\n]*?(?=[ .,;:]+{GRANT}|(?<=[a-z0-9)>]{{3}}){SHORT}\.[ \t]+[^ \t\n]|\n|$)"
#: A title stands before a line's end, a claim or a grant; other sentences that begin with it stay.
_TITLE = rf"(the )?(mit license|isc license|bsd [23]-clause license)\b( ?\([^)\n]*\))?( ?https?:[^ \n]*)?(?=[^a-z0-9(©\n]*(\n|$|{_MARK}|{GRANT}))"
#: The claims and titles that a line begins with; what stands behind them on the line stays.
CLAIM = rf"(^|\n)[^\na-z0-9(©]*(({_HOLDER}|all rights reserved|{_TITLE})[ \t.,;:]*)++"


def canonical(text: Column) -> Column:
    """Lower-case words of letters and digits, one blank before and after each."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(F.concat(F.lit("  "), F.regexp_replace(F.regexp_replace(plain, CLAIM, "\n"), OTHER, "  "), F.lit("  ")), "   +", "  ")
    for spelling, standard in SPELLINGS:
        out = F.replace(out, F.lit(f" {spelling} "), F.lit(f" {standard.replace(' ', '  ')} "))
    return out


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


@cache
def packed() -> dict[str, str]:
    """LICENSES, the texts of whole licences, and a tag of each SPDX id."""
    folder = files("panelflow.llm") / "license_texts"
    found = {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in folder.iterdir() if f.name.endswith(".txt") and f.name != "spdx_ids.txt"}
    tags = {f"{x}-tag": f"SPDX-License-Identifier: {x}" for x in (folder / "spdx_ids.txt").read_text("utf-8").split() if x not in ("MIT", "Apache-2.0")}
    return tags | found | LICENSES


def known(spark: SparkSession, licenses: dict[str, str] | None = None) -> DataFrame:
    """(license, known_digest) of each known text, as it stands and on one line; names of equal digests are joined by " | "."""
    texts = licenses or packed()
    forms = sorted({(name, form) for name, text in texts.items() for form in (text, " ".join(text.split()))})
    rows = spark.createDataFrame(forms, "license string, text string").select("license", digest(F.col("text")).alias("known_digest"))
    return rows.groupBy("known_digest").agg(F.concat_ws(" | ", F.array_sort(F.collect_set("license"))).alias("license")).select("license", "known_digest")


def scan(df: DataFrame, licenses: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, license): license is null where the digest isn't a known one."""
    rows = df.select(id_col, digest(F.col(text_col)).alias("digest"))
    return rows.join(F.broadcast(known(df.sparkSession, licenses)), F.col("digest") == F.col("known_digest"), "left").select(id_col, "digest", "license")


def canonical_sql(text: str) -> str:
    """DuckDB's form of canonical(). Its patterns can't look around, so places are marked first, by characters that no text keeps."""
    first = 0xE000
    mark, grant, short, end, stop, word, title, over = (chr(first + i) for i in range(8))
    marks = f"{mark}-{word}"
    titles = r"(mit license|isc license|bsd [23]-clause license)"
    named = rf"{titles}{word}( ?\([^)\n]*\))?( ?https?:[^ \n]*)?"
    abbreviations = SHORT.removeprefix("(?<!").removesuffix(")")
    steps = [
        (f"[{mark}-{over}]", chr(first + 16)),
        (rf"{abbreviations}\.", rf"\1{short}."),
        (r"([a-z0-9)>]{3})\.([ \t])", rf"\1{end}.\2"),
        (rf"{titles}\b", rf"\1{word}"),
        (f"({GRANT.replace('(the )?', '')})", rf"{grant}\1"),
        (f"the {grant}(mit|isc|bsd)", rf"{grant}the {grant}\1"),
        (f"({_MARK})", rf"{mark}\1"),
        (f"([ .,;:]+){grant}", rf"{stop}\1{grant}"),
        (rf"({named})([^a-z0-9(©\n]*(\n|$|{mark}|{grant}))", rf"{title}\1{over}\5"),
        (rf"(^|\n)[^\na-z0-9(©]*(([{marks}]*{_MARK}[^\n{end}{stop}]*|[{marks}]*all rights reserved|[{marks}]*(the[{marks}]* [{marks}]*)?{title}[^{over}]*{over})[ \t.,;:{marks}]*)+", "\n"),
        (f"[{mark}-{over}]", ""),
        (OTHER, "  "),
    ]
    out = f"lower(coalesce({text}, ''))"
    for pattern, by in steps:
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    out = f"regexp_replace('  ' || {out} || '  ', '   +', '  ', 'g')"
    for spelling, standard in SPELLINGS:
        out = f"replace({out}, ' {spelling} ', ' {standard.replace(' ', '  ')} ')"
    return out


def scan_sql(licenses: dict[str, str] | None = None) -> str:
    """All known texts as values, each as it stands and on one line."""
    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in sorted((licenses or packed()).items()))
    line = r"regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g')"
    return f"""
WITH listed(license, text) AS (VALUES {values}), forms AS (SELECT license, text FROM listed UNION SELECT license, {line} FROM listed),
known AS (SELECT known_digest, string_agg(DISTINCT license, ' | ' ORDER BY license) AS license FROM (SELECT license, sha256({canonical_sql('text')}) AS known_digest FROM forms) GROUP BY known_digest)
SELECT d.doc_id, d.digest, k.license
FROM (SELECT doc_id, sha256({canonical_sql('text')}) AS digest FROM documents) AS d LEFT JOIN known k ON d.digest = k.known_digest
"""
