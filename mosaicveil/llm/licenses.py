"""Licence texts by canonical digest, in DataFrame functions only.

A text is brought to one canonical form: A-Z lower-cased, copyright lines dropped, equivalent spellings unified, every run of
other characters than letters and digits turned into one space, the ends trimmed. The SHA-256 of that form is looked up, by a hash
join, among the digests of known licence texts made in the same way. Whole documents are looked up; so is each line of a document
that mentions a licence, for notices such as "Released under the MIT License."

The table of known texts is a parameter. The default, KNOWN, is of fixed size and is broadcast; it holds MIT, ISC, 0BSD, BSD-2-Clause,
BSD-3-Clause and Zlib in full and, of the longer licences, headers and notices of one line only. A table of the caller's own
(license_id, text) may be of any size and is joined as Spark sees fit. Null and empty texts have the
digest of the empty form and match nothing; repeated ids are judged row by row; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
)
_MIT = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = '\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."
_APACHE_HEADER = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_GPL_HEADER = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."

#: Known licence texts and notices, by identifier.
KNOWN: list[tuple[str, str]] = [
    ("MIT", "The MIT License (MIT)\n\n" + _GRANT + _MIT),
    ("MIT", "MIT License\n\n" + _GRANT + _MIT),
    ("MIT", _GRANT + _MIT),
    ("ISC", "ISC License\n\n" + _ISC + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_END),
    ("ISC", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_END),
    ("0BSD", _ISC + "." + _ISC_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD + _BSD_END),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD + _BSD3 + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD3 + _BSD_END),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Zlib", _ZLIB),
    ("Apache-2.0", _APACHE_HEADER),
    ("GPL-3.0", _GPL_HEADER),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("proprietary", "All rights reserved."),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Line by line: a line that starts (after spaces and comment marks) with a copyright claim.
COPYRIGHT_LINE = r"(^|\n)[ \t#*/;-]*(copyright|\(c\)|©)[^\n]*"
#: Spellings held equivalent, each as (pattern, spelling), in this order, once the text is lower case.
EQUIVALENT = [("licen[cs]e", "license"), ("sub[- ]licen", "sublicen"), ("non[- ](commercial|infringement)", r"non\1"), ("per cent", "percent"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("organis(e|ation)", r"organiz\1"), ("merchantibility", "merchantability"), ("https?://", "")]
OTHER = "[^a-z0-9\u0080-\U0010ffff]+"


def canonical(text: str) -> str:
    """The canonical form in plain Python, for the table of known texts and for tests."""
    low = text.translate(str.maketrans(_UPPER, _LOWER))
    low = re.sub(COPYRIGHT_LINE, r"\1", low)
    for pattern, spelling in EQUIVALENT:
        low = re.sub(pattern, spelling, low)
    return re.sub(OTHER, " ", low).strip(" ")


def canonical_column(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    low = F.regexp_replace(low, COPYRIGHT_LINE, "$1")
    for pattern, spelling in EQUIVALENT:
        low = F.regexp_replace(low, pattern, spelling.replace("\\", "$"))
    return F.trim(F.regexp_replace(low, "[^a-z0-9\\x{80}-\\x{10FFFF}]+", " "))


def known_digests() -> list[tuple[str, str]]:
    """(digest, identifier) of the known texts."""
    return sorted({(hashlib.sha256(canonical(t).encode()).hexdigest(), i) for i, t in KNOWN if canonical(t)})


#: Lines that may be notices; what has none of these words is not looked up line by line.
GATE = "(?i)licen[cs]|released|reserved|mozilla"


def scan(spark: SparkSession, docs: DataFrame, known: DataFrame | None = None, gate: str = GATE) -> DataFrame:
    """doc_id, digest, license_id (of the whole text, else null; of several the smallest), notices (distinct licences of lines, sorted, else
    empty). known: (license_id, text) in place of KNOWN; gate: a pattern of the lines that are looked up, empty for every line."""
    if known is None:
        known = F.broadcast(spark.createDataFrame(known_digests(), "known string, license_id string"))
    else:
        own = known.select(F.sha2(canonical_column(F.col("text")), 256).alias("known"), "license_id", canonical_column(F.col("text")).alias("form"))
        known = own.where("form <> ''").groupBy("known").agg(F.min("license_id").alias("license_id"))
    rows = docs.select("doc_id", "text").withColumn("digest", F.sha2(canonical_column(F.col("text")), 256))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(gate)))
    rows = rows.join(known, F.col("digest") == F.col("known"), "left").drop("known", "text")
    # few rows have such lines; only those go through the second lookup
    plain = rows.where("lines is null or size(lines) = 0").select("doc_id", "digest", "license_id", F.lit("").alias("notices"))
    told = rows.where("size(lines) > 0").withColumn("row", F.monotonically_increasing_id())
    lines = told.select("row", "doc_id", "digest", "license_id", F.explode("lines").alias("line")).withColumn("line", F.sha2(canonical_column(F.col("line")), 256))
    lines = lines.join(known.withColumnRenamed("license_id", "notice"), F.col("line") == F.col("known"), "left")
    lines = lines.groupBy("row", "doc_id", "digest", "license_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("notice"))).alias("notices"))
    return plain.unionByName(lines.drop("row"))


def _duck(text: str) -> str:
    low = f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"
    for pattern, spelling in [(COPYRIGHT_LINE, r"\1"), *EQUIVALENT]:
        low = f"regexp_replace({low}, '{pattern}', '{spelling}', 'g')"
    return f"trim(regexp_replace({low}, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g'), ' ')"


def oracle() -> str:
    values = ", ".join(f"('{d}', '{i}')" for d, i in known_digests())
    return f"""
WITH known(digest, license_id) AS (VALUES {values}),
whole AS (SELECT row_number() OVER () AS r, doc_id, text, sha256({_duck("text")}) AS digest FROM documents),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM whole),
told AS (SELECT r, string_agg(DISTINCT k.license_id, ',' ORDER BY k.license_id) AS notices
         FROM lines JOIN known k ON sha256({_duck("line")}) = k.digest
         WHERE regexp_matches(line, '(?i)licen[cs]|released|reserved|mozilla') GROUP BY r)
SELECT w.doc_id, w.digest, k.license_id, coalesce(t.notices, '') AS notices
FROM whole w LEFT JOIN known k ON w.digest = k.digest LEFT JOIN told t ON w.r = t.r"""
