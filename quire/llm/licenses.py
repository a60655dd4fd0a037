"""Licence scans by canonical digests: entire texts are normalised and hash-joined to those of known licences.

Normalising folds case, punctuation, white space and equivalent spellings, and drops copyright lines, so that copies
of one licence with other years, holders, quotes or line breaks have one digest. A copyright line begins with the word or
its sign and goes on with a sign, a year or a place for one: a line that a sentence's "copyright holders" happens to begin
stays. A text is looked up whole, and each of its lines and of its paragraphs (parted by lines without a letter or digit)
as an entire text of its own, since documents often carry a notice inside. Parts meet the known digests in a hash join.

Known are the texts and notices in KNOWN, with and without their titles, and the full texts whose digests are in FULL. A
folder of more texts, named by their licences, can be given (``known_texts``, ``known_licenses``); none is looked for.

Defined results: a null or empty text, or one of nothing but copyright lines, matches nothing (its digest is that of
the empty text); repeated rows repeat; two names of one digest give the smaller; an empty table gives an empty
result; extra columns are not looked at.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import text_of

#: Equivalent spellings, as regular expression and what it becomes (after lower-casing).
SPELLINGS = [
    ("licence", "license"),
    ("sub-\\s*license", "sublicense"),
    ("non-\\s*commercial", "noncommercial"),
    ("per\\s+cent", "percent"),
    ("https:", "http:"),
    ("(\\(c\\)|©)", "copyright"),
]
#: Texts of known licences and of the notices by which works name them.
KNOWN = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
]


#: Title lines that stand over these texts, or do not.
TITLES = {"MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License"], "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"], "Zlib": ["zlib License"]}
#: Names of Debian's files by the licences that they hold.
FILES = {"BSD": "BSD-3-Clause-UC", "Artistic": "Artistic-1.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-3": "LGPL-3.0"}
#: Digests of full texts as Debian distributes them, and the sizes of their canonical forms.
FULL: list[tuple[str, str, int]] = [
    ("Apache-2.0", "e54d72b4475d38e8ac691465cfb3533349778f63a32af127056c574c123b5dcf", 9890),
    ("Artistic-1.0", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702", 5833),
    ("BSD-3-Clause-UC", "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9", 1381),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", 6692),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60", 19583),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826", 22018),
    ("GPL-1.0", "490a17f9c44b8e7737e6d5b52eebf4c3610f67ee98c4ad515329fa012eebe42d", 11773),
    ("GPL-2.0", "2d0b5e012e036a2690fe078a56f4c6dabcb7e2c352ef799e5e2074dab15ef4ae", 17125),
    ("GPL-3.0", "d83c17395c9a12cd395b7344eeb0d7e93e4ce5c7e6565e5590ba6d2df2f9e9e1", 33414),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908", 24130),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", 25217),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", 7104),
    ("MPL-1.1", "f1daf3234686278093cf1137babd0598754ada714f0fc44e06e080008f7c6b38", 22499),
    ("MPL-2.0", "797da5d4e9dafcb728632460f1b236d20d0aa8b1f838aa5911bd9f74276d611e", 14349),
]
#: Fixed value: the beginning of a copyright line, in lower case.
STATEMENT = r"[ \t*#/;-]*(?:(?:copyright|\(c\)|©)[ \t]*(?:copyright|\(c\)|©|[0-9]{4}|\[yyyy\]|\[year\]|<year>)|©)"


def known_texts(folder: str | None = None) -> list[tuple[str, str]]:
    """license_id and text of what is known, and of the files of a folder if given, read by the driver."""
    found = [*KNOWN, *((name, f"{title}\n{text}") for name, text in KNOWN if len(text) > 500 for title in TITLES.get(name, []))]
    for name in sorted(os.listdir(folder)) if folder else []:
        path = os.path.join(folder, name)
        if os.path.isfile(path) and not os.path.islink(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                found.append((FILES.get(name, name), f.read()))
    return found


def folded(text: Column) -> Column:
    """Lower case, copyright lines out, spellings folded, and all that is no letter, digit or line break one space."""
    t = F.regexp_replace(F.lower(text), rf"(?m)^{STATEMENT}[^\n]*$", " ")
    for pattern, to in SPELLINGS:
        t = F.regexp_replace(t, pattern, to)
    return F.regexp_replace(t, r"[^\p{L}\p{N}\n]+", " ")


def canonical(fold: Column) -> Column:
    """The normalised text of a folded one: words with one space between."""
    return F.trim(F.regexp_replace(fold, "[ \n]+", " "))


def known_licenses(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """license_id, digest and size (of the canonical text), one row a digest: of the texts given, else of all that is known."""
    rows = spark.createDataFrame(known if known is not None else known_texts(), "license_id string, text string")
    rows = rows.select("license_id", canonical(folded(F.col("text"))).alias("t"))
    rows = rows.select("license_id", F.sha2("t", 256).alias("digest"), F.length("t").alias("size"))
    if known is None and FULL:
        rows = rows.unionByName(spark.createDataFrame(FULL, "license_id string, digest string, size int"))
    return rows.groupBy("digest", "size").agg(F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, known: DataFrame | None = None, few: int = 10_000) -> DataFrame:
    """doc_id, digest (of the whole text), license_id (whose entire text this is), line_licenses (names whose text or
    notice is a line or paragraph of it, sorted, joined by commas; '' for none).

    Only parts as long as a known text go on to the join, which is a broadcast one for up to ``few`` known licences.
    """
    known = known if known is not None else known_licenses(docs.sparkSession)
    sizes = [r["size"] for r in known.select("size").distinct().collect()]  # as many as licences are known
    known = known.select(F.col("digest").alias("of"), "license_id")
    known = F.broadcast(known) if known.count() <= few else known
    rows = text_of(docs).select("doc_id", F.monotonically_increasing_id().alias("row"), folded(F.col("text")).alias("f"))
    parts = F.concat(F.split("f", "\n"), F.split("f", "\n(?: ?\n)+"))
    held = F.filter(F.transform(parts, canonical), lambda x: F.length(x).isin(sizes))
    digest = F.sha2(canonical(F.col("f")), 256).alias("digest")
    rows = rows.select("row", "doc_id", digest, F.transform(F.array_distinct(held), lambda x: F.sha2(x, 256)).alias("parts"))
    ofs = F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.col("digest").alias("of"))), F.transform("parts", lambda x: F.struct(F.lit(False).alias("whole"), x.alias("of"))))
    found = rows.select("row", "doc_id", "digest", F.inline(ofs)).join(known, "of", "left")
    # A row whose parts match nothing comes back as it went: one row, its whole text.
    found = found.filter(F.col("whole") | F.col("license_id").isNotNull())
    name = F.max(F.when(F.col("whole"), F.col("license_id"))).alias("license_id")
    names = F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license_id")))), ",").alias("line_licenses")
    return found.groupBy("row", "doc_id", "digest").agg(name, names).drop("row")


def _sql_folded(text: str) -> str:
    t = rf"regexp_replace(lower({text}), '(?m)^{STATEMENT}[^\n]*$', ' ', 'g')"
    for pattern, to in SPELLINGS:
        t = f"regexp_replace({t}, '{pattern}', '{to}', 'g')"
    return rf"regexp_replace({t}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"


def _sql_canonical(fold: str) -> str:
    return rf"trim(regexp_replace({fold}, '[ \n]+', ' ', 'g'))"


def license_sql() -> str:
    known = ", ".join("('" + a + "', '" + b.replace("'", "''") + "')" for a, b in known_texts())
    full = ", ".join(f"('{a}', '{b}')" for a, b, _ in FULL)
    return rf"""
WITH known_text(license_id, text) AS (VALUES {known}),
full_text(license_id, digest) AS (VALUES {full}),
every AS (SELECT license_id, sha256({_sql_canonical(_sql_folded('text'))}) AS digest FROM known_text UNION ALL FROM full_text),
known AS (SELECT digest, min(license_id) AS license_id FROM every GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, {_sql_folded("coalesce(text, '')")} AS f FROM documents),
w AS (SELECT r, doc_id, sha256({_sql_canonical('f')}) AS digest FROM d),
p AS (SELECT r, unnest(list_concat(string_split(f, chr(10)), regexp_split_to_array(f, '
(?: ?
)+'))) AS part FROM d),
n AS (SELECT p.r, string_agg(DISTINCT k.license_id, ',' ORDER BY k.license_id) AS line_licenses FROM p JOIN known k ON sha256({_sql_canonical('p.part')}) = k.digest GROUP BY p.r)
SELECT w.doc_id, w.digest, k.license_id, coalesce(n.line_licenses, '') AS line_licenses
FROM w LEFT JOIN known k ON w.digest = k.digest LEFT JOIN n ON n.r = w.r
"""
