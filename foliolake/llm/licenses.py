"""License scans by canonical digest lookup, with DataFrame functions only.

A text's canonical form has lower case, no copyright lines, one spelling for
words that licences spell in two ways, and no punctuation or repeated space.
The digest of a whole document's form, and of each line's, is looked up by hash
join among digests of known licences and notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Spellings that count as one (from, to), on lower-case text.
SPELLINGS = [
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sub-license", "sublicense"),
    ("non-infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("organisation", "organization"),
    ("authorised", "authorized"),
    ("&", " and "),
    ("https:", "http:"),
]
# Notices of one line, as (license, text).
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("GPL-3.0", "Released under the GNU General Public License v3.0."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3."),
    ("GPL-3.0", "Licensed under the GPL v3."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
]
# Whole licence texts, as (license, text).
TEXTS = [
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    (
        "ISC",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    (
        "0BSD",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    (
        "BSD-2-Clause",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    (
        "BSD-3-Clause",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>',
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
]
# Title lines that may stand before a whole text.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License"],
    "Zlib": ["zlib License"],
    "Unlicense": ["The Unlicense"],
}


#: Words after which "copyright" begins no statement but a sentence that is wrapped there.
SENTENCE = r"(?m)^([ \t]*)copyright([ \t]+(?:notices?|holders?|owners?|laws?|licenses?|and|or|in|interest|to)\b)"
#: Copyright statements: lines that begin with a copyright mark, with "All rights reserved" on the line after, dropped.
COPYRIGHT = r"(?m)^[ \t]*(?:copyright\b|\(c\)|©)[^\n]*(?:\n[ \t]*all rights reserved[.]?[ \t\r]*$)?"
#: What is no part of a word: ASCII other than letters, digits and line feeds, Latin-1 signs, general punctuation.
SIGNS = r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f\x{a0}-\x{bf}\x{2010}-\x{203a}]+"


def canonical_lines(text: Column) -> Column:
    """The canonical form, line feeds kept; no line begins or ends with a space."""
    out = F.regexp_replace(F.lower(text), SENTENCE, "$1\u0001$2")
    out = F.replace(F.regexp_replace(out, COPYRIGHT, ""), F.lit("\u0001"), F.lit("copyright"))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(out, SIGNS, " "), r" *\n *", "\n")


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(canonical_lines(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def catalogue() -> list[tuple[str, str]]:
    """(license, text) of all notices, and of whole texts without and with a title."""
    return NOTICES + TEXTS + [(n, f"{title}\n{t}") for n, t in TEXTS for title in TITLES.get(n, [])]


def known(spark: SparkSession, texts: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """(digest, license) of known texts, each as one line. texts: pairs, or a table (license, text) of any size."""
    digest = lambda t: F.md5(F.array_join(_lines(t), " "))
    if isinstance(texts, DataFrame):
        return texts.where(F.size(_lines(F.col("text"))) > 0).select(digest(F.col("text")).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))
    each = [F.struct(digest(F.lit(t)).alias("digest"), F.lit(n).alias("license")) for n, t in (catalogue() if texts is None else texts)]
    return spark.range(1).select(F.explode(F.array(*each)).alias("k")).groupBy("k.digest").agg(F.min("k.license").alias("license"))


def scan(docs: DataFrame, texts: list[tuple[str, str]] | None = None, text_col: str = "text", more: DataFrame | None = None) -> DataFrame:
    """docs with license (of the whole text, else null) and notices (licences of its lines, sorted, distinct).

    Columns of these names in docs are replaced; other columns, repeated rows
    and null ids stay as they are. A null, empty or blank text has neither; a
    text is read whole, whatever its length. The known digests of texts are a
    constant of a few dozen rows, so both look-ups run where the documents are:
    a broadcast hash join for whole texts, a map for lines. Nothing is shuffled,
    and a licence that a third of all rows hold is no hot key. more: a table
    (license, text) of further whole texts, such as spark.read.text(folder,
    wholetext=True) gives; Spark chooses its join by its size.
    """
    table = known(docs.sparkSession, texts)
    pairs = [(r.digest, r.license) for r in table.collect()]
    lines_of = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    out = docs.withColumn("__lines", _lines(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    out = out.withColumns({"__whole": F.when(F.size("__lines") > 0, F.md5(F.array_join("__lines", " "))), "notices": F.array_sort(F.array_distinct(F.filter(F.transform("__lines", lambda x: F.element_at(lines_of, F.md5(x))), lambda x: x.isNotNull())))})
    table = table.select(F.col("digest").alias("__digest"), "license")
    out = out.drop("license").join(F.broadcast(table), F.col("__whole") == F.col("__digest"), "left")
    if more is not None:
        further = known(docs.sparkSession, more).select(F.col("digest").alias("__further"), F.col("license").alias("__more"))
        out = out.join(further, F.col("__whole") == F.col("__further"), "left").withColumn("license", F.coalesce("license", "__more")).drop("__further", "__more")
    return out.drop("__lines", "__whole", "__digest")


def oracle_sql() -> str:
    """The same in DuckDB over documents."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def canonical(x: str) -> str:
        out = f"regexp_replace(lower({x}), {quote(SENTENCE)}, '\\1' || chr(1) || '\\2', 'g')"
        out = f"replace(regexp_replace({out}, {quote(COPYRIGHT)}, '', 'g'), chr(1), 'copyright')"
        for a, b in SPELLINGS:
            out = f"replace({out}, {quote(a)}, {quote(b)})"
        return f"list_filter(list_transform(string_split(regexp_replace({out}, {quote(SIGNS)}, ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"

    values = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in catalogue())
    return f"""
WITH known AS (SELECT md5(array_to_string({canonical("t")}, ' ')) AS digest, min(n) AS license FROM (VALUES {values}) v(n, t) GROUP BY 1),
d AS (SELECT doc_id, {canonical("coalesce(text, '')")} AS ls FROM documents),
n AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM (SELECT doc_id, unnest(ls) AS l FROM d) u JOIN known ON md5(l) = digest GROUP BY doc_id)
SELECT d.doc_id, k.license AS license, coalesce(n.notices, '') AS notices
FROM d LEFT JOIN known k ON len(ls) > 0 AND md5(array_to_string(ls, ' ')) = k.digest LEFT JOIN n ON n.doc_id = d.doc_id"""
