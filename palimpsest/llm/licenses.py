"""License scan by canonical digests.

A text is brought to a canonical form (case, copyright lines, equivalent spellings, punctuation,
white space) and the SHA-256 digest of the whole form is looked up among those of known licences. The
same is done for its units, that is its paragraphs and its lines, against the paragraphs of the known texts, so
that a licence or a notice that stands in a longer document is found as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import fresh

# Equivalent spellings, each mapped to the second of the pair.
SPELLINGS = [("licence", "license"), ("sublicence", "sublicense"), ("noncommercial", "non commercial"), ("acknowledgement", "acknowledgment"), ("copyright holder", "copyright owner"), ("organisation", "organization"), ("favour", "favor"), ("behaviour", "behavior"), ("https", "http")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Regular expressions that Java and RE2 read alike. A line that states a copyright, or reserves rights, goes.
COPYRIGHT = r"(^|\n)[ \t*#/;.>-]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
#: What parts paragraphs: a line of white space alone.
PARAGRAPH = r"\n[ \t\r\n]*\n"
OTHER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Texts of well-known public licences.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>""",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MPL-2.0 header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
}


def canonical(text: Column) -> Column:
    """Canonical form: ASCII letters lower-cased, copyright lines dropped, ASCII punctuation and white
    space squeezed to single blanks, spellings made equal. Null gives the empty form."""
    out = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    out = F.regexp_replace(out, COPYRIGHT, "\n")
    # Two blanks between words, so that each of two neighbours has its own.
    out = F.concat(F.lit(" "), F.regexp_replace(out, OTHER, "  "), F.lit(" "))
    for one, other in SPELLINGS:
        out = F.regexp_replace(out, f" {one.replace(' ', '  ')}(s?) ", f" {other.replace(' ', '  ')}$1 ")
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def canonical_sql(text: str) -> str:
    """The same form as DuckDB SQL."""
    out = f"regexp_replace(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{COPYRIGHT}', chr(10), 'g')"
    out = f"' ' || regexp_replace({out}, '{OTHER}', '  ', 'g') || ' '"
    for one, other in SPELLINGS:
        out = f"regexp_replace({out}, ' {one.replace(' ', '  ')}(s?) ', ' {other.replace(' ', '  ')}\\1 ', 'g')"
    return f"trim(replace({out}, '  ', ' '), ' ')"


def _units(text: Column) -> Column:
    """Digests of the canonical forms of a text's paragraphs and lines, those of the empty form left out."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    parts = F.array_distinct(F.concat(F.split(whole, PARAGRAPH), F.split(whole, "\n")))
    forms = F.filter(F.transform(parts, canonical), lambda x: x != "")
    return F.array_distinct(F.transform(forms, lambda x: F.sha2(x, 256)))


def known_licenses(spark, texts: dict[str, str] | None = None) -> DataFrame:
    """license_id, digest of each known text and units, the digests of its paragraphs; of licences that share a
    digest the first by name."""
    rows = spark.createDataFrame(list((KNOWN if texts is None else texts).items()), "license_id string, text string")
    units = F.array_distinct(F.filter(F.transform(F.split("text", PARAGRAPH), canonical), lambda x: x != ""))
    rows = rows.select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest"), F.transform(units, lambda x: F.sha2(x, 256)).alias("units"))
    return rows.groupBy("digest").agg(F.min(F.struct("license_id", "units")).alias("x")).select("x.license_id", "digest", "x.units")


def scan(docs: DataFrame, known: DataFrame | None = None, small: int = 10_000) -> DataFrame:
    """Add ``digest`` of the canonical whole text, ``license_id`` (null: none) and ``contained``, the sorted ids of the
    known licences of which every paragraph is a paragraph or line of the text, to the rows of ``docs``.

    Null, empty and all-punctuation texts have the empty form's digest and contain nothing; an empty table gives an empty
    result. Each row is looked up, also repeated ones and those without an id; every other column is kept, except that
    columns of those three names are replaced. A very long text is one row, and its units are exploded to rows.
    Both lookups are equi-joins on the digest. The known side is counted first and broadcast if it has ``small`` rows at
    most; otherwise both sides are shuffled, and a digest that very many rows share is split.
    """
    known = known_licenses(docs.sparkSession) if known is None else known
    few = known.limit(small + 1).count() <= small
    side = F.broadcast if few else lambda df: df.hint("merge")
    whole = side(known.select("digest", "license_id").dropDuplicates(["digest"]))
    rows = docs.drop("digest", "license_id", "contained")
    # What a text contains is joined back by the digest of the text as it is, so it does not matter how rows are dealt.
    key = fresh(rows, "_key")
    rows = rows.withColumn(key, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    parts = known.select("license_id", F.size("units").alias("parts"), F.explode("units").alias("unit"))
    met = rows.select(key, F.explode(_units(F.col("text"))).alias("unit")).join(side(parts), "unit").distinct()
    held = met.groupBy(key, "license_id").agg(F.count("*").alias("n"), F.max("parts").alias("parts")).where("n = parts")
    contained = held.groupBy(key).agg(F.array_sort(F.collect_list("license_id")).alias("contained"))
    out = rows.withColumn("digest", F.sha2(canonical(F.col("text")), 256)).join(whole, "digest", "left").join(contained, key, "left")
    return out.withColumn("contained", F.coalesce("contained", F.array().cast("array<string>"))).drop(key)
