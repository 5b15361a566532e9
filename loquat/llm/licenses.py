"""License scans [native]: canonical digest lookup.

A text is brought to a canonical form (lower case; lines that state a copyright dropped; equivalent spellings
made one; every run of other marks than letters and digits one blank) and the SHA-256 of the *entire* form is
joined with the digests of known licence texts. The whole document is looked up, and so is each of its lines, as
short notices stand on a line of their own.

Everything is DataFrame operations. A line is only brought to its form if it holds the longest word of a known form
(in any spelling), without which it cannot be equal to one. The known digests are broadcast only if counted to be few.

Known are the texts below and, by the digests of their published texts alone, longer ones; a text is found if it is the
whole licence and nothing else, apart from copyright lines. Lines that state a copyright begin with the word and its
sign, or with one of them and name a year.

Defined cases: null text has no digest and no licence; a text whose form is empty has none either; rows that
repeat, or have no id, are each judged; ids are of any type; of known texts with equal forms the smallest name is given;
an empty table gives no row; a very long text is one row's work and is never split; columns other than id and text are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, bounded, table

# Public licence texts and the usual one-line notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {holder} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_THIRD = "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
KNOWN = [
    ("BSD-2-Clause", _BSD.format(third="", holder="HOLDER")),
    ("BSD-2-Clause", _BSD.format(third="", holder="HOLDERS")),
    ("BSD-3-Clause", _BSD.format(third=_THIRD, holder="HOLDER")),
    ("BSD-3-Clause", _BSD.format(third=_THIRD, holder="HOLDERS")),
    ("Unlicense", _UNLICENSE),
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("all-rights-reserved", "All rights reserved."),
]
# SHA-256 of the canonical form of the full texts of public licences, as they are published.
DIGESTS = [
    ("Apache-2.0", "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
]
# Spellings that count as equal.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("authorisation", "authorization"), ("authorised", "authorized"), ("noninfringement", "non infringement"), ("whilst", "while"), ("favour", "favor"), ("behaviour", "behavior"), ("organisation", "organization"), ("per cent", "percent"), ("https", "http")]
#: Distinct keys up to which lines are tested for them.
KEYS = 64
# A line that states a copyright: the word and its sign, or one of them and a year.
_COPYRIGHT = r"(?m)^[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©)[^\n]*|(copyright( notice)?\b|\(c\)|©)[^\n]*[0-9]{4}[^\n]*)$"
_MARKS = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    low = F.lower(text)
    marked = low.contains("copyright") | low.contains("(c)") | low.contains("©")
    out = F.when(marked, F.regexp_replace(low, _COPYRIGHT, " ")).otherwise(low)
    out = F.regexp_replace(out, _MARKS, " ")
    out = F.replace(F.concat(F.lit(" "), out, F.lit(" ")), F.lit(" "), F.lit("  "))  # each word has blanks of its own
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(" " + old.replace(" ", "  ") + " "), F.lit(" " + new.replace(" ", "  ") + " "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    form = canonical(text)
    return F.when(form != "", F.sha2(form.cast("binary"), 256))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license, key): the key is the longest word of the form."""
    df = spark.createDataFrame(known if known is not None else KNOWN, "license string, text string")
    form = canonical(F.col("text"))
    key = F.element_at(F.array_sort(F.transform(F.split(form, " "), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"]
    df = df.select("license", digest(F.col("text")).alias("digest"), key.alias("key")).filter("digest is not null")
    if known is None:
        df = df.unionByName(spark.createDataFrame([(*r, "license") for r in DIGESTS], "license string, digest string, key string"))
    return df.groupBy("digest").agg(F.min("license").alias("license"), F.min("key").alias("key"))


def _may_match(line: Column, keys: list[str]) -> Column:
    """Whether a line holds one of the keys, or a spelling that becomes one; with very many keys, always."""
    if len(keys) > KEYS:
        return F.lit(True)
    wanted = {*keys, *(old.split(" ")[0] for old, new in SPELLINGS if {*new.split(" ")} & {*keys})}
    low, out = F.lower(line), F.lit(False)
    for word in sorted(wanted):
        out |= low.contains(word)
    return out


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, digest, license (of the whole text or null), notices (licences of its lines, sorted)."""
    stage = Stage(docs.sparkSession, "licenses")
    known = stage.write(known, "known")
    keys = [r.key for r in known.select("key").distinct().limit(KEYS + 1).collect()]
    known = bounded(known.select("digest", "license"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lines = rows.select(F.xxhash64("text").alias("key"), F.explode(F.filter(F.split("text", "\n"), lambda line: _may_match(line, keys))).alias("line"))
    found = lines.select("key", digest(F.col("line")).alias("digest")).join(known, "digest").groupBy("key").agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices"))
    found = stage.write(found, "notices")
    whole = rows.select("doc_id", F.xxhash64("text").alias("key"), digest(F.col("text")).alias("digest")).join(known, "digest", "left")
    return whole.join(bounded(found), "key", "left").select("doc_id", "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), known_digests(spark))


def _form_sql(text: str) -> str:
    """Line by line and word by word, apart from the Column expressions."""
    states = "regexp_matches(l, '^[^a-z0-9]*copyright[ \\t]*([(]c[)]|©)') OR regexp_matches(l, '^[^a-z0-9]*(copyright( notice)?\\b|[(]c[)]|©).*[0-9]{4}')"
    lines = f"array_to_string(list_filter(string_split(lower({text}), chr(10)), lambda l: NOT ({states})), chr(10))"
    words = f"list_filter(string_split_regex({lines}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    single = " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in SPELLINGS if " " not in old)
    one = f"array_to_string(list_transform({words}, lambda w: CASE w {single} ELSE w END), '  ')"
    return f"trim(replace(replace(' ' || {one} || ' ', ' per  cent ', ' percent '), '  ', ' '))"


SQL = f"""
WITH known AS (
  SELECT digest, min(license) AS license FROM (
    SELECT sha256(form) AS digest, license
    FROM (SELECT license, {_form_sql("text")} AS form FROM (VALUES {", ".join("('" + a + "', '" + b.replace("'", "''") + "')" for a, b in KNOWN)}) AS v(license, text)) WHERE form <> ''
    UNION ALL SELECT * FROM (VALUES {", ".join(f"('{d}', '{name}')" for name, d in DIGESTS)}) AS d(digest, license)) GROUP BY 1
), whole AS (
  SELECT doc_id, CASE WHEN form <> '' THEN sha256(form) END AS digest FROM (SELECT doc_id, {_form_sql("text")} AS form FROM documents)
), lines AS (
  SELECT doc_id, {_form_sql("line")} AS form FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
), notices AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM lines JOIN known ON sha256(form) = known.digest WHERE form <> '' GROUP BY doc_id
)
SELECT w.doc_id, w.digest, k.license, coalesce(n.notices, '') AS notices FROM whole w LEFT JOIN known k ON w.digest = k.digest LEFT JOIN notices n ON w.doc_id = n.doc_id
"""
