"""License scans by canonical digest, in DataFrame functions alone.

A text is brought to a canonical form: lower case (A-Z), copyright notices dropped,
spellings made equal, everything but letters and digits a single space.  The SHA-256 of
the form is hash-joined to the digests of known licences.  Two things are looked up:
whole documents, against licence texts; and each line, whole, against licence notices.

Null and empty texts have the digest of the empty form and match nothing.  Documents
with equal ids share their notices.  A document without an id is matched like any
other.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What may stand before a copyright notice on its line.
_LEAD = r"^[ \t#*/;-]*"
#: Words that go on in a licence's own sentence after "copyright" at the start of a line.
BODY = "notices?|holders?|owners?|licen[cs]es?|laws?|statements?|statutes?|treat(?:y|ies)|protection|interests?|rights?|disclaimers?|permissions?|and|or|in|of|to|for|on|under|is|are|as|at|with|from|that|which|this|if|may|shall|will|must|can|not|does|do|applies|apply|has|have|permits?|messages?|information|status|infringement|works?|material"
#: A licence's own line that begins with the word; it gets a mark in front, so that it is not taken for a notice.
#: The mark is no letter or digit, so the canonical form does not have it.
OWN = _LEAD[0] + "(" + _LEAD[1:] + r")(copyright(?::[ \t]*|[ \t]+)(?:" + BODY + r")(?:[ \t\r\n.,;:)]|$))"
MARK = "\x02"
#: A copyright notice: the word with a sign, a year or a holder, the sign, or "(c)" with the word, a year or a reservation.
NOTICE = _LEAD + r"(?:©|\(c\)[ \t]*copyright|\(c\)[^\n]*(?:(?:19|20)[0-9][0-9]|all rights reserved)|copyright[ \t:]*(?:\(c\)|©|[0-9][0-9][0-9][0-9])|copyright(?::[ \t]*|[ \t]+)[^ \t\r\n.,;:)\"'(])[^\n]*"
#: Lines are looked at for notices only in texts with one of these.
CUES = ("copyright", "(c)", "©")
OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Spellings that count as equal.
SPELLINGS = (("licence", "license"), ("sub license", "sublicense"), ("organisation", "organization"), ("authoris", "authoriz"), ("favour", "favor"), ("merchantibility", "merchantability"), ("non commercial", "noncommercial"), ("http www", "https www"), ("per cent", "percent"), ("whilst", "while"))

#: Licences and notices as their owners publish them.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

""" + BSD_END
BSD_3 = BSD_2.replace(BSD_END, "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n") + BSD_END
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>"""
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
KNOWN: list[tuple[str, str, str]] = [
    ("MIT", "text", MIT),
    ("MIT", "text", "MIT License\n\n" + MIT),
    ("MIT", "text", "The MIT License (MIT)\n\n" + MIT),
    ("MIT", "text", "The MIT License\n\n" + MIT),
    ("ISC", "text", ISC),
    ("ISC", "text", "ISC License\n\n" + ISC),
    ("BSD-2-Clause", "text", BSD_2),
    ("BSD-2-Clause", "text", "BSD 2-Clause License\n\n" + BSD_2),
    ("BSD-3-Clause", "text", BSD_3),
    ("BSD-3-Clause", "text", "BSD 3-Clause License\n\n" + BSD_3),
    ("Zlib", "text", ZLIB),
    ("Zlib", "text", "zlib License\n\n" + ZLIB),
    ("Unlicense", "text", UNLICENSE),
    ("Unlicense", "text", UNLICENSE.replace("https", "http")),
    ("BSL-1.0", "text", BOOST),
    ("BSL-1.0", "text", "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + BOOST),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("MIT", "notice", "This project is licensed under the MIT License."),
    ("MIT", "notice", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "notice", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "notice", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "notice", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "notice", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "notice", "This work is licensed under CC BY 4.0."),
    ("CC0-1.0", "notice", "Released under CC0 1.0."),
]

#: SHA-256 of the canonical forms of longer licences, whole texts as their stewards publish them.
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "ef9aa6097e8b8724e8bedf9a9a264cbc3142b55ef97f3c3f079b7aa1aeac425c"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
]


def canonical(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    cued = F.lit(False)
    for cue in CUES:
        cued = cued | F.contains(low, F.lit(cue))
    # (?d): a line ends at a line feed alone
    x = F.when(cued, F.regexp_replace(F.regexp_replace(low, "(?dm)" + OWN, f"$1{MARK}$2"), "(?dm)" + NOTICE, "")).otherwise(low)
    x = F.trim(F.regexp_replace(x, OTHER, " "))
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def canonical_text(text: str) -> str:
    """The same for one text, for the table of known digests in SQL."""
    x = re.sub("(?m)" + OWN, rf"\1{MARK}\2", "".join(c.lower() if c in UPPER else c for c in text))
    x = re.sub("(?m)" + NOTICE, "", x)
    x = re.sub(OTHER, " ", x).strip(" ")
    for a, b in SPELLINGS:
        x = x.replace(a, b)
    return x


def known(spark: SparkSession, licenses: list[tuple[str, str, str]] = KNOWN, digests: list[tuple[str, str]] = DIGESTS) -> DataFrame:
    """(license, kind, digest), a row for each digest and kind; of several licences with one digest the first by name."""
    rows = spark.createDataFrame(licenses, "license string, kind string, text string").select("license", "kind", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    more = spark.createDataFrame(digests, "license string, digest string").select("license", F.lit("text").alias("kind"), "digest")
    return rows.unionByName(more).groupBy("kind", "digest").agg(F.min("license").alias("license"))


def scan(documents: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """(doc_id, canonical_sha256, license, notices): the licence that the whole text is, and those that lines of it name.

    ``table`` is the size of the list of known licences, not of the documents; Spark decides whether to broadcast it by its size."""
    table = known(documents.sparkSession) if table is None else table
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = table.filter("kind = 'text'").select(F.col("digest").alias("canonical_sha256"), "license")
    whole = rows.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256")).join(texts, "canonical_sha256", "left")
    lines = rows.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.sha2(canonical(F.col("line")), 256).alias("digest"))
    named = lines.join(table.filter("kind = 'notice'").select("digest", F.col("license").alias("notice")), "digest").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("notice")), ",").alias("notices"))
    named = named.withColumnRenamed("doc_id", "named_id")
    return whole.join(named, whole.doc_id.eqNullSafe(named.named_id), "left").select("doc_id", "canonical_sha256", "license", F.coalesce("notices", F.lit("")).alias("notices"))


def oracle_sql() -> str:
    quoted = lambda x: x.replace("'", "''")
    low = lambda c: f"translate(coalesce({c}, ''), '{UPPER}', '{LOWER}')"
    form = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace({low(c)}, '(?m){quoted(OWN)}', '\\1' || chr({ord(MARK)}) || '\\2', 'g'), '(?m){quoted(NOTICE)}', '', 'g'), '{OTHER}', ' ', 'g'), ' ')"

    def spelled(c: str) -> str:
        x = form(c)
        for a, b in SPELLINGS:
            x = f"replace({x}, '{a}', '{b}')"
        return x

    digests = {}
    for name, kind, digest in [(n, k, hashlib.sha256(canonical_text(t).encode()).hexdigest()) for n, k, t in KNOWN] + [(n, "text", d) for n, d in DIGESTS]:
        digests[kind, digest] = min(name, digests.get((kind, digest), name))
    values = ", ".join(f"('{k}', '{d}', '{n}')" for (k, d), n in digests.items())
    return f"""
WITH known(kind, digest, license) AS (VALUES {values}),
d AS (SELECT doc_id, text, sha256({spelled('text')}) AS canonical_sha256 FROM documents),
l AS (SELECT doc_id, sha256({spelled('line')}) AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
n AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM l JOIN known USING (digest) WHERE kind = 'notice' GROUP BY doc_id)
SELECT d.doc_id, canonical_sha256, license, coalesce(notices, '') AS notices
FROM d LEFT JOIN (SELECT * FROM known WHERE kind = 'text') k ON d.canonical_sha256 = k.digest LEFT JOIN n ON d.doc_id IS NOT DISTINCT FROM n.doc_id"""
