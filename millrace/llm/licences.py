"""Licence scans: whole texts that are a known licence, by the digest of a canonical form. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import pick

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Lines that only name the holder.
NOTICE = r"(^|\n)[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|[0-9<\[])|\(c\)[ \t]*[0-9]|©|all rights reserved)[^\n]*"

#: Kinds of lines in lower case, a letter each: without letters or digits, of copyright in any form, a possible title.
BLANK_LINE, HOLDER_LINE, TITLE_LINE, OTHER_LINE = "bcto"
NO_WORD = r"^[^a-z0-9]*$"
HOLDER = r"^[^a-z0-9]*copyright[ \t]"
COPYRIGHT = r"^[^a-z0-9]*copyright"
LONGEST_TITLE = 80

#: Over the kinds of a text's lines: what stays (one line of title at most), then the lines of copyright that go. No group
#: is repeated, since the matcher would descend a level for each turn.
FRONT = "^(b*(?:tb*)?)(c[cb]*)"

#: What is no letter and no digit; beyond ASCII only the quotes and dashes that ``TYPOGRAPHIC`` names count as such.
PUNCTUATION = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
TYPOGRAPHIC = "“”‘’«»–—… "

#: Spellings that licence matching treats as equal.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorise", "authorize"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisation", "capitalization"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("emphasise", "emphasize"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("licence", "license"),
    ("modelled", "modeled"),
    ("noncommercial", "non commercial"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("https", "http"),
)

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS {more}BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""

_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_CLAUSES = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""

_PERMISSION = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted"""

_NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""

#: Public licence texts and the notices that stand for a licence.
KNOWN = (
    (
        "MIT",
        """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

"""
        + _WARRANTY.format(more="OR COPYRIGHT HOLDERS "),
    ),
    ("BSD-2-Clause", _CLAUSES + _DISCLAIMER),
    (
        "BSD-3-Clause",
        _CLAUSES
        + """
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.

"""
        + _DISCLAIMER,
    ),
    (
        "ISC",
        _PERMISSION
        + """, provided that the above
copyright notice and this permission notice appear in all copies.

"""
        + _NO_WARRANTY,
    ),
    ("0BSD", _PERMISSION + ".\n\n" + _NO_WARRANTY),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In
no event will the authors be held liable for any damages arising from the use
of this software.

Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to
the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim
that you wrote the original software. If you use this software in a product, an
acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this
software dedicate any and all copyright interest in the software to the public
domain. We make this dedication for the benefit of the public at large and to
the detriment of our heirs and successors. We intend this dedication to be an
overt act of relinquishment in perpetuity of all present and future rights to
this software under copyright law.

"""
        + _WARRANTY.format(more="")
        + "\n\nFor more information, please refer to <https://unlicense.org/>",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)


#: Digests of whole public licence texts, and of those that end before their appendix.
WHOLE = (
    ("Apache-2.0", "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b"),
    ("Apache-2.0", "6aa661403864282a4d084f1551e8149a5f1a7b5e8b05b6db8e1a8a28d0badc64"),
    ("Apache-2.0", "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe"),
    ("GPL-1.0", "0c28ca4dd58dd03edf3afbd7bcf01857c943e8fa9c124d4ca1eaefab216d6b0f"),
    ("GPL-1.0", "af30c0af27b90ec812acdb040f3dcc944a87cd893456690efe35063f39e3eeeb"),
    ("GPL-1.0", "74d0cd23803c9754c36f6ca0e1af411b418ed6b6564e757472bf0d870a1b5d1b"),
    ("GPL-2.0", "9c05d74a883c3b9a1f9c0850cd047eb9d7a3580bdda1f342f19570447984ab29"),
    ("GPL-2.0", "c67cc53030ae25fe2e2f0143b59060eca5ad89da8d2beca1445641234d29fc88"),
    ("GPL-2.0", "1551b61aa183f987ecceedd8966ec1e9b2da3848f8862c2adedc0d82f41904ca"),
    ("GPL-3.0", "dfd1fc3abea1d3d88bd12db363da0b9cdb8731d6e379deb4759ae40fc0208bcb"),
    ("GPL-3.0", "5b8bbbc08610f585b26c4d45ec4c46b3a401532b9362524e72b89d9db72bcb4f"),
    ("GPL-3.0", "57f71ba95bda9ddb21fcd4d2b6841fdc3ef7fcebd5c12a2fd2ee5f2027869fc6"),
    ("LGPL-2.0", "e4deecd0730802431ad09f00ae3793f3703c8e4dba639586545d9f958405614d"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1", "d3826e4e563a04a354453ff139a32b19d6c3fe283f518eb566107c54e18cd01f"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("GFDL-1.2", "58b6ebdf2bd26f81dd551d8efda909bfbc8914ce77996a5c289c28616b91ceeb"),
    ("GFDL-1.3", "c4f8ea2b5247ab1ff721ce8255137250d4c14f50a0fb68c00fd793f496ced65e"),
)


def canonical(text: Column) -> Column:
    """Lower case, without notices of copyright and punctuation, in one spelling, with single spaces."""
    out = F.translate(text, UPPER, LOWER)
    out = F.regexp_replace(out, NOTICE, "\n")
    out = F.translate(out, TYPOGRAPHIC, " " * len(TYPOGRAPHIC))
    out = F.regexp_replace(out, PUNCTUATION, " ")
    for ours, theirs in SPELLINGS:
        out = F.replace(out, F.lit(ours), F.lit(theirs))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def line_kinds(lines: Column) -> Column:
    """The kinds of lines as one text, a letter for each; the last one has no end and is never a line of copyright."""

    def kind(line: Column) -> Column:
        title = (F.char_length(line) <= LONGEST_TITLE) & ~line.rlike(COPYRIGHT)
        own = F.when(line.rlike(NO_WORD), BLANK_LINE).when(line.rlike(HOLDER), HOLDER_LINE)
        return own.when(title, TITLE_LINE).otherwise(OTHER_LINE)

    ended = F.slice(lines, F.lit(1), F.size(lines) - 1)
    return F.concat(F.array_join(F.transform(ended, kind), ""), F.lit(OTHER_LINE))


def lookup_digest(lines: Column, kinds: Column) -> Column:
    """The digest without the lines of copyright in front, null if there are none."""
    stays = F.char_length(F.regexp_extract(kinds, FRONT, 1))
    goes = F.char_length(F.regexp_extract(kinds, FRONT, 2))
    rest = F.slice(lines, stays + goes + 1, F.size(lines))
    return F.when(goes > 0, digest(F.array_join(F.concat(F.slice(lines, F.lit(1), stays), rest), "\n")))


def known_digests(
    spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN, whole: tuple[tuple[str, str], ...] = WHOLE
) -> DataFrame:
    """``digest, licence``, one row for each canonical form of ``known`` and each digest of ``whole``; the first name in order wins."""
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = lambda rows: ", ".join(f"({quote(name)}, {quote(text)})" for name, text in rows)
    table = spark.sql(f"SELECT * FROM VALUES {values(known)} AS t(licence, body)").select(digest(F.col("body")).alias("digest"), "licence")
    if whole:
        table = table.unionByName(spark.sql(f"SELECT * FROM VALUES {values(whole)} AS t(licence, digest)"))
    return table.groupBy("digest").agg(F.min("licence").alias("licence"))


def find_licences(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, digest, licence`` for every row; the licence is null if the whole text is none that is known.

    Lines of copyright in front of a licence are left out of what is looked up; ``digest`` is that of the canonical form.
    ``known`` has ``digest, licence``, one row for each digest. It is joined by hash and broadcast only if Spark
    knows it to be small; copies of one text that fill a task are split by adaptive execution. A null text has a null
    digest. Empty texts and texts of punctuation share the digest of the empty text, which is no licence unless
    ``known`` holds it. Repeated rows come back repeated.
    """
    named = known.select(F.col("digest").alias("__digest"), "licence")
    lower = F.translate("text", UPPER, LOWER)
    # only texts that name a copyright are cut into lines
    lines = F.when(F.contains(lower, F.lit("copyright")), F.split(lower, "\n", -1))
    out = pick(docs, "doc_id", "text").select("doc_id", digest(F.col("text")).alias("digest"), lines.alias("__lines"))
    out = out.withColumn("__kinds", line_kinds(F.col("__lines")))
    out = out.withColumn("__lookup", lookup_digest(F.col("__lines"), F.col("__kinds")))
    return out.join(named, F.coalesce("__lookup", "digest") == F.col("__digest"), "left").select("doc_id", "digest", "licence")


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def form(column: str) -> str:
        out = f"translate({column}, {quote(UPPER)}, {quote(LOWER)})"
        out = f"regexp_replace({out}, {quote(NOTICE)}, chr(10), 'g')"
        out = f"translate({out}, {quote(TYPOGRAPHIC)}, {quote(' ' * len(TYPOGRAPHIC))})"
        out = f"regexp_replace({out}, {quote(PUNCTUATION)}, ' ', 'g')"
        for ours, theirs in SPELLINGS:
            out = f"replace({out}, {quote(ours)}, {quote(theirs)})"
        return f"sha256(trim({out}))"

    texts = ", ".join(f"({quote(name)}, {quote(text)})" for name, text in KNOWN)
    whole = ", ".join(f"({quote(name)}, {quote(text)})" for name, text in WHOLE)
    kind = (
        f"CASE WHEN regexp_matches(x, {quote(NO_WORD)}) THEN 'b' WHEN regexp_matches(x, {quote(HOLDER)}) THEN 'c' "
        f"WHEN length(x) <= {LONGEST_TITLE} AND NOT regexp_matches(x, {quote(COPYRIGHT)}) THEN 't' ELSE 'o' END"
    )
    return f"""
WITH known AS (
  SELECT digest, min(licence) AS licence FROM (
    SELECT {form('body')} AS digest, licence FROM (VALUES {texts}) AS t(licence, body)
    UNION ALL SELECT digest, licence FROM (VALUES {whole}) AS t(licence, digest)) GROUP BY 1),
split AS (SELECT doc_id, text, string_split(translate(text, {quote(UPPER)}, {quote(LOWER)}), chr(10)) AS lines FROM documents),
kinds AS (SELECT *, array_to_string(list_transform(lines[:-2], lambda x: {kind}), '') || 'o' AS kinds FROM split),
front AS (SELECT *, regexp_extract(kinds, {quote(FRONT)}, 1) AS stays, regexp_extract(kinds, {quote(FRONT)}, 2) AS goes FROM kinds),
cut AS (SELECT *, CASE WHEN goes <> '' THEN array_to_string(list_concat(lines[:length(stays)], lines[length(stays) + length(goes) + 1:]), chr(10)) END AS rest FROM front),
scanned AS (SELECT doc_id, {form('text')} AS digest, CASE WHEN goes <> '' THEN {form('rest')} END AS lookup FROM cut)
SELECT s.doc_id, s.digest, k.licence FROM scanned s LEFT JOIN known k ON coalesce(s.lookup, s.digest) = k.digest
"""


SQL = _sql()
