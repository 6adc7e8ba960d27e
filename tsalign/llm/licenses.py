"""Licence scan by canonical digest: normalise entire texts, hash them, join the hashes with known ones.

Two texts have one digest if they differ only in case, punctuation, white space,
copyright lines, title lines, list marks and the equivalent spellings below. A text
must match as a whole; a licence quoted inside a longer text does not. The table of
known texts holds the short ones; ``known_files`` takes published files besides.

Defined results: NULL text has a NULL digest and no licence; a text that
normalises to nothing has the digest of the empty text and no licence; equal
texts get equal answers; known texts with one digest answer with the smallest
id; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsalign.llm.common import measured

#: Spellings that licence comparison treats as equal.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("behaviour", "behavior"),
    ("cancelled", "canceled"),
    ("copyright owner", "copyright holder"),
    ("distributor's", "distributors"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelled", "labeled"),
    ("licence", "license"),
    ("merchantibility", "merchantability"),
    ("modelled", "modeled"),
    ("organisation", "organization"),
    ("practise", "practice"),
    ("programme", "program"),
    ("recognise", "recognize"),
    ("sub-license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

#: Known digests up to which they are sent to every executor (about 100 bytes each).
KNOWN_ROWS = 200_000

_COPYRIGHT = r"(?m)^[ \t#*/;-]*(?:copyright (?:\(c\)|©|[0-9])|\(c\) ?[0-9]|©)[^\n]*$"
#: A line that names a holder without a year; the phrase "copyright holder" is one word while lines go.
_NAMED = (
    r"(?m)^[ \t#*/;-]*copyright (?:by )?[^\n]*(?:contributors|authors|developers|maintainers|team|project|foundation|corporation|company|inc|ltd|llc|gmbh|reserved)\.?[ \t]*$"
)
_TITLE = (
    r"(?m)^[ \t#*=/-]*(?:the )?(?:mit/x11|mit|x11|isc|zero-clause bsd|bsd zero[- ]clause|simplified bsd|new bsd|modified bsd|revised bsd|bsd|"
    r"bsd [023]-clause|[023]-clause bsd|zlib|boost software) (?:\"[a-z]+\" )?licen[cs]e(?: \([a-z0-9-]+\))?(?: - version 1\.0)?[ \t:*=-]*$"
)
_MARK = r"(?m)^[ \t]*(?:\(?[0-9]{1,2}[.)]|\(?[a-z][.)]|[*•-])[ \t]+"
_RESERVED = r"(?m)^[ \t#*/;-]*all rights reserved\.?[ \t]*$"
#: What goes, line by line, in this order.
_LINES = (_COPYRIGHT, _NAMED, _RESERVED, _TITLE, _MARK)
_HOLDER = ("copyright holder", "copyrightholder")
_OTHER = r"[^\p{L}\p{N}]+"

_MIT_BODY = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
    "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.\n"
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission.\n"
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
    "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
    "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n"
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
    "purpose, commercial or non-commercial, and by any means.\n"
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
    "public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication "
    "to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
    "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the "
    "use of this software.\n"
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
    "subject to the following restrictions:\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, "
    "an acknowledgment in the product documentation would be appreciated but is not required.\n"
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
    "3. This notice may not be removed or altered from any source distribution."
)

#: Licence texts and one-line notices, by id. A caller may pass a table of its own instead.
KNOWN = (
    ("MIT", _MIT_BODY),
    ("MIT", "MIT License\n" + _MIT_BODY),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_END),
    ("0BSD", _ISC_GRANT + ".\n" + _ISC_END),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_END),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAMES + _BSD_END),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + "\nFor more information, please refer to <https://unlicense.org/>"),
    ("Unlicense", _UNLICENSE + "\nFor more information, please refer to <https://unlicense.org>"),
    ("Unlicense", _UNLICENSE + "\nFor more information, please refer to <http://unlicense.org/>"),
    ("Zlib", _ZLIB),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)


def normalised(text: Column) -> Column:
    """The canonical form whose digest is compared."""
    text = F.replace(F.lower(text), F.lit(_HOLDER[0]), F.lit(_HOLDER[1]))
    for pattern in _LINES:
        text = F.regexp_replace(text, pattern, "")
    for one, other in SPELLINGS:
        text = F.replace(text, F.lit(one), F.lit(other))
    return F.trim(F.replace(F.regexp_replace(text, _OTHER, " "), F.lit(_HOLDER[1]), F.lit(_HOLDER[0])))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form, in hex."""
    return F.sha2(normalised(text), 256)


def known_texts(spark: SparkSession) -> DataFrame:
    """``KNOWN`` as a table ``license_id, text``."""
    return spark.createDataFrame(list(KNOWN), "license_id string, text string")


def known_files(spark: SparkSession, folder: str) -> DataFrame:
    """Published licence files as a table ``license_id, text``: the id is the file's name without ``.txt``."""
    files = spark.read.text(f"{folder}/*", wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1).alias("name"), F.col("value").alias("text"))
    return files.select(F.regexp_replace("name", r"\.txt$", "").alias("license_id"), "text")


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, digest, license_id`` (NULL where no known text has the digest).

    ``known`` has ``license_id`` and ``text``. Only digests meet in the join; up
    to ``KNOWN_ROWS`` known ones are sent to every executor, more are shuffled.
    """
    by_digest = (
        known.select(digest(F.col("text")).alias("digest"), normalised(F.col("text")).alias("form"), "license_id")
        .where("form <> ''")
        .groupBy("digest")
        .agg(F.min("license_id").alias("license_id"))
    )
    by_digest = measured(by_digest, "licenses", KNOWN_ROWS)
    hashed = docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest"))
    return hashed.join(by_digest, "digest", "left").select("doc_id", "digest", "license_id")


def oracle() -> str:
    """The same in SQL."""
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def form(x: str) -> str:
        x = f"replace(lower({x}), {quoted(_HOLDER[0])}, {quoted(_HOLDER[1])})"
        for pattern in _LINES:
            x = f"regexp_replace({x}, {quoted(pattern)}, '', 'g')"
        for one, other in SPELLINGS:
            x = f"replace({x}, {quoted(one)}, {quoted(other)})"
        return f"trim(replace(regexp_replace({x}, {quoted(_OTHER)}, ' ', 'g'), {quoted(_HOLDER[1])}, {quoted(_HOLDER[0])}))"

    rows = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in KNOWN)
    return f"""
        WITH known AS (SELECT sha256({form('t')}) AS digest, min(i) AS license_id FROM (VALUES {rows}) v(i, t) GROUP BY 1),
        hashed AS (SELECT doc_id, sha256({form('text')}) AS digest FROM documents)
        SELECT doc_id, digest, license_id FROM hashed LEFT JOIN known USING (digest)"""
