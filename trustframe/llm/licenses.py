"""License scans: canonical digests of whole texts looked up in a table of known licence digests."""

from __future__ import annotations

import re
import textwrap
from collections.abc import Iterable
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table, up_to, whole

BROADCAST_ROWS = 100_000
# Lines that name the owner differ from copy to copy and are left out.
COPYRIGHT_LINE = r"\n[\x20\x09*#/;-]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*"
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Equivalent spellings, applied in this order at word starts of the normalised text.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("organisation", "organization"), ("favour", "favor"),
    ("authorisation", "authorization"), ("recognised", "recognized"), ("whilst", "while"), ("non commercial", "noncommercial"),
    ("per cent", "percent"), ("copyright owner", "copyright holder"), ("http ", "https "),
)

WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_TERMS = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)
NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
# Complete licence texts, one file per SPDX identifier; a text that "only" and "or later" share has the "only" name.
TEXTS = Path(__file__).with_name("license_texts")
# Parts that copies leave out: what follows these lines tells how to apply the licence.
APPENDIX = re.compile(r"(?<=END OF TERMS AND CONDITIONS)\n.*", re.S)
# Titles of the short licences; every text is known without a title, too.
MIT_TITLES = ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT", "MIT License (MIT)")
ISC_TITLES = ("ISC License", "The ISC License", "ISC", "ISC License (ISC)", "ISC License (ISCL)")
BSD2_TITLES = ("BSD 2-Clause License", "The BSD 2-Clause License", '"Simplified BSD License"', "BSD License", "The BSD License")
BSD3_TITLES = ("BSD 3-Clause License", "The BSD 3-Clause License", '"New BSD License"', '"Modified BSD License"', "BSD License", "The BSD License")
# How the conditions of the BSD licences are marked. Not "(c)": the canonical form takes it for a copyright line.
MARKS = (("", "", ""), ("1.", "2.", "3."))
BSD_NAME_FORMS = (BSD_NAMES, BSD_NAMES.replace("the copyright holder nor the names of its", "the author nor the names of its"))
MIT_BODY = f"{GRANT}, subject to the following conditions:\n\n{NOTICE}\n\n{WARRANTY}"
ISC_BODY = f"{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{ISC_WARRANTY}"


@lru_cache(maxsize=None)
def _filled(line: str, width: int, hang: str) -> str:
    return textwrap.fill(line, width, subsequent_indent=hang)


def _key(text: str) -> str:
    """As ``canonical`` without spellings: tells which texts need not be listed twice."""
    return re.sub(PUNCTUATION, " ", re.sub(COPYRIGHT_LINE, "", "\n" + text.lower())).strip()


def _forms(license_id: str, titles: Iterable[str], body: str) -> list[tuple[str, str]]:
    """The body on long lines and wrapped, without and with each title.

    The canonical form leaves out a line that happens to begin with "copyright", so widths and indents count.
    """
    hang = lambda line, h: h if re.match(r"\S{0,5} ?(?:Redistributions|Neither)", line) else ""
    wraps = {_key(body): body}
    for width in (*range(66, 82), 100):
        for h in ("", "  ", "   "):
            text = "\n".join(_filled(line, width, hang(line, h)) for line in body.split("\n"))
            wraps.setdefault(_key(text), text)
    return [(license_id, f"{t}\n\n{text}" if t else text) for text in wraps.values() for t in ("", *titles)]


def _bsd(marks: tuple[str, str, str], names: str = "") -> str:
    terms = [x[2:].strip() for x in (BSD_TERMS.split("\n") + ([names] if names else []))]
    return f"{BSD_HEAD}\n\n" + "\n\n".join(f"{m} {x}".strip() for m, x in zip(marks, terms)) + f"\n\n{BSD_WARRANTY}"


def _known() -> tuple[tuple[str, str], ...]:
    """(SPDX identifier, text) pairs, texts of one canonical form once: notices, short licences in their variants, files."""
    out = [*_forms("MIT", MIT_TITLES, MIT_BODY), *_forms("MIT-0", ("MIT No Attribution",), f"{GRANT}.\n\n{WARRANTY}")]
    out += [*_forms("ISC", ISC_TITLES, ISC_BODY), *_forms("0BSD", ("BSD Zero Clause License", "Zero-Clause BSD"), f"{ISC_GRANT}.\n\n{ISC_WARRANTY}")]
    for marks in MARKS:
        out += _forms("BSD-2-Clause", BSD2_TITLES, _bsd(marks))
        for names in BSD_NAME_FORMS:
            out += _forms("BSD-3-Clause", BSD3_TITLES, _bsd(marks, names))
    for path in sorted(TEXTS.glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        out += [(path.stem, text), (path.stem, APPENDIX.sub("", text))]
    out += [
        ("MIT", "Released under the MIT License."),
        ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
        ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ]
    seen: dict[tuple[str, str], tuple[str, str]] = {}
    for k, t in out:
        seen.setdefault((k, _key(t)), (k, t))
    return tuple(seen.values())


# Known texts (SPDX identifier, text): public licence texts and one-line notices.
KNOWN = _known()


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, words split by single blanks, one spelling. NULL counts as empty."""
    t = F.regexp_replace(F.concat(F.lit("\n"), ascii_lower(whole(text))), COPYRIGHT_LINE, "")
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, PUNCTUATION, " ")), F.lit(" "))
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(" " + old), F.lit(" " + new))
    return F.trim(t)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, license_id), one row per digest; a text under several names takes the first in order."""
    rows = spark.createDataFrame(list(known), "license_id string, text string")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, digest, license_id`` for every row (NULL id when unknown).

    A text equals a licence when the canonical forms are equal as a whole.  Empty and NULL texts never
    match.  Repeated rows and NULL ids keep their rows; other columns are ignored; an empty table gives no
    row.  ``known`` is broadcast when it counts at most ``BROADCAST_ROWS`` rows, else Spark shuffles.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), canonical(F.col(text)).alias("_c"))
    d = d.select("doc_id", F.sha2("_c", 256).alias("digest"), (F.col("_c") == "").alias("_empty"))
    k = F.broadcast(known) if up_to(known, BROADCAST_ROWS) else known
    out = d.join(k, "digest", "left")
    return out.select("doc_id", "digest", F.when(~F.col("_empty"), F.col("license_id")).alias("license_id"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), known_digests(spark))


def _canonical_sql(t: str) -> str:
    q = lambda x: x.replace("'", "''")
    out = f"regexp_replace(chr(10) || translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{q(COPYRIGHT_LINE)}', '', 'g')"
    out = f"' ' || trim(regexp_replace({out}, '{q(PUNCTUATION)}', ' ', 'g')) || ' '"
    for old, new in SPELLINGS:
        out = f"replace({out}, ' {old}', ' {new}')"
    return f"trim({out})"


_VALUES = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in KNOWN)
SQL = f"""WITH k AS (SELECT sha256({_canonical_sql('text')}) AS digest, min(license_id) AS license_id FROM (VALUES {_VALUES}) v(license_id, text) GROUP BY 1),
d AS (SELECT doc_id, {_canonical_sql('text')} AS c FROM documents)
SELECT doc_id, sha256(c) AS digest, CASE WHEN c <> '' THEN license_id END AS license_id FROM d LEFT JOIN k ON k.digest = sha256(d.c)"""
