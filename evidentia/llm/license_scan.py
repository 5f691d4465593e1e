"""Operator 7: licence scans by canonical digests, in DataFrame operations only.

A text is brought to one form: lower case, without copyright lines, with one spelling of equivalent words
and no punctuation. The digest of its whole form, and of each of its lines, is joined by hash to the
digests of the known licence texts and notices, which go through the same expressions. The known table
is a constant of this module (with the whole texts in the folder licenses) or an argument; it does not
grow with the corpus. Only lines as long as a known text are digested. A line that starts with the word
copyright is left out only if a year, (c), a template or a holder's name follows: license texts in their
usual wrapping have other lines that start with it, and list items that start with (c).

The SQL knows the notices and one-line texts alone and drops every line that starts with copyright or (c);
it gives the same rows where documents hold no whole text of the folder and no such line.

Defined cases: a null or empty text has the digest of the empty form and no licence; several licences are
given in order with commas; rows that share a doc_id are looked at by themselves; columns
beside doc_id and text are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import table

#: Equivalent spellings, as (pattern, spelling); after lower case.
SPELLINGS = (("licence", "license"), ("sub[- ]licens", "sublicens"), ("non[- ]commercial", "noncommercial"), ("merchantab[a-z]*", "merchantability"), ("copyright (owner|holder)", "copyright holder"), ("https://", "http://"), ("&", " and "))
COPYRIGHT_LINE = "(^|\n)[ \t]*(copyright|\\(c\\)|©)[^\n]*"
#: Real copyright lines, before lower case: a capital starts a holder's name, unless the word is one of prose.
HOLDER_LINE = "(^|\n)[ \t]*(?:(?i:copyright)[ \t:,]*(?:(?i:\\(c\\)|by\\b)|©|(?:19|20)[0-9]{2}|[\\[<{]|(?!(?i:notices?|licen[cs]es?|laws?|holders?|owners?|statements?|interests?|and|or)\\b)\\p{Lu}\\p{Ll})|(?i:\\(c\\))[ \t]*(?:(?i:copyright)|(?:19|20)[0-9]{2})|©)[^\n]*"
OTHER = "[^\\p{L}\\p{N}\n]+"

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_TEXTS = {
    "MIT": _MIT,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_END,
}
WHOLE_TEXTS = Path(__file__).parent / "licenses"
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "{0} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "{1} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
    "{2}THIS SOFTWARE IS PROVIDED BY THE {3} AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE {4} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_NAME = "{0} Neither the name of the {1} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_HEADINGS = {"MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License",), "0BSD": ("BSD Zero Clause License",)}


def known_texts() -> list[tuple[str, str]]:
    """Licence ids with the texts and notices that stand for them; notices are made from names by rule."""
    out = [(name, text) for name, text in _TEXTS.items()]
    out += [(name, f"{heading}\n\n{_TEXTS[name]}") for name, headings in _HEADINGS.items() for heading in headings]
    names = [("MIT", "MIT License"), ("ISC", "ISC License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("MPL-2.0", "Mozilla Public License, Version 2.0"), ("Unlicense", "Unlicense")]
    names += [(f"Apache-{v}", f"Apache License, Version {v}") for v in ("1.1", "2.0")]
    names += [(f"GPL-{v}.0", f"GNU General Public License, version {v}") for v in (1, 2, 3)]
    names += [(f"LGPL-{v}", f"GNU Lesser General Public License, version {v}") for v in ("2.1", "3")]
    names += [("AGPL-3.0", "GNU Affero General Public License, version 3")]
    names += [(f"CC-{k}-{v}", f"CC {k} {v}") for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("2.0", "2.5", "3.0", "4.0")]
    for licence, name in names:
        article = "" if name.startswith("CC ") else "the "
        out += [(licence, f"{start} under {article}{name}.") for start in ("Licensed", "Released", "Distributed", "This work is licensed")]
    return out


def whole_texts() -> list[tuple[str, str]]:
    """Licence ids with whole texts: the files of the folder, with and without what follows their terms, and the forms of BSD."""
    out = []
    for file in sorted(WHOLE_TEXTS.glob("*.txt")):
        text = file.read_text(encoding="utf-8")
        out.append((file.stem, text))
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        if end:
            out += [(file.stem, terms + end), (file.stem, terms)]
    holders = [("COPYRIGHT HOLDERS", "COPYRIGHT HOLDER"), ("COPYRIGHT HOLDERS", "COPYRIGHT HOLDERS"), ("COPYRIGHT HOLDER", "COPYRIGHT HOLDER"), ("REGENTS", "REGENTS"), ("AUTHOR", "AUTHOR"), ("AUTHORS", "AUTHORS")]
    names = ("copyright holder", "copyright holders", "University", "<organization>", "author", "authors")
    for marks in (("1.", "2.", "3."), ("*", "*", "*"), ("a.", "b.", "c.")):
        for first, second in holders:
            forms = [("BSD-2-Clause", _BSD.format(*marks[:2], "", first, second))]
            forms += [("BSD-3-Clause", _BSD.format(*marks[:2], _BSD_NAME.format(marks[2], name), first, second)) for name in names]
            for licence, text in forms:
                n = licence[4]
                for heading in ("", f"BSD {n}-Clause License", f"The {n}-Clause BSD License", f"The BSD {n}-Clause License", "BSD License", "The BSD License"):
                    out += [(licence, f"{heading}\n\n{reserved}{text}") for reserved in ("", "All rights reserved.\n\n")]
    return out


def canonical_lines(text: Column) -> Column:
    """The form of a text with its line ends: one space for each run of other characters between them."""
    form = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), HOLDER_LINE, "$1"))
    for pattern, spelling in SPELLINGS:
        form = F.regexp_replace(form, pattern, spelling)
    return F.regexp_replace(form, OTHER, " ")


def whole_form(lines: Column) -> Column:
    """One line, with the spellings of words that a line end parts."""
    form = F.trim(F.regexp_replace(lines, "[ \n]+", " "))
    for words, spelling in (("copyright owner", "copyright holder"), ("sub licens", "sublicens"), ("non commercial", "noncommercial")):
        form = F.replace(form, F.lit(words), F.lit(spelling))
    return form


def digest(form: Column) -> Column:
    return F.sha2(form.cast("binary"), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license_id, size) of the known texts; a digest of several licences stands for the first by name."""
    rows = spark.createDataFrame(known if known is not None else known_texts() + whole_texts(), "license_id string, text string")
    form = rows.select("license_id", whole_form(canonical_lines(F.col("text"))).alias("form"))
    return form.groupBy(digest(F.col("form")).alias("digest")).agg(F.min("license_id").alias("license_id"), F.min(F.length("form")).alias("size"))


def scan_licenses(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, text_sha256 of the whole form, license_id of the whole text, and the licences of its lines.

    Each text is brought to its form once, where it is: the digest of the whole is joined to the known ones, and those
    of its lines are met with them as sets in the row."""
    spark = docs.sparkSession
    constant = known_digests(spark, known).collect()
    digests = spark.createDataFrame(constant, "text_sha256 string, license_id string, size int").drop("size")
    sizes = sorted({r["size"] for r in constant})
    rows = docs.select("doc_id", canonical_lines(F.col("text")).alias("_lines"))
    lines = F.transform(F.split("_lines", "\n"), lambda x: F.trim(x))
    likely = F.array_distinct(F.filter(lines, lambda x: F.length(x).isin(sizes)))
    found = F.array_intersect(F.transform(likely, digest), F.lit([r["digest"] for r in constant]) if constant else F.array().cast("array<string>"))
    units = rows.select("doc_id", digest(whole_form(F.col("_lines"))).alias("text_sha256"), F.when(F.size(likely) > 0, found).alias("found"))
    names = F.create_map(*[F.lit(x) for r in constant for x in (r["digest"], r["license_id"])]) if constant else F.lit(None).cast("map<string,string>")
    notices = F.when(F.size("found") > 0, F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: F.element_at(names, x)))), ","))
    whole = units.join(F.broadcast(digests), "text_sha256", "left")
    return whole.select("doc_id", "text_sha256", "license_id", F.coalesce(notices, F.lit("")).alias("notices"))


def op7_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences of every document by the digest of its whole form, and by those of its lines."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql_form(text: str) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    form = f"regexp_replace(lower(coalesce({text}, '')), {quote(COPYRIGHT_LINE)}, '\\1', 'g')"
    for pattern, spelling in SPELLINGS:
        form = f"regexp_replace({form}, {quote(pattern)}, {quote(spelling.replace('$', chr(92)))}, 'g')"
    return f"regexp_replace({form}, {quote(OTHER)}, ' ', 'g')"


def oracle() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in known_texts())
    return f"""
WITH known AS (
  SELECT sha256(trim(regexp_replace({_sql_form("text")}, '[ \n]+', ' ', 'g'))) AS digest, min(license_id) AS license_id
  FROM (VALUES {known}) k(license_id, text) GROUP BY 1),
forms AS (SELECT doc_id, {_sql_form("text")} AS lines FROM documents),
parts AS (SELECT doc_id, trim(unnest(string_split(lines, '\n'))) AS line FROM forms),
notices AS (
  SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
  FROM parts JOIN known ON sha256(line) = digest GROUP BY doc_id),
whole AS (SELECT doc_id, sha256(trim(regexp_replace(lines, '[ \n]+', ' ', 'g'))) AS text_sha256 FROM forms)
SELECT w.doc_id, w.text_sha256, k.license_id, coalesce(n.notices, '') AS notices
FROM whole w LEFT JOIN known k ON k.digest = w.text_sha256 LEFT JOIN notices n ON n.doc_id = w.doc_id
"""
