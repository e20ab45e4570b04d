"""License scans by canonical digest, with built-in functions alone.

A text's canonical form is lower case, without its copyright lines, with one spelling of words that have several, and
with each run of anything but letters and digits as one blank. Whole texts, and each of their lines, hash-join the
SHA-256 digests of known licence texts and notices. Whole texts are also known by a second form, of licence files as they
are distributed: without a title line before the text, without FSF's postal address, with one way to name holders, and
with a copyright line only where a year, a sign or a holder follows. Texts of that registry are files in
``license_texts``. The registry has a proven bound (``most_known``) and is broadcast; a larger one is joined by shuffle.

Defined results: a null or empty text, or one of punctuation alone, has the digest of no characters and no licence;
repeated rows get equal rows; a licence found several times in a text is listed once; a null id stays null; other
columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings taken as equal.
SPELLINGS = [("licence", "license"), ("favour", "favor"), ("behaviour", "behavior"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("whilst", "while"), ("https", "http")]
#: A copyright line of a licence file; "(c)" alone is an item of a list, "copyright notice" is prose.
COPYRIGHT_LINE = (
    r"(^|\n)[ \t]*(?:(?:portions[ \t]+)?copyright\b[^\n]*?(?:\b(?:1[89]|20)\d\d\b|\(c\)|©|[\[<{(]y)[^\n]*"
    r"|copyright[ \t:]+(?!(?:notices?|licen[cs]es?|holders?|owners?|laws?|interests?|statements?|treat(?:y|ies)|rights?|protections?|infringements?|and|or|in|on|of|to|is|by|for|as|under|resulting|held|permission|the[ \t]+(?:above|software))\b)[^\n]+"
    r"|(?:\(c\)|©)[ \t]*(?:copyright\b|(?:1[89]|20)\d\d\b|[\[<{(]y)[^\n]*)"
)
#: A title before the text.
TITLE_LINE = r"^[ \n]*(?:the )?(?:mit|expat|x11|isc|mit expat|(?:new |modified |revised |simplified |original )?bsd(?: style)?(?: ?[234]| two| three| four)?(?: clause)?|(?:[234]|two|three|four) clause bsd) (?:open source )?licen[sc]e(?: mit| expat| x11| isc| isc l| bsd [23] clause)? *\n"
#: Wordings of one licence that differ by holder, or by the mark of an item.
WORDINGS = [
    (r"\b(?:regents|copyright holders?|copyright owners?|authors?) (and|or) contributors\b", "copyright holders $1 contributors"),
    (r"\bneither the names? of .{1,120}? nor the names of\b", "neither the name of the copyright holder nor the names of"),
    (r"(?<= )[0-9a-z] (?=redistributions (?:of source|in binary)|neither the name )", ""),
    (r"\band or distribute this software\b", "and distribute this software"),
]
#: Known licence texts and notices.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
]


def _lines(text: Column) -> Column:
    """Canonical lines of a text, as one string."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(^|\n)[ \t]*(copyright|\(c\)|©)[^\n]*", "\n")
    for other, one in SPELLINGS:
        low = F.replace(low, F.lit(other), F.lit(one))
    return F.regexp_replace(low, r"[^\p{L}\p{N}\n]+", " ")


def canonical(text: Column) -> Column:
    return F.trim(F.regexp_replace(_lines(text), r"[ \n]+", " "))


def distributed(text: Column) -> Column:
    """The form of a whole licence file, however it is wrapped, titled and signed."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\r\n?", "\n")
    low = F.regexp_replace(low, COPYRIGHT_LINE, "\n")
    for other, one in SPELLINGS:
        low = F.replace(low, F.lit(other), F.lit(one))
    low = F.regexp_replace(low, r"[^\p{L}\p{N}\n]+", " ")
    low = F.regexp_replace(low, r"(^|\n) *(all rights reserved *(?=\n|$)|(51 franklin|59 temple|675 mass)[^\n]*)", "\n")
    low = F.trim(F.regexp_replace(F.regexp_replace(low, TITLE_LINE, ""), r"[ \n]+", " "))
    for other, one in WORDINGS:
        low = F.regexp_replace(low, other, one)
    return low


def license_texts() -> list[tuple[str, str]]:
    """licence and text of the files of the registry, with and without what follows the end of the terms."""
    out = []
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        terms, end, rest = text.partition("END OF TERMS AND CONDITIONS")
        out += [(path.stem, text)] + ([(path.stem, terms + end), (path.stem, terms)] if rest.strip() else [])
    return out


def registry(spark: SparkSession, known: list[tuple[str, str]] = KNOWN, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """licence, digest, size (characters) of both forms of each known text."""
    texts = license_texts() if texts is None else texts
    rows = spark.createDataFrame([*known, *texts], "licence string, text string")
    rows = rows.select("licence", F.explode(F.array(canonical(F.col("text")), distributed(F.col("text")))).alias("form"))
    return rows.select("licence", F.sha2("form", 256).alias("digest"), F.length("form").alias("size")).where("size > 0").groupBy("digest").agg(F.min("licence").alias("licence"), F.first("size").alias("size"))


def scan(df: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text", most_known: int = 10_000) -> DataFrame:
    """doc_id, digest of the canonical text, licence of the whole text or null, notices (licences of its lines, sorted)."""
    facts = known.agg(F.count("*").alias("n"), F.collect_set("size").alias("sizes")).first()
    lines = df.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), _lines(F.col(text).cast("string")).alias("lines"))
    lines = lines.withColumn("form", F.sha2(distributed(F.col("text")), 256)).drop("text")
    whole = F.sha2(F.trim(F.regexp_replace("lines", r"[ \n]+", " ")), 256)
    sized = F.filter(F.transform(F.split("lines", "\n"), lambda x: F.trim(x)), lambda x: F.length(x).isin(facts["sizes"]))
    units = lines.select("row", "doc_id", "form", whole.alias("digest"), F.array_distinct(F.transform(sized, lambda x: F.sha2(x, 256))).alias("found"))
    units = units.select("row", "doc_id", "digest", "form", F.explode(F.array_union(F.array_distinct(F.array("digest", "form")), "found")).alias("unit"), F.col("found"))
    table = known.select(F.col("digest").alias("unit"), "licence")
    hit = units.join(F.broadcast(table) if facts["n"] <= most_known else table, "unit", "left")
    licence = F.coalesce(*(F.max(F.when(F.col("unit") == F.col(c), F.col("licence"))) for c in ("digest", "form")))
    return (
        hit.groupBy("row", "doc_id", "digest")
        .agg(licence.alias("licence"), F.array_join(F.sort_array(F.collect_set(F.when(F.array_contains("found", F.col("unit")), F.col("licence")))), ",").alias("notices"))
        .drop("row")
    )


def _sql(text: str) -> str:
    low = f"regexp_replace(lower(coalesce({text}, '')), '(^|\\n)[ \\t]*(copyright|\\(c\\)|©)[^\\n]*', chr(10), 'g')"
    for other, one in SPELLINGS:
        low = f"replace({low}, '{other}', '{one}')"
    return f"regexp_replace({low}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"


_KNOWN_SQL = ", ".join("('{}', '{}')".format(a, b.replace("'", "''").replace("\n", "' || chr(10) || '")) for a, b in KNOWN)
ORACLE_SQL = f"""
WITH known AS (SELECT digest, min(licence) AS licence FROM (SELECT licence, sha256(trim(regexp_replace({_sql("text")}, '[ \\n]+', ' ', 'g'))) AS digest FROM (VALUES {_KNOWN_SQL}) AS k(licence, text)) GROUP BY digest),
canon AS (SELECT row_number() OVER () AS row, doc_id, {_sql("text")} AS lines FROM documents),
whole AS (SELECT row, doc_id, lines, sha256(trim(regexp_replace(lines, '[ \\n]+', ' ', 'g'))) AS digest FROM canon),
units AS (SELECT row, sha256(trim(unnest(string_split(lines, chr(10))))) AS unit FROM whole),
notices AS (SELECT row, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices FROM units JOIN known ON unit = known.digest GROUP BY row)
SELECT w.doc_id, w.digest, k.licence, coalesce(n.notices, '') AS notices
FROM whole w LEFT JOIN known k ON w.digest = k.digest LEFT JOIN notices n ON w.row = n.row
"""
