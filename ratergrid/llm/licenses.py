"""Licence scan by canonical digests, in DataFrame functions only.

A text is normalised (case, copyright lines, spellings, punctuation), hashed as a whole and joined with the digests of
known licences. The same is done with every line, for notices that name a licence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ratergrid.dims import small_table
from ratergrid.llm.common import quoted, whole_text
from ratergrid.llm.license_digests import DIGESTS
from ratergrid.session import stored

#: Spellings that count as equal, applied in order to lower-case text. Fixed values.
SPELLINGS = [("licenc", "licens"), ("©", "(c)"), ("https:", "http:"), ("sub-licens", "sublicens"),
             ("non-commercial", "noncommercial"), ("organis", "organiz"), ("authoris", "authoriz"),
             ("copyright owner", "copyright holder"), ("whilst", "while"), ("favour", "favor")]
#: Words that follow "copyright" or "(c)" in prose, and what a name is, to the end of the line.
_PROSE = (r"(?!(?i:notices?|holders?|owners?|law|laws|licen[sc]\w*|interests?|permissions?|disclaimers?|statements?|protection|"
          r"patents?|and|or|the|in|on|of|to|for|is|are|as|you|if)\b)")
_NAME = (_PROSE + r"\p{Lu}[^\s,;]*+(?:[ \t,;]+(?!(?i:all rights reserved))(?:\p{Lu}[^\s,;]*+|[0-9][^\s,;]*+|&|<[^\s>]++>|"
         r"\([^\s)]++\)|(?:and|of|the|de|van|von|der|inc|by)\b\.?))*+(?:[ \t.,]+(?i:all rights reserved))?[ \t.,;\r]*(?=\n|\z)")
_YEAR = r"(?:[0-9]{4}|[\[<{(]?(?i:year|yyyy)\b)"
#: A line that states a copyright (a sign, a year or a name follows), with the line break before it.
COPYRIGHT_LINE = (r"(^|\n)[ \t#*/;-]*(?:(?i:copyright)[ \t:]*(?:(?i:\(c\))|©|" + _YEAR + r"|(?i:by[ \t]+)?" + _NAME + r")|(?:(?i:\(c\))|©)"
                  r"[ \t]*(?:(?i:copyright)\b" + _PROSE + "|" + _YEAR + "|" + _NAME + r")|(?i:all rights reserved))[^\n]*")
OTHER = r"[^\p{L}\p{N}]+"
#: Words one of which every known text has; lines without any are not looked up.
MARKS = "licens|permission|public domain"

#: Known texts. The first four are notices, the others whole licences. Fixed values.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Zero-Clause BSD License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
]


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines, with one spelling, and one space for everything between words."""
    out = F.lower(F.regexp_replace(text, COPYRIGHT_LINE, r"$1"))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, OTHER, " "))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]]) -> DataFrame:
    """(license_id, _digest) of the known texts; of two with one digest the smaller id counts."""
    rows = small_table(spark, known, "license_id string, text string")
    return rows.groupBy(digest(canonical(F.col("text"))).alias("_digest")).agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  known: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_digest, license_id, notices, n_notices.

    license_id is the known licence that the whole text is (NULL if none); besides ``KNOWN`` those whose digests are in
    ``license_digests`` count. notices the distinct licences that
    single lines are, by name, comma-joined; n_notices counts such lines. A NULL text counts as empty; an
    empty text, or one of copyright lines only, has the digest of the empty text and no licence. Repeated rows give one
    row each; a NULL id is kept; an empty table gives no rows. Columns besides the two named are not read. ``known``
    is configuration: its texts are part of the plan.
    """
    spark = docs.sparkSession
    texts = known or KNOWN
    digests = known_digests(spark, texts)
    if known is None:
        more = small_table(spark, [(i, d) for i, all_ in DIGESTS.items() for d in all_.split()], "license_id string, _digest string")
        digests = digests.unionByName(more).groupBy("_digest").agg(F.min("license_id").alias("license_id"))
    digests = stored(digests, "known")
    source = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(quoted(id_col)).alias("doc_id"),
                         whole_text(text_col).alias("_text"))
    marked = lambda line: F.replace(F.lower(line), F.lit("licenc"), F.lit("licens")).rlike(MARKS)
    lines = F.filter(F.split("_text", "\n"), marked) if known is None else F.split("_text", "\n")
    rows = stored(source.select(
        "_row", "doc_id", digest(canonical(F.col("_text"))).alias("text_digest"),
        F.transform(lines, lambda line: digest(canonical(line))).alias("_lines")), "digests")
    met = rows.select("_row", F.explode("_lines").alias("_digest")).join(digests, "_digest")
    notices = met.groupBy("_row").agg(F.array_join(F.sort_array(F.collect_set("license_id")), ",").alias("notices"),
                                      F.count("*").alias("n_notices"))
    whole = rows.select("_row", F.col("text_digest").alias("_digest")).join(digests, "_digest").select(
        "_row", "license_id")
    return rows.select("_row", "doc_id", "text_digest").join(whole, "_row", "left").join(notices, "_row", "left").select(
        "doc_id", "text_digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"),
        F.coalesce("n_notices", F.lit(0)).alias("n_notices"))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: What COPYRIGHT_LINE says of a line, for an engine without look-ahead: patterns one of which must match, each with one
#: that must not.
_START = r"^[ \t#*/;-]*"
_SIGN = r"(?:(?i:\(c\))|©)"
_PROSE_WORD = _PROSE.removeprefix("(?!").removesuffix(")")
_NAME_LINE = _NAME.removeprefix(_PROSE).replace("*+", "*").replace("++", "+").replace("(?!(?i:all rights reserved))", "").replace(
    r"(?=\n|\z)", "$")
SQL_COPYRIGHT_LINES = [
    (rf"{_START}(?i:copyright)[ \t:]*(?:{_SIGN}|{_YEAR})", None),
    *[(_START + lead + _NAME_LINE, _START + lead + _PROSE_WORD) for lead in (
        r"(?i:copyright)[ \t:]*", r"(?i:copyright)[ \t:]*(?i:by[ \t]+)", rf"{_SIGN}[ \t]*")],
    (rf"{_START}{_SIGN}[ \t]*(?:(?i:copyright)\b|{_YEAR})", None),
    (rf"{_START}(?i:all rights reserved)", None),
]


def _canonical_sql(expr: str) -> str:
    stated = " OR ".join(f"(regexp_matches(x, {_literal(yes)})" + (f" AND NOT regexp_matches(x, {_literal(no)}))" if no else ")")
                         for yes, no in SQL_COPYRIGHT_LINES)
    out = f"lower(array_to_string(list_filter(string_split({expr}, chr(10)), lambda x: NOT ({stated})), chr(10)))"
    for old, new in SPELLINGS:
        out = f"replace({out}, {_literal(old)}, {_literal(new)})"
    return f"sha256(trim(regexp_replace({out}, {_literal(OTHER)}, ' ', 'g')))"


LICENSES_SQL = f"""WITH k AS MATERIALIZED (SELECT digest, MIN(id) AS license_id FROM (
  SELECT id, {_canonical_sql('t')} AS digest FROM (VALUES {', '.join(f'({_literal(i)}, {_literal(t)})' for i, t in KNOWN)}) v(id, t)
  UNION ALL SELECT id, digest FROM (VALUES {', '.join(f"('{i}', '{d}')" for i, all_ in DIGESTS.items() for d in all_.split())})
    w(id, digest)) GROUP BY digest),
d AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents),
w AS (SELECT doc_id, {_canonical_sql('t')} AS text_digest FROM d),
l AS (SELECT doc_id, {_canonical_sql('line')} AS digest FROM (SELECT doc_id, UNNEST(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(replace(lower(line), 'licenc', 'licens'), '{MARKS}')),
n AS (SELECT doc_id, STRING_AGG(DISTINCT license_id, ',' ORDER BY license_id) AS notices, COUNT(*) AS n_notices
  FROM l JOIN k USING (digest) GROUP BY doc_id)
SELECT w.doc_id, text_digest, k.license_id, COALESCE(notices, '') AS notices, COALESCE(n_notices, 0) AS n_notices
FROM w LEFT JOIN k ON k.digest = w.text_digest LEFT JOIN n ON n.doc_id = w.doc_id"""
