"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Four kinds have patterns of their own: mail and internet addresses, card and phone numbers. What these find are the
seeds. Every chunk of text shaped like an identifier is an instance, seed or not, and the one and the two words before
it are its lexical patterns. In the graph of patterns and instances a pattern is as sure of a kind as its instances are
known to be of it; instances that sure patterns hold become known, which makes further patterns sure, and so on until
nothing new is found. So 'mobile: 0171 555 1234' is found because 'mobile:' stands before proper phone numbers elsewhere.

Patterns are scored over the whole corpus: a word that mostly has no identifier after it says nothing, however many
seeds follow it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratergrid.llm.common import BLANKS, quoted, whole_text
from ratergrid.llm.spans import with_places
from ratergrid.session import stored

#: Kinds in the order of the report, with the patterns of the contract. Fixed values.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches without going back: a run of letters or digits is tried from its first character (or from the end of
#: the match before) only, so texts without blanks take linear time, and long numbers take no stack.
FAST = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": KINDS["phone"],
}
_IP = r"^(0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(\.|$)){4}$"
_B = r"\x20\x09-\x0D"
#: Instances: numbers that go on after single spaces, or chunks between blanks with a digit or @, and the blank before.
INSTANCE = (rf"[{_B}](?:[(+]*[0-9][0-9().-]*(?:\x20[(]?[0-9][0-9().-]*)+|[^{_B}0-9@]*[0-9@][^{_B}]*)")
_FAST_INSTANCE = (rf"[{_B}](?:[(+]*+[0-9][0-9().-]*+(?:\x20[(]?[0-9][0-9().-]*+)++|[^{_B}0-9@]*+[0-9@][^{_B}]*+)")
#: Characters that don't belong to an instance at its ends; its most code points, its least and most digits.
BEFORE, AFTER = "\"'<[{", ".,;:!?\"')>]}"
LONGEST, DIGITS = 64, (6, 34)
#: Most code points of a context word, and how far before an instance its two words are looked for.
WORD, REACH = 40, 90
#: A pattern needs so many known values and thousandths of all its values, and an instance in one of MOSTLY of its uses;
#: an instance needs so many thousandths from the patterns that hold it.
KNOWN, PATTERN_MILLI, MOSTLY, INSTANCE_MILLI = 3, 500, 2, 600
ROUNDS = 4


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)

    def share(i: Column) -> Column:
        digit = F.substring(back, i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, doubled(digit)).otherwise(digit)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), share), F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern keeps the kind's rule."""
    if kind == "ip":
        return value.rlike(_IP)
    if kind == "card":
        digits = F.regexp_replace(value, "[ -]", "")
        return F.length(digits).between(16, 19) & F.when(F.length(digits).between(16, 19), _luhn(digits))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _kind_of(value: Column) -> Column:
    """Number of the first kind of which the value holds a proper match, -1 for none."""
    out = F.lit(-1)
    for k, kind in reversed(list(enumerate(KINDS))):
        found = F.regexp_extract(value, FAST[kind], 0)
        out = F.when((found != "") & F.coalesce(_passes(kind, found), F.lit(False)), F.lit(k)).otherwise(out)
    return out


def _base(df: DataFrame) -> DataFrame:
    """Adds ``base``: array of (kind number, start, end, value) of the matches that pass, by kind, then start."""
    text = F.col("_text")
    signs = {"email": "@", "ip": ".", "phone": "+"}
    for k, kind in enumerate(KINDS):
        df = with_places(df, f"_{kind}", text, FAST[kind], F.contains(text, F.lit(signs[kind])) if kind in signs else None)
        df = df.withColumn(f"_{kind}", F.transform(F.filter(f"_{kind}", lambda s: _passes(kind, s["value"])), lambda s: F.struct(
            F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))))
    return df.withColumns({"base": F.concat(*[F.col(f"_{kind}") for kind in KINDS]),
                           **{f"n_{kind}": F.size(f"_{kind}").cast("long") for kind in KINDS}})


def _contexts(gap: Column) -> Column:
    """The last word of a gap, and its last two; words of more than ``WORD`` code points are none."""
    gap = F.rtrim(gap, F.lit(BLANKS))
    near = F.split(F.lower(F.right(gap, F.lit(REACH))), f"[{_B}]+")
    near = F.when(F.length(gap) > REACH, F.slice(near, F.lit(2), F.size(near))).otherwise(near)
    word = lambda i: F.try_element_at(near, F.lit(i))
    proper = lambda w: F.length(w).between(1, WORD)
    return F.array_compact(F.array(F.when(proper(word(-1)), word(-1)),
                                   F.when(proper(word(-1)) & proper(word(-2)), F.concat_ws(" ", word(-2), word(-1)))))


def _instances(df: DataFrame) -> DataFrame:
    """Adds ``_found``: array of (start, end, value, patterns) of chunks shaped like an identifier."""
    spaced = F.concat(F.lit(" "), F.col("_text"))
    df = with_places(df, "_found", spaced, _FAST_INSTANCE, F.col("_text").rlike("[0-9@]"), gaps=True)
    short = F.filter("_found", lambda s: F.length(s["value"]) <= LONGEST + 16)

    def trimmed(s: Column) -> Column:
        front = F.ltrim(s["value"], F.lit(BLANKS + BEFORE))
        start = s["end"] - F.length(front) - 1  # without the space in front of the text
        value = F.rtrim(front, F.lit(AFTER))
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), s["gap"].alias("gap"))

    def shaped(s: Column) -> Column:
        digits = F.length(F.regexp_replace(s["value"], "[^0-9]", ""))
        return F.length(s["value"]).between(1, LONGEST) & (digits.between(*DIGITS) | s["value"].rlike("[^@]@[^@]"))

    return df.withColumn("_found", F.transform(F.filter(F.transform(short, trimmed), shaped), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), _contexts(s["gap"]).alias("patterns"))))


def _uses(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, uses): how often each of ``patterns``, one word or two in a row, occurs in all texts."""
    words = texts.select(F.split(F.lower("_text"), f"[{_B}]+").alias("_words"))
    pairs = F.zip_with("_words", F.slice("_words", F.lit(2), F.size("_words")), lambda a, b: F.concat_ws(" ", a, b))
    every = words.select(F.explode("_words").alias("pattern")).unionByName(
        words.select(F.explode(F.slice(pairs, F.lit(1), F.greatest(F.size("_words") - 1, F.lit(0)))).alias("pattern")))
    return every.join(patterns.select("pattern"), "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("uses"))


def _first(rows: DataFrame, by: str, score: str) -> DataFrame:
    """The kind with the highest score for each ``by``, the first one of ties."""
    best = rows.groupBy(by).agg(F.max(F.col(score) * len(KINDS) + (len(KINDS) - 1 - F.col("kind"))).alias("_best"))
    return best.select(by, (len(KINDS) - 1 - F.col("_best") % len(KINDS)).cast("int").alias("kind"),
                       F.floor(F.col("_best") / len(KINDS)).alias(score))


def learn_identifiers(mentions: DataFrame, texts: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """From mentions (value, seed kind or -1, patterns) and all texts: unseen (value, kind), and the sure patterns
    (pattern, kind, milli) of the last round."""
    edges = mentions.select("value", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "value", "seed").agg(
        F.count("*").alias("times"))
    edges = stored(edges, "edges")
    common = stored(edges.groupBy("pattern").agg(F.count("*").alias("values"), F.sum("times").alias("times")).where(
        F.col("values") >= KNOWN), "contexts")
    telling = common.join(_uses(texts, common), "pattern").where(F.col("times") * MOSTLY >= F.col("uses"))
    links = stored(edges.join(telling.select("pattern", "values"), "pattern"), "links")
    known = links.where("seed >= 0").select("value", F.col("seed").alias("kind")).distinct()
    unseen = links.limit(0).select("value", F.lit(0).alias("kind"))
    sure = links.limit(0).select("pattern", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("milli"))
    for _ in range(rounds):
        held = links.join(known, "value").groupBy("pattern", "kind", "values").agg(F.count("*").alias("_held"))
        best = _first(held, "pattern", "_held").join(links.select("pattern", "values").distinct(), "pattern")
        best = best.withColumn("milli", F.floor(1000 * F.col("_held") / F.col("values")))
        sure = stored(best.where((F.col("_held") >= KNOWN) & (F.col("milli") >= PATTERN_MILLI)).select(
            "pattern", "kind", "milli"), "patterns")
        votes = links.where("seed < 0").join(sure, "pattern").groupBy("value", "kind").agg(F.sum("milli").alias("_sum"))
        fresh = _first(votes, "value", "_sum").where(F.col("_sum") >= INSTANCE_MILLI).join(
            unseen.select("value"), "value", "left_anti").select("value", "kind")
        fresh = stored(fresh, "identifiers")
        if fresh.isEmpty():
            break
        known, unseen = known.unionByName(fresh), unseen.unionByName(fresh)
    return unseen, sure


def scan_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base (array of spans), spans (array of base
    spans and of those of identifiers learned from their contexts), n_learned.

    A span is (kind number, start, end, value), by kind, then start; ends are exclusive, in code points. Learned spans
    never overlap base ones. NULL and empty texts have no spans; repeated rows count as often as they occur; ids are only
    carried along. An empty table gives no rows. Columns besides the two named are not read.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(quoted(id_col)).alias("doc_id"),
                        whole_text(text_col).alias("_text"))
    counts = [f"n_{kind}" for kind in KINDS]
    found = stored(_instances(_base(texts)).select("_row", "doc_id", *counts, "base", "_found"), "found")
    mentions = found.select("_row", F.inline("_found")).withColumn("seed", _kind_of(F.col("value")))
    mentions = stored(mentions, "mentions")
    unseen, _ = learn_identifiers(mentions, texts, rounds)
    learned = mentions.where("seed < 0").join(unseen, "value").select("_row", "kind", "start", "end", "value")
    learned = stored(learned, "learned")
    clear = _clear_of_base(learned, found)
    per_row = clear.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end", "value"))).alias("_more"))
    spans = F.when(F.col("_more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", F.col("_more"))))
    return found.join(per_row, "_row", "left").select(
        "doc_id", *counts, "base", spans.alias("spans"), F.coalesce(F.size("_more"), F.lit(0)).cast("long").alias("n_learned"))


def _clear_of_base(learned: DataFrame, found: DataFrame) -> DataFrame:
    """Learned spans that overlap no base span of their text; they never overlap each other."""
    base = found.select("_row", F.inline("base")).join(learned.select("_row"), "_row", "left_semi")
    both = learned.withColumn("_learned", F.lit(True)).unionByName(base.withColumn("_learned", F.lit(False)))
    before = F.max(F.when(~F.col("_learned"), F.col("end"))).over(Window.partitionBy("_row").orderBy("start"))
    after = F.min(F.when(~F.col("_learned"), F.col("start"))).over(Window.partitionBy("_row").orderBy(F.desc("start")))
    return both.withColumns({"_before": before, "_after": after}).where(
        F.col("_learned") & (F.coalesce("_before", F.lit(0)) <= F.col("start")) & (
            F.col("_after").isNull() | (F.col("_after") >= F.col("end")))).select("_row", "kind", "start", "end", "value")


def _listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data_report(docs: DataFrame) -> DataFrame:
    """The scan with spans as text and the base spans' digest."""
    return scan_personal_data(docs).select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"), "n_learned")


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_BLANK_SQL = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_NAMES_SQL = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"


def _found_sql(text: str, pattern: str) -> str:
    """doc_id, gap before, hit and its end, by place i, of all matches."""
    p = _sql_text(pattern)
    return f"""SELECT doc_id, i, g, h, SUM(length(g) + length(h)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS e FROM (
      SELECT doc_id, UNNEST(hs) AS h, UNNEST(gs[1:len(hs)]) AS g, UNNEST(range(len(hs))) AS i FROM (
        SELECT doc_id, regexp_extract_all({text}, {p}) AS hs, string_split_regex({text}, {p}) AS gs FROM d) WHERE len(hs) > 0)"""


def _passes_sql(kind: str, v: str) -> str:
    digits = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    if kind == "ip":
        return f"regexp_matches({v}, {_sql_text(_IP)})"
    if kind == "card":
        return f"""(length({digits}) BETWEEN 16 AND 19 AND list_sum(list_transform(range(length({digits})), lambda k:
          CASE WHEN k % 2 = 0 THEN substring(reverse({digits}), k::INT + 1, 1)::INT
               ELSE 2 * substring(reverse({digits}), k::INT + 1, 1)::INT
                    - CASE WHEN substring(reverse({digits}), k::INT + 1, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0)"""
    return f"length({digits}) BETWEEN 8 AND 15" if kind == "phone" else "TRUE"


def _seed_sql() -> str:
    cases = [f"WHEN regexp_extract(value, {_sql_text(p)}) != '' AND {_passes_sql(kind, f'regexp_extract(value, {_sql_text(p)})')} THEN {k}"
             for k, (kind, p) in enumerate(KINDS.items())]
    return f"CASE {' '.join(cases)} ELSE -1 END"


def _first_sql(rows: str, by: str, score: str) -> str:
    return f"SELECT {by}, arg_max(kind, {score} * {len(KINDS)} - kind) AS kind, MAX({score}) AS {score} FROM ({rows}) GROUP BY {by}"


def _round_sql(k: int) -> str:
    return f"""held{k} AS (SELECT pattern, kind, COUNT(*) AS score FROM links JOIN known{k} USING (value) GROUP BY ALL),
sure{k} AS (SELECT pattern, kind, 1000 * score // n_values AS milli FROM ({_first_sql(f'FROM held{k}', 'pattern', 'score')})
  JOIN telling USING (pattern) WHERE score >= {KNOWN} AND 1000 * score // n_values >= {PATTERN_MILLI}),
votes{k} AS (SELECT value, kind, SUM(milli)::BIGINT AS score FROM links JOIN sure{k} USING (pattern) WHERE seed < 0 GROUP BY ALL),
known{k + 1} AS MATERIALIZED (SELECT value, kind FROM known{k} UNION ALL
  SELECT value, kind FROM ({_first_sql(f'FROM votes{k}', 'value', 'score')}) WHERE score >= {INSTANCE_MILLI}
    AND value NOT IN (SELECT value FROM known{k})),"""


_NEAR_SQL = f"string_split_regex(lower(right(g, {REACH})), '[{_B}]+')"
PERSONAL_DATA_SQL = f"""WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, ' ' || COALESCE(text, '') AS spaced FROM documents),
base AS MATERIALIZED ({' UNION ALL '.join(f'''SELECT doc_id, {k} AS kind, e - length(h) AS s, e FROM ({_found_sql('t', p)})
  WHERE {_passes_sql(kind, 'h')}''' for k, (kind, p) in enumerate(KINDS.items()))}),
cut AS (SELECT doc_id, rtrim(g, {_BLANK_SQL}) AS g, e - 1 AS e, ltrim(h, {_BLANK_SQL} || {_sql_text(BEFORE)}) AS front
  FROM ({_found_sql('spaced', INSTANCE)}) WHERE length(h) <= {LONGEST + 16}),
shaped AS (SELECT doc_id, e - length(front) AS s, rtrim(front, {_sql_text(AFTER)}) AS value,
  CASE WHEN length(g) > {REACH} THEN {_NEAR_SQL}[2:] ELSE {_NEAR_SQL} END AS near FROM cut),
mentions AS MATERIALIZED (SELECT doc_id, s, s + length(value) AS e, value, {_seed_sql()} AS seed,
  CASE WHEN length(near[-1]) BETWEEN 1 AND {WORD} THEN near[-1] END AS one,
  CASE WHEN length(near[-1]) BETWEEN 1 AND {WORD} AND length(near[-2]) BETWEEN 1 AND {WORD} THEN near[-2] || ' ' || near[-1] END AS two
  FROM shaped WHERE length(value) BETWEEN 1 AND {LONGEST} AND (regexp_matches(value, '[^@]@[^@]')
    OR length(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN {DIGITS[0]} AND {DIGITS[1]})),
edges AS MATERIALIZED (SELECT pattern, value, seed, COUNT(*) AS times FROM (
  SELECT value, seed, UNNEST([one, two]) AS pattern FROM mentions) WHERE pattern IS NOT NULL GROUP BY ALL),
common AS (SELECT pattern, COUNT(*) AS n_values, SUM(times) AS times FROM edges GROUP BY ALL HAVING COUNT(*) >= {KNOWN}),
words AS (SELECT string_split_regex(lower(t), '[{_B}]+') AS w FROM d),
uses AS (SELECT pattern, COUNT(*) AS uses FROM (SELECT UNNEST(w) AS pattern FROM words UNION ALL
    SELECT UNNEST(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS pattern FROM words)
  WHERE pattern IN (SELECT pattern FROM common) GROUP BY ALL),
telling AS MATERIALIZED (SELECT pattern, n_values FROM common JOIN uses USING (pattern) WHERE times * {MOSTLY} >= uses),
links AS MATERIALIZED (SELECT * FROM edges JOIN telling USING (pattern)),
known0 AS MATERIALIZED (SELECT DISTINCT value, seed AS kind FROM links WHERE seed >= 0),
{chr(10).join(_round_sql(k) for k in range(ROUNDS))}
learned AS (SELECT doc_id, kind, s, e FROM mentions JOIN known{ROUNDS} USING (value) WHERE seed < 0 AND NOT EXISTS (
  SELECT 1 FROM base b WHERE b.doc_id = mentions.doc_id AND b.s < mentions.e AND mentions.s < b.e)),
listed AS (SELECT doc_id, kind, s, ({_NAMES_SQL})[kind + 1] || ':' || s || ':' || e AS span, own
  FROM (SELECT *, TRUE AS own FROM base UNION ALL SELECT *, FALSE FROM learned)),
per AS (SELECT doc_id, {', '.join(f'COUNT(*) FILTER (own AND kind = {k}) AS n_{kind}' for k, kind in enumerate(KINDS))},
  STRING_AGG(span, ',' ORDER BY kind, s) FILTER (own) AS base, STRING_AGG(span, ',' ORDER BY kind, s) AS spans,
  COUNT(*) FILTER (NOT own) AS n_learned FROM listed GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'COALESCE(n_{kind}, 0) AS n_{kind}' for kind in KINDS)}, sha256(COALESCE(base, '')) AS base_sha256,
  COALESCE(spans, '') AS spans, COALESCE(n_learned, 0) AS n_learned FROM d LEFT JOIN per USING (doc_id)"""
