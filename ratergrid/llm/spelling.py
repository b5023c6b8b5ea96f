"""Spelling variants: words one edit apart, joined by asymmetric q-chunks, each led to a far more frequent form.

Of two words one edit apart the longer (either one, if equally long) gives two disjoint chunks that make up the whole
word, and the other gives positional grams. The edit lies in one chunk, so the other chunk is a gram of the shorter
word, at its own place or one before. Grams farther off than one can't meet a chunk and are not written; a pair that
meets is verified by its edit distance.

A chunk that very many words share (a common beginning) makes a hot group. There the broken half is cut again: the key
is then the shared chunk and one half of the rest, and so on down to a single character, where a group is as large as
the alphabet at most. Groups are joined as soon as they are small, so candidates grow with the words, no group is written
out as pairs, and no pair is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ratergrid.llm.common import quoted, whole_text
from ratergrid.session import stored

#: Letters of a run, as a character class.
LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
#: Words have so many code points, and occur so often, at least.
MIN_LENGTH, MIN_COUNT = 7, 2
#: A form is so many times as frequent as its variant, at least.
FACTOR = 10
#: Candidates of one group that are joined as they are; larger groups are split further.
SMALL_GROUP = 256
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    plain = F.octet_length(word) == F.length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, _CAPITALS, _CAPITALS.lower()))


def letter_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, run): the maximal runs of letters of whole texts with ``min_length`` code points or more, A-Z in lower
    case, one row per occurrence. NULL and empty texts have none; other columns are not read."""
    found = F.regexp_extract_all(whole_text(text_col), F.lit(f"{LETTERS}{{{min_length},}}"), F.lit(0))
    return docs.select(F.col(quoted(id_col)).alias("doc_id"), F.explode(found).alias("run")).select(
        "doc_id", lower_ascii(F.col("run")).alias("run"))


def with_lost_letters(runs: DataFrame, one_in: int = 31) -> DataFrame:
    """``runs`` in which one in ``one_in`` (document, run) has lost a code point, by the crc32 of ``<doc_id>:<run>``.

    A NULL id counts as an empty one.
    """
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    place = (F.col("_h") % F.length("run")).cast("int")
    lost = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    return runs.withColumn("_h", h).select("doc_id", F.when(F.col("_h") % one_in == 0, lost).otherwise(
        F.col("run")).alias("run"))


def vocabulary(runs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): distinct runs with their number of occurrences, by partial aggregation; short and rare ones left out."""
    return runs.where(F.length("run") >= min_length).groupBy(F.col("run").alias("word")).agg(
        F.count("*").alias("n")).where(F.col("n") >= min_count)


def _keyed(words: DataFrame) -> DataFrame:
    """A group key for rows (word, _size, _a, _b, _chunks): the word without the broken part from _a up to _b.

    ``_size`` is the length of the word that gives the chunks; a word shorter by one has its broken part shorter by one.
    """
    after = F.col("_b") - F.col("_size") + F.length("word")
    return words.withColumn("_key", F.xxhash64(
        F.substring("word", F.lit(1), F.col("_a")), F.substring("word", after + 1, F.length("word")), "_size", "_a", "_b"))


def _sides(words: DataFrame) -> DataFrame:
    """Each word as the giver of two chunks, as the giver of grams for words of its length, and for words longer by one.

    Words of one length have their chunks and grams at the same places, so one row stands for both.
    """
    size = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("_size")
    half = F.floor(F.col("_size") / 2).cast("int")
    parts = F.array(F.struct(half.alias("a"), F.col("_size").alias("b")), F.struct(F.lit(0).alias("a"), half.alias("b")))
    rows = words.select("word", size).select("word", "_size", F.explode(parts).alias("_broken"))
    return _keyed(rows.select("word", "_size", F.col("_broken.a").alias("_a"), F.col("_broken.b").alias("_b"),
                              (F.col("_size") == F.length("word")).alias("_chunks")))


def _split(rows: DataFrame) -> DataFrame:
    """The rows of hot groups, with the broken part cut in two."""
    middle = F.floor((F.col("_a") + F.col("_b")) / 2).cast("int")
    parts = F.array(F.struct(F.col("_a").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("_b").alias("b")))
    cut = rows.select("word", "_size", "_chunks", F.explode(parts).alias("_broken"))
    return _keyed(cut.select("word", "_size", F.col("_broken.a").alias("_a"), F.col("_broken.b").alias("_b"), "_chunks"))


def near_words(words: DataFrame, small_group: int = SMALL_GROUP) -> DataFrame:
    """(_w, _v): all pairs of different words that are one inserted, deleted or replaced code point apart, once each.

    ``words`` has distinct values of ``word``. A NULL word and the empty table give none.
    """
    rows = stored(_sides(words.where("word IS NOT NULL")), "chunks")
    found = []
    while True:
        groups = rows.groupBy("_key").agg(F.count_if("_chunks").alias("_c"), F.count("*").alias("_g"),
                                          F.max(F.col("_b") - F.col("_a")).alias("_width")).where("_c > 0 AND _g > 1")
        groups = stored(groups.select("_key", ((F.col("_c") * F.col("_g") > small_group) & (
            F.col("_width") > 1)).alias("_hot")), "groups")
        met = stored(rows.join(groups, "_key"), "met")
        found.append(_verified(met.where("NOT _hot")))
        hot = met.where("_hot")
        if hot.isEmpty():
            break
        rows = stored(_split(hot), "chunks")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs


def _verified(met: DataFrame) -> DataFrame:
    """Pairs of a group one edit apart. The first place at which they differ lies in the broken part, so that a pair
    with a doubled letter at a cut is found on one side of it only."""
    grams = met.select("_key", F.col("word").alias("_v"), F.col("_chunks").alias("_same_size"))
    pair = met.where("_chunks").select("_key", F.col("word").alias("_w"), "_b").join(grams, "_key")
    pair = pair.where("NOT _same_size OR _w < _v").where(
        F.substring("_w", F.lit(1), F.col("_b")) != F.substring("_v", F.lit(1), F.col("_b")))
    return pair.where(F.levenshtein("_w", "_v", 1) == 1).select("_w", "_v")


def spelling_forms(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """One row per row of ``words`` (word, n): word, form, root, n, n_near, form_n.

    n_near counts the words one edit away. ``form`` is the most frequent of these (ties: smallest in code-point order)
    if it is at least ``factor`` (above 1) times as frequent, else NULL; ``form_n`` is its n. ``root`` follows forms to
    the last one; a word without form is its own root. An empty table gives no rows.
    """
    if factor <= 1:
        raise ValueError("a form must be more frequent than its variants: factor above 1")
    counts = words.select("word", "n")
    pairs = stored(near_words(counts), "near-words")
    both = pairs.unionByName(pairs.select(F.col("_v").alias("_w"), F.col("_w").alias("_v")))
    near = both.join(counts.select(F.col("word").alias("_v"), F.col("n").alias("_n")), "_v").groupBy("_w").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("_n")).alias("less"), F.col("_v").alias("word"))).alias("_best"))
    out = counts.join(near, counts["word"] == near["_w"], "left")
    better = -F.col("_best.less") >= factor * F.col("n")
    out = stored(out.select("word", F.when(better, F.col("_best.word")).alias("form"), "n",
                            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                            F.when(better, -F.col("_best.less")).alias("form_n")), "forms")
    roots = _roots(out.where("form IS NOT NULL").select("word", "form"))
    return out.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) by pointer jumping: each round doubles the steps, and every step multiplies n by the factor, so
    the rounds are few."""
    to = forms.select("word", F.col("form").alias("root"))
    while True:
        step = to.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        jumped = stored(to.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root"),
                                                              F.col("_next").isNotNull().alias("_moved")), "roots")
        to = jumped.select("word", "root")
        if jumped.where("_moved").isEmpty():
            return to


def spelling_report(docs: DataFrame) -> DataFrame:
    """Forms of the words of ``documents``, some of which lose a letter first."""
    return spelling_forms(stored(vocabulary(with_lost_letters(letter_runs(docs))), "vocabulary"))


#: crc32 from its rule, over code points below 128 and those of U+00C0 to U+00FF, whose UTF-8 is 195 and 64 less.
_CRC_SQL = """(4294967295 - list_reduce(flatten(list_transform(string_split({text}, ''), lambda c:
  CASE WHEN c = '' THEN [] WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END)),
  lambda a, x: xor(a >> 8, list_extract({table}, (xor(a, x) & 255) + 1)), 4294967295))"""
SPELLING_SQL = f"""WITH RECURSIVE steps AS (
  SELECT b::BIGINT AS b, b::BIGINT AS v, 0 AS k FROM range(256) t(b)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS MATERIALIZED (SELECT list(v ORDER BY b) AS t FROM steps WHERE k = 8),
runs AS MATERIALIZED (SELECT doc_id, translate(run, '{_CAPITALS}', '{_CAPITALS.lower()}') AS run, COUNT(*) AS times
  FROM (SELECT doc_id, UNNEST(regexp_extract_all(COALESCE(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{{MIN_LENGTH},}}')) AS run
        FROM documents) GROUP BY ALL),
hashed AS (SELECT run, times, {_CRC_SQL.format(text="COALESCE(doc_id::VARCHAR, '') || ':' || run", table="crc.t")} AS h
  FROM runs, crc),
words AS MATERIALIZED (SELECT word, SUM(times)::BIGINT AS n FROM (
  SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2)
              ELSE run END AS word, times FROM hashed) WHERE length(word) >= {MIN_LENGTH} GROUP BY word
  HAVING SUM(times) >= {MIN_COUNT}),
less AS MATERIALIZED (SELECT word, i, substring(word, 1, i) || substring(word, i + 2) AS rest
  FROM (SELECT word, UNNEST(range(length(word)))::INT AS i FROM words)),
near AS MATERIALIZED (SELECT a.word AS w, b.word AS v FROM less a JOIN less b USING (i, rest) WHERE a.word != b.word
  UNION SELECT l.word, s.word FROM less l JOIN words s ON l.rest = s.word
  UNION SELECT s.word, l.word FROM less l JOIN words s ON l.rest = s.word),
best AS (SELECT w, v, words.n AS form_n, COUNT(*) OVER (PARTITION BY w) AS n_near,
  ROW_NUMBER() OVER (PARTITION BY w ORDER BY words.n DESC, v) AS r FROM near JOIN words ON v = words.word),
forms AS MATERIALIZED (SELECT word, CASE WHEN form_n >= {FACTOR} * n THEN v END AS form, n, COALESCE(n_near, 0) AS n_near,
  CASE WHEN form_n >= {FACTOR} * n THEN form_n END AS form_n FROM words LEFT JOIN best ON w = word AND r = 1),
walk AS (SELECT word, word AS place, 0 AS k FROM forms
  UNION ALL SELECT walk.word, form, k + 1 FROM walk JOIN forms ON forms.word = walk.place WHERE form IS NOT NULL)
SELECT forms.word, form, ends.place AS root, n, n_near, form_n
FROM forms JOIN (SELECT word, arg_max(place, k) AS place FROM walk GROUP BY word) AS ends ON ends.word = forms.word"""
