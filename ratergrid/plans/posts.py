"""Filters, projections and scalar functions over posts, prompts and flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratergrid.functions.codebook import codebook_rating
from ratergrid.functions.posts import to_long_or_zero, to_timestamp_or_null
from ratergrid.operators import posts as P, workplan as W
from ratergrid.operators.hygiene import condition_label_map, display_name_map, drop_legacy_rater
from ratergrid.plans.fixtures import (ALL_CONDITIONS, END, START, condition_annotations,
                                      line_ratings, posts, table)
from ratergrid.plans.registry import query, with_ctes
from ratergrid.schemas import SCORE_COLS

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
_TYPE = ("CASE WHEN COALESCE(retweetedTweet, FALSE) THEN 'retweet' "
         "WHEN COALESCE(quotedTweet, FALSE) THEN 'quote' "
         "WHEN in_reply_to_screen_name IS NOT NULL THEN 'reply' ELSE 'tweet' END")


@query("filter_language", with_ctes({}, "SELECT doc_id, lang, text FROM documents WHERE lang = 'en'"))
def _(spark, sf):
    return P.filter_language(table(spark, sf, "documents").select("doc_id", "lang", "text"), "en")


@query("filter_date_range", with_ctes({}, f"SELECT id, date FROM fx_posts WHERE date >= '{START}' AND date <= '{END}'"))
def _(spark, sf):
    return P.filter_date_range(posts(spark, sf).select("id", "date"), START, END)


@query("filter_date_range_days", with_ctes({}, f"SELECT id, date FROM fx_posts WHERE CAST(SUBSTR(date, 1, 10) AS DATE) BETWEEN DATE '{START}' AND DATE '{END}'"))
def _(spark, sf):
    return P.filter_date_range(posts(spark, sf).select("id", "date"), START, END, mode="date")


@query("skip_counters", with_ctes({}, f"""
SELECT COUNT(*) AS processed,
  COUNT(CASE WHEN lang = 'en' AND date BETWEEN '{START}' AND '{END}' THEN 1 END) AS kept,
  COUNT(CASE WHEN lang IS NULL OR lang <> 'en' THEN 1 END) AS skipped_language,
  COUNT(CASE WHEN lang = 'en' AND (date IS NULL OR date < '{START}' OR date > '{END}') THEN 1 END) AS skipped_date
FROM fx_posts"""))
def _(spark, sf):
    return P.skip_counters(posts(spark, sf), "en", START, END)


_RENAMED = """SELECT id AS tweet_id, date, lang AS language, text, rawContent AS raw_content,
  likeCount AS like_count, retweetCount AS retweet_count, replyCount AS reply_count,
  quoteCount AS quote_count, viewCount AS view_count, retweetedTweet AS retweeted_tweet,
  quotedTweet AS quoted_tweet, in_reply_to_screen_name, hashtags, url, user_name AS "user" FROM fx_posts"""


@query("project_rename", with_ctes({}, _RENAMED))
def _(spark, sf):
    return P.project_rename(posts(spark, sf))


@query("null_to_zero", with_ctes({}, """SELECT id, likeCount, COALESCE(retweetCount, 0) AS retweetCount,
  COALESCE(quoteCount, 0) AS quoteCount FROM fx_posts"""))
def _(spark, sf):
    df = posts(spark, sf).select("id", "likeCount", "retweetCount", "quoteCount")
    return P.null_to_zero(df, ["likeCount", "retweetCount", "quoteCount"])


@query("safe_cast_numeric", with_ctes({}, """SELECT id, viewCount,
  COALESCE(CAST(TRY_CAST(viewCount AS DOUBLE) AS BIGINT), 0) AS view_count FROM fx_posts"""))
def _(spark, sf):
    return posts(spark, sf).select("id", "viewCount",
                                   to_long_or_zero(F.col("viewCount")).alias("view_count"))


_MESSY = {"messy": """SELECT id, CASE id % 11 WHEN 0 THEN 'n/a' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN '2024-13-45 01:02:03'
  WHEN 4 THEN CONCAT('about ', date) WHEN 5 THEN SUBSTR(date, 1, 10) WHEN 6 THEN '2024-02-30' ELSE date END AS text FROM fx_posts"""}


@query("safe_cast_timestamp", with_ctes(_MESSY, """SELECT id, text, STRFTIME(TRY_CAST(text AS TIMESTAMP),
  '%Y-%m-%d %H:%M:%S.%f') AS date_text FROM messy"""))
def _(spark, sf):
    """Words, blanks, dates that do not exist and dates without a time among the stamps."""
    kind = F.col("id") % 11
    text = (F.when(kind == 0, "n/a").when(kind == 1, "").when(kind == 2, None).when(kind == 3, "2024-13-45 01:02:03")
            .when(kind == 4, F.concat(F.lit("about "), "date")).when(kind == 5, F.substring("date", 1, 10))
            .when(kind == 6, "2024-02-30").otherwise(F.col("date")))
    messy = posts(spark, sf).select("id", text.alias("text"))
    return messy.select("id", "text", F.date_format(to_timestamp_or_null(F.col("text")), STAMP).alias("date_text"))


def _pool(spark, sf):
    return P.ingest_posts(posts(spark, sf), "en", START, END)


@query("ingest_posts", with_ctes({}, f"""SELECT id AS tweet_id, date, lang AS language, text, rawContent AS raw_content,
  COALESCE(likeCount, 0) AS like_count, COALESCE(retweetCount, 0) AS retweet_count,
  COALESCE(replyCount, 0) AS reply_count, COALESCE(quoteCount, 0) AS quote_count, viewCount AS view_count,
  retweetedTweet AS retweeted_tweet, quotedTweet AS quoted_tweet, in_reply_to_screen_name, hashtags, url,
  user_name AS "user", {_TYPE} AS post_type FROM fx_pool"""))
def _(spark, sf):
    return _pool(spark, sf)


@query("cast_sample_types", with_ctes({}, """SELECT CAST(id AS INT) AS row_id, id AS tweet_id,
  STRFTIME(TRY_CAST(date AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f') AS date_text, COALESCE(likeCount, 0) AS like_count,
  COALESCE(retweetCount, 0) AS retweet_count, COALESCE(replyCount, 0) AS reply_count,
  COALESCE(quoteCount, 0) AS quote_count,
  COALESCE(CAST(TRY_CAST(viewCount AS DOUBLE) AS BIGINT), 0) AS view_count FROM fx_posts"""))
def _(spark, sf):
    df = P.cast_sample_types(P.project_rename(posts(spark, sf)).withColumn("row_id", F.col("tweet_id")))
    return df.select("row_id", "tweet_id", F.date_format("date", STAMP).alias("date_text"), *P.COUNT_COLS,
                     "view_count")


@query("reorder_columns", with_ctes({}, """SELECT likeCount AS like_count, id AS tweet_id, lang AS language,
  date FROM fx_posts"""))
def _(spark, sf):
    return P.reorder_columns(P.project_rename(posts(spark, sf)),
                             ["like_count", "tweet_id", "language", "date"])


@query("derive_post_type", with_ctes({}, f"SELECT id AS tweet_id, {_TYPE} AS post_type FROM fx_posts"))
def _(spark, sf):
    return P.derive_post_type(P.project_rename(posts(spark, sf))).select("tweet_id", "post_type")


@query("classify_engagement", with_ctes({}, """SELECT id AS tweet_id, likeCount AS like_count,
  CASE WHEN likeCount <= 50 THEN 'low' WHEN likeCount <= 500 THEN 'medium' ELSE 'high' END AS engagement_level
  FROM fx_posts"""))
def _(spark, sf):
    df = P.project_rename(posts(spark, sf)).select("tweet_id", "like_count")
    return P.classify_engagement(df)


@query("add_sample_metadata", with_ctes({}, """SELECT id, CAST(NULL AS VARCHAR) AS dataset_split,
  'engagement_stratified' AS sampling_strategy FROM fx_posts"""))
def _(spark, sf):
    return P.add_sample_metadata(posts(spark, sf).select("id")).drop("sampled_at")


@query("text_length", "SELECT doc_id, CAST(LENGTH(text) AS INT) AS text_length FROM documents")
def _(spark, sf):
    return P.add_text_length(table(spark, sf, "documents").select("doc_id", "text")).drop("text")


# ------------------------------------------------------------------------------ prompts and plans

MODELS = [{"llm_id": 1, "llm_name_version": "model-one-2024"}, {"llm_id": 3, "llm_name_version": "model-three-8b"},
          {"llm_id": 4, "llm_name_version": "model-four"}]
VARIANTS = [{"prompt_variant": "A"}, {"prompt_variant": "B"}]
PROMPTS = [
    ("A", "Rules one", "Reply with JSON", " | kind of post: ", " | body: [", "]"),
    ("B", "Rules two", "Reply with JSON", " / a ", " that says <", ">"),
]
SYSTEM_PROMPTS = {c: f"You rate posts. Framing: {c}." for c in ALL_CONDITIONS}
CONDITION_LABELS = {"subtle_liberal": "hint left", "subtle_conserv": "hint right",
                    "extreme_dem": "push left", "extreme_rep": "push right"}

_PROMPT_SQL = """SELECT doc_id, 'A' AS prompt_variant, CONCAT('Rules one', CHR(10), 'Reply with JSON',
  ' | kind of post: ', source, ' | body: [', text, ']') AS prompt FROM documents
  UNION ALL SELECT doc_id, 'B', CONCAT('Rules two', CHR(10), 'Reply with JSON',
  ' / a ', source, ' that says <', text, '>') FROM documents"""


def _prompts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("post_type"), "text")
    return W.build_prompt(W.work_plan_cross(docs, VARIANTS), PROMPTS).select(
        "doc_id", "prompt_variant", "prompt")


@query("build_prompt", _PROMPT_SQL)
def _(spark, sf):
    return _prompts(spark, sf)


@query("prompt_length", f"SELECT doc_id, prompt_variant, CAST(LENGTH(prompt) AS INT) AS prompt_length "
                        f"FROM ({_PROMPT_SQL}) q")
def _(spark, sf):
    return W.add_prompt_length(_prompts(spark, sf)).drop("prompt")


@query("system_prompt_lookup", """SELECT doc_id, c.condition, CONCAT('You rate posts. Framing: ', c.condition, '.')
  AS system_prompt FROM documents CROSS JOIN (VALUES ('neutral'), ('subtle_liberal'), ('subtle_conserv'),
  ('extreme_dem'), ('extreme_rep')) AS c(condition)""")
def _(spark, sf):
    plan = W.work_plan_cross(table(spark, sf, "documents").select("doc_id"),
                             [{"condition": c} for c in ALL_CONDITIONS])
    return W.system_prompt_lookup(plan, SYSTEM_PROMPTS).select("doc_id", "condition", "system_prompt")


@query("work_plan_cross", """SELECT doc_id, m.llm_id, m.llm_name_version FROM documents CROSS JOIN
  (VALUES (1, 'model-one-2024'), (3, 'model-three-8b'), (4, 'model-four')) AS m(llm_id, llm_name_version)""")
def _(spark, sf):
    return W.work_plan_cross(table(spark, sf, "documents").select("doc_id"), MODELS)


_DONE_SQL = {
    "done": "SELECT doc_id, 1 AS llm_id FROM labels UNION ALL SELECT doc_id, 3 FROM labels WHERE quality = 1 "
            "UNION ALL SELECT doc_id, 2 FROM labels",
    "work": "SELECT doc_id, m.llm_id, m.llm_name_version FROM documents CROSS JOIN (VALUES "
            "(1, 'model-one-2024'), (3, 'model-three-8b'), (4, 'model-four')) AS m(llm_id, llm_name_version)",
}


def _done(spark, sf):
    """Model 1 rated every labelled document, model 3 the good ones; model 2 is no longer planned."""
    labels = table(spark, sf, "labels")
    ids = F.when(F.col("quality") == 1, F.array(F.lit(1), F.lit(3), F.lit(2))).otherwise(
        F.array(F.lit(1), F.lit(2)))
    return labels.select("doc_id", F.explode(ids).alias("llm_id"))


@query("remaining_work", with_ctes(_DONE_SQL, """SELECT doc_id, llm_id, llm_name_version FROM work w WHERE NOT EXISTS
  (SELECT 1 FROM done d WHERE d.doc_id = w.doc_id AND d.llm_id = w.llm_id)"""))
def _(spark, sf):
    return W.remaining_work(table(spark, sf, "documents").select("doc_id"), MODELS,
                            _done(spark, sf), "doc_id", "llm_id")


@query("progress_report", with_ctes(_DONE_SQL, """SELECT COUNT(*) AS total, COUNT(d.doc_id) AS done,
  COUNT(*) - COUNT(d.doc_id) AS remaining FROM work w LEFT JOIN (SELECT DISTINCT * FROM done) d
  ON d.doc_id = w.doc_id AND d.llm_id = w.llm_id"""))
def _(spark, sf):
    return W.progress_report(table(spark, sf, "documents"), MODELS, _done(spark, sf), "doc_id", "llm_id")


# --------------------------------------------------------------------------------- names and rules

@query("display_name_map", with_ctes({}, """SELECT unit_id, CASE rater WHEN 'L1' THEN 'Human P1'
  WHEN 'L2' THEN 'Human P2' ELSE rater END AS rater, V1 FROM fx_ratings_raw"""))
def _(spark, sf):
    df = line_ratings(spark, sf).select("unit_id", "rater", "V1")
    return display_name_map(df, {"L1": "Human P1", "L2": "Human P2"})


@query("drop_legacy_rater", with_ctes({}, "SELECT unit_id, rater, V1 FROM fx_ratings_raw WHERE rater <> 'L7'"))
def _(spark, sf):
    return drop_legacy_rater(line_ratings(spark, sf).select("unit_id", "rater", "V1"), ["L7"])


@query("condition_label_map", with_ctes({}, """SELECT unit_id, condition, CASE condition
  WHEN 'subtle_liberal' THEN 'hint left' WHEN 'subtle_conserv' THEN 'hint right'
  WHEN 'extreme_dem' THEN 'push left' WHEN 'extreme_rep' THEN 'push right' END AS condition_label
  FROM fx_conditions WHERE variable = 'V1'"""))
def _(spark, sf):
    df = condition_annotations(spark, sf).select("unit_id", F.col("rater").alias("condition"))
    return condition_label_map(df, CONDITION_LABELS)


_FLAGS = {"flags": "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity > 25 AS a, l_discount > 0.05 AS b, "
                   "l_tax > 0.04 AS b1, l_returnflag = 'R' AS b2 FROM lineitem"}
_TWO = "1 + CAST(a AS INT) + CAST(b AS INT)"
_ACT = ("CASE WHEN NOT a AND NOT b1 AND NOT b2 THEN 1 WHEN NOT a AND (b1 OR b2) THEN 2 "
        "WHEN a AND b1 AND b2 THEN 3 END")
_CAND = ("CASE WHEN NOT a AND NOT b1 AND NOT b2 THEN 1 WHEN a AND NOT b1 AND NOT b2 THEN 2 "
         "WHEN a AND b1 AND b2 THEN 3 END")
_DIST = ("CASE WHEN NOT a AND NOT b1 AND NOT b2 THEN 1 WHEN a AND NOT b1 AND NOT b2 THEN 2 "
         "WHEN a AND (b1 OR b2) THEN 3 END")
_RULES = {"V1": _TWO, "V2": _ACT, "V3": _ACT, "V4": _CAND, "V5": _TWO, "V6": _TWO, "V7": _DIST, "V8": _TWO}


@query("codebook_rating", with_ctes(_FLAGS, "SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(
    f"{rule} AS {v}" for v, rule in _RULES.items()) + " FROM flags"))
def _(spark, sf):
    flags = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") > 25).alias("a"),
        (F.col("l_discount") > 0.05).alias("b"), (F.col("l_tax") > 0.04).alias("b1"),
        (F.col("l_returnflag") == "R").alias("b2"))
    a, b, b1, b2 = map(F.col, ("a", "b", "b1", "b2"))
    return flags.select("l_orderkey", "l_linenumber", "l_partkey",
                        *[codebook_rating(v, a, b, b1, b2).alias(v) for v in SCORE_COLS])
