"""Inputs of the registered queries: views over the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ratergrid.dims import fan_out
from ratergrid.operators.alignment import (common_core, grid_from_columns, latest_score_grid,
                                           pattern_counts, score_grid_wide)
from ratergrid.operators.hygiene import validity_filter
from ratergrid.schemas import SCORE_COLS

RATERS = ["L1", "L2", "L3", "L4", "L5", "L6", "L7"]
LINE_VARS = ["V1", "V2", "V3", "V4"]
LATEST = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
HUMANS, MODELS = ["L1", "L2"], ["L3", "L4", "L5"]
DOC_RATERS = ["r_chars", "r_words", "r_dots", "r_const"]
# Condition ids as annotation tables hold them.
BASELINE = "neutral"
CONDITIONS = ["subtle_liberal", "subtle_conserv", "extreme_dem", "extreme_rep"]
ALL_CONDITIONS = [BASELINE, *CONDITIONS]
RESPONSE_VARS = ["V1", "V2"]
START, END = "2024-01-05", "2024-01-25"

_LINE_RATINGS = [
    "CAST(l_orderkey AS VARCHAR(20)) AS unit_id",
    "CONCAT('L', CAST(l_linenumber AS VARCHAR(20))) AS rater",
    "CASE WHEN l_quantity <= 16 THEN 1 WHEN l_quantity <= 33 THEN 2 ELSE 3 END AS V1",
    "CASE WHEN l_extendedprice <= 20000 THEN 1 WHEN l_extendedprice <= 50000 THEN 2 ELSE 3 END AS V2",
    "CASE WHEN l_discount <= 0.035 THEN 1 WHEN l_discount <= 0.065 THEN 2 ELSE 3 END AS V3",
    "CASE WHEN l_tax <= 0.075 THEN 1 WHEN l_linestatus = 'F' THEN 2 ELSE 9 END AS V4",
    *LATEST,
]

_WORDS = "LENGTH(text) - LENGTH(REPLACE(text, ' ', ''))"
_DOTS = "LENGTH(text) - LENGTH(REPLACE(text, '.', ''))"
_DOC_RATINGS = [
    "CAST(doc_id AS VARCHAR(20)) AS unit_id", "lang", "source",
    "CASE WHEN n_chars <= 600 THEN 1 WHEN n_chars <= 3000 THEN 2 ELSE 3 END AS r_chars",
    f"CASE WHEN {_WORDS} <= 100 THEN 1 WHEN {_WORDS} <= 450 THEN 2 ELSE 3 END AS r_words",
    f"CASE WHEN {_DOTS} <= 12 THEN 1 WHEN {_DOTS} <= 60 THEN 2 ELSE 3 END AS r_dots",
    "1 AS r_const",
]

_POSTS = [
    "event_id AS id",
    "SUBSTR(CAST(ts AS VARCHAR(40)), 1, 10) AS date_day",
    "CAST(ts AS VARCHAR(40)) AS date",
    "CASE WHEN user_id % 4 = 0 THEN 'es' WHEN user_id % 17 = 0 THEN NULL ELSE 'en' END AS lang",
    "CONCAT(event_type, ' ', props) AS text",
    "props AS rawContent",
    "CAST(FLOOR(value * 3) AS INT) AS likeCount",
    "CASE WHEN event_type = 'error' THEN NULL ELSE CAST(FLOOR(value) AS INT) END AS retweetCount",
    "CAST(user_id % 9 AS INT) AS replyCount",
    "CASE WHEN user_id % 5 = 0 THEN NULL ELSE CAST(user_id % 7 AS INT) END AS quoteCount",
    "CASE WHEN event_id % 7 = 0 THEN 'n/a' WHEN event_id % 5 = 0 THEN NULL "
    "WHEN event_id % 3 = 0 THEN CONCAT(CAST(event_id * 11 AS VARCHAR(20)), '.0') "
    "ELSE CAST(event_id * 11 AS VARCHAR(20)) END AS viewCount",
    "event_type = 'click' AS retweetedTweet",
    "event_type IN ('click', 'purchase') AS quotedTweet",
    "CASE WHEN event_type = 'view' THEN CONCAT('u', CAST(user_id AS VARCHAR(20))) END "
    "AS in_reply_to_screen_name",
    "CAST(NULL AS VARCHAR(20)) AS hashtags",
    "CONCAT('post/', CAST(event_id AS VARCHAR(20))) AS url",
    "CONCAT('u', CAST(user_id AS VARCHAR(20))) AS user_name",
]


def _condition_score(unit: str, k: str, order: str) -> str:
    return (f"CASE WHEN ({unit} * 7 + {k} * 3) % 10 < 6 - {k} % 3 THEN 1 "
            f"WHEN ({unit} * 7 + {k} * 3 + {order} * (CASE WHEN {unit} % 9 = 0 THEN 1 ELSE 0 END)) "
            f"% 10 < 8 THEN 2 ELSE 3 END")


_FENCE_OPEN = "CASE WHEN doc_id % 11 = 0 THEN CONCAT('```json', CHR(10)) ELSE '' END"
_FENCE_CLOSE = "CASE WHEN doc_id % 11 = 0 THEN CONCAT(CHR(10), '```') ELSE '' END"
_RAW_TEXT = (
    f"CONCAT({_FENCE_OPEN}, '{{\"V1\":{{\"score\":', CASE WHEN doc_id % 13 = 0 AND attempt < 3 "
    "THEN '5' ELSE CAST(1 + (quality + toxic) % 3 AS VARCHAR(5)) END, ',\"V1_reason\":\"q\"}', "
    "CASE WHEN doc_id % 17 = 0 AND attempt = 1 THEN '' ELSE CONCAT(',\"V2\":{\"score\":', "
    "CAST(1 + toxic AS VARCHAR(5)), ',\"V2_reason\":\"t\"}') END, "
    f"CASE WHEN doc_id % 19 = 0 THEN '' ELSE '}}' END, {_FENCE_CLOSE})")

_VALUES = lambda rows: ", ".join(f"({', '.join(map(repr, r))})" for r in rows)

FIXTURE_SQL = {
    "fx_ratings_raw": f"SELECT {', '.join(_LINE_RATINGS)} FROM lineitem",
    "fx_latest":
        "SELECT unit_id, rater, V1, V2, V3, V4 FROM (SELECT *, ROW_NUMBER() OVER ("
        "PARTITION BY unit_id, rater ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, "
        "l_extendedprice DESC, V1 DESC, V2 DESC, V3 DESC, V4 DESC) AS rn FROM fx_ratings_raw "
        "WHERE V1 IN (1, 2, 3) AND V2 IN (1, 2, 3) AND V3 IN (1, 2, 3) AND V4 IN (1, 2, 3)) q "
        "WHERE rn = 1",
    "fx_ratings": " UNION ALL ".join(
        f"SELECT unit_id, rater, '{v}' AS variable, {v} AS score FROM fx_latest" for v in LINE_VARS),
    "fx_pairs":
        "SELECT x.rater AS rater_a, y.rater AS rater_b, x.variable, x.unit_id, x.score AS a, "
        "y.score AS b FROM fx_ratings x JOIN fx_ratings y ON x.unit_id = y.unit_id "
        "AND x.variable = y.variable AND x.rater < y.rater",
    "fx_docs_wide": f"SELECT {', '.join(_DOC_RATINGS)} FROM documents",
    "fx_docs": " UNION ALL ".join(
        f"SELECT unit_id, {i} AS ord, '{r}' AS rater, 'V1' AS variable, {r} AS score FROM fx_docs_wide"
        for i, r in enumerate(DOC_RATERS)),
    "fx_posts": f"SELECT {', '.join(_POSTS)} FROM events",
    "fx_pool":
        "SELECT * FROM fx_posts WHERE lang = 'en' AND date >= '2024-01-05' AND date <= '2024-01-25'",
    "fx_tiered":
        "SELECT *, CASE WHEN likeCount <= 50 THEN 'low' WHEN likeCount <= 500 THEN 'medium' "
        "ELSE 'high' END AS engagement_level FROM fx_pool",
    "fx_conditions":
        "SELECT CAST(d.doc_id AS VARCHAR(20)) AS unit_id, c.condition, c.ord, v.variable, "
        f"{_condition_score('d.doc_id', 'v.k', 'c.ord')} AS score FROM documents d CROSS JOIN "
        f"(VALUES {_VALUES([(c, i) for i, c in enumerate(ALL_CONDITIONS)])}) AS c(condition, ord) "
        f"CROSS JOIN (VALUES {_VALUES([(v, i) for i, v in enumerate(SCORE_COLS, 1)])}) AS v(variable, k)",
    "fx_condition_pairs":
        "SELECT x.condition AS rater_a, y.condition AS rater_b, x.ord AS ord_a, y.ord AS ord_b, "
        "x.variable, x.unit_id, x.score AS a, y.score AS b FROM fx_conditions x JOIN fx_conditions y "
        "ON x.unit_id = y.unit_id AND x.variable = y.variable AND x.ord < y.ord",
    "fx_raw_responses":
        "SELECT CAST(doc_id AS VARCHAR(20)) AS unit_id, doc_id, 'm1' AS rater, attempt, "
        f"{_RAW_TEXT} AS raw_text FROM labels CROSS JOIN (VALUES (1), (2), (3)) AS a(attempt)",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide ratings with repeated keys, missing raters and invalid V4 scores."""
    return table(spark, sf_dir, "lineitem").selectExpr(*_LINE_RATINGS)


def line_grid(spark: SparkSession, sf_dir: str, raters: list[str] = RATERS) -> DataFrame:
    """Valid, latest ratings side by side."""
    valid = validity_filter(line_ratings(spark, sf_dir), LINE_VARS)
    return latest_score_grid(valid, raters, LATEST, LINE_VARS)


def line_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_counts(line_grid(spark, sf_dir), RATERS)


def doc_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with three correlated raters and a constant one."""
    return table(spark, sf_dir, "documents").selectExpr(*_DOC_RATINGS)


def doc_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_from_columns(doc_ratings(spark, sf_dir), DOC_RATERS, "V1")


def doc_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_counts(doc_grid(spark, sf_dir), DOC_RATERS)


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Post-shaped rows with missing languages, junk view counts and overlapping flags."""
    df = table(spark, sf_dir, "events").selectExpr(*_POSTS)
    return df.withColumnRenamed("user_name", "user")


def condition_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide scores per document and framing condition; conditions act as raters."""
    framed = table(spark, sf_dir, "documents").select("doc_id", fan_out(
        [{"rater": c, "ord": i} for i, c in enumerate(ALL_CONDITIONS)]))
    scores = [f"{_condition_score('doc_id', str(k), 'ord')} AS {v}"
              for k, v in enumerate(SCORE_COLS, 1)]
    return framed.selectExpr("CAST(doc_id AS STRING) AS unit_id", "rater", *scores)


def condition_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = score_grid_wide(condition_annotations(spark, sf_dir), ALL_CONDITIONS)
    return common_core(grid, ALL_CONDITIONS)


def condition_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_counts(condition_grid(spark, sf_dir), ALL_CONDITIONS)


def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response log with fences, bad scores, missing variables and truncated JSON."""
    tries = table(spark, sf_dir, "labels").withColumn(
        "attempt", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return tries.selectExpr("CAST(doc_id AS STRING) AS unit_id", "'m1' AS rater", "attempt",
                            f"{_RAW_TEXT} AS raw_text")
