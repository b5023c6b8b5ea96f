"""Response log: cleaning, parsing, validation, attempts, and the scorer hook."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from ratergrid.functions.text import strip_code_fences
from ratergrid.operators import responses as R
from ratergrid.plans.fixtures import RESPONSE_VARS, raw_responses, table
from ratergrid.plans.registry import query, with_ctes

# The scorer below travels with its task, as a user's scorer defined in a notebook would.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_READ = {
    "cleaned": "SELECT unit_id, doc_id, rater, attempt, raw_text, REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE("
               "REGEXP_REPLACE(raw_text, '```(?:json)?\\s*', '', 'g'), '^\\s+|\\s+$', '', 'g'), '`+$', ''), "
               "'^\\s+|\\s+$', '', 'g') AS cleaned FROM fx_raw_responses",
    "parsed": "SELECT *, JSON_VALID(cleaned) AS ok, CASE WHEN JSON_VALID(cleaned) THEN "
              "TRY_CAST(JSON_EXTRACT_STRING(cleaned, '$.V1.score') AS DOUBLE) END AS s1, CASE WHEN JSON_VALID(cleaned) "
              "THEN TRY_CAST(JSON_EXTRACT_STRING(cleaned, '$.V2.score') AS DOUBLE) END AS s2, "
              "CASE WHEN JSON_VALID(cleaned) THEN JSON_EXTRACT_STRING(cleaned, '$.V1.V1_reason') END AS t1, "
              "CASE WHEN JSON_VALID(cleaned) THEN JSON_EXTRACT_STRING(cleaned, '$.V2.V2_reason') END AS t2, "
              "CASE WHEN JSON_VALID(cleaned) THEN JSON_EXTRACT(cleaned, '$.V1') IS NOT NULL END AS has1, "
              "CASE WHEN JSON_VALID(cleaned) THEN JSON_EXTRACT(cleaned, '$.V2') IS NOT NULL END AS has2 FROM cleaned",
    "checked": "SELECT *, CASE WHEN NOT ok THEN 'parse' WHEN NOT has1 THEN 'missing_variable' "
               "WHEN s1 IS NULL OR s1 NOT IN (1, 2, 3) THEN 'invalid_score' WHEN NOT has2 THEN 'missing_variable' "
               "WHEN s2 IS NULL OR s2 NOT IN (1, 2, 3) THEN 'invalid_score' WHEN t1 IS NULL OR t2 IS NULL "
               "THEN 'missing_reason' END AS error_code, CASE WHEN NOT ok THEN NULL WHEN NOT has1 THEN 'V1' "
               "WHEN s1 IS NULL OR s1 NOT IN (1, 2, 3) THEN 'V1' WHEN NOT has2 THEN 'V2' WHEN s2 IS NULL OR "
               "s2 NOT IN (1, 2, 3) THEN 'V2' WHEN t1 IS NULL THEN 'V1' WHEN t2 IS NULL THEN 'V2' END "
               "AS error_variable FROM parsed",
}
FIRST_VALID = {**_READ, "first_ok": "SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY unit_id, rater "
                                    "ORDER BY attempt) AS rn FROM checked WHERE error_code IS NULL "
                                    "AND attempt <= 10) q WHERE rn = 1"}
KEY = "unit_id, rater"


def _read(spark, sf):
    return R.read_responses(raw_responses(spark, sf), RESPONSE_VARS)


@query("strip_code_fences", with_ctes(_READ, "SELECT unit_id, attempt, cleaned FROM cleaned"))
def _(spark, sf):
    return raw_responses(spark, sf).select("unit_id", "attempt",
                                           strip_code_fences(F.col("raw_text")).alias("cleaned"))


@query("parse_annotation_json", with_ctes(_READ, "SELECT unit_id, attempt, ok AS parsed, s1 AS V1, s2 AS V2 FROM parsed"))
def _(spark, sf):
    df = R.parse_annotation_json(raw_responses(spark, sf), RESPONSE_VARS)
    return df.select("unit_id", "attempt", "parsed",
                     *[R.score_value(F.col(f"annotation.{v}.score")).alias(v) for v in RESPONSE_VARS])


@query("validate_annotation", with_ctes(_READ, "SELECT unit_id, attempt, error_code, error_variable, "
                                               "error_code IS NULL AS valid FROM checked"))
def _(spark, sf):
    return _read(spark, sf).select("unit_id", "attempt", "error_code", "error_variable", "valid")


@query("flatten_annotation", with_ctes(_READ, """SELECT unit_id, rater, attempt, CAST(s1 AS INT) AS V1, t1 AS V1_reason,
  CAST(s2 AS INT) AS V2, t2 AS V2_reason, CAST(s1 + s2 AS INT) AS total_score FROM checked WHERE error_code IS NULL"""))
def _(spark, sf):
    return R.flatten_annotation(_read(spark, sf), RESPONSE_VARS).drop("raw_text")


@query("first_valid_attempt", with_ctes(FIRST_VALID, """SELECT unit_id, rater, attempt, CAST(s1 AS INT) AS V1, t1 AS V1_reason,
  CAST(s2 AS INT) AS V2, t2 AS V2_reason, CAST(s1 + s2 AS INT) AS total_score FROM first_ok"""))
def _(spark, sf):
    return R.first_valid_attempt(_read(spark, sf), RESPONSE_VARS)


@query("failed_keys", with_ctes(_READ, f"""SELECT {KEY}, COUNT(*) AS attempts, ARG_MAX(error_code, attempt) AS last_error,
  CAST(NULL AS VARCHAR) AS last_variable FROM checked GROUP BY {KEY} HAVING COUNT(error_code) = COUNT(*)"""))
def _(spark, sf):
    return R.failed_keys(_read(spark, sf))


@query("retry_wait_seconds", with_ctes(_READ, f"""SELECT {KEY}, CAST(SUM(CASE WHEN error_code IS NOT NULL AND attempt < 10
  THEN 15 * attempt ELSE 0 END) AS BIGINT) AS wait_seconds FROM checked GROUP BY {KEY}"""))
def _(spark, sf):
    return R.retry_wait_seconds(_read(spark, sf))


@query("error_breakdown", with_ctes(_READ, """SELECT error_code, COUNT(*) AS n FROM checked WHERE error_code IS NOT NULL
  GROUP BY error_code"""))
def _(spark, sf):
    return R.error_breakdown(_read(spark, sf))


@query("annotations_to_ratings", with_ctes(FIRST_VALID, """SELECT unit_id, rater, 'V1' AS variable, CAST(s1 AS INT) AS score
  FROM first_ok UNION ALL SELECT unit_id, rater, 'V2', CAST(s2 AS INT) FROM first_ok"""))
def _(spark, sf):
    return R.annotations_to_ratings(R.first_valid_attempt(_read(spark, sf), RESPONSE_VARS), RESPONSE_VARS)


def stub_scorer(text: str, post_type: str, prompt: str, system_prompt: str) -> str:
    """Stands in for a user's model: rates a post by its length, fails on very long ones."""
    size = len(text)
    if size > 20000:
        raise ValueError("too long")
    return ('{"V1":{"score":%d,"V1_reason":"%d characters"},"V2":{"score":%d,"V2_reason":"%s"}}'
            % (1 + (size > 600) + (size > 3000), size, 1 + ("." in text), post_type))


@query("annotator_hook", """SELECT CAST(doc_id AS VARCHAR) AS unit_id, 'stub' AS rater, CAST(1 AS INT) AS attempt,
  CASE WHEN LENGTH(text) <= 20000 THEN CONCAT('{"V1":{"score":',
  CASE WHEN LENGTH(text) > 3000 THEN '3' WHEN LENGTH(text) > 600 THEN '2' ELSE '1' END, ',"V1_reason":"',
  CAST(LENGTH(text) AS VARCHAR), ' characters"},"V2":{"score":', CASE WHEN CONTAINS(text, '.') THEN '2' ELSE '1' END,
  ',"V2_reason":"', source, '"}}') END AS raw_text,
  CASE WHEN LENGTH(text) > 20000 THEN 'ValueError: too long' END AS error FROM documents""")
def _(spark, sf):
    work = table(spark, sf, "documents").select(
        F.col("doc_id").alias("unit_id"), F.lit("stub").alias("rater"), "text",
        F.col("source").alias("post_type"), F.lit("").alias("prompt"), F.lit("").alias("system_prompt"))
    return R.annotator_hook(work, stub_scorer, tasks=spark.sparkContext.defaultParallelism)
