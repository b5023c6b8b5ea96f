"""Sources and sinks. Files are written below the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratergrid import sources as S
from ratergrid.operators import posts as P, sampling as Z
from ratergrid.operators.profile import score_counts, score_distribution
from ratergrid.operators.hygiene import melt_scores
from ratergrid.plans.fixtures import (END, START, condition_annotations, line_ratings, posts, table)
from ratergrid.plans.posts import STAMP
from ratergrid.plans.registry import query, with_ctes
from ratergrid.plans.sampling import SAMPLE_SQL, SEED, SIZE
from ratergrid.schemas import SAMPLED_POST_SCHEMA
from ratergrid.session import scratch_path


@query("scan_parquet", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _(spark, sf):
    return S.scan_parquet(spark, f"{sf}/documents.parquet")


PARTS = {"click": [1, 3], "purchase": [2], "view": [1, 2, 3, 4]}
_CHOSEN = " OR ".join(f"(event_type = '{p}' AND event_id % 4 + 1 IN ({', '.join(map(str, c))}))"
                      for p, c in PARTS.items())


@query("scan_parquet_parts", f"SELECT event_id, user_id, value FROM events WHERE {_CHOSEN}")
def _(spark, sf):
    """Written as part/chunk folders, of which the listed ones are read: choosing chunks is the feature."""
    root = scratch_path(spark, "parts")
    events = table(spark, sf, "events").select(
        "event_id", "user_id", "value", F.col("event_type").alias("part"),
        (F.col("event_id") % 4 + 1).alias("chunk"))
    events.write.partitionBy("part", "chunk").parquet(root)
    return S.scan_parquet_parts(spark, root, PARTS, "part={part}/chunk={chunk}")


@query("evenly_spaced_chunks", """WITH bounds AS (SELECT event_type, MIN(event_id) AS lo, MAX(event_id) AS hi FROM events
  GROUP BY event_type) SELECT event_type, lo, hi, CAST(s.step AS INT) AS step,
  lo + (s.step * (hi - lo)) // 5 AS chunk FROM bounds CROSS JOIN (SELECT UNNEST(GENERATE_SERIES(0, 5)) AS step) s""")
def _(spark, sf):
    bounds = table(spark, sf, "events").groupBy("event_type").agg(
        F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    return S.evenly_spaced_chunks(bounds, 6)


def _docs_as_posts(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("tweet_id"), F.col("source").alias("post_type"), "text")


_DOC_POSTS = "SELECT CAST(doc_id AS VARCHAR) AS tweet_id, source AS post_type, text FROM documents"


@query("scan_csv", _DOC_POSTS)
def _(spark, sf):
    path = scratch_path(spark, "csv")
    S.sink_csv(_docs_as_posts(spark, sf), path)
    return S.scan_csv(spark, path, schema=SAMPLED_POST_SCHEMA, required=["tweet_id", "post_type", "text"])


@query("scan_csv_split", _DOC_POSTS)
def _(spark, sf):
    """Files with line breaks in their texts, written in parallel; many tasks read each one that is longer than a range."""
    path = scratch_path(spark, "csv")
    S.sink_csv(_docs_as_posts(spark, sf), path)
    return S.scan_csv_split(spark, path, schema=SAMPLED_POST_SCHEMA, required=["tweet_id", "post_type", "text"])


@query("sink_csv", with_ctes({}, """SELECT rater, variable, CAST(s.score AS INT) AS score, COUNT(r.score) AS n FROM
  (SELECT DISTINCT condition AS rater, variable FROM fx_conditions) g CROSS JOIN (VALUES (1), (2), (3)) AS s(score)
  LEFT JOIN fx_conditions r ON r.condition = g.rater AND r.variable = g.variable AND r.score = s.score
  GROUP BY rater, g.variable, s.score""".replace("SELECT rater, variable,", "SELECT rater, g.variable AS variable,")))
def _(spark, sf):
    path = scratch_path(spark, "report")
    report = score_distribution(score_counts(melt_scores(condition_annotations(spark, sf))))
    S.sink_csv(report, path, single_file=True)
    return S.scan_csv(spark, path, schema="rater string, variable string, score int, n bigint")


@query("convert_parquet_to_csv", _DOC_POSTS.replace("CAST(doc_id AS VARCHAR) AS tweet_id, source AS post_type, text",
                                                    "doc_id, lang, text"))
def _(spark, sf):
    path = scratch_path(spark, "converted")
    S.convert_parquet_to_csv(spark, f"{sf}/documents.parquet", path, ["doc_id", "lang", "text"])
    return S.scan_csv(spark, path, schema="doc_id bigint, lang string, text string")


@query("scan_done_keys", """SELECT CAST(doc_id AS VARCHAR) AS tweet_id, m.llm_id FROM labels CROSS JOIN
  (VALUES ('1'), ('3')) AS m(llm_id)""")
def _(spark, sf):
    path = scratch_path(spark, "done")
    pair = lambda label: F.array(F.col("doc_id"), F.lit(label).cast("bigint"))
    table(spark, sf, "labels").select(F.array(pair(1), pair(3)).alias("completed")).write.json(path)
    return S.scan_done_keys(spark, path)


@query("sink_parquet_typed", with_ctes(SAMPLE_SQL, """SELECT CAST(row_id AS INT) AS row_id,
  STRFTIME(TRY_CAST(date AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f') AS date_text, engagement_level, lang AS language, likeCount AS like_count,
  COALESCE(CAST(TRY_CAST(viewCount AS DOUBLE) AS BIGINT), 0) AS view_count, text, id AS tweet_id,
  CAST(NULL AS VARCHAR) AS dataset_split, 'engagement_stratified' AS sampling_strategy FROM sampled"""))
def _(spark, sf):
    """The whole sampling run: ingest, tier, sample, add metadata, write typed, read back."""
    path = scratch_path(spark, "sample")
    pool = P.classify_engagement(P.ingest_posts(posts(spark, sf), "en", START, END))
    sample = Z.stratified_sample(pool, "engagement_level", Z.tier_quota(SIZE), "tweet_id", SEED)
    S.sink_parquet_typed(P.add_sample_metadata(sample), path)
    return S.scan_parquet(spark, path).select(
        "row_id", F.date_format("date", STAMP).alias("date_text"), "engagement_level", "language", "like_count",
        "view_count", "text", "tweet_id", "dataset_split", "sampling_strategy")


@query("existing_output_resume", "SELECT doc_id, quality, toxic FROM labels")
def _(spark, sf):
    """A second run over everything adds only what the first run did not store."""
    path = scratch_path(spark, "resume")
    labels = table(spark, sf, "labels")
    S.append_keyed(spark, labels.where("quality = 1"), path, ["doc_id"])
    S.append_keyed(spark, labels, path, ["doc_id"])
    return S.read_keyed(spark, path)


@query("append_missing_keys", """SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 5 <> 0 UNION ALL
  SELECT * FROM (SELECT CAST(NULL AS BIGINT) AS doc_id, quality, toxic FROM labels WHERE doc_id % 5 = 0
  ORDER BY quality, toxic LIMIT 1) q""")
def _(spark, sf):
    """Rows without an id share one key: one of them is stored, however often they are appended."""
    path = scratch_path(spark, "resume")
    labels = table(spark, sf, "labels").withColumn("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("doc_id")))
    for _ in range(3):
        S.append_keyed(spark, labels, path, ["doc_id"])
    return S.read_keyed(spark, path)


@query("require_columns", _DOC_POSTS)
def _(spark, sf):
    return S.require_columns(_docs_as_posts(spark, sf), ["tweet_id", "post_type", "text"])


@query("min_rows_guard", with_ctes({}, "SELECT unit_id, rater, V1 FROM fx_ratings_raw"))
def _(spark, sf):
    return S.min_rows_guard(line_ratings(spark, sf).select("unit_id", "rater", "V1"), 2000)
