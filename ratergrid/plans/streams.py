"""Streaming runs over the given tables: each processes all files, and the sink equals the batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratergrid.operators import posts as P
from ratergrid.plans.fixtures import END, RESPONSE_VARS, START, _POSTS, raw_responses, table
from ratergrid.plans.registry import query, with_ctes
from ratergrid.plans.responses import FIRST_VALID
from ratergrid.session import scratch_path
from ratergrid.streaming import (read_annotation_log, run_annotation_log, run_ingest, stream_files,
                                 stream_progress)


def _post_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    raw = stream_files(spark, sf, schema, glob="events.parquet").selectExpr(*_POSTS)
    return raw.withColumnRenamed("user_name", "user")


def _keep(df):
    return P.ingest_posts(df, "en", START, END).select("tweet_id", "date", "like_count", "post_type")


@query("stream_filter_project", with_ctes({}, """SELECT id AS tweet_id, date, COALESCE(likeCount, 0) AS like_count,
  CASE WHEN retweetedTweet THEN 'retweet' WHEN quotedTweet THEN 'quote'
  WHEN in_reply_to_screen_name IS NOT NULL THEN 'reply' ELSE 'tweet' END AS post_type FROM fx_pool"""))
def _(spark, sf):
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "state")
    run_ingest(_post_stream(spark, sf), _keep, out, state)
    return spark.read.parquet(out)


@query("stream_progress", with_ctes({}, f"""SELECT COUNT(*) AS processed,
  COUNT(CASE WHEN lang = 'en' AND date BETWEEN '{START}' AND '{END}' THEN 1 END) AS kept,
  COUNT(CASE WHEN lang IS NULL OR lang <> 'en' THEN 1 END) AS skipped_language,
  COUNT(CASE WHEN lang = 'en' AND (date IS NULL OR date < '{START}' OR date > '{END}') THEN 1 END) AS skipped_date
  FROM fx_posts"""))
def _(spark, sf):
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "state")
    counters = {"language": "en", "start": START, "end": END}
    done = run_ingest(_post_stream(spark, sf), _keep, out, state, counters)
    return stream_progress(spark, done).agg(*[
        F.sum(c).alias(c) for c in ("processed", "kept", "skipped_language", "skipped_date")])


@query("stream_annotation_log", with_ctes(FIRST_VALID, """SELECT unit_id, rater, attempt, CAST(s1 AS INT) AS V1, t1 AS V1_reason,
  CAST(s2 AS INT) AS V2, t2 AS V2_reason, CAST(s1 + s2 AS INT) AS total_score FROM first_ok"""))
def _(spark, sf):
    """The log arrives as one file per attempt, later attempts first; the last file under a new checkpoint. It is
    compacted after the second one, so the read takes the compacted rows and one batch."""
    src, out, state = (scratch_path(spark, n) for n in ("log", "annotations", "state"))
    log = raw_responses(spark, sf)
    for folder, attempts in (("a", (3, 1)), ("b", (2,))):
        for attempt in attempts:
            log.where(F.col("attempt") == attempt).write.mode("append").parquet(f"{src}/{folder}")
            run_annotation_log(stream_files(spark, f"{src}/{folder}", log.schema), out, f"{state}/{folder}",
                               RESPONSE_VARS, compact=attempt == 1)
    return read_annotation_log(spark, out, RESPONSE_VARS)
