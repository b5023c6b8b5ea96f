"""Column lists and schemas shared by all modules."""

from __future__ import annotations

from pyspark.sql import types as T

# The eight ordinal variables, their scale, and the table layouts users exchange.
SCORE_COLS = ["V1", "V2", "V3", "V4", "V5", "V6", "V7", "V8"]
VALID_SCORES = [1, 2, 3]

REQUIRED_POST_COLS = ["tweet_id", "post_type", "text"]

# source column -> sample column
POST_COLUMNS = {
    "id": "tweet_id",
    "date": "date",
    "lang": "language",
    "text": "text",
    "rawContent": "raw_content",
    "likeCount": "like_count",
    "retweetCount": "retweet_count",
    "replyCount": "reply_count",
    "quoteCount": "quote_count",
    "viewCount": "view_count",
    "retweetedTweet": "retweeted_tweet",
    "quotedTweet": "quoted_tweet",
    "in_reply_to_screen_name": "in_reply_to_screen_name",
    "hashtags": "hashtags",
    "url": "url",
    "user": "user",
}

SAMPLE_COLUMNS = [
    "row_id", "date", "post_type", "engagement_level", "language",
    "like_count", "retweet_count", "reply_count", "quote_count", "view_count",
    "text", "hashtags", "tweet_id", "retweeted_tweet", "quoted_tweet", "url", "user",
    "raw_content", "in_reply_to_screen_name", "dataset_split", "sampling_strategy", "sampled_at",
]

POSTS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("date", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("rawContent", T.StringType()),
    T.StructField("likeCount", T.IntegerType()),
    T.StructField("retweetCount", T.IntegerType()),
    T.StructField("replyCount", T.IntegerType()),
    T.StructField("quoteCount", T.IntegerType()),
    T.StructField("viewCount", T.StringType()),
    T.StructField("retweetedTweet", T.BooleanType()),
    T.StructField("quotedTweet", T.BooleanType()),
    T.StructField("in_reply_to_screen_name", T.StringType()),
    T.StructField("hashtags", T.ArrayType(T.StringType())),
    T.StructField("url", T.StringType()),
    T.StructField("user", T.StringType()),
])

RATINGS_SCHEMA = T.StructType([
    T.StructField("unit_id", T.StringType()),
    T.StructField("rater", T.StringType()),
    T.StructField("variable", T.StringType()),
    T.StructField("score", T.IntegerType()),
])

SAMPLED_POST_SCHEMA = T.StructType([
    T.StructField("tweet_id", T.StringType()),
    T.StructField("post_type", T.StringType()),
    T.StructField("text", T.StringType()),
])

DONE_KEYS_SCHEMA = T.StructType([
    T.StructField("completed", T.ArrayType(T.ArrayType(T.StringType()))),
])

RAW_RESPONSE_SCHEMA = T.StructType([
    T.StructField("unit_id", T.StringType()),
    T.StructField("rater", T.StringType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("raw_text", T.StringType()),
    T.StructField("error", T.StringType()),
])


def annotation_schema(variables: list[str] = SCORE_COLS) -> T.StructType:
    """One JSON response: ``{"V1": {"score": n, "V1_reason": s}, ...}``.

    Leaves are variants: that keeps 2.0, "2", true, null and a missing key apart.
    """
    return T.StructType([
        T.StructField(v, T.StructType([
            T.StructField("score", T.VariantType()),
            T.StructField(f"{v}_reason", T.VariantType()),
        ])) for v in variables
    ])


def annotation_columns(variables: list[str] = SCORE_COLS, extra: list[str] = ()) -> list[str]:
    """Output column order of the annotation table."""
    scores = [c for v in variables for c in (v, f"{v}_reason")]
    return ["annotation_id", "tweet_id", "llm_id", "llm_name_version", "post_type", "text",
            *scores, "total_score", "date", "annotation_session", *extra]
