"""Post ingestion: filters, projection, derived columns and the typed sample layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ratergrid.functions.posts import (ENGAGEMENT_TIERS, engagement_tier, in_range, post_type,
                                       to_long_or_zero, to_timestamp_or_null, zero_if_null)
from ratergrid.schemas import POST_COLUMNS, POSTS_SCHEMA, SAMPLE_COLUMNS

COUNT_COLS = ["like_count", "retweet_count", "reply_count", "quote_count"]


def filter_language(df: DataFrame, language: str = "en", col: str = "lang") -> DataFrame:
    """Rows in one language; a missing language is dropped. Pushed down to the scan."""
    return df.where(F.col(col) == language)


def filter_date_range(df: DataFrame, start: str, end: str, col: str = "date",
                      mode: str = "string") -> DataFrame:
    """Rows dated ``start`` to ``end``; missing dates are dropped. String mode is pushed down."""
    return df.where(in_range(F.col(col), start, end, mode))


def skip_counters(df: DataFrame, language: str, start: str, end: str, lang_col: str = "lang",
                  date_col: str = "date", mode: str = "string") -> DataFrame:
    """One row: processed, kept and skipped rows. Language is tested before the date."""
    return df.agg(*_skip_counts(language, start, end, lang_col, date_col, mode))


def observe_skip_counters(df: DataFrame, observation, language: str, start: str, end: str,
                          lang_col: str = "lang", date_col: str = "date",
                          mode: str = "string") -> DataFrame:
    """Collect the same counters while another job or stream runs over ``df``."""
    return df.observe(observation, *_skip_counts(language, start, end, lang_col, date_col, mode))


def _skip_counts(language, start, end, lang_col, date_col, mode) -> list[Column]:
    lang_ok = F.coalesce(F.col(lang_col) == language, F.lit(False))
    date_ok = F.coalesce(in_range(F.col(date_col), start, end, mode), F.lit(False))
    return [
        F.count(F.lit(1)).alias("processed"),
        F.count_if(lang_ok & date_ok).alias("kept"),
        F.count_if(~lang_ok).alias("skipped_language"),
        F.count_if(lang_ok & ~date_ok).alias("skipped_date"),
    ]


def project_rename(df: DataFrame, mapping: dict[str, str] = POST_COLUMNS) -> DataFrame:
    """Source columns under their sample names; a known column the source lacks is all NULL."""
    def column(src: str) -> Column:
        if src not in df.columns and src in POSTS_SCHEMA.names:
            return F.lit(None).cast(POSTS_SCHEMA[src].dataType)
        return F.col(src)

    return df.select(*[column(src).alias(dst) for src, dst in mapping.items()])


def null_to_zero(df: DataFrame, cols: list[str] = COUNT_COLS) -> DataFrame:
    return df.withColumns({c: zero_if_null(F.col(c)) for c in cols})


def derive_post_type(df: DataFrame, retweeted: str = "retweeted_tweet", quoted: str = "quoted_tweet",
                     reply_to: str = "in_reply_to_screen_name") -> DataFrame:
    """Only a true flag counts: a column that is not boolean (text, a struct) never marks a post."""
    def flag(col: str) -> Column:
        return F.col(col) if df.schema[col].dataType == T.BooleanType() else F.lit(False)

    return df.withColumn("post_type", post_type(flag(retweeted), flag(quoted), F.col(reply_to)))


def classify_engagement(df: DataFrame, likes: str = "like_count",
                        tiers: dict[str, float | None] = ENGAGEMENT_TIERS) -> DataFrame:
    return df.withColumn("engagement_level", engagement_tier(F.col(likes), tiers))


def add_text_length(df: DataFrame, col: str = "text") -> DataFrame:
    """Length in code points."""
    return df.withColumn("text_length", F.length(col))


def ingest_posts(df: DataFrame, language: str, start: str, end: str,
                 mode: str = "string") -> DataFrame:
    """Source rows to pool rows: filter, rename, fill counts, derive the post type."""
    return (df.transform(filter_language, language)
            .transform(filter_date_range, start, end, "date", mode)
            .transform(project_rename)
            .transform(null_to_zero)
            .transform(derive_post_type))


def add_sample_metadata(df: DataFrame, strategy: str = "engagement_stratified",
                        sampled_at: Column | None = None) -> DataFrame:
    return df.withColumns({
        "dataset_split": F.lit(None).cast("string"),
        "sampling_strategy": F.lit(strategy),
        "sampled_at": F.current_timestamp() if sampled_at is None else sampled_at,
    })


def cast_sample_types(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "row_id": F.col("row_id").cast("int"),
        "tweet_id": F.col("tweet_id").cast("bigint"),
        "date": to_timestamp_or_null(F.col("date")),
        **{c: to_long_or_zero(F.col(c)).try_cast("int") for c in COUNT_COLS},
        "view_count": to_long_or_zero(F.col("view_count")),
    })


def reorder_columns(df: DataFrame, columns: list[str] = SAMPLE_COLUMNS) -> DataFrame:
    return df.select(*columns)
