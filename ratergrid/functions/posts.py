"""Column functions over post fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Upper like bounds of the tiers (the last is open) and their share of a sample.
ENGAGEMENT_TIERS = {"low": 50, "medium": 500, "high": None}
ENGAGEMENT_PROPORTIONS = {"low": 0.50, "medium": 0.30, "high": 0.20}


def post_type(retweeted: Column, quoted: Column, reply_to: Column) -> Column:
    """Retweet wins over quote, quote over reply; flags that are missing count as false."""
    return (F.when(F.coalesce(retweeted, F.lit(False)), "retweet")
            .when(F.coalesce(quoted, F.lit(False)), "quote")
            .when(reply_to.isNotNull(), "reply")
            .otherwise("tweet"))


def engagement_tier(likes: Column, tiers: dict[str, float | None] = ENGAGEMENT_TIERS) -> Column:
    """First tier whose upper bound holds the like count. NaN exceeds every bound."""
    bounded = [(name, hi) for name, hi in tiers.items() if hi is not None]
    top = next(name for name, hi in tiers.items() if hi is None)
    tier = F
    for name, hi in bounded:
        tier = tier.when(likes <= hi, name)
    return tier.otherwise(top)


def zero_if_null(col: Column) -> Column:
    return F.coalesce(col, F.lit(0))


def to_long_or_zero(col: Column) -> Column:
    """Number in any notation to a whole number; junk, NaN and overflow become 0."""
    number = col.try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number).try_cast("bigint"), F.lit(0).cast("bigint"))


def to_timestamp_or_null(col: Column, fmt: str | None = None) -> Column:
    return F.try_to_timestamp(col, F.lit(fmt)) if fmt else col.try_cast("timestamp")


def in_range(col: Column, lo: str, hi: str, mode: str = "string") -> Column:
    """Inclusive range. ``string`` compares text, so a time on the last day falls outside;
    ``date`` compares calendar days."""
    if mode == "string":
        return col.between(lo, hi)
    if mode == "date":
        return col.try_cast("date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))
    raise ValueError(f"unknown mode {mode!r}")
