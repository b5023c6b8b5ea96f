"""Remaining work: done posts are dropped where they are read, and nothing open is lost."""

import pytest

from ratergrid.operators import workplan as W

LABELS = [{"rater": "a", "prompt": "p"}, {"rater": "b", "prompt": "q"}]


def tables(spark):
    """4,000 posts of which 40 lack both labels and 30 one; a post without id, a repeated post, unknown labels."""
    posts = [(i, f"text {i}") for i in range(4000)] + [(7, "again"), (None, "no id"), (3999, "twice")]
    done = [(i, r) for i in range(3960) for r in "ab" if not (r == "b" and i < 30)]
    done += [(i, "other") for i in range(3990, 4000)] + [(5, "a"), (None, "a")]
    return (spark.createDataFrame(posts, "post_id long, text string").repartition(5),
            spark.createDataFrame(done, "post_id long, rater string").repartition(3), posts, set(done))


def wanted(posts, done):
    return sorted((str(i), t, row["rater"], row["prompt"]) for i, t in posts for row in LABELS
                  if i is None or (i, row["rater"]) not in done)


@pytest.mark.parametrize("bits", [1 << 24, 64])
@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_remaining_work_against_brute_force(spark, monkeypatch, bits, threshold):
    """Also with a filter that lets everything pass, and with flags too large to broadcast."""
    monkeypatch.setattr(W, "OPEN_FILTER_BITS", bits)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        posts, done, rows, keys = tables(spark)
        got = W.remaining_work(posts, LABELS, done, "post_id", "rater").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((str(r[0]), *r[1:]) for r in got) == wanted(rows, keys)


def test_done_posts_do_not_move(spark):
    posts, done, rows, _ = tables(spark)
    flags = W._done_flags(done, "post_id", "rater", ["a", "b"])
    kept = W.may_be_open(posts, flags, "post_id", 2)
    assert kept.columns == posts.columns
    assert 73 <= kept.count() <= 76  # 40 + 30, the repeated two and the one without id


def test_nothing_done_and_no_posts(spark):
    posts, done, rows, _ = tables(spark)
    assert W.remaining_work(posts, LABELS, done.limit(0), "post_id", "rater").count() == 2 * len(rows)
    assert W.remaining_work(posts.limit(0), LABELS, done, "post_id", "rater").count() == 0
