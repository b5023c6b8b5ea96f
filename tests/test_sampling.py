"""Samples against brute force, and the properties they must keep."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ratergrid.operators import sampling as Z
from ratergrid.operators.posts import classify_engagement
from ratergrid.operators.profile import tier_composition
from ratergrid.plans.studies import sampling_report, sampling_run
from ratergrid.schemas import POSTS_SCHEMA, SAMPLE_COLUMNS


def digest(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


def pool(spark, n=4000):
    """Nearly all rows in one stratum, a small one, and one smaller than its quota."""
    rows = [(i, "low" if i % 40 else ("medium" if i % 80 else "high")) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, tier string")


QUOTAS = {"low": 300, "medium": 20, "high": 90}


def expected(rows, quotas, seed):
    out = []
    for tier, quota in quotas.items():
        ids = sorted((i for i, t in rows if t == tier), key=lambda i: (digest(seed, i), i))
        out += ids[:quota]
    return out


@pytest.mark.parametrize("digits", [1, 3, 5])
def test_sample_equals_full_sort(spark, digits):
    rows, df = pool(spark)
    got = Z.stratified_sample(df, "tier", QUOTAS, "id", 45, prefix_digits=digits).orderBy("row_id").collect()
    assert [r["id"] for r in got] == expected(rows, QUOTAS, 45)
    assert [r["row_id"] for r in got] == list(range(1, len(got) + 1))


def test_sample_does_not_depend_on_partitioning(spark):
    _, df = pool(spark)
    ids = lambda d: {r["id"] for r in Z.stratified_sample(d, "tier", QUOTAS, "id", 7).collect()}
    assert ids(df.repartition(1)) == ids(df.repartition(13)) == ids(df.orderBy(F.desc("id")))


def test_short_stratum_gives_all_and_missing_stratum_none(spark):
    _, df = pool(spark, 400)
    quotas = {"low": 10, "high": 90, "absent": 5}
    got = {r["tier"]: r["n"] for r in Z.stratified_sample(df, "tier", quotas, "id", 1)
           .groupBy("tier").agg(F.count("*").alias("n")).collect()}
    assert got == {"low": 10, "high": 5}
    report = {r["tier"]: (r["target"], r["available"], r["taken"], r["shortfall"])
              for r in Z.tier_shortfall(df, "tier", quotas).collect()}
    assert report == {"low": (10, 390, 10, 0), "high": (90, 5, 5, 85), "absent": (5, 0, 0, 5)}


def test_quota_truncates():
    assert Z.tier_quota(2000) == {"low": 1000, "medium": 600, "high": 400}
    assert Z.tier_quota(7) == {"low": 3, "medium": 2, "high": 1}


def test_simple_random_sample(spark):
    rows, df = pool(spark, 500)
    got = {r["id"] for r in Z.simple_random_sample(df, 50, "id", 42).collect()}
    assert got == set(sorted((i for i, _ in rows), key=lambda i: digest(42, i))[:50])
    assert Z.simple_random_sample(df, 9999, "id", 42).count() == 500


@pytest.mark.parametrize("limit", [1, 99, 100, 101, 1234, 2999, 3000, 5000])
def test_bounded_collect(spark, limit):
    """One file holds most rows; the limit may fall before, in or after it."""
    rows = [("f1", i) for i in range(100)] + [("f2", i) for i in range(2500)] + [("f3", i) for i in range(400)]
    df = spark.createDataFrame(rows, "file string, pos long").repartition(5)
    got = Z.bounded_collect(df, limit, "file", "pos", width=64)
    assert sorted(map(tuple, got.collect())) == rows[:limit]


def test_tier_bounds(spark):
    likes = [0, 50, 51, 500, 501, None]
    df = spark.createDataFrame([(x,) for x in likes], "like_count int").fillna(0)
    out = [r["engagement_level"] for r in classify_engagement(df).collect()]
    assert out == ["low", "low", "medium", "medium", "high", "low"]
    nan = classify_engagement(spark.createDataFrame([(float("nan"),)], "like_count double")).first()
    assert nan["engagement_level"] == "high"


def test_tier_composition_fills_absent_tiers(spark):
    df = spark.createDataFrame([("low",)] * 3 + [("high",)], "engagement_level string")
    got = {r["engagement_level"]: (r["n"], r["pct"]) for r in tier_composition(df).collect()}
    assert got == {"low": (3, 75.0), "medium": (0, 0.0), "high": (1, 25.0)}


def test_sampling_run(spark, tmp_path):
    rows = [(i, f"2024-08-{1 + i % 31:02d} 10:00:00", "en" if i % 5 else "es", f"t{i}", None, i % 700, None, 1, 2,
             "12.0" if i % 2 else "junk", i % 3 == 0, None, None, ["a"], "u", "x") for i in range(2000)]
    out = sampling_run(spark.createDataFrame(rows, POSTS_SCHEMA), str(tmp_path / "sample"), "en",
                       "2024-08-01", "2024-08-31", 100, 45)
    assert out.columns == SAMPLE_COLUMNS
    got = out.orderBy("row_id").collect()
    assert [r["row_id"] for r in got] == list(range(1, 101))
    assert [r["engagement_level"] for r in got] == ["low"] * 50 + ["medium"] * 30 + ["high"] * 20
    assert all(r["language"] == "en" and r["date"].day < 31 for r in got)  # times on the last day are later
    assert {r["view_count"] for r in got} == {0, 12} and {r["retweet_count"] for r in got} == {0}
    assert {r["post_type"] for r in got} <= {"retweet", "tweet"}
    source = spark.createDataFrame(rows, POSTS_SCHEMA)
    report = sampling_report(source, out, "en", "2024-08-01", "2024-08-31", 100)
    seen = report["skip_counters"].first()
    assert seen["processed"] == 2000 and seen["kept"] + seen["skipped_language"] + seen["skipped_date"] == 2000
    assert sum(r["n"] for r in report["pool_composition"].collect()) == seen["kept"]
    assert {r["engagement_level"]: r["n"] for r in report["sample_composition"].collect()} == {"low": 50, "medium": 30, "high": 20}
    assert {r["shortfall"] for r in report["shortfall"].collect()} == {0}
    few = sampling_report(source, out, "en", "2024-08-01", "2024-08-31", 100, limit=(400, "date", "id"))
    assert sum(r["n"] for r in few["pool_composition"].collect()) == 400
    with pytest.raises(ValueError, match="need 5000"):
        sampling_run(spark.createDataFrame(rows, POSTS_SCHEMA), str(tmp_path / "x"), "en", "2024-08-01",
                     "2024-08-31", 5000, 45)


def test_rows_without_ids_are_sampled(spark):
    df = spark.createDataFrame([(None if i % 2 else i, i) for i in range(1000)], "id long, k long")
    for n, ties in ((100, []), (700, []), (100, ["k"]), (1000, ["k"]), (5000, [])):
        got = Z.simple_random_sample(df, n, "id", 45, ties)
        assert got.count() == min(n, 1000)
    got = Z.simple_random_sample(df, 400, "id", 45, ["k"])
    assert 120 < got.where("id IS NULL").count() < 280
    with pytest.raises(ValueError, match="strata"):
        Z.stratified_sample(df, "k", {str(i): 1 for i in range(Z.MAX_GROUPS + 1)}, "id", 1)


def test_limit_over_missing_and_repeated_positions(spark):
    rows = [(None if i % 3 == 0 else f"g{i % 5}", None if i % 4 == 0 else i // 10, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, p long, k long")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0))
    for n in (0, 1, 10, 60, 130, 200, 499, 500, 900):
        got = Z.bounded_collect(df, n, "g", "p", width=4)
        want = order[:n]
        assert got.count() == len(want)
        if want:
            last = want[-1][:2]
            sure = {r[2] for r in want if r[:2] != last}
            assert sure <= {r["k"] for r in got.collect()} <= sure | {r[2] for r in rows if r[:2] == last}
