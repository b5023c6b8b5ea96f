"""Sources, sinks, hygiene, profiles, rounding, reports and streams."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from ratergrid import sources as S
from ratergrid.functions.codebook import codebook_rating
from ratergrid.functions.numeric import round_exact, round_scaled
from ratergrid.functions.posts import to_long_or_zero, to_timestamp_or_null
from ratergrid.functions.text import format_metric
from ratergrid.functions.verdicts import (agreement_zone, divergence_bucket, drift_direction,
                                          stability_verdict)
from ratergrid.operators import disagreement as D, hygiene as H, posts as P, profile as R
from ratergrid.operators import reports
from ratergrid.schemas import RAW_RESPONSE_SCHEMA, SAMPLED_POST_SCHEMA
from ratergrid.streaming import (read_annotation_log, run_annotation_log, run_ingest, stream_files,
                                 stream_progress)
from ratergrid.streaming.annotation_log import write_batch


def test_csv_round_trip(spark, tmp_path):
    rows = [("1", "reply", 'a "quoted", text\nwith lines\r\nand \\ slash\\'), ("2", "tweet", "  padded  "),
            ("3", "quote", "\U0001f923 emoji"), ("4", "tweet", None), ("5", "tweet", "")]
    df = spark.createDataFrame(rows, SAMPLED_POST_SCHEMA)
    S.sink_csv(df, str(tmp_path / "c"))
    back = S.scan_csv(spark, str(tmp_path / "c"), schema=SAMPLED_POST_SCHEMA, required=["text"])
    want = df.replace("", None)  # an empty field reads as missing
    assert sorted(back.collect(), key=lambda r: r[0]) == want.collect()


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text('text,extra,tweet_id,V1\n"a, b",z,7,1.0\nc,,8,junk\n')
    schema = "tweet_id bigint, V1 double, text string, missing string"
    got = S.scan_csv(spark, str(tmp_path / "t.csv"), schema=schema, required=["tweet_id", "text"])
    assert list(map(tuple, got.collect())) == [(7, 1.0, "a, b", None), (8, None, "c", None)]
    with pytest.raises(ValueError, match="missing"):
        S.scan_csv(spark, str(tmp_path / "t.csv"), schema=schema)


def test_source_without_optional_columns(spark):
    df = spark.createDataFrame([(1, "2024-08-02", "en", "hi")], "id long, date string, lang string, text string")
    row = P.ingest_posts(df, "en", "2024-08-01", "2024-08-31").first()
    assert (row["tweet_id"], row["like_count"], row["post_type"], row["hashtags"]) == (1, 0, "tweet", None)


def test_done_keys(spark, tmp_path):
    path = tmp_path / "done.json"
    path.write_text('{"completed": [[1, 1], [2, 1],\n [1, 1], ["x", "A"]]}')
    got = S.scan_done_keys(spark, str(path), multi_line=True).collect()
    assert sorted(map(tuple, got)) == [("1", "1"), ("2", "1"), ("x", "A")]


def test_evenly_spaced_chunks(spark):
    """Near-even chunk numbers, first and last included."""
    bounds = spark.createDataFrame([(23, 1, 20), (24, 21, 40), (28, 101, 117)], "part int, lo int, hi int")
    got = {}
    for r in S.evenly_spaced_chunks(bounds, 6).orderBy("part", "step").collect():
        got.setdefault(r["part"], []).append(r["chunk"])
    assert got == {23: [1, 4, 8, 12, 16, 20], 24: [21, 24, 28, 32, 36, 40],
                   28: [101, 104, 107, 110, 113, 117]}


def test_scan_parts_reads_only_listed_chunks(spark, tmp_path):
    root = str(tmp_path / "p")
    for part in (1, 2):
        for chunk in (1, 2, 3):
            spark.createDataFrame([(part * 10 + chunk,)], "id int").coalesce(1).write.parquet(
                f"{root}/part_{part}/chunk_{chunk}.parquet")
    df = S.scan_parquet_parts(spark, root, {"1": [1, 3], "2": [2]}, "part_{part}/chunk_{chunk}.parquet")
    assert sorted(r["id"] for r in df.collect()) == [11, 13, 22]
    assert len(df.inputFiles()) == 3


def test_guards(spark):
    df = spark.range(5)
    assert S.min_rows_guard(df, 5) is df
    with pytest.raises(ValueError, match="only 5 rows"):
        S.min_rows_guard(df, 6)
    with pytest.raises(ValueError, match="text"):
        S.require_columns(df, ["id", "text"])


def test_filters_use_pushdown(spark, tmp_path):
    spark.createDataFrame([("en", "2024-08-01", 1)], "lang string, date string, x int").write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    plan = P.filter_date_range(P.filter_language(df), "2024-08-01", "2024-08-31").select("x")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in text and "GreaterThanOrEqual(date,2024-08-01)" in text


def test_date_filter_modes(spark):
    df = spark.createDataFrame([("2024-08-31",), ("2024-08-31 10:00",), ("2024-07-31",), (None,), ("",)], "date string")
    assert P.filter_date_range(df, "2024-08-01", "2024-08-31").count() == 1
    assert P.filter_date_range(df, "2024-08-01", "2024-08-31", mode="date").count() == 2


def test_skip_counters_and_observation(spark):
    rows = [("en", "2024-08-02"), ("es", "2024-01-01"), (None, "2024-08-02"), ("en", None), ("en", "2025-01-01")]
    df = spark.createDataFrame(rows, "lang string, date string")
    got = P.skip_counters(df, "en", "2024-08-01", "2024-08-31").first().asDict()
    assert got == {"processed": 5, "kept": 1, "skipped_language": 2, "skipped_date": 2}
    from pyspark.sql import Observation
    seen = Observation("counts")
    P.observe_skip_counters(df, seen, "en", "2024-08-01", "2024-08-31").count()
    assert seen.get == got


def test_post_type_precedence(spark):
    rows = [(True, True, "u"), (False, True, "u"), (None, None, "u"), (None, None, None), (False, False, None)]
    df = spark.createDataFrame(rows, "retweeted_tweet boolean, quoted_tweet boolean, in_reply_to_screen_name string")
    assert [r["post_type"] for r in P.derive_post_type(df).collect()] == ["retweet", "quote", "reply", "tweet", "tweet"]


def test_flags_that_are_not_boolean_never_mark_a_post(spark):
    df = spark.createDataFrame([("True", (1,), None), ("x", (2,), "u")],
                               "retweeted_tweet string, quoted_tweet struct<id:int>, in_reply_to_screen_name string")
    assert [r["post_type"] for r in P.derive_post_type(df).collect()] == ["tweet", "reply"]


def test_counts_with_missing_and_nan_values(spark):
    df = spark.createDataFrame([(1, 7, "2024-08-01", float("nan"), None, 2.0, 3.0, "x")],
                               "row_id long, tweet_id long, date string, like_count double, retweet_count double, "
                               "reply_count double, quote_count double, view_count string")
    out = P.cast_sample_types(df)
    assert [out.schema[c].dataType.typeName() for c in P.COUNT_COLS] == ["integer"] * 4
    assert tuple(out.select(*P.COUNT_COLS, "view_count").first()) == (0, 0, 2, 3, 0)


def test_safe_casts(spark):
    df = spark.createDataFrame([("12",), ("12.0",), ("1e3",), ("n/a",), (None,), ("NaN",), ("1e300",)], "v string")
    assert [r[0] for r in df.select(to_long_or_zero(F.col("v"))).collect()] == [12, 12, 1000, 0, 0, 0, 0]
    df = spark.createDataFrame([("2024-08-01 10:00:00",), ("junk",), (None,)], "v string")
    assert [r[0] for r in df.select(to_timestamp_or_null(F.col("v"))).collect()] == [
        dt.datetime(2024, 8, 1, 10), None, None]


SCORES = "unit_id string, V1 int, V2 int"


def test_invalid_scores(spark):
    rows = [("a", 1, 2), ("b", 0, 9), ("c", 3, 4), ("d", None, 1), ("e", 2, None)]
    df = spark.createDataFrame(rows, SCORES)
    assert [r["unit_id"] for r in H.validity_filter(df, ["V1", "V2"]).collect()] == ["a"]
    listed = sorted(map(tuple, H.invalid_rows(df, ["V1", "V2"]).collect()), key=str)
    assert listed == [("b", "V1", "0"), ("c", "V2", "4"), ("d", "V1", None), ("e", "V2", None)]
    report = {r["column"]: (r["n_invalid"], r["n_values"]) for r in H.invalid_report(df, ["V1", "V2"]).collect()}
    assert report == {"V1": (2, 1), "V2": (2, 1)}


def test_dedupe_keeps_the_latest_of_very_many_copies(spark):
    rows = [("hot", "r", i % 50, i) for i in range(3000)] + [(f"u{i}", "r", 1, 1) for i in range(100)]
    df = spark.createDataFrame(rows, "unit_id string, rater string, at int, score int").repartition(4)
    out = H.dedupe_latest(df, ["unit_id", "rater"], ["at"])
    assert out.columns == df.columns and out.count() == 101
    assert tuple(out.where("unit_id = 'hot'").first()) == ("hot", "r", 49, 2999)


def test_id_sets(spark):
    a = spark.createDataFrame([("1",), ("2",), ("2",)], "unit_id string")
    b = spark.createDataFrame([("2",), ("3",)], "unit_id string")
    assert sorted(map(tuple, H.id_set_ops(a, b).collect())) == [("1", True, False), ("2", True, True), ("3", False, True)]
    assert [r[0] for r in H.missing_ids(a, b).collect()] == ["1"]
    assert H.overlap_semi(a, b).count() == 2


def test_quantiles_match_linear_interpolation(spark):
    rng = random.Random(9)
    for xs in ([5.0], [1.0, 2.0], [0.0] * 900 + [rng.paretovariate(0.4) for _ in range(400)],
               [rng.gauss(0, 1e4) for _ in range(777)] + [-3.5] * 50):
        df = spark.createDataFrame([(x,) for x in xs] + [(None,), (float("nan"),)], "x double").repartition(3)
        got = R.describe_numeric(df, "x").first()
        xs = sorted(xs)
        for name, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
            pos = (len(xs) - 1) * p
            lo = xs[int(pos)]
            hi = xs[min(int(pos) + 1, len(xs) - 1)]
            assert got[name] == pytest.approx(lo + (hi - lo) * (pos - int(pos)))
        assert got["count"] == len(xs) and got["mean"] == pytest.approx(statistics.fmean(xs))
        assert got["std"] == (pytest.approx(statistics.stdev(xs)) if len(xs) > 1 else None)


def test_rounding_follows_the_stored_value(spark):
    xs = [0.0805, 0.9195, 0.0005, 0.0015, 0.0025, -0.0805, -0.9195, 0.0625, 0.1875, 2.0, 0.1234567]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double")
    got = [r[0] for r in df.select(round_exact("x", 3)).collect()]
    assert got == [round(x, 3) + 0.0 for x in xs] + [None]
    scaled = [r[0] for r in df.select(round_scaled("x", 3)).collect()]
    assert scaled == [round(x * 1000) / 1000 + 0.0 for x in xs] + [None]


def test_labels(spark):
    df = spark.createDataFrame([(0.80,), (0.67,), (0.6,), (0.81,), (None,)], "x double")
    assert [r[0] for r in df.select(agreement_zone(F.col("x"))).collect()] == [
        "reliable", "tentative", "below", "reliable", "n/a"]
    assert [r[0] for r in df.select(stability_verdict(F.col("x"))).collect()] == [
        "Acceptable", "Acceptable", "Unstable", "Stable", "Unstable"]
    assert [r[0] for r in df.select(format_metric(F.col("x"))).collect()] == ["0.80", "0.67", "0.60", "0.81", "n/a"]
    df = spark.createDataFrame([(0,), (-2,), (3,), (None,)], "d int")
    assert [r[0] for r in df.select(divergence_bucket(F.col("d"))).collect()] == ["exact", "near", "far", None]
    assert [r[0] for r in df.select(drift_direction(F.col("d"))).collect()] == ["same", "negative", "positive", None]


def test_scale_rules(spark):
    rows = [(a, b1, b2) for a in (False, True) for b1 in (False, True) for b2 in (False, True)]
    df = spark.createDataFrame(rows, "a boolean, b1 boolean, b2 boolean")
    rate = lambda v: [r[0] for r in df.select(codebook_rating(v, F.col("a"), F.col("b1"), F.col("b1"), F.col("b2"))).collect()]
    assert rate("V1") == [1, 1, 2, 2, 2, 2, 3, 3]
    assert rate("V2") == [1, 2, 2, 2, None, None, None, 3]
    assert rate("V4") == [1, None, None, None, 2, None, None, 3]
    assert rate("V7") == [1, None, None, None, 2, 3, 3, 3]


def test_spread_of_known_cases(spark):
    """Totals of two published posts under five raters."""
    rows = [("208", f"r{i}", "V", 8) for i in range(5)]
    rows += [("254", f"r{i}", "V", s) for i, s in enumerate((9, 12, 14, 14, 11))] + [("solo", "r0", "V", 3)]
    ratings = spark.createDataFrame(rows, "unit_id string, rater string, variable string, score int")
    got = {r["unit_id"]: (r["mean_score"], r["spread"]) for r in D.spread_map(D.unit_totals(ratings)).collect()}
    assert got == {"208": (8.0, 0), "254": (12.0, 5)}


def test_summary_means(spark):
    """Means are taken over printed values; rho propagates missing values and alpha skips them."""
    drift = [-0.0384, 0.0191, 0.0072, 0.0061, 0.0379, 0.0131, 0.0229, 0.0129]
    rows = [("c", f"V{i}", d, None if i == 4 else 0.5, None if i == 4 else 0.25) for i, d in enumerate(drift, 1)]
    m = spark.createDataFrame(rows, "condition string, variable string, drift double, rho double, alpha double")
    assert reports.framing_drift_summary(m).first()["mean_drift"] == 0.010
    assert reports.framing_rho_summary(m).first()["mean_rho"] is None
    assert reports.framing_alpha_summary(m).first()["mean_alpha"] == 0.25


def test_metric_lookup(spark):
    t = spark.createDataFrame([("a", "b", "V1", 0.5)], "rater_a string, rater_b string, variable string, rho double")
    got = {r["variable"]: r["rho"] for r in reports.metric_lookup(t, [("a", "b", "V1"), ("a", "b", "V2")], "rho").collect()}
    assert got == {"V1": 0.5, "V2": None}


POST_STREAM = "id long, date string, lang string"


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    keep = lambda df: P.filter_date_range(P.filter_language(df), "2024-08-01", "2024-08-31")
    part = lambda k: spark.createDataFrame([(i, f"2024-0{7 + i % 3}-05", "en" if i % 2 else "es")
                                            for i in range(k * 50, k * 50 + 50)], POST_STREAM)
    counters = {"language": "en", "start": "2024-08-01", "end": "2024-08-31"}
    for k in (0, 1):
        part(k).coalesce(1).write.mode("append").parquet(src)
    source = lambda: stream_files(spark, src, part(0).schema, max_files=1)
    query = run_ingest(source(), keep, out, state, counters)
    progress = stream_progress(spark, query).collect()
    assert len(progress) == 2 and sum(r["processed"] for r in progress) == 100
    part(2).coalesce(1).write.mode("append").parquet(src)
    run_ingest(source(), keep, out, state, counters)
    want = sorted(map(tuple, keep(spark.read.parquet(src)).collect()))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == want


def test_annotation_log_replay_adds_nothing(spark, tmp_path):
    good = '{"V1":{"score":%d,"V1_reason":"q"}}'
    batch = lambda rows: spark.createDataFrame(rows, RAW_RESPONSE_SCHEMA)
    one = batch([("a", "m", 1, good % 1, None), ("b", "m", 1, "broken", None)])
    two = batch([("a", "m", 2, good % 3, None), ("b", "m", 2, good % 2, None)])
    out = str(tmp_path / "log")
    for df, i in ((two, 0), (one, 1), (one, 1), (two, 0)):
        write_batch(df, i, out, ["V1"])
        write_batch(df, i, out, ["V1"], run_id="r1")
    got = sorted((r["unit_id"], r["attempt"], r["V1"]) for r in read_annotation_log(spark, out, ["V1"]).collect())
    assert got == [("a", 1, 1), ("b", 2, 2)]


def test_annotation_log_stream_resumes(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    good = '{"V1":{"score":2,"V1_reason":"q"}}'
    for unit, text in (("a", good), ("b", "broken"), ("b", good), ("a", good)):
        df = spark.createDataFrame([(unit, "m", 1, text, None)], RAW_RESPONSE_SCHEMA)
        df.coalesce(1).write.mode("append").parquet(src)
        run_annotation_log(stream_files(spark, src, RAW_RESPONSE_SCHEMA, max_files=1), out, state, ["V1"])
    assert sorted(r["unit_id"] for r in read_annotation_log(spark, out, ["V1"]).collect()) == ["a", "b"]


def test_annotation_log_any_order_and_new_checkpoint(spark, tmp_path):
    good = '{"V1":{"score":%d,"V1_reason":"q"}}'
    out = str(tmp_path / "out")
    for step, (attempt, text) in enumerate(((3, good % 3), (2, good % 2), (1, "broken"))):
        src, state = str(tmp_path / f"src{step}"), str(tmp_path / f"state{step}")
        spark.createDataFrame([("a", "m", attempt, text, None), (f"u{step}", "m", 1, good % 1, None)],
                              RAW_RESPONSE_SCHEMA).write.parquet(src)
        run_annotation_log(stream_files(spark, src, RAW_RESPONSE_SCHEMA), out, state, ["V1"])
    got = {r["unit_id"]: r["attempt"] for r in read_annotation_log(spark, out, ["V1"]).collect()}
    assert got == {"a": 2, "u0": 1, "u1": 1, "u2": 1}


def test_quantiles_divide_a_hot_bin(spark):
    """Two hundred thousand stamps of a month share few bins; the parts they are divided into are small."""
    import numpy as np

    values = 1704067200000 + np.random.default_rng(2).integers(0, 31 * 86400_000, 200_000)
    df = spark.createDataFrame([(int(v),) for v in values], "x long")
    got = R.exact_quantiles(df, "x").first()
    assert [got[q] for q in ("q25", "q50", "q75")] == pytest.approx(np.quantile(values, [0.25, 0.5, 0.75]).tolist())
    _, fine = R._bins(df, "x")
    assert fine.count() < 200
    same = spark.createDataFrame([(7.5,)] * 50 + [(None,)], "x double")
    assert tuple(R.describe_numeric(same, "x").first()) == (50, 7.5, 0.0, 7.5, 7.5, 7.5, 7.5, 7.5)
    none = R.describe_numeric(same.limit(0), "x").first()
    assert none["count"] == 0 and none["mean"] is None and none["q50"] is None
