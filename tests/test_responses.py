"""Parsing, validation, attempts, work plans, and the annotation run."""

import json

import pytest
from pyspark.sql import functions as F

from ratergrid.functions.text import strip_code_fences
from ratergrid.operators import responses as R, workplan as W
from ratergrid.plans.studies import annotation_run, framing_study, stability_study
from ratergrid.schemas import SCORE_COLS

VARS = ["V1", "V2"]
GOOD = '{"V1":{"score":1,"V1_reason":"q"},"V2":{"score":3,"V2_reason":"t"}}'

# response text -> (parsed, error code, variable); as a strict JSON reader would see it
CASES = [
    (GOOD, True, None, None),
    ("```json\n" + GOOD + "\n```", True, None, None),
    ("  " + GOOD + "``` \n", True, None, None),
    (" " + GOOD + " ", True, None, None),
    (GOOD.replace("3", "2.0"), True, None, None),
    (GOOD.replace("3", "2e0"), True, None, None),
    (GOOD.replace("3", "true"), True, None, None),
    (GOOD.replace('"t"', "null"), True, None, None),
    (GOOD.replace("3", '"3"'), True, "invalid_score", "V2"),
    (GOOD.replace("3", "2.5"), True, "invalid_score", "V2"),
    (GOOD.replace("3", "false"), True, "invalid_score", "V2"),
    (GOOD.replace("3", "4"), True, "invalid_score", "V2"),
    (GOOD.replace("3", "null"), True, "invalid_score", "V2"),
    (GOOD.replace(',"V2_reason":"t"', ""), True, "missing_reason", "V2"),
    ('{"V2":{"score":3,"V2_reason":"t"}}', True, "missing_variable", "V1"),
    ('{"V1":{"score":9,"V1_reason":"q"}}', True, "invalid_score", "V1"),
    ("[1]", True, "missing_variable", "V1"),
    (GOOD[:-1], False, "parse", None),
    (GOOD + " done", False, "parse", None),
    (GOOD + " " + GOOD, False, "parse", None),
    (GOOD + "," + GOOD, False, "parse", None),
    (GOOD + ',"x":' + GOOD, False, "parse", None),
    (GOOD + "],[1", False, "parse", None),
    (GOOD + ',"end":1} {', False, "parse", None),
    (GOOD.replace('"', "'"), False, "parse", None),
    ('{"V1":{"score":1,"V1_reason":"a\nb"}}', False, "parse", None),
    (GOOD.replace("3", "NaN"), False, "parse", None),  # not JSON by its standard
    ("", False, "parse", None),
    (None, False, "parse", None),
]


def test_parse_and_validate(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(CASES)], "i int, raw_text string")
    got = {r["i"]: (r["parsed"], r["error_code"], r["error_variable"])
           for r in R.read_responses(df, VARS).collect()}
    assert got == {i: tuple(want) for i, (_, *want) in enumerate(CASES)}


def no_constant(name):
    raise ValueError(name)


def test_parse_agrees_with_strict_reader(spark):
    texts = [t for t, *_ in CASES if t]
    df = spark.createDataFrame([(t,) for t in texts], "raw_text string")
    for row in R.parse_annotation_json(df, VARS).collect():
        try:
            json.loads(row["cleaned"], parse_constant=no_constant)
            ok = True
        except ValueError:
            ok = False
        assert row["parsed"] == ok, row["raw_text"]


def test_duplicate_key_keeps_the_last(spark):
    text = GOOD.replace('"V2":', '"V1":{"score":2,"V1_reason":"again"},"V2":')
    df = spark.createDataFrame([(text,)], "raw_text string")
    row = R.flatten_annotation(R.read_responses(df, VARS), VARS).first()
    assert (row["V1"], row["V1_reason"], row["total_score"]) == (2, "again", 5)


def test_strip_code_fences(spark):
    df = spark.createDataFrame([("```json\n{}\n```",), ("a``` b ```",), ("\n x`` \t",)], "t string")
    assert [r[0] for r in df.select(strip_code_fences(F.col("t"))).collect()] == ["{}", "ab", "x"]
    spaces = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    df = spark.createDataFrame([(spaces + "x" + spaces + "`" + "``",)], "t string")
    assert df.select(strip_code_fences(F.col("t"))).first()[0] == "x"


def test_responses_are_parsed_once(spark):
    """Filters on validity must not repeat the parse."""
    df = spark.createDataFrame([("u", "m", 1, GOOD)], "unit_id string, rater string, attempt int, raw_text string")
    for out in (R.first_valid_attempt(R.read_responses(df, VARS), VARS),
                R.flatten_annotation(R.read_responses(df, VARS), VARS),
                R.failed_keys(R.read_responses(df, VARS))):
        text = out._jdf.queryExecution().executedPlan().toString()
        assert text.count("from_json(") == 1 and text.count("regexp_replace(") == 1


def attempts(spark):
    bad = '{"V1":{"score":7}}'
    rows = [("u1", "m", 1, bad, None), ("u1", "m", 2, GOOD, None), ("u1", "m", 3, GOOD.replace("3", "2"), None),
            ("u2", "m", 1, None, "Timeout: x"), ("u2", "m", 2, bad, None),
            ("u3", "m", 11, GOOD, None), ("u3", "m", 10, "oops", None)]
    df = spark.createDataFrame(rows, "unit_id string, rater string, attempt int, raw_text string, error string")
    return R.read_responses(df, VARS, error="error")


def test_attempts(spark):
    log = attempts(spark)
    first = R.first_valid_attempt(log, VARS).collect()
    assert [(r["unit_id"], r["attempt"], r["V2"]) for r in first] == [("u1", 2, 3)]
    failed = {r["unit_id"]: (r["attempts"], r["last_error"], r["last_variable"]) for r in R.failed_keys(log).collect()}
    assert failed == {"u2": (2, "invalid_score", "V1"), "u3": (1, "parse", None)}
    waits = {r["unit_id"]: r["wait_seconds"] for r in R.retry_wait_seconds(log).collect()}
    assert waits == {"u1": 15, "u2": 45, "u3": 0}
    codes = {r["error_code"]: r["n"] for r in R.error_breakdown(log).collect()}
    assert codes == {"invalid_score": 2, "provider": 1, "parse": 1}


def test_remaining_work(spark):
    posts = spark.createDataFrame([(f"p{i}", f"text {i}") for i in range(5)], "tweet_id string, text string")
    labels = [{"llm_id": 1, "name": "a"}, {"llm_id": 2, "name": "b"}]
    done = spark.createDataFrame([("p0", 1), ("p0", 1), ("p0", 2), ("p1", 2), ("zz", 1), ("p2", 9)],
                                 "tweet_id string, llm_id int")
    left = W.remaining_work(posts, labels, done, "tweet_id", "llm_id")
    got = sorted((r["tweet_id"], r["llm_id"], r["name"]) for r in left.collect())
    assert got == [("p1", 1, "a")] + [(f"p{i}", k, n) for i in (2, 3, 4) for k, n in ((1, "a"), (2, "b"))]
    report = W.progress_report(posts, labels, done, "tweet_id", "llm_id").first()
    assert tuple(report) == (10, 3, 7)


def test_prompt_keeps_placeholders_in_text(spark):
    plan = spark.createDataFrame([("A", "reply", 'say "{text}" {post_type}'), ("A", "tweet", None)],
                                 "prompt_variant string, post_type string, text string")
    out = W.build_prompt(plan, [("A", "CB", "FMT", "\nRate this ", ":\n\"", "\"")]).collect()
    assert out[0]["prompt"] == 'CB\nFMT\nRate this reply:\n"say "{text}" {post_type}"'
    assert out[1]["prompt"] == 'CB\nFMT\nRate this tweet:\n""'


def make_scorer(fail_text):
    def scorer(text, post_type, prompt, system_prompt):
        if text == fail_text:
            raise RuntimeError("quota")
        base = len(text) + (1 if "reworded" in prompt else 0) + (1 if "strict" in system_prompt else 0)
        return json.dumps({v: {"score": 1 + (base + i) % 3, f"{v}_reason": post_type}
                           for i, v in enumerate(f"V{k}" for k in range(1, 9))})
    return scorer


def test_annotation_run_resumes(spark, tmp_path):
    posts = spark.createDataFrame([(i, "tweet", "x" * (i % 5 + 1)) for i in range(12)] + [(99, "reply", "boom")],
                                  "tweet_id long, post_type string, text string")
    prompts = [("A", "codebook", "json", "\nRate ", ":", "."), ("B", "reworded", "json", "\nRate ", ":", ".")]
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    run = lambda fail: annotation_run(posts, out, log, [{"prompt_variant": "A"}, {"prompt_variant": "B"}],
                                      "prompt_variant", prompts, "system", make_scorer(fail), "s1", max_attempts=2)
    failed = run("boom").collect()
    assert sorted((r["unit_id"], r["rater"], r["last_error"], r["attempts"]) for r in failed) == [
        ("99", "A", "provider", 2), ("99", "B", "provider", 2)]
    before = spark.read.parquet(out)
    assert before.count() == 24
    assert run("nothing").count() == 0
    after = spark.read.parquet(out)
    assert after.count() == 26 and after.select("annotation_id").distinct().count() == 26
    calls = spark.read.parquet(log).groupBy("unit_id", "rater").agg(F.count("*").alias("n"))
    assert {r["n"] for r in calls.where("unit_id <> '99'").collect()} == {1}
    assert {r["total_score"] for r in after.collect()} == {sum(r[v] for v in SCORE_COLS) for r in after.collect()}
    study = stability_study(after)
    assert study["stability_summary"].count() == 8
    assert study["agreement_breakdown"].count() == 8 and study["divergence_stats"].first()["n"] == 13
    with pytest.raises(ValueError, match="repeat"):
        stability_study(after.unionByName(after.limit(1)))
    shares = study["score_distributions"].groupBy("variable").agg(F.sum("prompt_a").alias("a")).collect()
    assert all(r["a"] == pytest.approx(1.0) for r in shares)


def test_annotation_run_finishes_a_stopped_run(spark, tmp_path):
    """The calls were made and logged, then the run was stopped: nothing is called again."""
    posts = spark.createDataFrame([(str(i), "tweet", "x" * (i % 5 + 1)) for i in range(6)],
                                  "tweet_id string, post_type string, text string")
    prompts = [("A", "codebook", "json", "\nRate ", ":", ".")]
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    calls = posts.selectExpr("tweet_id AS unit_id", "'A' AS rater", "text", "post_type", "'' AS prompt", "'' AS system_prompt")
    R.annotator_hook(calls.limit(4), make_scorer("none")).write.parquet(f"{log}/run=rx")

    answer, calls_file = make_scorer("none"), str(tmp_path / "calls")

    def count_call(text, post_type, prompt, system_prompt):
        with open(calls_file, "a") as file:
            file.write("x")
        return answer(text, post_type, prompt, system_prompt)

    run = lambda: annotation_run(posts, out, log, [{"prompt_variant": "A"}], "prompt_variant", prompts, "system",
                                 count_call, "s1")
    assert run().count() == 0 and spark.read.parquet(out).count() == 6
    assert len((tmp_path / "calls").read_text()) == 2
    assert run().count() == 0 and len((tmp_path / "calls").read_text()) == 2


def test_annotator_hook_spreads_calls(spark):
    work = spark.range(200).coalesce(1).selectExpr("CAST(id AS STRING) AS unit_id", "'m' AS rater", "'t' AS text",
                                                   "'tweet' AS post_type", "'' AS prompt", "'' AS system_prompt")
    log = R.annotator_hook(work, make_scorer("none"), tasks=16)
    assert log.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 12
    assert log.count() == 200


def test_framing_run(spark, tmp_path):
    posts = spark.createDataFrame([(str(i), "tweet", "x" * (i % 7 + 1)) for i in range(20)],
                                  "tweet_id string, post_type string, text string")
    labels = [{"framing_condition": c} for c in ("neutral", "plain", "strict")]
    systems = {"neutral": "s", "plain": "s", "strict": "strict s"}
    annotation_run(posts, str(tmp_path / "f"), str(tmp_path / "fl"), labels, "framing_condition",
                   [("A", "c", "j", " ", ":", ".")], systems, make_scorer(""), "s1")
    out = framing_study(spark.read.parquet(str(tmp_path / "f")), "neutral", ["plain", "strict"])
    drift = {r["framing_condition"] if "framing_condition" in r else r["condition"]: r
             for r in out["framing_drift_summary"].collect()}
    assert drift["plain"]["mean_drift"] == 0.0 and drift["strict"]["V1"] != 0.0
    rho = {r["condition"]: r for r in out["framing_rho_summary"].collect()}
    assert rho["plain"]["mean_rho"] == 1.0
    assert out["spread"].count() == 20 and out["drift_quantiles"].count() == 16
    same = {r["variable"]: r["direction"] for r in out["drift_quantiles"].where("condition = 'plain'").collect()}
    assert len(same) == 8 and len(set(same.values())) == 1
