"""Calls that outlive a crash: batches, what a later run reads, and how often the scorer is called."""

import json

import pytest

from ratergrid.plans.studies import annotation_run
from ratergrid.streaming.call_log import logged_calls, mark_stored, unread_log

PROMPTS = [("A", "codebook", "json", "\nRate ", ":", ".")]
ANSWER = json.dumps({f"V{k}": {"score": 1 + k % 3, f"V{k}_reason": "r"} for k in range(1, 9)})


def posts_df(spark, n):
    return spark.createDataFrame([(str(i), "tweet", f"text {i}") for i in range(n)],
                                 "tweet_id string, post_type string, text string")


def counting_scorer(folder, stop_at=None):
    """Counts its calls in a file; beyond ``stop_at`` it brings the task down, which no scorer error does."""
    def scorer(text, post_type, prompt, system_prompt):
        import os
        path = f"{folder}/calls"
        with open(path, "a") as file:
            file.write(text + "\n")
        if stop_at is not None and os.path.getsize(path) and sum(1 for _ in open(path)) > stop_at:
            raise SystemExit("killed")
        return ANSWER
    return scorer


def calls_made(folder):
    return (folder / "calls").read_text().splitlines()


def test_a_killed_run_goes_on_where_its_last_batch_ended(spark, tmp_path):
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    run = lambda scorer: annotation_run(posts_df(spark, 80), out, log, [{"prompt_variant": "A"}], "prompt_variant", PROMPTS,
                                        "system", scorer, "s", tasks=4, batch_calls=8)
    with pytest.raises(Exception, match="killed|exit|Exception"):
        run(counting_scorer(tmp_path, stop_at=40))
    first = len(calls_made(tmp_path))
    kept = unread_log(spark, log).select("unit_id").distinct().count()
    assert 40 < first < 60 and first - kept <= 3 * 8  # what a batch holds is uneven by hash
    assert run(counting_scorer(tmp_path)).count() == 0
    again = calls_made(tmp_path)[first:]
    assert len(again) == 80 - kept and len(set(again)) == len(again)
    assert spark.read.parquet(out).count() == 80
    assert run(counting_scorer(tmp_path)).count() == 0 and len(calls_made(tmp_path)) == first + len(again)


def test_stored_logs_are_not_read_again(spark, tmp_path):
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    run = lambda n: annotation_run(posts_df(spark, n), out, log, [{"prompt_variant": "A"}], "prompt_variant", PROMPTS, "system",
                                   counting_scorer(tmp_path), "s", batch_calls=4)
    for n in (6, 12):
        run(n)
        left = unread_log(spark, log)
        assert left.count() == 0
        text = left._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(run" in text or "NOT" in text.split("PartitionFilters")[1][:200]
    assert len(calls_made(tmp_path)) == 12 and spark.read.parquet(out).count() == 12


def test_batches_are_folders_and_nothing_to_do_is_nothing(spark, tmp_path):
    log = str(tmp_path / "log")
    assert unread_log(spark, log) is None
    work = spark.range(50).selectExpr("id AS unit_id", "'m' AS rater", "CAST(id AS STRING) AS text", "'tweet' AS post_type",
                                      "'' AS prompt", "'' AS system_prompt")
    made = logged_calls(work, counting_scorer(tmp_path), log, "r1", tasks=2, batch_calls=10)
    assert made.count() == 50 and len(list((tmp_path / "log" / "run=r1").glob("b*"))) >= 4
    mark_stored(spark, log, unread_log(spark, log))
    assert unread_log(spark, log).count() == 0
    assert logged_calls(work.limit(0), counting_scorer(tmp_path), log, "r2").count() == 0
    assert len(calls_made(tmp_path)) == 50


def test_a_run_may_keep_a_keyed_table(spark, tmp_path):
    from ratergrid.sources import read_keyed

    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    for n in (5, 9, 9):
        annotation_run(posts_df(spark, n), out, log, [{"prompt_variant": "A"}], "prompt_variant", PROMPTS, "system",
                       counting_scorer(tmp_path), "s", keyed=True)
    assert read_keyed(spark, out).count() == 9 and len(calls_made(tmp_path)) == 9
