"""Physical plans: what is pushed down, how often data moves, and that no join is a nested loop."""

import os
import re

import pytest

import __spark_entry__ as entry
from ratergrid.plans import REGISTRY

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")

LAZY = ["filter_language", "skip_counters", "work_plan_cross", "remaining_work", "build_prompt",
        "common_core", "paired_scores", "rater_subsets", "case_extract", "contingency", "pair_metrics",
        "krippendorff_alpha_ordinal", "alpha_by_subset", "spread_map", "spread_quadrant", "unit_totals",
        "stratified_sample", "simple_random_sample", "bounded_collect", "describe_numeric",
        "tier_composition", "score_distribution", "first_valid_attempt", "failed_keys", "id_set_ops"]


def plan(spark, name):
    return REGISTRY[name].run(spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_nested_loops_and_no_python(spark, name):
    text = plan(spark, name)
    assert not re.search("CartesianProduct|NestedLoopJoin|PythonUDF|InPandas|ArrowEval", text)


def moves(text):
    return len(re.findall(r"Exchange (?:hash|range)", text))


def test_language_filter_reaches_the_scan(spark):
    text = plan(spark, "filter_language")
    assert "EqualTo(lang,en)" in text and moves(text) == 0


def test_counters_read_two_columns_once(spark):
    text = plan(spark, "skip_counters")
    assert text.count("FileScan") == 1 and moves(text) == 0
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>", text)


@pytest.mark.parametrize("name", ["spread_map", "unit_totals", "common_core", "paired_scores", "rater_subsets"])
def test_one_shuffle_from_ratings_to_units(spark, name):
    assert moves(plan(spark, name)) == 1


@pytest.mark.parametrize("name", ["work_plan_cross", "build_prompt"])
def test_plans_fan_out_without_a_shuffle(spark, name):
    assert moves(plan(spark, name)) == 0


def test_ratings_shrink_before_they_move(spark):
    """Below the first shuffle there is a partial aggregate."""
    for name in ("krippendorff_alpha_ordinal", "alpha_by_subset", "first_valid_attempt"):
        below = plan(spark, name).split("Exchange")[-1]
        assert "partial_" in below


def test_failed_keys_are_found_by_hash_aggregates(spark):
    text = plan(spark, "failed_keys")
    assert "SortAggregate" not in text and text.count("HashAggregate") == 2


def test_an_order_by_day_needs_no_sort(spark):
    text = plan(spark, "latest_grid_by_day")
    assert "SortAggregate" not in text and "HashAggregate" in text and moves(text) == 1


def test_model_coverage_reads_its_input_once(spark):
    assert plan(spark, "model_coverage").count("FileScan") == 1


def test_every_query_has_sql():
    assert set(REGISTRY) <= set(entry.queries()) and set(REGISTRY) <= set(entry.oracle_sql())
