"""Whole runs: draw a sample, annotate it, and report how far the raters agree.

Each run has one pass over the large input. Score patterns are written to the shared folder, and all
report tables read those few rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ratergrid.dims import map_values, quoted, small_table
from ratergrid.functions.posts import ENGAGEMENT_PROPORTIONS, ENGAGEMENT_TIERS
from ratergrid.operators import alignment as L, disagreement as D, posts as P, reports as R
from ratergrid.operators import responses as Q, sampling as Z, workplan as W
from ratergrid.operators.agreement import (agreement_breakdown, contingency, contingency_dense,
                                            pair_metrics)
from ratergrid.operators.hygiene import (annotation_id, as_scores, dedupe_latest, drop_legacy_rater,
                                         invalid_report, invalid_rows, missing_ids, validity_filter)
from ratergrid.operators.profile import (pattern_score_counts, score_distribution,
                                         score_proportions, tier_composition)
from ratergrid.schemas import REQUIRED_POST_COLS, SCORE_COLS, annotation_columns
from ratergrid.session import stored
from ratergrid.sources import (append_annotations, append_keyed, load_existing, min_rows_guard, read_keyed,
                               refuse_repeats, require_columns, sink_csv, sink_parquet_typed)
from ratergrid.streaming.call_log import BATCH_CALLS, logged_calls, mark_stored, unread_log


#: Raters from which on pairs are counted densely.
DENSE_FROM = 10


def _pool(source: DataFrame, language: str, start: str, end: str, tiers: dict[str, float | None],
          limit: tuple[int, str, str] | None) -> DataFrame:
    if limit:
        wanted = P.filter_date_range(P.filter_language(source, language), start, end)
        source = Z.bounded_collect(wanted, *limit)
    return P.ingest_posts(source, language, start, end).transform(
        P.classify_engagement, "like_count", tiers)


def sampling_report(source: DataFrame, sample: DataFrame, language: str, start: str, end: str, n: int,
                    tiers: dict[str, float | None] = ENGAGEMENT_TIERS,
                    proportions: dict[str, float] = ENGAGEMENT_PROPORTIONS,
                    limit: tuple[int, str, str] | None = None) -> dict[str, DataFrame]:
    """What a sampling run read, kept and skipped, and how pool and sample are made up."""
    pool = stored(_pool(source, language, start, end, tiers, limit).select("engagement_level"), "tiers")
    return {
        "skip_counters": P.skip_counters(source, language, start, end),
        "pool_composition": tier_composition(pool, tiers=list(tiers)),
        "sample_composition": tier_composition(sample, tiers=list(tiers)),
        "shortfall": Z.tier_shortfall(pool, "engagement_level", Z.tier_quota(n, proportions)),
    }


def sampling_run(source: DataFrame, out: str, language: str, start: str, end: str, n: int,
                 seed: int, tiers: dict[str, float | None] = ENGAGEMENT_TIERS,
                 proportions: dict[str, float] = ENGAGEMENT_PROPORTIONS,
                 sampled_at: Column | None = None, limit: tuple[int, str, str] | None = None) -> DataFrame:
    """Filter, tier, sample and write a typed sample table; returns the table.

    ``limit`` = (rows, group column, position column) stops the collection after so many accepted posts, in
    the order of file and position, say.
    """
    pool = _pool(source, language, start, end, tiers, limit)
    min_rows_guard(pool, n)
    sample = Z.stratified_sample(pool, "engagement_level", Z.tier_quota(n, proportions), "tweet_id",
                                 seed)
    sink_parquet_typed(P.add_sample_metadata(sample, sampled_at=sampled_at), out)
    return source.sparkSession.read.parquet(out)


def annotation_run(posts: DataFrame, out: str, log: str, labels: list[dict], label_col: str,
                   prompts: list[tuple], system_prompt: str | dict[str, str],
                   scorer: Callable[[str, str, str, str], str], session: str,
                   variables: list[str] = SCORE_COLS, max_attempts: int = Q.MAX_ATTEMPTS,
                   tasks: int | None = None, batch_calls: int = BATCH_CALLS,
                   keyed: bool = False) -> DataFrame:
    """Annotate the (post, label) keys that ``out`` lacks and append them; returns the failed keys.

    ``labels`` are models, prompt variants or conditions. Responses go to ``log`` in batches of ``batch_calls``,
    before they are read. A run first stores what earlier, unfinished runs have logged, so a run that was stopped is
    gone on with and repeats one batch of calls at most; logs that were stored are marked and not read again.
    ``system_prompt`` is one text, or one per condition; ``tasks`` calls run at a time. With ``keyed``, ``out`` is a
    keyed table (``read_keyed``), for outputs that grow over many runs; otherwise a plain Parquet folder.
    """
    spark = posts.sparkSession
    append, load = (append_keyed, read_keyed) if keyed else (append_annotations, load_existing)
    posts = require_columns(posts, REQUIRED_POST_COLS).select(*REQUIRED_POST_COLS)
    posts = posts.withColumn("tweet_id", F.col("tweet_id").cast("string"))

    def store(responses: DataFrame) -> None:
        done = Q.first_valid_attempt(responses, variables, max_attempts=max_attempts)
        # each post meets its annotations once; what belongs to the label is looked up afterwards
        rows = done.withColumnRenamed("unit_id", "tweet_id").join(posts, "tweet_id")
        rows = annotation_id(rows, ["tweet_id", "rater"]).withColumns({
            **{c: map_values(F.col("rater"), {str(row[label_col]): row[c] for row in labels})
               for c in labels[0]},
            "date": F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"),
            "annotation_session": F.lit(session)})
        order = [c for c in annotation_columns(variables) if c in rows.columns]
        extra = [c for c in labels[0] if c not in order]
        append(spark, rows.select(*order, *extra).where(F.col(label_col).isNotNull()), out, ["tweet_id", label_col])

    earlier = unread_log(spark, log)
    if earlier is not None:
        store(Q.read_responses(earlier, variables, error="error"))
        mark_stored(spark, log, earlier)
    existing = load(spark, out)
    work = (W.work_plan_cross(posts, labels) if existing is None
            else W.remaining_work(posts, labels, existing, "tweet_id", label_col))
    if "prompt_variant" not in work.columns:
        work = work.withColumn("prompt_variant", F.lit(prompts[0][0]))
    work = W.build_prompt(work, prompts)
    if isinstance(system_prompt, dict):
        work = W.system_prompt_lookup(work, system_prompt, label_col)
    else:
        work = work.withColumn("system_prompt", F.lit(system_prompt))
    calls = work.withColumnsRenamed({"tweet_id": "unit_id"}).withColumn(
        "rater", F.col(label_col).cast("string"))
    run_id = f"r{uuid.uuid4().hex}"
    made = logged_calls(calls, scorer, log, run_id, max_attempts, tasks, batch_calls)
    responses = Q.read_responses(made, variables, error="error")
    store(responses)
    mark_stored(spark, log, None, run_id)
    return Q.failed_keys(responses, max_attempts=max_attempts, variables=variables)


def _as_raters(df: DataFrame, rater: Column, id_col: str, keep: list[str] = ()) -> DataFrame:
    return as_scores(df).select(F.col(id_col).cast("string").alias("unit_id"), rater.alias("rater"),
                                *SCORE_COLS, *keep)


def _latest(df: DataFrame, keys: list[str], order_cols: list[str], label: str) -> DataFrame:
    """One row per key: the latest by ``order_cols``, or an error when keys repeat and no order is given."""
    if order_cols:
        return dedupe_latest(df.select(*keys, *SCORE_COLS, *order_cols), keys, order_cols)
    return refuse_repeats(df, keys, label)


def present_models(models: DataFrame, model_col: str, display: dict[str, str],
                   most: int = 1000) -> dict[str, str]:
    """Display names of the versions that occur, listed ones first and in their order; the others keep
    their version as name. A table of more than ``most`` versions is refused."""
    found = [r[0] for r in models.select(model_col).where(F.col(model_col).isNotNull()).distinct()
             .limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} distinct values of {model_col}")
    listed = {k: v for k, v in display.items() if k in found}
    return listed | {k: k for k in sorted(found) if k not in listed}


def consistency_study(first: DataFrame, second: DataFrame, models: DataFrame,
                      display: dict[str, str], humans: tuple[str, str] = ("Human P1", "Human P2"),
                      short: dict[str, str] | None = None, id_col: str = "tweet_id",
                      model_col: str = "llm_name_version", order_cols: list[str] = (),
                      validate_models: bool = True, legacy: list[str] = (),
                      human_order_cols: list[str] = (),
                      cases: list[str] = (), dense_from: int = DENSE_FROM) -> dict[str, DataFrame]:
    """Retest and model agreement on the posts every rater scored.

    The models are those that occur in ``models``, but for ``legacy`` versions; ``display`` names some of
    them and puts these first. With order columns the latest of repeated rows counts; without, a
    repeated (post, rater) is an error. What was left out is among the tables: ``invalid_rows``,
    ``invalid_report``, ``missing_ids`` (posts of the first rating that the second lacks) and
    ``model_coverage``. ``cases`` lists posts whose scores are returned side by side. From ``dense_from`` raters on,
    patterns would be as many as posts: pairs are then counted densely, and the rest is taken from the posts.
    """
    models = drop_legacy_rater(models, list(legacy), model_col) if legacy else models
    names = present_models(models, model_col, display)
    raters = [*humans, *names.values()]
    people = [_as_raters(_latest(df, [id_col], list(human_order_cols), h), F.lit(h), id_col)
              for df, h in zip((first, second), humans)]
    latest = _latest(models, [id_col, model_col], list(order_cols), model_col)
    machines = _as_raters(latest, map_values(F.col(model_col), names), id_col).where("rater IS NOT NULL")
    checked = [*people, *([machines] if validate_models else [])]
    given = stored(reduce(DataFrame.unionByName, checked), "given")
    annotations = validity_filter(given)
    if not validate_models:
        annotations = annotations.unionByName(machines)
    core = stored(L.common_core(L.score_grid_wide(annotations, raters), raters), "core")
    dense = len(raters) >= dense_from
    patterns = (core.withColumn("n", F.lit(1).cast("bigint")) if dense
                else stored(L.pattern_counts(core, raters), "patterns"))
    subsets = L.study_subsets(list(humans), list(names.values()), short)
    groups = {"all": raters, "models": list(names.values()), "humans": list(humans)}
    totals = stored(D.unit_totals(L.grid_to_ratings(core, raters)), "totals")
    spread = D.spread_map(totals)
    pairs = L.study_pairs(list(humans), list(names.values()))
    joint = stored(contingency_dense(core, raters) if dense else contingency(patterns, pairs), "pairs")
    drifts = D.drift_values(contingency(patterns, [humans]), ["variable"])
    diff = D.total_differences(totals, *humans)
    counts = pattern_score_counts(patterns, raters)
    score = lambda v, r: F.max(F.when(F.col("variable") == v, F.col(quoted(r))))
    wide = core.groupBy("unit_id").agg(*[score(v, r).alias(f"{v}_{i}") for v in SCORE_COLS
                                         for i, r in enumerate(humans)])
    wide = wide.select("unit_id", F.inline(F.array(*[F.struct(
        F.lit(r).alias("rater"), *[F.col(f"{v}_{i}").alias(v) for v in SCORE_COLS])
        for i, r in enumerate(humans)])))
    valid = given.transform(validity_filter)
    one, two = (valid.where(F.col("rater") == h) for h in humans)
    coverage = small_table(first.sparkSession, [(n,) for n in names.values()], "rater string").join(
        machines.groupBy("rater").agg(F.count(F.lit(1)).alias("n_rows")), "rater", "left")
    out = {
        "intra_annotator": R.intra_rater_table(patterns, *humans),
        "inter_annotator": R.inter_rater_table_of(joint, pairs),
        "agreement_matrix": R.agreement_matrix(pair_metrics(joint), raters),
        "krippendorff_alpha": R.alpha_subset_table(patterns, subsets),
        "agreement_breakdown": agreement_breakdown(joint),
        "score_drift": D.drift_table(wide, *humans),
        "drift_counts": D.drift_counts(drifts),
        "drift_quantiles": D.drift_quantiles(drifts),
        "spread": D.spread_quadrant(spread),
        "spread_medians": D.spread_medians(spread),
        "divergence_hist": D.score_divergence_hist(diff),
        "divergence_stats": D.score_divergence_stats(diff),
        "score_distribution": score_distribution(counts),
        "reliability_summary": R.reliability_summary(patterns, *humans, groups),
        "invalid_rows": invalid_rows(given.withColumn("unit_id", F.concat_ws("/", "rater", "unit_id"))),
        "invalid_report": invalid_report(given),
        "missing_ids": missing_ids(one, two),
        "model_coverage": coverage.withColumns({
            "n_rows": F.coalesce("n_rows", F.lit(0)), "n_models": F.lit(len(names))}),
    }
    if cases:
        out["cases"] = core.where(F.col("unit_id").isin([str(c) for c in cases])).repartition(1)
    return out


def _variant_core(annotations: DataFrame, key: str, variants: list[str], id_col: str,
                  order_cols: list[str]) -> DataFrame:
    """Scores of the posts that all variants rated, side by side, written once."""
    rows = _as_raters(annotations, F.col(key), id_col, order_cols)
    if order_cols:
        grid = L.latest_score_grid(rows, variants, order_cols)
    else:
        grid = L.score_grid_wide(refuse_repeats(rows, ["unit_id", "rater"], key), variants)
    return stored(L.common_core(grid, variants), "core")


def stability_study(annotations: DataFrame, variants: tuple[str, str] = ("A", "B"),
                    key: str = "prompt_variant", id_col: str = "tweet_id",
                    order_cols: list[str] = ()) -> dict[str, DataFrame]:
    """Two prompt variants compared on the posts both scored. Rows that repeat a (post, variant) need an order."""
    core = _variant_core(annotations, key, list(variants), id_col, list(order_cols))
    patterns = stored(L.pattern_counts(core, list(variants)), "patterns")
    counts = pattern_score_counts(patterns, list(variants))
    diff = D.total_differences(D.unit_totals(L.grid_to_ratings(core, list(variants))), *variants)
    columns = {v: f"prompt_{v.lower()}" for v in variants}
    return {
        "stability_summary": R.stability_table(patterns, *variants),
        "score_distributions": score_proportions(counts, columns),
        "rho_vs_exact": R.rho_vs_exact(patterns, *variants),
        "agreement_breakdown": agreement_breakdown(contingency(patterns, [variants])),
        "divergence_hist": D.score_divergence_hist(diff),
        "divergence_stats": D.score_divergence_stats(diff),
    }


def framing_study(annotations: DataFrame, baseline: str, conditions: list[str],
                  key: str = "framing_condition", id_col: str = "tweet_id",
                  order_cols: list[str] = (), cases: list[str] = ()) -> dict[str, DataFrame]:
    """Framing conditions compared with the baseline on the posts scored under all of them."""
    every = [baseline, *conditions]
    core = _variant_core(annotations, key, every, id_col, list(order_cols))
    patterns = stored(L.pattern_counts(core, every), "patterns")
    metrics = R.framing_metrics(patterns, baseline, conditions)
    spread = stored(D.spread_map(D.unit_totals(L.grid_to_ratings(core, every))), "spread")
    joint = contingency(patterns, [(c, baseline) for c in conditions])
    drifts = D.drift_values(joint, ["rater_a", "variable"]).withColumnRenamed("rater_a", "condition")
    out = {
        "framing_drift_summary": R.framing_drift_summary(metrics),
        "framing_rho_summary": R.framing_rho_summary(metrics),
        "framing_alpha_summary": R.framing_alpha_summary(metrics),
        "abs_drift_vs_rho": R.abs_drift_vs_rho(metrics),
        "drift_quantiles": D.drift_quantiles(drifts, ["condition", "variable"]),
        "spread": D.spread_quadrant(spread),
        "spread_medians": D.spread_medians(spread),
    }
    if cases:
        out["cases"] = core.where(F.col("unit_id").isin([str(c) for c in cases])).repartition(1)
    return out


def write_reports(tables: dict[str, DataFrame], out: str) -> None:
    """One CSV per table; report tables with a row per post are written in parallel."""
    per_post = {"score_drift", "spread", "invalid_rows", "missing_ids"}
    for name, df in tables.items():
        sink_csv(df, f"{out}/{name}", single_file=name not in per_post)
