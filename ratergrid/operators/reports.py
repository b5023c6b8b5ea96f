"""Report tables built from the statistics. Inputs are score patterns and other small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ratergrid.dims import fan_out, join_dim, literal, map_values, quoted
from ratergrid.functions.numeric import round_exact, round_scaled
from ratergrid.functions.verdicts import agreement_zone, stability_verdict
from ratergrid.operators.agreement import (alpha_by_subset, contingency, pair_metrics,
                                           with_p_value)
from ratergrid.operators.alignment import baseline_pairs
from ratergrid.operators.profile import floor_effect, pattern_score_counts
from ratergrid.schemas import SCORE_COLS

# Fixed value: printed digits of metrics; p-values get four.
DIGITS = 3


def _pairing(sep: str = " vs "):
    return F.concat_ws(sep, "rater_a", "rater_b")


def intra_rater_table(patterns: DataFrame, first: str, second: str) -> DataFrame:
    """Retest agreement per variable; drift is first - second."""
    m = with_p_value(pair_metrics(contingency(patterns, [(first, second)])))
    return m.select(
        "variable",
        round_scaled("alpha", DIGITS).alias("krippendorff_alpha"),
        round_scaled("rho", DIGITS).alias("spearman_rho"),
        round_scaled("p", 4).alias("spearman_p"),
        round_exact("mad", DIGITS).alias("mad"),
        round_exact("msd", DIGITS).alias("mean_drift"),
        round_exact("pct_exact", DIGITS).alias("pct_exact_agree"))


def inter_rater_table(patterns: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """rho, p and MAD for every pair and variable, numbered in pair order."""
    return inter_rater_table_of(contingency(patterns, pairs), pairs)


def inter_rater_table_of(joint: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """The same from joint counts of the pairs."""
    m = with_p_value(pair_metrics(joint))
    order = {f"{a} vs {b}": i for i, (a, b) in enumerate(pairs, 1)}
    return m.select(
        map_values(_pairing(), order).alias("pair_ord"), "rater_a", "rater_b",
        _pairing().alias("pairing"), "variable",
        round_scaled("rho", DIGITS).alias("spearman_rho"),
        round_scaled("p", 4).alias("spearman_p"),
        round_exact("mad", DIGITS).alias("mad"))


def alpha_subset_table(patterns: DataFrame, subsets: dict[str, list[str]],
                       cols: list[str] = SCORE_COLS) -> DataFrame:
    """Alpha per rater group, one column per variable."""
    alpha = alpha_by_subset(patterns, subsets)
    return pivot_metric(alpha, "subset", "alpha", cols, lambda x: round_scaled(x, DIGITS))


def pivot_metric(df: DataFrame, index: str, value: str, cols: list[str] = SCORE_COLS,
                 finish=F.expr) -> DataFrame:
    """index x variable matrix of means, with the variables listed so no extra job runs."""
    wide = df.groupBy(index).pivot("variable", cols).agg(F.avg(value))
    return wide.select(index, *[finish(quoted(c)).alias(c) for c in cols])


def stability_table(patterns: DataFrame, first: str, second: str) -> DataFrame:
    """Agreement of two prompt variants per variable, with a verdict on the unrounded rho."""
    m = with_p_value(pair_metrics(contingency(patterns, [(first, second)])))
    return m.select(
        "variable",
        round_scaled("rho", DIGITS).alias("spearman_rho"),
        round_scaled("p", 4).alias("p_value"),
        round_scaled("alpha", DIGITS).alias("krippendorff_alpha"),
        round_exact("mad", DIGITS).alias("mad"),
        round_exact("pct_exact", DIGITS).alias("pct_exact_agree"),
        stability_verdict(F.col("rho")).alias("verdict"),
        agreement_zone(F.col("alpha")).alias("alpha_zone"))


def framing_metrics(patterns: DataFrame, baseline: str, conditions: list[str]) -> DataFrame:
    """Long table (condition, variable): drift (condition - baseline), rho and alpha."""
    m = pair_metrics(contingency(patterns, baseline_pairs(baseline, conditions)))
    return m.select(F.col("rater_b").alias("condition"), "variable", (-F.col("msd")).alias("drift"),
                    "rho", "alpha", "mad", "pct_exact")


def _summary(metrics: DataFrame, value: str, mean_name: str, cols: list[str], rounding,
             nan_policy: str) -> DataFrame:
    """Variables as columns, rounded, and the mean of the rounded values."""
    wide = pivot_metric(metrics, "condition", value, cols, lambda x: rounding(x, DIGITS))
    names = [quoted(c) for c in cols]
    if nan_policy == "propagate":
        mean = f"({' + '.join(names)}) / {len(cols)}"
    elif nan_policy == "skip":
        known = " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in names)
        mean = f"try_divide({' + '.join(f'coalesce({c}, 0.0D)' for c in names)}, {known})"
    else:
        raise ValueError(f"unknown nan_policy {nan_policy!r}")
    return wide.withColumn(mean_name, round_scaled(mean, DIGITS))


def framing_drift_summary(metrics: DataFrame, cols: list[str] = SCORE_COLS) -> DataFrame:
    return _summary(metrics, "drift", "mean_drift", cols, round_exact, "propagate")


def framing_rho_summary(metrics: DataFrame, cols: list[str] = SCORE_COLS) -> DataFrame:
    """The mean is NULL when any variable is undefined."""
    return _summary(metrics, "rho", "mean_rho", cols, round_scaled, "propagate")


def framing_alpha_summary(metrics: DataFrame, cols: list[str] = SCORE_COLS) -> DataFrame:
    """The mean skips undefined variables."""
    return _summary(metrics, "alpha", "mean_alpha", cols, round_scaled, "skip")


def abs_drift_vs_rho(metrics: DataFrame) -> DataFrame:
    return metrics.select("condition", "variable", "rho", F.abs("drift").alias("abs_drift"))


def rho_vs_exact(patterns: DataFrame, first: str, second: str) -> DataFrame:
    """rho against exact agreement, low-variance variables flagged by the first variant's floor."""
    m = pair_metrics(contingency(patterns, [(first, second)]))
    floor = floor_effect(pattern_score_counts(patterns, [first]))
    return (m.join(floor.select("variable", F.col("floor_effect").alias("low_variance")), "variable")
            .select("variable", "rho", "pct_exact", "low_variance"))


def metric_lookup(table: DataFrame, wanted: list[tuple[str, str, str]], value: str) -> DataFrame:
    """Point lookups (rater_a, rater_b, variable) in a result table; NULL when absent."""
    schema = "rater_a string, rater_b string, variable string"
    keys = ["rater_a", "rater_b", "variable"]
    hits = join_dim(table.select(*keys, value), wanted, schema, keys, "inner")
    listed = table.sparkSession.range(1).select(fan_out([dict(zip(keys, w)) for w in wanted]))
    return listed.join(hits, keys, "left")


def reliability_summary(patterns: DataFrame, first: str, second: str,
                        groups: dict[str, list[str]]) -> DataFrame:
    """Per variable: retest rho, MAD and MSD, alpha of each named group, floor flag."""
    m = pair_metrics(contingency(patterns, [(first, second)]))
    alpha = (alpha_by_subset(patterns, groups).groupBy("variable")
             .pivot("subset", list(groups)).agg(F.first("alpha")))
    floor = floor_effect(pattern_score_counts(patterns, [first])).select("variable", "floor_effect")
    joined = m.join(alpha, "variable", "left").join(floor, "variable", "left")
    return joined.select(
        "variable",
        round_scaled("rho", DIGITS).alias("rho"),
        round_exact("mad", DIGITS).alias("mad"),
        round_exact("msd", DIGITS).alias("msd"),
        *[round_scaled(f"`{g}`", DIGITS).alias(f"alpha_{g}") for g in groups],
        "floor_effect")


def agreement_matrix(metrics: DataFrame, raters: list[str], value: str = "rho",
                     lower_only: bool = False) -> DataFrame:
    """Symmetric rater x rater matrix per variable with a unit diagonal."""
    both = F.array(F.struct(F.col("rater_a").alias("row"), F.col("rater_b").alias("col")),
                   F.struct(F.col("rater_b").alias("row"), F.col("rater_a").alias("col")))
    cells = metrics.select("variable", F.col(value).alias("x"), F.inline(both))
    matrix = cells.groupBy("variable", "row").pivot("col", raters).agg(F.first("x"))
    ords = ", ".join(f"{literal(r)}, {i}" for i, r in enumerate(raters))
    out = []
    for i, r in enumerate(raters):
        x = f"CASE WHEN row = {literal(r)} THEN 1.0D ELSE {quoted(r)} END"
        if lower_only:
            x = f"CASE WHEN map({ords})[row] >= {i} THEN {x} END"
        out.append(F.expr(x).alias(r))
    return matrix.select("variable", "row", *out)


def case_extract(annotations: DataFrame, cases: list[tuple[str, str]],
                 unit: str = "unit_id", label: str = "rater") -> DataFrame:
    """All raters' rows of the chosen units, by case then rater."""
    listed = annotations.where(F.col(unit).isin([u for _, u in cases]))  # reaches the scan
    picked = join_dim(listed, [(u, c) for c, u in cases],
                      f"{unit} string, case_name string", unit)
    return picked.orderBy("case_name", label)


def minmax_scale(df: DataFrame, col: str, name: str, base: float = 0.0, span: float = 1.0,
                 eps: float = 1e-9) -> DataFrame:
    """base + span * (x - min) / (max - min + eps) over a small metric table."""
    every = Window.partitionBy()
    lo, hi = F.min(col).over(every), F.max(col).over(every)
    return df.withColumn(name, F.lit(base) + F.lit(span) * (F.col(col) - lo) / (hi - lo + eps))
