"""Totals, spread and drift per unit."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from ratergrid.functions.verdicts import DRIFT_BAND, divergence_bucket, drift_direction
from ratergrid.schemas import SCORE_COLS


def total_of(cols: list[str] = SCORE_COLS) -> Column:
    return reduce(add, [F.col(c) for c in cols])


def total_score(df: DataFrame, cols: list[str] = SCORE_COLS) -> DataFrame:
    """Adds the total of the variables, recomputed from the scores."""
    return df.withColumn("total_score", total_of(cols))


def unit_totals(ratings: DataFrame, unit: str = "unit_id") -> DataFrame:
    """Total per unit and rater from long ratings."""
    return ratings.groupBy(unit, "rater").agg(F.sum("score").alias("total_score"))


def spread_map(totals: DataFrame, unit: str = "unit_id") -> DataFrame:
    """Mean total and max - min over raters, for units with at least two raters."""
    return (totals.groupBy(unit)
            .agg(F.avg("total_score").alias("mean_score"),
                 (F.max("total_score") - F.min("total_score")).alias("spread"),
                 F.count("total_score").alias("n_raters"))
            .where("n_raters >= 2"))


def _median(col: str) -> Column:
    return F.percentile(col, F.lit(0.5), F.col("n")).cast("double").alias(f"median_{col}")


def spread_medians(spread: DataFrame) -> DataFrame:
    """Medians of mean and spread. Totals take few values, so their counts are small."""
    counts = spread.groupBy("mean_score", "spread").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(_median("mean_score"), _median("spread"))


def spread_quadrant(spread: DataFrame) -> DataFrame:
    """Side of both medians for every unit; a value on the median is on the low side."""
    medians = spread_medians(spread).select(
        F.struct("median_mean_score", "median_spread").alias("m")).scalar()
    high_score = F.col("mean_score") > medians["median_mean_score"]
    high_spread = F.col("spread") > medians["median_spread"]
    label = F.concat(F.when(high_score, "high score").otherwise("low score"), F.lit(" / "),
                     F.when(high_spread, "high spread").otherwise("low spread"))
    return spread.withColumn("quadrant", label)


# --------------------------------------------------------------------- two raters, score by score

def drift_table(annotations: DataFrame, first: str, second: str, cols: list[str] = SCORE_COLS,
                names: tuple[str, str] = ("H1", "H2"), unit: str = "unit_id") -> DataFrame:
    """One row per unit scored by both: both scores and first - second, per variable."""
    cells = [F.max(F.when(F.col("rater") == r, F.col(c))).alias(f"{c}_{name}")
             for c in cols for r, name in ((first, names[0]), (second, names[1]))]
    both = [F.max(F.col("rater") == r).alias(f"_{i}") for i, r in enumerate((first, second))]
    wide = (annotations.where(F.col("rater").isin(first, second)).groupBy(unit)
            .agg(*cells, *both).where("_0 AND _1"))
    out = [c for v in cols for c in (
        F.col(f"{v}_{names[0]}"), F.col(f"{v}_{names[1]}"),
        (F.col(f"{v}_{names[0]}") - F.col(f"{v}_{names[1]}")).alias(f"{v}_drift"))]
    return wide.select(unit, *out)


def drift_values(table: DataFrame, by: list[str]) -> DataFrame:
    """Counts per drift a - b from joint counts; the drift reports read this."""
    return (table.withColumn("drift", F.col("a") - F.col("b")).groupBy(*by, "drift")
            .agg(F.sum("n").alias("n")))


def drift_quantiles(drifts: DataFrame, by: list[str] = ("variable",),
                    band: float = DRIFT_BAND) -> DataFrame:
    """Mean, quartiles and direction of the drift per variable."""
    q = F.percentile("drift", F.array(F.lit(0.25), F.lit(0.75)), F.col("n"))
    mean = F.sum(F.col("drift") * F.col("n").cast("double")) / F.sum("n")
    return (drifts.groupBy(*by).agg(mean.alias("mean_drift"), q.alias("q"))
            .select(*by, "mean_drift", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q75"),
                    drift_direction(F.col("mean_drift"), band).alias("direction")))


def drift_counts(drifts: DataFrame, by: list[str] = ("variable",)) -> DataFrame:
    """Units scored higher, the same and lower by the first rater, and the mean drift."""
    d, n = F.col("drift"), F.col("n")
    tally = lambda hit: F.sum(F.when(hit, n).otherwise(0))
    return drifts.groupBy(*by).agg(
        tally(d > 0).alias("n_up"), tally(d == 0).alias("n_same"), tally(d < 0).alias("n_down"),
        (F.sum(d * n.cast("double")) / F.sum("n")).alias("mean_drift"))


# ------------------------------------------------------------------------------- total divergence

def total_differences(totals: DataFrame, first: str, second: str,
                      unit: str = "unit_id") -> DataFrame:
    """Counts of second - first total over units both raters scored."""
    a, b = [F.max(F.when(F.col("rater") == r, F.col("total_score"))) for r in (first, second)]
    return (totals.where(F.col("rater").isin(first, second)).groupBy(unit)
            .agg((b - a).alias("diff")).where("diff IS NOT NULL")
            .groupBy("diff").agg(F.count(F.lit(1)).alias("n")))


def score_divergence_hist(differences: DataFrame, reach: int = 4) -> DataFrame:
    """Counts per difference from -reach to reach, zero-filled; others are dropped."""
    bins = differences.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("diff"))
    n = differences.select(F.col("diff").cast("int").alias("diff"), "n")
    return bins.join(n, "diff", "left").select(
        "diff", F.coalesce("n", F.lit(0)).alias("n"),
        divergence_bucket(F.col("diff")).alias("bucket"))


def score_divergence_stats(differences: DataFrame, within: int = 3) -> DataFrame:
    """Number of units, mean, mean absolute and share within ``within`` points, over all rows."""
    d, n = F.col("diff"), F.col("n")
    total = F.sum("n")
    weighted = lambda x: F.sum(x * n.cast("double")) / total
    return differences.agg(
        total.alias("n"), weighted(d).alias("mean_diff"), weighted(F.abs(d)).alias("mean_abs"),
        (weighted(F.when(F.abs(d) <= within, 1).otherwise(0)) * 100.0).alias("pct_within"))
