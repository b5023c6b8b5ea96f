"""Descriptive profiles of posts and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratergrid.dims import fan_out, inline_rows, literal, quoted
from ratergrid.functions.posts import ENGAGEMENT_TIERS
from ratergrid.functions.verdicts import FLOOR_SHARE, floor_effect_flag
from ratergrid.schemas import VALID_SCORES
from ratergrid.session import stored


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per category, most frequent first; missing values are not counted."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), col))


def tier_composition(df: DataFrame, key: str = "engagement_level",
                     tiers: list[str] = tuple(ENGAGEMENT_TIERS)) -> DataFrame:
    """Count and percentage per tier, absent tiers as zero."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("found"))
    listed = counts.sparkSession.range(1).select(
        fan_out([{key: t, "ord": i} for i, t in enumerate(tiers, 1)]))
    n = F.coalesce("found", F.lit(0))
    total = F.sum(n).over(Window.partitionBy())
    return listed.join(counts, key, "left").select(
        key, "ord", n.alias("n"), F.try_divide(n * F.lit(100.0), total).alias("pct"))


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


#: Bins of a power of e, and parts that a bin is divided into. They bound every group that is looked at together.
PER_E, PARTS = 65536, 65536


def _bins(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (x, bin), and one row per bin with its count, mean, squared deviations and extremes."""
    rows = (df.select(F.col(col).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
            .withColumn("bin", F.expr(f"CAST(signum(x) * floor(ln(1 + abs(x)) * {PER_E}) AS BIGINT)")))
    fine = rows.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"),
        F.min("x").alias("lo"), F.max("x").alias("hi"))
    return rows, fine


def _quantiles_of(rows: DataFrame, fine: DataFrame, probs: dict[str, float]) -> DataFrame:
    coarse = (fine.withColumn("coarse", F.expr("floor(bin / 1024)")).groupBy("coarse")
              .agg(F.sum("n").alias("coarse_n")).selectExpr(
                  "coarse", "sum(coarse_n) OVER () AS total",
                  "sum(coarse_n) OVER (ORDER BY coarse) - coarse_n AS coarse_before"))
    ranks = {}
    for name, prob in probs.items():
        lower = f"floor((total - 1) * {float(prob)}D)"
        ranks[f"{name}_lo"], ranks[f"{name}_hi"] = lower, f"least({lower} + 1, total - 1)"
    holds = " OR ".join(f"{rank} BETWEEN before AND before + n - 1" for rank in ranks.values())
    # all broadcast sides are bounded: coarse bins by the range of a double, the others by the ranks
    wanted = (fine.withColumn("coarse", F.expr("floor(bin / 1024)")).join(F.broadcast(coarse), "coarse")
              .withColumn("before", F.expr(
                  "coarse_before + sum(n) OVER (PARTITION BY coarse ORDER BY bin) - n"))
              .where(holds).select("bin", "before", "total", "lo", "hi"))
    part = F.expr(f"least(coalesce(floor(try_divide(x - lo, hi - lo) * {PARTS}), 0), {PARTS - 1})")
    inside = rows.join(F.broadcast(wanted), "bin").withColumn("part", part)
    parts = (inside.groupBy("bin", "part", "before", "total").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("before", F.expr("before + sum(n) OVER (PARTITION BY bin ORDER BY part) - n"))
             .where(holds).select("bin", "part", F.col("before").alias("part_before")))
    values = (inside.join(F.broadcast(parts), ["bin", "part"])
              .groupBy("bin", "part", "part_before", "total", "x").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("upto", F.expr("part_before + sum(n) OVER (PARTITION BY bin, part ORDER BY x)")))
    ends = [F.expr(f"max(CASE WHEN {rank} BETWEEN upto - n AND upto - 1 THEN x END)").alias(end)
            for end, rank in ranks.items()]
    out = []
    for name, prob in probs.items():
        position = f"((total - 1) * {float(prob)}D)"
        out.append(f"{name}_lo + ({name}_hi - {name}_lo) * ({position} - floor({position})) "
                   f"AS {name}")
    return values.agg(F.max("total").alias("total"), *ends).selectExpr(*out)


def exact_quantiles(df: DataFrame, col: str, probs: dict[str, float] = QUARTILES) -> DataFrame:
    """One row of exact quantiles with linear interpolation, for any number of distinct values.

    Three passes over one column: counts in narrow bins of ln(1 + |x|); counts in equal parts of the few bins that
    hold the wanted ranks; the values in the parts that hold them. Rows are never sorted or shuffled as such,
    and a bin with very many distinct values is divided again.
    """
    return _quantiles_of(*_bins(df, col), probs)


def describe_numeric(df: DataFrame, col: str, approx: bool = False,
                     accuracy: int = 10000) -> DataFrame:
    """count, mean, std (n - 1), min, quartiles, max. ``approx`` sketches the quartiles in one pass.

    The exact form writes the bins of the first pass to the shared folder and takes count, mean, deviation and
    extremes from them, so the column is read three times in all.
    """
    if approx:
        x = F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))
        basics = [F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                  F.min(x).alias("min"), F.max(x).alias("max")]
        sketch = F.percentile_approx(x, list(QUARTILES.values()), accuracy).alias("q")
        return df.agg(*basics, sketch).select(
            "count", "mean", "std", "min",
            *[F.col("q")[i].alias(name) for i, name in enumerate(QUARTILES)], "max")
    rows, fine = _bins(df, col)
    fine = stored(fine, "bins")
    total = F.sum("n")
    mean = F.sum(F.col("n") * F.col("mean")) / total
    whole = fine.agg(total.alias("count"), mean.alias("mean"), F.min("lo").alias("min"), F.max("hi").alias("max"))
    centre = whole.select("mean").scalar()
    squares = F.sum(F.col("n") * (F.col("var") + (F.col("mean") - centre) * (F.col("mean") - centre)))
    spread = fine.agg(squares.alias("s"), total.alias("k")).select(
        F.expr("CASE WHEN k > 1 THEN sqrt(s / (k - 1)) END").alias("std")).scalar()
    quartiles = _quantiles_of(rows, fine, QUARTILES).select(F.struct(*QUARTILES).alias("q")).scalar()
    return whole.select(F.coalesce("count", F.lit(0)).alias("count"), "mean", spread.alias("std"), "min",
                        *[quartiles[name].alias(name) for name in QUARTILES], "max")


def date_extent(df: DataFrame, col: str = "date") -> DataFrame:
    return df.agg(F.min(col).alias("first"), F.max(col).alias("last"))


def all_match(df: DataFrame, **conditions: Column) -> DataFrame:
    """Whether each named condition holds on every row, in one pass; NULL counts as a miss, no rows as a match."""
    return df.agg(*[(F.count_if(~F.coalesce(c, F.lit(False))) == 0).alias(name)
                    for name, c in conditions.items()])


def model_coverage(df: DataFrame, model_col: str = "rater") -> DataFrame:
    """Rows per model and the number of models present."""
    per_model = df.groupBy(model_col).agg(F.count(F.lit(1)).alias("n_rows"))
    # the window runs over one row per model
    return per_model.withColumn("n_models", F.count(F.col(model_col)).over(Window.partitionBy()))


def score_counts(ratings: DataFrame, by: list[str] = ("rater", "variable")) -> DataFrame:
    """Observed counts per score; the input of the distribution reports."""
    return ratings.groupBy(*by, "score").agg(F.count(F.lit(1)).alias("n"))


def pattern_score_counts(patterns: DataFrame, raters: list[str],
                         by: list[str] = ("variable",)) -> DataFrame:
    """The same counts per rater from score patterns, without reading ratings again."""
    cells = inline_rows([{"rater": literal(r), "score": quoted(r)} for r in raters])
    return (patterns.selectExpr(*map(quoted, by), "n", cells).where("score IS NOT NULL")
            .groupBy("rater", *by, "score").agg(F.sum("n").alias("n")))


def score_distribution(counts: DataFrame, by: list[str] = ("rater", "variable"),
                       values: list[int] = VALID_SCORES) -> DataFrame:
    """Counts per score of the scale, zero where a score never occurs."""
    per_value = [F.expr(f"sum(CASE WHEN score = {v} THEN n ELSE 0 END)").alias(f"n_{v}")
                 for v in values]
    filled = inline_rows([{"score": literal(v), "n": f"n_{v}"} for v in values])
    return counts.groupBy(*by).agg(*per_value).selectExpr(*map(quoted, by), filled)


def score_proportions(counts: DataFrame, columns: dict[str, str],
                      values: list[int] = VALID_SCORES, key: str = "rater") -> DataFrame:
    """Share of each score per variable, one column per listed rater or prompt variant."""
    def n(rater: str, test: str = "true") -> str:
        return f"sum(CASE WHEN {quoted(key)} = {literal(rater)} AND {test} THEN n ELSE 0 END)"

    rows = inline_rows([{"score": literal(v), **{
        name: f"try_divide({quoted(f'{name}_{v}')}, {quoted(name)})" for name in columns.values()}}
        for v in values])
    sums = [F.expr(n(r)).alias(name) for r, name in columns.items()]
    sums += [F.expr(n(r, f"score = {v}")).alias(f"{name}_{v}")
             for r, name in columns.items() for v in values]
    return counts.groupBy("variable").agg(*sums).selectExpr("variable", rows)


def floor_effect(counts: DataFrame, by: list[str] = ("rater", "variable"),
                 minimum: int = VALID_SCORES[0], threshold: float = FLOOR_SHARE) -> DataFrame:
    """Share of scores at the scale minimum, flagged when it exceeds the threshold."""
    at_min = F.sum(F.when(F.col("score") == minimum, F.col("n")).otherwise(0))
    share = (at_min / F.sum("n")).alias("floor_share")
    return (counts.groupBy(*by).agg(share)
            .withColumn("floor_effect", floor_effect_flag(F.col("floor_share"), threshold)))
