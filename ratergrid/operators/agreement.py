"""Agreement statistics. Everything here reads small tables of counts, never raw ratings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ratergrid.dims import inline_rows, literal, quoted
from ratergrid.functions.numeric import spearman_p
from ratergrid.operators.alignment import paired_scores
from ratergrid.schemas import VALID_SCORES

PAIR = ["rater_a", "rater_b", "variable"]
#: Most bytes of pair matrices that a task holds at once.
GRAM_BYTES = 64 << 20


def contingency(patterns: DataFrame, pairs: list[tuple[str, str]],
                by: list[str] = ("variable",)) -> DataFrame:
    """Joint counts ``n`` of the scores (a, b) per pair and variable.

    ``patterns`` comes from ``pattern_counts``; the pairs are formed on distinct patterns.
    """
    joint = paired_scores(patterns, pairs, keep=[*by, "n"])
    return joint.groupBy("rater_a", "rater_b", *by, "a", "b").agg(F.sum("n").alias("n"))


def contingency_of_grid(grid: DataFrame, pairs: list[tuple[str, str]],
                        by: list[str] = ("variable",)) -> DataFrame:
    """The same counts straight from a grid, for raters too many for patterns.

    Pairs fan out in place and are summed before they move: pairs x groups x scores^2 rows per task.
    """
    return contingency_of(paired_scores(grid, pairs, keep=list(by)), ["rater_a", "rater_b", *by])


def contingency_dense(grid: DataFrame, raters: list[str], by: list[str] = ("variable",),
                      values: list[int] = VALID_SCORES, most_bytes: int = GRAM_BYTES) -> DataFrame:
    """Joint counts of all pairs of ``raters``, in their order, from a grid, for scores on the scale.

    A task adds up, per group of ``by``, the matrix of how often each (rater, score) meets each other one: a product of
    0-1 matrices for each batch. No pair of scores is ever a row; what moves is (raters x scores)^2 / 2 rows a task and
    group at most. Groups beyond ``most_bytes`` of matrices are handed on and summed with the rest.
    """
    kinds = [f"{quoted(c)} {grid.schema[c].dataType.simpleString()}" for c in by]
    parts = grid.select(*by, *[F.col(quoted(r)) for r in raters]).mapInArrow(
        lambda batches: _gram(batches, len(by), len(raters), list(values), most_bytes),
        ", ".join([*kinds, "_a int, _b int, a int, b int, n long"]))
    names = F.array(*[F.lit(r) for r in raters])
    counts = parts.groupBy("_a", "_b", *by, "a", "b").agg(F.sum("n").alias("n"))
    return counts.select(names[F.col("_a")].alias("rater_a"), names[F.col("_b")].alias("rater_b"), *by, "a", "b", "n")


def _gram(batches: Iterator[pa.RecordBatch], n_by: int, raters: int, values: list[int],
          most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows (group, rater numbers, scores, n) of the counts of all batches of a task."""
    k = len(values)
    first, second = np.triu_indices(raters, 1)
    cell_a = (first[:, None] * k + np.repeat(np.arange(k), k)).ravel()
    cell_b = (second[:, None] * k + np.tile(np.arange(k), k)).ravel()
    sums: dict[tuple, np.ndarray] = {}
    kinds: list[pa.DataType] = []

    def handed_on() -> Iterator[pa.RecordBatch]:
        for group, matrix in sums.items():
            n = matrix[cell_a, cell_b]
            seen = np.flatnonzero(n)
            a, b = cell_a[seen], cell_b[seen]
            scores = np.array(values, np.int32)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([x] * len(seen), kind) for x, kind in zip(group, kinds)],
                 *[pa.array(c.astype(np.int32)) for c in (a // k, b // k, scores[a % k], scores[b % k])], pa.array(n[seen])],
                names=[*names, "_a", "_b", "a", "b", "n"])
        sums.clear()

    for batch in batches:
        names, kinds = batch.schema.names[:n_by], [batch.schema.field(i).type for i in range(n_by)]
        scores = np.stack([batch.column(n_by + r).to_numpy(zero_copy_only=False).astype(float) for r in range(raters)], axis=1)
        marks = np.zeros((batch.num_rows, raters * k), np.float32)
        for i, v in enumerate(values):
            marks[:, i::k] = scores == v
        keys = list(zip(*[batch.column(i).to_pylist() for i in range(n_by)])) if n_by else [()] * batch.num_rows
        number = {key: i for i, key in enumerate(dict.fromkeys(keys))}
        of = np.array([number[key] for key in keys])
        for group, g in number.items():
            part = marks[of == g]
            if group not in sums and (len(sums) + 1) * (raters * k) ** 2 * 8 > most_bytes:
                yield from handed_on()
            sums[group] = sums.get(group, 0) + (part.T @ part).astype(np.int64)
    if sums:
        yield from handed_on()


def contingency_of(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Joint counts from a table that already holds score pairs (a, b)."""
    return pairs.groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n"))


def cumulative_counts(counts: DataFrame, by: list[str], value: str = "score",
                      n: str = "n") -> DataFrame:
    """Adds ``upto``: how many ratings are at or below each distinct value."""
    upto = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding,
                                                              Window.currentRow)
    return counts.withColumn("upto", F.sum(n).over(upto))


def _weighted_mean(x: str) -> Column:
    return F.expr(f"sum(CAST(n AS DOUBLE) * ({x})) / sum(n)")


def mad(table: DataFrame, by: list[str] = PAIR) -> DataFrame:
    return table.groupBy(*by).agg(_weighted_mean("abs(a - b)").alias("mad"))


def msd(table: DataFrame, by: list[str] = PAIR, sign: int = 1) -> DataFrame:
    """Mean of a - b, or of b - a with ``sign=-1``."""
    return table.groupBy(*by).agg(_weighted_mean(f"{sign} * (a - b)").alias("msd"))


def pct_exact(table: DataFrame, by: list[str] = PAIR) -> DataFrame:
    return table.groupBy(*by).agg(_weighted_mean("CAST(a = b AS INT)").alias("pct_exact"))


def agreement_breakdown(table: DataFrame, by: list[str] = PAIR, max_gap: int = 2) -> DataFrame:
    """Counts and proportions of pairs that differ by 0, 1, .. ``max_gap``."""
    counts = [F.expr(f"sum(CASE WHEN abs(a - b) = {k} THEN n ELSE 0 END)").alias(f"n_diff{k}")
              for k in range(max_gap + 1)]
    out = table.groupBy(*by).agg(F.sum("n").alias("n"), *counts)
    return out.selectExpr("*", *[f"n_diff{k} / n AS p_diff{k}" for k in range(max_gap + 1)])


def with_mid_ranks(table: DataFrame, by: list[str] = PAIR) -> DataFrame:
    """Adds ``rank_a`` and ``rank_b``: tie-averaged ranks, centred on their mean (n + 1) / 2.

    Ranks are cumulative counts over the few distinct values, not over rows.
    """
    keys = ", ".join(map(quoted, by))

    def centred(col: str) -> str:
        same = f"sum(n) OVER (PARTITION BY {keys}, {col})"
        upto = f"sum(n) OVER (PARTITION BY {keys} ORDER BY {col})"
        total = f"sum(n) OVER (PARTITION BY {keys})"
        return f"CAST({upto} AS DOUBLE) - (CAST({same} AS DOUBLE) + {total}) / 2.0D AS rank_{col}"

    return table.selectExpr("*", centred("a"), centred("b"))


def _pair_alpha(values: list[int]) -> str:
    """Ordinal alpha of two raters from joint counts: each unit adds (a, b) and (b, a)."""
    def joint(c: int, k: int) -> str:
        weight = 2 if c == k else 1
        return (f"CAST(sum(CASE WHEN (a = {c} AND b = {k}) OR (a = {k} AND b = {c}) "
                f"THEN {weight} * n ELSE 0 END) AS DOUBLE)")

    return ordinal_alpha({(c, k): joint(c, k) for c, k in _value_pairs(values)}, values)


def _value_pairs(values: list[int]) -> list[tuple[int, int]]:
    return [(c, k) for i, c in enumerate(values) for k in values[i:]]


def ordinal_alpha(coincidences: dict[tuple[int, int], str], values: list[int]) -> str:
    """Alpha from the coincidences of value pairs c <= k, as expressions of type double.

    NULL when fewer than two values occur. The ordinal distance of c and k is the number of ratings
    between them, half of c's and k's own included, squared.
    """
    o = {**coincidences, **{(k, c): x for (c, k), x in coincidences.items()}}
    plus = lambda terms: "(" + " + ".join(terms) + ")"
    n = {c: plus(o[c, k] for k in values) for c in values}
    observed, expected = [], []
    for i, c in enumerate(values):
        for j in range(i + 1, len(values)):
            k = values[j]
            distance = f"({plus(n[g] for g in values[i:j + 1])} - ({n[c]} + {n[k]}) / 2.0D)"
            observed.append(f"{o[c, k]} * {distance} * {distance}")
            expected.append(f"{n[c]} * {n[k]} * {distance} * {distance}")
    total = plus(n.values())
    return f"1.0D - ({total} - 1.0D) * try_divide({plus(observed)}, {plus(expected)})"


def pair_metrics(table: DataFrame, by: list[str] = PAIR,
                 values: list[int] = VALID_SCORES) -> DataFrame:
    """All two-rater statistics per group: n, rho, MAD, MSD (a - b), exact agreement and alpha."""
    rho = ("CASE WHEN min(a) < max(a) AND min(b) < max(b) THEN greatest(-1.0D, least(1.0D, "
           "sum(n * rank_a * rank_b) / sqrt(sum(n * rank_a * rank_a) * sum(n * rank_b * rank_b)))) "
           "END")
    return with_mid_ranks(table, by).groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.expr(rho).alias("rho"),
        _weighted_mean("abs(a - b)").alias("mad"),
        _weighted_mean("a - b").alias("msd"),
        _weighted_mean("CAST(a = b AS INT)").alias("pct_exact"),
        F.expr(_pair_alpha(values)).alias("alpha"),
    )


def spearman_rho(table: DataFrame, by: list[str] = PAIR) -> DataFrame:
    return pair_metrics(table, by).select(*by, "n", "rho")


def with_p_value(metrics: DataFrame, rho: str = "rho", n: str = "n") -> DataFrame:
    return metrics.withColumn("p", spearman_p(F.col(rho), F.col(n)))


# ----------------------------------------------------------------------------- alpha, any raters

def _count_col(v: int) -> str:
    return f"n_{v}"


def unit_profiles(ratings: DataFrame, values: list[int] = VALID_SCORES,
                  by: list[str] = ("variable",), unit: str = "unit_id") -> DataFrame:
    """How many units have each combination of value counts.

    Needs no rater list. Ratings of one unit, however many, shrink to one row before the shuffle.
    """
    counts = [F.expr(f"count_if(score = {v})").alias(_count_col(v)) for v in values]
    units = ratings.groupBy(*by, unit).agg(*counts)
    return units.groupBy(*by, *map(_count_col, values)).agg(F.count(F.lit(1)).alias("units"))


def unit_profiles_wide(annotations: DataFrame, cols: list[str], values: list[int] = VALID_SCORES,
                       unit: str = "unit_id") -> DataFrame:
    """The same from wide rows: one shuffled row per annotation instead of one per score."""
    counts = [F.expr(f"count_if({quoted(c)} = {v})").alias(f"{c}_{v}") for c in cols for v in values]
    rows = inline_rows([{"variable": literal(c), **{_count_col(v): quoted(f"{c}_{v}") for v in values}}
                        for c in cols])
    units = annotations.groupBy(unit).agg(*counts).selectExpr(rows)
    return units.groupBy("variable", *map(_count_col, values)).agg(
        F.count(F.lit(1)).alias("units"))


def subset_profiles(patterns: DataFrame, subsets: dict[str, list[str]],
                    values: list[int] = VALID_SCORES, by: list[str] = ("variable",)) -> DataFrame:
    """Profiles of named rater groups, all from one table of score patterns."""
    def count(members: list[str], v: int) -> str:
        return " + ".join(f"CAST({quoted(r)} <=> {v} AS INT)" for r in members)

    rows = inline_rows([{"subset": literal(s), **{_count_col(v): count(rs, v) for v in values}}
                        for s, rs in subsets.items() if len(rs) >= 2])
    return patterns.selectExpr(*map(quoted, by), "n AS units", rows)


def krippendorff_alpha(profiles: DataFrame, by: list[str] = ("variable",),
                       values: list[int] = VALID_SCORES) -> DataFrame:
    """Ordinal alpha per group for any number of raters, missing ratings allowed.

    Units with fewer than two ratings do not count. Adds ``n_units`` and ``n_ratings``.
    """
    m = "(" + " + ".join(map(_count_col, values)) + ")"
    n = {v: f"CAST({_count_col(v)} AS DOUBLE)" for v in values}
    sums = [F.expr(f"sum(units * {n[c]} * ({n[k]} - {int(c == k)}) / ({m} - 1))").alias(f"o_{c}_{k}")
            for c, k in _value_pairs(values)]
    alpha = ordinal_alpha({(c, k): f"o_{c}_{k}" for c, k in _value_pairs(values)}, values)
    return (profiles.where(f"{m} >= 2").groupBy(*by)
            .agg(F.sum("units").alias("n_units"),
                 F.expr(f"CAST(sum(units * {m}) AS BIGINT)").alias("n_ratings"), *sums)
            .selectExpr(*map(quoted, by), "n_units", "n_ratings", f"{alpha} AS alpha"))


def alpha_by_subset(patterns: DataFrame, subsets: dict[str, list[str]],
                    values: list[int] = VALID_SCORES) -> DataFrame:
    return krippendorff_alpha(subset_profiles(patterns, subsets, values),
                              ["subset", "variable"], values)
