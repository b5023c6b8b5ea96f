"""Bringing the raters of a study side by side.

``score_grid`` holds one row per (unit, variable) and one column per rater: the only step that
shuffles ratings. ``pattern_counts`` reduces it to distinct score patterns with their frequency.
With R raters on a K-point scale there are at most (K+1)^R patterns per variable, whatever the
number of units, and every agreement statistic of any pair or group of raters follows from them.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ratergrid.dims import inline_rows, literal, quoted, struct_of
from ratergrid.schemas import SCORE_COLS, VALID_SCORES


def rater_cols(raters: list[str]) -> list[Column]:
    return [F.col(quoted(r)) for r in raters]


def rater_pairs(raters: list[str]) -> list[tuple[str, str]]:
    """All pairs, in registry order."""
    return list(combinations(raters, 2))


def study_pairs(humans: list[str], models: list[str]) -> list[tuple[str, str]]:
    """Human pairs first, then each human with each model, then model pairs."""
    return (list(combinations(humans, 2)) + [(h, m) for h in humans for m in models]
            + list(combinations(models, 2)))


def baseline_pairs(baseline: str, others: list[str]) -> list[tuple[str, str]]:
    return [(baseline, o) for o in others]


def study_subsets(humans: list[str], models: list[str],
                  short: dict[str, str] | None = None) -> dict[str, list[str]]:
    """Named rater groups: everyone, humans, models, and each pair; groups under two are skipped."""
    # The labels of the groups in report tables.
    name = lambda r: (short or {}).get(r, r)
    groups = {
        "All annotators": humans + models,
        f"Humans only ({', '.join(map(name, humans))})": humans,
        f"LLMs only ({len(models)} models)": models,
    }
    for a, b in study_pairs(humans, models)[len(list(combinations(humans, 2))):]:
        groups[f"{name(a)} + {name(b)}"] = [a, b]
    return {label: members for label, members in groups.items() if len(members) >= 2}


def score_grid(ratings: DataFrame, raters: list[str],
               keys: list[str] = ("unit_id", "variable")) -> DataFrame:
    """Long ratings, one per (unit, rater, variable), to one row per (unit, variable)."""
    per_rater = [F.expr(f"max(score) FILTER (WHERE rater = {literal(r)})").alias(r)
                 for r in raters]
    return ratings.where(F.col("rater").isin(raters)).groupBy(*keys).agg(*per_rater)


def score_grid_wide(annotations: DataFrame, raters: list[str], cols: list[str] = SCORE_COLS,
                    values: list[int] = VALID_SCORES, unit: str = "unit_id") -> DataFrame:
    """The same grid from wide rows, one per (unit, rater); scores off the scale are missing.

    A row travels as one packed number, not as one number per score.
    """
    return _packed_grid(annotations, raters, [], cols, values, unit)


def latest_score_grid(annotations: DataFrame, raters: list[str], order_cols: list[str],
                      cols: list[str] = SCORE_COLS, values: list[int] = VALID_SCORES,
                      unit: str = "unit_id") -> DataFrame:
    """``dedupe_latest`` on (unit, rater) and ``score_grid_wide`` in a single shuffle on the unit.

    An order of days, small integers and flags that fits into one number with the scores is packed in front of them, so
    hash aggregates can hold it; other orders travel as a struct, for which Spark sorts within tasks.
    """
    return _packed_grid(annotations, raters, order_cols, cols, values, unit)


def _case(subject: str, mapping: dict, otherwise: str = "NULL") -> str:
    branches = " ".join(f"WHEN {subject} = {literal(k)} THEN {v}" for k, v in mapping.items())
    return f"CASE {branches} ELSE {otherwise} END"


#: Bits and smallest value of types that order by their number; NULL comes first, as in a struct.
_ORDER_BITS = {"boolean": (1, 0), "tinyint": (8, -(1 << 7)), "smallint": (16, -(1 << 15)), "int": (32, -(1 << 31)),
               "date": (23, -(1 << 22))}
_NUMBER_BITS = 63


def _order_number(df: DataFrame, order_cols: list[str], low_bits: int) -> str | None:
    """An expression of the order as one number above ``low_bits`` free bits, or None when it does not fit."""
    kinds = [df.schema[c].dataType.simpleString() for c in order_cols]
    if any(k not in _ORDER_BITS for k in kinds) or low_bits + sum(_ORDER_BITS[k][0] + 1 for k in kinds) > _NUMBER_BITS:
        return None
    out = "0L"
    for c, kind in zip(order_cols, kinds):
        bits, least = _ORDER_BITS[kind]
        number = f"unix_date({quoted(c)})" if kind == "date" else f"CAST({quoted(c)} AS BIGINT)"
        out = f"(shiftleft({out}, {bits + 1}) + coalesce({number} - ({least}L) + 1L, 0L))"
    return f"shiftleft({out}, {low_bits})"


def _packed_grid(annotations, raters, order_cols, cols, values, unit) -> DataFrame:
    bits = len(values).bit_length()
    per_pack = 62 // bits
    packs = [cols[i:i + per_pack] for i in range(0, len(cols), per_pack)]
    names = [f"_pack{i}" for i in range(len(packs))]

    def code(c: str) -> str:  # position on the scale, 0 when missing
        return f"CAST({_case(quoted(c), {v: i for i, v in enumerate(values, 1)}, '0')} AS BIGINT)"

    codes = [" | ".join(f"shiftleft({code(c)}, {at * bits})" for at, c in enumerate(pack)) for pack in packs]
    order = _order_number(annotations, order_cols, len(cols) * bits) if order_cols and len(packs) == 1 else None
    if order:  # the cells below read the lowest bits only
        codes, order_cols = [f"{order} | {codes[0]}"], []
    packed = annotations.where(F.col("rater").isin(raters)).selectExpr(
        quoted(unit), "rater", *map(quoted, order_cols), *[f"{c} AS {name}" for name, c in zip(names, codes)])
    bare = not order_cols and len(names) == 1
    row = names[0] if bare else struct_of({c: quoted(c) for c in [*order_cols, *names]})
    wide = packed.groupBy(unit).agg(*[
        F.expr(f"max({row}) FILTER (WHERE rater = {literal(r)})").alias(r) for r in raters])

    # fan out to variables by number; each cell is then a shift of its rater's pack
    numbers = ", ".join(map(str, range(len(cols))))
    fanned = wide.selectExpr(quoted(unit), f"explode(array({numbers})) AS _v", *map(quoted, raters))
    at = "_v" if len(packs) == 1 else f"_v % {per_pack}"

    def cell(r: str) -> str:
        pack = quoted(r)
        if not bare:
            pack = _case(f"_v div {per_pack}",
                         {i: f"{quoted(r)}.{n}" for i, n in enumerate(names)})
        position = f"(shiftright({pack}, ({at}) * {bits}) & {(1 << bits) - 1})"
        return f"{_case(position, {i: literal(v) for i, v in enumerate(values, 1)})} AS {quoted(r)}"

    variable = _case("_v", {i: literal(c) for i, c in enumerate(cols)})
    return (fanned.selectExpr(quoted(unit), f"{variable} AS variable", *map(cell, raters))
            .where(f"coalesce({', '.join(map(quoted, raters))}) IS NOT NULL"))


def grid_from_columns(df: DataFrame, raters: list[str], variable: str,
                      unit: str = "unit_id") -> DataFrame:
    """A table that already has one column per rater, as a grid of one variable."""
    return df.select(unit, F.lit(variable).alias("variable"), *raters)


def common_core(grid: DataFrame, raters: list[str]) -> DataFrame:
    """Units and variables scored by every rater."""
    return grid.where(" AND ".join(f"{quoted(r)} IS NOT NULL" for r in raters))


def core_units(ratings: DataFrame, raters: list[str], unit: str = "unit_id") -> DataFrame:
    """Ids rated by every rater, from one grouping of long or wide rows."""
    seen = [F.expr(f"max(rater = {literal(r)})").alias(f"_{i}") for i, r in enumerate(raters)]
    hits = ratings.where(F.col("rater").isin(raters)).groupBy(unit).agg(*seen)
    return hits.where(" AND ".join(f"_{i}" for i in range(len(raters)))).select(unit)


def grid_to_ratings(grid: DataFrame, raters: list[str]) -> DataFrame:
    """Back to (unit, variable, rater, score). Fans out in place, so what follows per unit needs no
    further shuffle (``unpivot`` would lose the partitioning)."""
    ids = [quoted(c) for c in grid.columns if c not in raters]
    cells = inline_rows([{"rater": literal(r), "score": quoted(r)} for r in raters])
    return grid.selectExpr(*ids, cells).where("score IS NOT NULL")


def pattern_counts(grid: DataFrame, raters: list[str], by: list[str] = ("variable",)) -> DataFrame:
    return grid.groupBy(*by, *rater_cols(raters)).agg(F.count(F.lit(1)).alias("n"))


def paired_scores(grid: DataFrame, pairs: list[tuple[str, str]],
                  keep: list[str] = ("unit_id", "variable")) -> DataFrame:
    """(keep, rater_a, rater_b, a, b) for each listed pair with both scores present."""
    both = inline_rows([{"rater_a": literal(x), "rater_b": literal(y), "a": quoted(x),
                         "b": quoted(y)} for x, y in pairs])
    return grid.selectExpr(*map(quoted, keep), both).where("a IS NOT NULL AND b IS NOT NULL")


def rater_subsets(grid: DataFrame, subsets: dict[str, list[str]],
                  keep: list[str] = ("unit_id", "variable")) -> DataFrame:
    """(keep, subset, rater, score) for each listed group of at least two raters."""
    members = inline_rows([{"subset": literal(s), "rater": literal(r), "score": quoted(r)}
                           for s, rs in subsets.items() if len(rs) >= 2 for r in rs])
    return grid.selectExpr(*map(quoted, keep), members).where("score IS NOT NULL")
