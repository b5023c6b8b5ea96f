"""Cleaning annotation tables: validity, duplicates, names, id sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ratergrid.dims import map_values
from ratergrid.schemas import SCORE_COLS, VALID_SCORES

#: Annotations that one task counts by unit: a few hundred MB of counts at four variables.
TASK_ROWS = 250_000
#: Most tasks that rows are first dealt to: up to 200, Spark writes them out as they come and holds none in memory.
FIRST_TASKS = 200


def _is_valid(col: str, values: list[int]) -> Column:
    return F.coalesce(F.col(col).isin(values), F.lit(False))


def as_scores(df: DataFrame, cols: list[str] = SCORE_COLS) -> DataFrame:
    """Scores as integers, whether read as text, 1 or 1.0; anything else becomes NULL."""
    def score(c: str) -> Column:
        number = F.col(c).try_cast("double")
        return F.when(number == F.floor(number), number.try_cast("int"))

    return df.withColumns({c: score(c) for c in cols})


def validity_filter(df: DataFrame, cols: list[str] = SCORE_COLS,
                    values: list[int] = VALID_SCORES) -> DataFrame:
    """Rows whose every score is on the scale."""
    return df.where(reduce(lambda x, y: x & y, [F.col(c).isin(values) for c in cols]))


def first_invalid_column(cols: list[str] = SCORE_COLS, values: list[int] = VALID_SCORES) -> Column:
    """Name of the first column, in order, whose score is off the scale; NULL for a valid row."""
    return F.coalesce(*[F.when(~_is_valid(c, values), F.lit(c)) for c in cols])


def invalid_rows(df: DataFrame, cols: list[str] = SCORE_COLS, values: list[int] = VALID_SCORES,
                 id_col: str = "unit_id") -> DataFrame:
    """One row (id, column, raw value) per dropped row; a row counts for its first bad column."""
    bad = df.withColumn("column", first_invalid_column(cols, values)).where("column IS NOT NULL")
    raw = F.coalesce(*[F.when(F.col("column") == c, F.col(c).cast("string")) for c in cols])
    return bad.select(id_col, "column", raw.alias("raw_value"))


def invalid_report(df: DataFrame, cols: list[str] = SCORE_COLS, values: list[int] = VALID_SCORES,
                   id_col: str = "unit_id") -> DataFrame:
    """Dropped rows and distinct raw values per column. ``invalid_rows`` lists the ids."""
    rows = invalid_rows(df, cols, values, id_col)
    per_value = rows.groupBy("column", "raw_value").agg(F.count(F.lit(1)).alias("n"))
    return per_value.groupBy("column").agg(
        F.sum("n").alias("n_invalid"), F.count("raw_value").alias("n_values"))


def dedupe_latest(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """The row with the greatest ``order_cols`` per key. Copies are reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order_cols]
    latest = F.max(F.struct(*order_cols, *rest)).alias("latest")
    return df.groupBy(*keys).agg(latest).select(*keys, "latest.*").select(*df.columns)


def latest_scores(df: DataFrame, keys: list[str], order_cols: list[str], cols: list[str],
                  task_rows: int = TASK_ROWS) -> DataFrame:
    """Keys and ``cols`` of ``dedupe_latest``, dealt by key to tasks of at most about ``task_rows`` rows.

    For tables with nearly as many keys as rows: neither the sort of a whole file split nor that of a partition sized by
    shuffled bytes, into which millions of ratings fit, is held by a task. Rows of ``df`` are counted first. Copies are
    reduced within pieces of ``task_rows`` rows of the input, each piece of a key in another task.
    """
    tasks = max(-(-df.count() // task_rows), df.sparkSession.sparkContext.defaultParallelism)
    piece = F.floor(F.monotonically_increasing_id() / task_rows).alias("_piece")
    pieces = df.select("*", piece).repartition(min(tasks, FIRST_TASKS), *keys, "_piece")
    reduced = dedupe_latest(pieces, [*keys, "_piece"], order_cols).drop("_piece")
    return dedupe_latest(reduced.repartition(tasks, *keys), keys, order_cols).select(*keys, *cols)


def overlap_semi(df: DataFrame, other: DataFrame, on: str | list[str] = "unit_id") -> DataFrame:
    """Rows of ``df`` whose id occurs in ``other``."""
    keys = [on] if isinstance(on, str) else on
    return df.join(other.select(*keys), keys, "left_semi")


def missing_ids(df: DataFrame, other: DataFrame, on: str = "unit_id") -> DataFrame:
    """Distinct ids of ``df`` that ``other`` lacks."""
    return df.select(on).distinct().join(other.select(on), on, "left_anti")


def id_set_ops(a: DataFrame, b: DataFrame, on: str = "unit_id") -> DataFrame:
    """Every id with flags ``in_a`` and ``in_b``, from one grouping of both sides."""
    tagged = (a.select(on, F.lit(True).alias("a"), F.lit(False).alias("b"))
              .unionByName(b.select(on, F.lit(False).alias("a"), F.lit(True).alias("b"))))
    return tagged.groupBy(on).agg(F.max("a").alias("in_a"), F.max("b").alias("in_b"))


def sorted_ids(df: DataFrame, col: str = "unit_id") -> DataFrame:
    """Distinct ids in order, for reports."""
    return df.select(col).distinct().orderBy(col)


def head_preview(df: DataFrame, n: int, order_col: str, cols: list[str] | None = None) -> DataFrame:
    return df.select(*(cols or df.columns)).orderBy(order_col).limit(n)


def display_name_map(df: DataFrame, names: dict[str, str], col: str = "rater") -> DataFrame:
    """Version strings to display names; unknown ones stay as they are."""
    return df.withColumn(col, map_values(F.col(col), names, F.col(col)))


def drop_legacy_rater(df: DataFrame, legacy: list[str], col: str = "rater") -> DataFrame:
    return df.where(~F.col(col).isin(legacy))


def condition_label_map(df: DataFrame, labels: dict[str, str],
                        col: str = "condition") -> DataFrame:
    return df.withColumn("condition_label", map_values(F.col(col), labels))


def annotation_id(df: DataFrame, key_cols: list[str]) -> DataFrame:
    """A stable 128-bit id from the key: the same on every run. Each value is preceded by its length, NULL by -1,
    so no two keys are written alike."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")),
                        F.lit("-1:")) for c in key_cols]
    return df.withColumn("annotation_id", F.md5(F.concat(*parts).cast("binary")))


def melt_scores(df: DataFrame, cols: list[str] = SCORE_COLS,
                ids: list[str] = ("unit_id", "rater")) -> DataFrame:
    """Wide scores to (ids, variable, score)."""
    return df.unpivot(list(ids), cols, "variable", "score")
