"""Checks that fail early."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def require_columns(df: DataFrame, columns: list[str], label: str = "input") -> DataFrame:
    """Return ``df`` unchanged, or raise when columns are missing. Runs no job."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"[{label}] missing columns: {missing}")
    return df


def refuse_repeats(df: DataFrame, keys: list[str], label: str = "input") -> DataFrame:
    """Return ``df`` unchanged, or raise when rows repeat a key, naming one of them."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n").first()
    if twice is not None:
        raise ValueError(f"[{label}] rows repeat {twice.asDict()}: state an order, or keep one of them")
    return df


def min_rows_guard(df: DataFrame, n: int, label: str = "pool") -> DataFrame:
    """Return ``df`` unchanged, or raise when it holds fewer than ``n`` rows.

    Counts column-free rows up to ``n``, so the job stops scanning as soon as enough were seen.
    """
    found = df.select().limit(n).count()
    if found < n:
        raise ValueError(f"[{label}] only {found} rows, need {n}")
    return df
