"""Writers and resume helpers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ratergrid.operators.posts import cast_sample_types, reorder_columns
from ratergrid.sources.readers import scan_parquet


def sink_parquet_typed(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Cast to the sample types, put columns in their fixed order, write parquet."""
    df.transform(cast_sample_types).transform(reorder_columns).write.mode(mode).parquet(path)


def sink_csv(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> None:
    """CSV with a header for ``scan_csv``; empty text and NULL both read back as NULL.

    ``single_file`` is for small reports: one task does all that follows the last shuffle of ``df``.
    """
    out = df.coalesce(1) if single_file else df
    (out.write.mode(mode)
        .option("header", True)
        .option("quote", '"').option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path))


def convert_parquet_to_csv(spark: SparkSession, src: str, dst: str,
                           columns: list[str] | None = None) -> None:
    df = scan_parquet(spark, src)
    sink_csv(df.select(*columns) if columns else df, dst)


def load_existing(spark: SparkSession, path: str) -> DataFrame | None:
    """Earlier results at ``path``, or None when nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def one_per_key(new: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows that repeat a key, the one whose other columns come first in their order."""
    rest = [c for c in new.columns if c not in keys]
    return new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*").select(*new.columns)


def without_keys(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key ``known`` lacks; NULL is a key value like any other."""
    held = known.select(*[F.col(k).alias(f"_stored{i}") for i, k in enumerate(keys)])
    return rows.join(held, [F.col(k).eqNullSafe(F.col(f"_stored{i}")) for i, k in enumerate(keys)], "left_anti")


def append_annotations(spark: SparkSession, new: DataFrame, path: str, keys: list[str]) -> None:
    """Append one row for each key that is not stored yet to a plain folder; see ``append_keyed`` for a table that is
    read in part and outlives broken and concurrent appends.

    Of rows that repeat a key, the one whose other columns come first in their order is taken.
    """
    fresh = one_per_key(new, keys)
    existing = load_existing(spark, path)
    if existing is not None:
        fresh = without_keys(fresh, existing, keys)
    fresh.write.mode("append").parquet(path)
