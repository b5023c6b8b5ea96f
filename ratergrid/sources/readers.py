"""Readers. Schemas are explicit wherever the format does not carry one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ratergrid.schemas import DONE_KEYS_SCHEMA
from ratergrid.sources.guards import require_columns


def scan_parquet(spark: SparkSession, *paths: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*paths)


def scan_parquet_parts(spark: SparkSession, root: str, parts: dict[str, list[int]],
                       pattern: str = "{part}/chunk_{chunk}.parquet",
                       schema: StructType | None = None) -> DataFrame:
    """Read only the listed chunk files of each part."""
    paths = [f"{root}/{pattern.format(part=part, chunk=chunk)}"
             for part, chunks in parts.items() for chunk in chunks]
    return scan_parquet(spark, *paths, schema=schema)


def evenly_spaced_chunks(bounds: DataFrame, k: int, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """``k`` chunk numbers per row of ``bounds``, from ``lo`` to ``hi`` inclusive, near-even steps."""
    step = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("step")
    chunk = F.expr(f"{lo} + (step * ({hi} - {lo})) div {max(k - 1, 1)}")
    return bounds.select("*", step).withColumn("chunk", chunk)


def scan_csv(spark: SparkSession, *paths: str, schema: StructType | str,
             required: list[str] | None = None) -> DataFrame:
    """The columns of ``schema`` from CSV with a header, embedded newlines and doubled quotes.

    Columns are found by header name, so files may hold others and in any order; values that do not
    parse are NULL, and so is a column that is neither present nor ``required`` (by default all are).
    One file is one task; ``scan_csv_split`` reads big ones in ranges.
    """
    fields = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    raw = (spark.read.option("header", True).option("multiLine", True)
           .option("quote", '"').option("escape", '"').option("enforceSchema", False)
           .csv(list(paths)))
    require_columns(raw, [f.name for f in fields] if required is None else list(required), "csv")
    return raw.select(*[
        (F.col(f"`{f.name}`") if f.name in raw.columns else F.lit(None))
        .try_cast(f.dataType).alias(f.name) for f in fields])


def scan_done_keys(spark: SparkSession, path: str, key_names: list[str] = ("tweet_id", "llm_id"),
                   multi_line: bool = False) -> DataFrame:
    """``{"completed": [[id, label], ...]}`` as one row per distinct key, keys as strings."""
    completed = (spark.read.schema(DONE_KEYS_SCHEMA).option("multiLine", multi_line).json(path)
                 .select(F.explode("completed").alias("key")))
    return completed.select(*[F.col("key")[i].alias(name)
                              for i, name in enumerate(key_names)]).distinct()
