"""A table with one row per key, in hash buckets, of which only committed files count."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ratergrid.session import stored
from ratergrid.sources.manifest import commit, latest_commit
from ratergrid.sources.writers import load_existing, one_per_key, without_keys

VERSION, BUCKET, COMMITS = "_version", "_key_bucket", "_commits"
BUCKETS = 64


def read_keyed(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame | None:
    """The committed rows (of some buckets), or None when nothing was committed yet."""
    rows = _committed(spark, path, latest_commit(spark, f"{path}/{COMMITS}")[1], buckets)
    return None if rows is None else rows.drop(VERSION, BUCKET)


def _committed(spark: SparkSession, path: str, content: dict | None, buckets: list[int] | None) -> DataFrame | None:
    files = load_existing(spark, path) if content else None
    if files is None:
        return None
    rows = files.where(F.col(VERSION).cast("string").isin(content["versions"]))
    return rows if buckets is None else rows.where(F.col(BUCKET).isin(buckets))


def append_keyed(spark: SparkSession, new: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> int:
    """Append one row for each key that is not stored yet; returns how many. NULL is a key value like any other.

    Of rows that repeat a key, the one whose other columns come first in their order is taken. Rows lie in the bucket
    of their key's hash; only buckets with new keys are read. An append counts from its commit on: one that was broken
    off leaves files that no reader sees, and of two at a time the later one looks again at what the other one
    stored. The number of buckets belongs to the table and is kept with it.
    """
    rows = None
    while True:
        number, content = latest_commit(spark, f"{path}/{COMMITS}")
        if rows is None:
            buckets = content["buckets"] if content else buckets
            bucket = F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys]), F.lit(buckets))
            rows = stored(one_per_key(new, keys).withColumn(BUCKET, bucket.cast("int")), "append")
        fresh = rows
        if content:
            touched = [r[0] for r in rows.select(BUCKET).distinct().collect()]  # at most the number of buckets
            known = _committed(spark, path, content, touched)
            if known is not None:
                fresh = without_keys(rows, known, keys)
        version = f"v{uuid.uuid4().hex}"
        fresh.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/{VERSION}={version}")
        written = load_existing(spark, f"{path}/{VERSION}={version}")
        if written is None:
            return 0
        versions = [*(content["versions"] if content else []), version]
        if commit(spark, f"{path}/{COMMITS}", number + 1, {"versions": versions, "buckets": buckets}):
            return written.count()
