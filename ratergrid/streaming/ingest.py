"""Incremental ingestion with the same transforms as the batch path."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ratergrid.dims import small_table
from ratergrid.operators.posts import observe_skip_counters

PROGRESS = "skip_counters"
POLL_SECONDS = 1


def stream_files(spark: SparkSession, path: str, schema: StructType, glob: str = "*.parquet",
                 max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def run_ingest(source: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str,
               checkpoint: str, counters: dict | None = None) -> dict[int, dict]:
    """Process what is available, append to parquet, stop. Restarting continues from the checkpoint.

    ``counters`` holds language, start and end; their skip counts are then observed per batch and
    returned by batch number.
    """
    if counters:
        source = observe_skip_counters(source, PROGRESS, **counters)
    query = (transform(source).writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    events: dict[int, dict] = {}
    running = True
    while running:  # a query remembers its latest events only, so they are gathered while it runs
        running = not query.awaitTermination(POLL_SECONDS)
        for progress in query.recentProgress:
            event = json.loads(progress.json)
            if event["numInputRows"]:
                events[event["batchId"]] = event.get("observedMetrics", {}).get(PROGRESS, {})
    return events


def stream_progress(spark: SparkSession, events: dict[int, dict]) -> DataFrame:
    """Processed, kept and skipped rows per batch, from the events ``run_ingest`` returns."""
    names = ["processed", "kept", "skipped_language", "skipped_date"]
    rows = [(batch, *[seen[n] for n in names]) for batch, seen in events.items() if seen]
    return small_table(spark, rows, "batch_id bigint, " + ", ".join(f"{n} bigint" for n in names))
