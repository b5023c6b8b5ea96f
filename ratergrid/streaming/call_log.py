"""Calls to a scorer as a stream of small batches, each durable before the next one starts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ratergrid.operators.responses import CALL_COLS, annotator_hook
from ratergrid.schemas import RAW_RESPONSE_SCHEMA
from ratergrid.session import scratch_path
from ratergrid.sources.writers import load_existing

#: Calls of one batch: what a crash can cost at most.
BATCH_CALLS = 1000
RUN, _MARKS = "run", "_stored"


def logged_calls(work: DataFrame, fn: Callable[[str, str, str, str], str], log: str, run_id: str,
                 max_attempts: int = 1, tasks: int | None = None, batch_calls: int = BATCH_CALLS) -> DataFrame:
    """Make the planned calls (see ``annotator_hook``) and return their log, which is kept below ``log``.

    The plan is written to files that hold a task's share of a batch, and a stream takes as many files at a time as
    calls run at once. Each batch has its own folder, complete or absent; what a batch has answered is never called
    again, whatever happens to later ones: ``unread_log`` returns it. ``tasks`` calls run at a time (default: the
    cores of the session).
    """
    spark = work.sparkSession
    tasks = tasks or spark.sparkContext.defaultParallelism
    plan, folder = scratch_path(spark, "call-plan"), f"{log}/{RUN}={run_id}"
    calls = work.select(F.col("unit_id").cast("string").alias("unit_id"), *CALL_COLS[1:])
    calls.repartition(tasks, "unit_id", "rater").write.option(
        "maxRecordsPerFile", max(1, -(-batch_calls // tasks))).parquet(plan)
    source = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", tasks).parquet(plan)

    def handle(batch: DataFrame, batch_id: int) -> None:
        annotator_hook(batch, fn, max_attempts, tasks).write.mode("overwrite").parquet(f"{folder}/b{batch_id:06d}")

    query = (source.writeStream.foreachBatch(handle).option("checkpointLocation", scratch_path(spark, "call-state"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    made = load_existing(spark, f"{folder}/*")
    return spark.createDataFrame([], RAW_RESPONSE_SCHEMA) if made is None else made


def unread_log(spark: SparkSession, log: str) -> DataFrame | None:
    """The calls of runs that were not marked as stored; folders of marked runs are not read."""
    earlier = load_existing(spark, log)
    if earlier is None:
        return None
    marks = load_existing(spark, f"{log}/{_MARKS}")
    done = [] if marks is None else [r[0] for r in marks.distinct().collect()]  # one row a run
    return (earlier.where(~F.col(RUN).cast("string").isin(done)) if done else earlier)


def mark_stored(spark: SparkSession, log: str, responses: DataFrame | None, run_id: str | None = None) -> None:
    """Remember the runs in ``responses``, or one run, as stored."""
    runs = (spark.createDataFrame([(run_id,)], f"{RUN} string") if run_id
            else responses.select(F.col(RUN).cast("string").alias(RUN)).distinct())
    runs.coalesce(1).write.mode("append").parquet(f"{log}/{_MARKS}")
