"""Resumable annotation log: a stream of raw responses whose table does not depend on their order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ratergrid.operators.responses import (KEY, MAX_ATTEMPTS, first_attempt, flatten_annotation,
                                           read_responses)
from ratergrid.schemas import SCORE_COLS
from ratergrid.sources.manifest import commit, file_system, latest_commit
from ratergrid.sources.writers import load_existing

RUN, BATCH = "run_id", "batch_id"
#: Runs that hold compacted rows, and the folder of commits that say which one counts.
COMPACTED, COMPACTIONS = "compacted-", "_compactions"


def write_batch(batch: DataFrame, batch_id: int, out: str, variables: list[str] = SCORE_COLS,
                error: str | None = None, run_id: str = "r0") -> None:
    """Store the valid attempts of a batch, in a folder of its run and number that it replaces.

    A replay after a crash leaves the table as it would have been, and nothing stored earlier is read.
    """
    valid = flatten_annotation(read_responses(batch, variables, error), variables)
    valid.write.mode("overwrite").parquet(f"{out}/{RUN}={run_id}/{BATCH}={batch_id}")


def _log_view(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame, int, dict]:
    """The latest compacted folder with the batches it does not cover, these batches alone, and the latest commit."""
    files = load_existing(spark, out)
    if files is None:
        raise ValueError(f"no annotation log at {out}")
    number, content = latest_commit(spark, f"{out}/{COMPACTIONS}")
    content = content or {"folder": "", "covered": {}}
    run, batch = F.col(RUN).cast("string"), F.col(BATCH).cast("bigint")
    tail = files.where(~run.startswith(COMPACTED))
    for name, upto in content["covered"].items():
        tail = tail.where((run != name) | (batch > upto))
    return files.where(run == content["folder"]).unionByName(tail), tail, number, content


def read_annotation_log(spark: SparkSession, out: str, variables: list[str] = SCORE_COLS,
                        keys: list[str] = KEY, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """One row per key: its first valid attempt, in whatever order and run the attempts arrived.

    Reads what was compacted last and the batches since; folders of covered batches are not opened.
    """
    view, *_ = _log_view(spark, out)
    return first_attempt(view.drop(RUN, BATCH), variables, keys, max_attempts)


def compact_annotation_log(spark: SparkSession, out: str, variables: list[str] = SCORE_COLS, keys: list[str] = KEY,
                           max_attempts: int = MAX_ATTEMPTS) -> bool:
    """Reduce the log to one row per key, in a folder of its own that counts from its commit on.

    What was compacted before is merged with the finished batches since; a batch that is still being written is left for
    the next time. A compaction that is broken off, or that another one overtakes, changes nothing. Returns whether
    there was anything to do and it was committed. Batches that are covered may be deleted. ``max_attempts`` is then
    that of the readers: later attempts of a key are gone.
    """
    view, tail, number, content = _log_view(spark, out)
    # one row per batch since the last compaction
    last = {r[0]: r[1] for r in tail.groupBy(F.col(RUN).cast("string")).agg(F.max(F.col(BATCH).cast("bigint"))).collect()}
    fs, make = file_system(spark, out)
    upto = {run: b if fs.exists(make(f"{out}/{RUN}={run}/{BATCH}={b}/_SUCCESS")) else b - 1 for run, b in last.items()}
    upto = {run: b for run, b in upto.items() if b > content["covered"].get(run, -1)}
    if not upto:
        return False
    run, batch = F.col(RUN).cast("string"), F.col(BATCH).cast("bigint")
    chosen = run == content["folder"]
    for name, b in upto.items():
        chosen |= (run == name) & (batch <= b)
    folder = f"{COMPACTED}{uuid.uuid4().hex}"
    first_attempt(view.where(chosen).drop(RUN, BATCH), variables, keys, max_attempts).write.parquet(
        f"{out}/{RUN}={folder}/{BATCH}=0")
    return commit(spark, f"{out}/{COMPACTIONS}", number + 1,
                  {"folder": folder, "covered": content["covered"] | upto})


def _run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that belongs to a checkpoint: kept beside its state, new when the state is new."""
    path = f"{checkpoint.rstrip('/')}/annotation-run"
    known = load_existing(spark, path)
    if known is None:
        spark.createDataFrame([(f"r{uuid.uuid4().hex}",)], "run_id string").write.parquet(path)
        known = spark.read.parquet(path)
    return known.first()["run_id"]


def run_annotation_log(source: DataFrame, out: str, checkpoint: str,
                       variables: list[str] = SCORE_COLS,
                       error: str | None = None, compact: bool = False) -> StreamingQuery:
    """Process what is available and stop; run again to resume. A new checkpoint over an existing table
    adds to it: its batches have folders of their own. With ``compact`` the log is compacted afterwards."""
    run_id = _run_id(source.sparkSession, checkpoint)

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, out, variables, error, run_id)

    query = (source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    if compact:
        compact_annotation_log(source.sparkSession, out, variables)
    return query
