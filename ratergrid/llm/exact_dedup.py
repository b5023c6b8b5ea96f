"""Exact duplicates with a heavy-hitter split.

Misra-Gries summaries of each partition's digests name the few digests that can be frequent. Their exact
counts and winners are worked out by partial aggregation and broadcast (at most ``counters`` rows), so their
rows never move; the remaining digests, none of which holds more than rows / counters, are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ratergrid.llm.common import BLANKS, quoted, text_hash, whole_text
from ratergrid.session import stored

#: Counters of a Misra-Gries summary, and the most digests that are ever broadcast.
COUNTERS = 1024


def normalised_digest(text_col: str):
    """SHA-256 of the text without blanks, as bytes."""
    return F.unhex(F.sha2(F.translate(whole_text(text_col), BLANKS, "").cast("binary"), 256))


def merge_counts(keys: np.ndarray, counts: np.ndarray, counters: int) -> tuple[np.ndarray, np.ndarray]:
    """Misra-Gries reduction: subtract the largest count that has no counter, drop what falls to zero."""
    if len(keys) <= counters:
        return keys, counts
    cut = np.partition(counts, -counters - 1)[-counters - 1]
    held = counts > cut
    return keys[held], counts[held] - cut


def summarise(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """The Misra-Gries summary of one partition; memory is one batch and the counters."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        new, n = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_counts=True)
        both, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate([counts, n]), minlength=len(both)).astype(np.int64)
        keys, counts = merge_counts(both, total, counters)
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["_short", "_n"])


def frequent_digests(rows: DataFrame, counters: int) -> DataFrame:
    """At most ``counters`` values of ``_short``: every one with more than rows / counters rows is among them."""
    parts = rows.select("_short").mapInArrow(lambda it: summarise(it, counters), "_short long, _n long")
    return parts.groupBy("_short").agg(F.sum("_n").alias("_n")).orderBy(F.desc("_n"), "_short").limit(counters)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, text_hash.

    Texts are equal when identical without blanks; NULL counts as empty, and empty texts are equal to each
    other. The row with the most code points stays, then the smallest id, in the order of its type (a NULL id comes last), then, among
    rows that repeat an id, the first one read: one row of each group is kept. An empty table gives no rows.
    Other columns, whatever their names, are not read.
    """
    rows = stored(docs.select(
        F.col(quoted(id_col)).alias("doc_id"), normalised_digest(text_col).alias("_digest"),
        F.length(whole_text(text_col)).alias("_chars"), F.monotonically_increasing_id().alias("_row"),
        text_hash(text_col).alias("text_hash")).withColumn("_short", F.xxhash64("_digest")), "digests")
    total = rows.count()

    short = stored(frequent_digests(rows, counters), "frequent")
    hot = rows.join(F.broadcast(short.select("_short")), "_short")
    verified = hot.groupBy("_digest").agg(F.count("*").alias("group_size"), F.max("_chars").alias("_most")).where(
        F.col("group_size") * counters > total)
    winners = _winners(hot, stored(verified.orderBy(F.desc("group_size"), "_digest").limit(counters), "verified"))
    winners = stored(winners, "winners")

    same = F.broadcast(winners)
    hot = rows.join(same, "_digest").select("doc_id", "_digest", "text_hash", "keep_id", "group_size",
                                            (F.col("_row") == F.col("_keep_row")).alias("kept"))
    group = Window.partitionBy("_digest")
    best = group.orderBy(F.desc("_chars"), F.asc_nulls_last("doc_id"), "_row")
    rest = rows.join(F.broadcast(winners.select("_digest")), "_digest", "left_anti").select(
        "doc_id", "_digest", "text_hash", F.first("doc_id").over(best).alias("keep_id"),
        F.count("*").over(group).alias("group_size"), (F.row_number().over(best) == 1).alias("kept"))
    return hot.unionByName(rest).select("doc_id", "keep_id", "group_size", "kept",
                                        F.lower(F.hex("_digest")).alias("text_sha256"), "text_hash")


def _winners(hot: DataFrame, verified: DataFrame) -> DataFrame:
    """The row that stays for each verified digest, by hash aggregates over the longest texts only."""
    longest = hot.join(F.broadcast(verified), "_digest").where(F.col("_chars") == F.col("_most"))
    ids = stored(longest.groupBy("_digest").agg(F.min("doc_id").alias("_id")), "ids")
    first = longest.join(F.broadcast(ids), "_digest").where(F.col("doc_id").eqNullSafe(F.col("_id")))
    return first.groupBy("_digest", "group_size").agg(
        F.min("doc_id").alias("keep_id"), F.min("_row").alias("_keep_row"))


EXACT_DEDUP_SQL = r"""WITH n AS (
  SELECT doc_id, length(COALESCE(text, '')) AS chars,
         sha256(regexp_replace(COALESCE(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, FIRST_VALUE(doc_id) OVER w AS keep_id, COUNT(*) OVER (PARTITION BY text_sha256) AS group_size,
       ROW_NUMBER() OVER w = 1 AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)"""
