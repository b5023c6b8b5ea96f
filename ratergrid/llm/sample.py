"""A bounded, repeatable sample of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ratergrid.llm.common import fold, quoted, whole_text


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, parts: int, held_out: int,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(label, text) of at most ``rows`` labelled documents outside the held-out fold, chosen by a hash of the id.

    Rows without id or label are not used; of labels that repeat an id, the largest counts. The chosen ids
    are few, so they are broadcast and the texts are not shuffled.
    """
    ids = labels.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(label_col)).alias("_label")).where(
        F.col("_id").isNotNull() & F.col("_label").isNotNull() & (fold(F.col("_id"), parts) != held_out))
    chosen = ids.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(
        F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(quoted(id_col)).alias("_id"), whole_text(text_col).alias("_text"))
    return texts.join(F.broadcast(chosen), "_id").select("_label", "_text")
