"""From raw documents to packed training sequences, in five stages over one another's results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ratergrid.llm.common import drop_rows, keep_rows, table
from ratergrid.llm.decontamination import contamination
from ratergrid.llm.exact_dedup import exact_dedup
from ratergrid.llm.near_dedup import near_dedup_survivors
from ratergrid.llm.packing import pack_documents
from ratergrid.llm.quality import accepted, fit_quality
from ratergrid.session import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on the labelled ones among ``docs``."""
    return accepted(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest as written, then the smallest id."""
    return keep_rows(docs, exact_dedup(docs).where("kept"), "doc_id", "text")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, the smallest id; documents without words all stay."""
    return keep_rows(docs, near_dedup_survivors(docs), "doc_id", "text")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return drop_rows(docs, contamination(docs, table(spark, sf_dir, "benchmark")), "doc_id", "text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 1024 ids, with their ids."""
    return pack_documents(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("pack", pack)]
#: A fitted classifier, a hashed similarity search and a tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again.

    NULL ids and texts, empty and repeated rows are dealt with as each operator says; an empty table gives no
    rows. Extra columns of the documents, whatever their names, are carried up to the last stage.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
