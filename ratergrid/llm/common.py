"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The characters that contracts call white space, as text and as a character class.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = "[\\x20\\x09-\\x0D]"


class WordCache(dict):
    """What ``make`` says of a word, kept for two generations of ``size`` words, so memory is bounded.

    When a generation is full it becomes the older one, from which words still in use come back.
    """

    def __init__(self, make: Callable, size: int = 300_000):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, word):
        value = self.older.get(word)
        if value is None:
            value = self.make(word)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[word] = value
        return value


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str) -> Column:
    """A text column with NULL as the empty text."""
    return F.coalesce(F.col(quoted(name)).cast("string"), F.lit(""))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def id_text(col: Column) -> Column:
    """An id as a join key that also matches NULL with NULL."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit("null"))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; the fold that labels are split by."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def fold_of(doc_id: int, parts: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % parts


def text_hash(text_col: str) -> Column:
    """Hash of a whole text; with the id it names a row among those that repeat an id."""
    return F.xxhash64(whole_text(text_col))


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text_hash) is in ``kept``, one row for each such pair; columns as they are.

    The rows are shuffled once: the join and the choice among repeated rows use the same partitioning and order.
    """
    left, keys = _keyed(docs, id_col, text_col)
    return left.join(_keys(kept, keys), keys, "left_semi").dropDuplicates(keys).select(
        *[F.col(quoted(c)) for c in docs.columns])


def drop_rows(docs: DataFrame, dropped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text_hash) is not in ``dropped``; columns as they are."""
    left, keys = _keyed(docs, id_col, text_col)
    return left.join(_keys(dropped, keys), keys, "left_anti").select(*[F.col(quoted(c)) for c in docs.columns])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    taken = {c.lower() for c in docs.columns}
    names = []
    for name in ("__id", "__text"):
        while name in taken:
            name += "_"
        names.append(name)
    return docs.withColumns({names[0]: id_text(F.col(quoted(id_col))), names[1]: text_hash(text_col)}), names


def _keys(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select(id_text(F.col("doc_id")).alias(names[0]), F.col("text_hash").alias(names[1])).distinct()
