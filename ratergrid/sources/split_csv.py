"""CSV with line breaks inside quotes, read in byte ranges of one file at a time by many tasks.

A line can't tell whether it begins inside quotes, but the number of quotes before it can: doubled quotes leave its
parity as it is. So one pass counts the quotes of each range, a running parity over the ranges of a file tells how each
one begins, and every range then cuts its own lines into records. What crosses a cut is put together from its pieces.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from ratergrid.dims import quoted
from ratergrid.session import stored
from ratergrid.sources.guards import require_columns

#: Most ranges whose parities (some 150 bytes each) are broadcast.
MOST_RANGES = 200_000
_OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true"}
_CUT = "text string, file string, start long, place int"


def scan_csv_split(spark: SparkSession, *paths: str, schema: StructType | str,
                   required: list[str] | None = None) -> DataFrame:
    """What ``scan_csv`` reads, from files of any size in many tasks.

    All files have the header of the first one. Records end with ``\\n`` or ``\\r\\n``; empty lines are left out. Ranges
    are those of ``spark.sql.files.maxPartitionBytes``; more than ``MOST_RANGES`` are refused, larger ranges are then the
    way. A quote that never ends makes one record of the rest of its file, as for any reader.
    """
    fields = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    names = spark.read.option("header", True).options(**_OPTIONS).csv(paths[0]).columns
    have = spark.createDataFrame([], ", ".join(f"{quoted(n)} string" for n in names))
    require_columns(have, [f.name for f in fields] if required is None else list(required), "csv")

    lines = spark.read.option("lineSep", "\n").text(list(paths)).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        ((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2).alias("odd"))
    ranges = stored(lines.groupBy("file", "start").agg(F.expr("bit_xor(odd)").alias("odd")), "ranges")
    if ranges.limit(MOST_RANGES + 1).count() > MOST_RANGES:
        raise ValueError(f"more than {MOST_RANGES} ranges: raise spark.sql.files.maxPartitionBytes")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    opens = ranges.select("file", "start", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).alias("inside"))
    # a broadcast join keeps the order of lines within a range
    pieces = lines.join(F.broadcast(stored(opens, "opens")), ["file", "start"]).select(
        "value", "file", "start", "odd", "inside").mapInArrow(lambda batches: _records(batches, names), _CUT)
    pieces = stored(pieces, "records")

    crossing = pieces.where("place < 2")
    chain = F.sum("place").over(Window.partitionBy("file").orderBy("start", "place"))
    joined = crossing.withColumn("chain", chain).groupBy("file", "chain").agg(F.array_sort(F.collect_list(
        F.struct("start", "place", "text"))).alias("parts")).select(
            F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    records = pieces.where("place = 2").select("text").unionByName(joined).select(F.rtrim("text", F.lit("\r")).alias("text"))
    parsed = records.where("text != ''").select(F.from_csv(
        "text", ", ".join(f"{quoted(n)} string" for n in names), _OPTIONS).alias("row"))
    return parsed.select(*[
        (F.col(f"row.{quoted(f.name)}") if f.name in names else F.lit(None)).try_cast(f.dataType).alias(f.name)
        for f in fields])


def _records(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Records of each range of lines (place 2), and the pieces of those that end in it (0) or begin in it (1) only.

    A range that lies inside a record altogether is a piece of place 0. The header of a file is checked and left out.
    """
    key, held, place, inside, header = None, [], 2, 0, False
    out: list[tuple] = []

    def cut() -> None:
        """The lines held are what was left at the end of a range."""
        if held:
            out.append(("\n".join(held), *key, 0 if place == 0 else 1))
            held.clear()

    for batch in batches:
        for value, file, start, odd, opens in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if (file, start) != key:
                cut()
                key, inside, header = (file, start), opens, start == 0
                place = 0 if opens else 2
            held.append(value)
            inside ^= odd
            if not inside:
                text = "\n".join(held)
                held.clear()
                if header:
                    found = next(csv.reader([text.rstrip("\r").removeprefix("﻿")]), [])
                    if found != names:
                        raise ValueError(f"the header of {file} is not that of the first file: {found}")
                    header = False
                else:
                    out.append((text, *key, place))
                place = 2
        yield _batch(out)
        out.clear()
    cut()
    yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["text", "file", "start", "place"])
