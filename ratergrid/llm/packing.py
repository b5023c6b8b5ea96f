"""Harmonic packing of token sequences.

A piece of length n belongs to class k = capacity div n, that is, its length lies in
(capacity / (k + 1), capacity / k], and a bin of class k takes exactly k pieces. Every worker fills its bins
alone, with one open bin for each class, so nothing is shuffled but the bins still open at the end: at most
one for each class and worker. These meet in groups of ``FAN_IN`` workers, again and again, until one task has
the last of them and packs them first-fit by length.

A document is cut where this makes padding small: whole capacities first, then exact reciprocals
capacity / k, until what is left wastes at most ``slack`` ids of its own slot.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ratergrid.llm.common import quoted, whole_text
from ratergrid.llm.tokens import encoder
from ratergrid.session import stored

CAPACITY, SLACK, FAN_IN = 1024, 12, 32
#: Reciprocal classes: all up to 32, then powers of two, so that open bins stay few.
SMALL = 32
_COLUMNS = ["start", "length", "doc_tokens", "ids"]


def piece_class(length: int, capacity: int) -> int:
    """How many pieces of this length a bin takes."""
    k = capacity // length
    return k if k <= SMALL else 1 << (k.bit_length() - 1)


def cut(length: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[int]:
    """Lengths of the pieces of a document of ``length`` ids, in order."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = piece_class(rest, capacity)
        if capacity // k - rest <= slack or k >= SMALL:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


class Bins:
    """The open bins of one worker, and the rows of the full ones."""

    def __init__(self, worker: int, first: int, capacity: int):
        self.worker, self.base, self.capacity = worker, (first + worker) << 40, capacity
        self.open: dict[int, list[tuple]] = {}
        self.made, self.rows = 0, []

    def add(self, piece: tuple) -> None:
        """``piece``: (id, start, length, doc_tokens, ids)."""
        k = piece_class(piece[2], self.capacity)
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            self.close(self.open.pop(k))

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for piece in pieces:
            self.rows.append((*piece, self.base + self.made, offset, True, self.worker))
            offset += piece[2]
        self.made += 1

    def finish(self) -> None:
        """First fit by length over what is open; the number of pieces is bounded by the classes."""
        pieces = sorted((p for held in self.open.values() for p in held), key=lambda p: -p[2])
        bins: list[list] = []
        for piece in pieces:
            room = next((b for b in bins if b[0] >= piece[2]), None)
            if room is None:
                bins.append(room := [self.capacity, []])
            room[0] -= piece[2]
            room[1].append(piece)
        for _, held in bins:
            self.close(held)
        self.open = {}

    def leave(self) -> None:
        for held in self.open.values():
            self.rows += [(*piece, None, None, False, self.worker) for piece in held]
        self.open = {}

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(schema)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("doc_id", id_type), ("start", pa.int64()), ("length", pa.int64()),
                      ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()),
                      ("offset", pa.int64()), ("closed", pa.bool_()), ("worker", pa.int64())])


def _cut_and_fill(batches: Iterator[pa.RecordBatch], ranks_file: str | None, capacity: int, slack: int,
                  end_id: int) -> Iterator[pa.RecordBatch]:
    encode, bins = encoder(ranks_file).marked_ids, Bins(TaskContext.get().partitionId(), 0, capacity)
    end = struct.pack("<I", end_id)
    for batch in batches:
        schema = _schema(batch.schema.field(0).type)
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = encode(text.as_py()) + end
            total, start = len(ids) // 4, 0
            for length in cut(total, capacity, slack):
                bins.add((doc_id, start, length, total, ids[4 * start:4 * (start + length)]))
                start += length
            if len(bins.rows) >= 4096:
                yield bins.batch(schema)
        yield bins.batch(schema)
    if bins.open:
        bins.leave()
        yield bins.batch(schema)


def _refill(batches: Iterator[pa.RecordBatch], first: int, last: bool, capacity: int) -> Iterator[pa.RecordBatch]:
    """Pieces of open bins, with the group of workers that meet as last column; a group is a worker from now on."""
    groups: dict[int, Bins] = {}
    for batch in batches:
        schema = _schema(batch.schema.field(0).type)
        *pieces, met = (batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, batch.num_columns - 1))
        for group, *piece in zip(met, *pieces):
            if group not in groups:
                groups[group] = Bins(group, first, capacity)
            groups[group].add(tuple(piece))
        for bins in groups.values():
            yield bins.batch(schema)
    for bins in groups.values():
        bins.finish() if last else bins.leave()
        yield bins.batch(schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   slack: int = SLACK, end_id: int = 0, ranks_file: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    ``ids`` are little-endian unsigned 32-bit numbers. Every document, also an empty or NULL one, ends with
    ``end_id``; all its ids lie in exactly one piece. A row that repeats another is packed again; NULL ids are
    kept. An empty table gives no rows. Columns besides the two named are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(quoted(id_col)).alias("doc_id"), whole_text(text_col).alias("text"))
    schema = (f"doc_id {source.schema[0].dataType.simpleString()}, start long, length long, doc_tokens long, "
              "ids binary, sequence_id long, offset long, closed boolean, worker long")
    fill = functools.partial(_cut_and_fill, ranks_file=ranks_file, capacity=capacity, slack=slack, end_id=end_id)
    level = stored(source.mapInArrow(fill, schema), "pieces")
    done, first, last = [level.where("closed")], 0, False
    while not last:
        # Worker numbers are part of the sequence id: those of a level start above all earlier ones.
        first += (level.agg(F.max("worker")).first()[0] or 0) + 1
        opened = level.where("NOT closed").withColumn("_met", F.floor(F.col("worker") / FAN_IN))
        groups = opened.select("_met").distinct().count()
        if not groups:
            break
        last = groups == 1
        refill = functools.partial(_refill, first=first, last=last, capacity=capacity)
        level = stored(opened.repartition(groups, "_met").mapInArrow(refill, schema), "pieces")
        done.append(level.where("closed"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", *_COLUMNS, "sequence_id", "offset")
