"""Chat formatting as a prefix tree.

Conversations that begin with the same turns share the nodes of these turns. Every node's text is formatted and
tokenized once. Nodes are laid out depth first, so that the subtree of a node is one run of positions; a node
knows where it starts there, and at which position id (the tokens of its ancestors come before). A conversation is
then a list of intervals of that layout, one for each turn: what its last turn may attend to.

A turn is written ``### role: text</turn>`` and a line break. Backslashes, ``#`` and ``<`` inside texts and roles, and the
colon inside roles, get a backslash before them, so no control string can occur there, and the format can be read
back exactly.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ratergrid.llm.common import quoted, whole_text
from ratergrid.llm.tokens import encoder
from ratergrid.session import stored

OPEN, MID, CLOSE = "### ", ": ", "</turn>\n"
#: The role whose text is trained on.
TRAINED = "assistant"
_TEXT, _ROLE = re.compile(r"([\\#<])"), re.compile(r"([\\#<:])")
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.)*+)</turn>\n", re.S)
_BACK = re.compile(r"\\(.)", re.S)


def format_turn(role: str, text: str) -> str:
    return OPEN + _ROLE.sub(r"\\\1", role) + MID + _TEXT.sub(r"\\\1", text) + CLOSE


def read_turn(segment: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    found = _TURN.fullmatch(segment)
    if not found:
        raise ValueError("not a formatted turn")
    return _BACK.sub(r"\1", found.group(1)), _BACK.sub(r"\1", found.group(2))


def text_span(segment: str) -> tuple[int, int]:
    """Where the escaped text lies in a formatted turn."""
    return _TURN.fullmatch(segment).span(2)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node ids along sorted turns (conversation, role, text): the digest of all turns up to this one.

    Only the running digest is held from one row to the next, however long a conversation is.
    """
    last, running, place = object(), b"", 0
    for batch in batches:
        places, nodes, parents, segments = [], [], [], []
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if conv != last:
                last, running, place = conv, b"", -1
            segment = format_turn(role, text)
            place += 1
            places.append(place)
            parents.append(running or None)
            running = hashlib.blake2b(running + segment.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            nodes.append(running)
            segments.append(segment)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(places, pa.int64()), pa.array(nodes, pa.binary()), pa.array(parents, pa.binary()),
             pa.array(segments, pa.string()), batch.column(1)],
            names=["conv_id", "place", "node_id", "parent_id", "segment", "role"])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Path of each picked node from sorted turns (conversation, row, node, opens a branch, picked): the nodes on the
    way to it that open a branch."""
    last, path = object(), []
    for batch in batches:
        rows, paths = [], []
        for conv, row, node, opens, picked in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if conv != last:
                last, path = conv, []
            if opens:
                path.append(int.from_bytes(node[:8], "big", signed=True))
            if picked:
                rows.append(row)
                paths.append(list(path))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(paths, pa.list_(pa.int64()))],
                                         names=["_row", "_path"])


def _laid_out(batches: Iterator[pa.RecordBatch], ranks_file: str | None) -> Iterator[pa.RecordBatch]:
    """Tokens of sorted nodes, and where each starts within its partition."""
    encode, part, at = encoder(ranks_file).ids, TaskContext.get().partitionId(), 0
    for batch in batches:
        ids = [encode(s.as_py()) for s in batch.column(batch.schema.get_field_index("segment"))]
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        starts = at + np.cumsum(sizes) - sizes
        at += int(sizes.sum())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(ids, pa.binary()), pa.array(sizes), pa.array(starts),
             pa.array(np.full(len(ids), part), pa.int32())],
            names=[*batch.schema.names, "ids", "n_tokens", "_at", "_part"])


def prefix_tree(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", ranks_file: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, turns).

    nodes, one row per distinct prefix of turns: node_id, parent_id, role, segment (the formatted turn), text_start and
    text_end (its text within the segment, in code points), trained, ids (tokens, little-endian 32-bit), n_tokens, start
    (place of its first token in the depth-first layout), position (position id of that token).
    turns, one row per turn: conv_id, place (0 for the first), node_id, start, n_tokens, position. The intervals
    [start, start + n_tokens) of a conversation's turns up to one are what that turn's tokens may attend to.

    Rows are ordered by turn, then role, then text; NULL turns come first, a NULL role or text is empty. Rows that
    repeat a turn are turns of their own. Rows with a NULL conversation are one conversation. An empty table gives
    empty results. Other columns are not read.
    """
    rows = conversations.select(
        F.col(quoted(conv_col)).alias("conv_id"), F.col(quoted(turn_col)).alias("_turn"),
        whole_text(role_col).alias("role"), whole_text(text_col).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "_turn", "role", "text")
    chained = stored(ordered.select("conv_id", "role", "text").mapInArrow(
        _chained, f"conv_id {kind}, place long, node_id binary, parent_id binary, segment string, role string"
    ).withColumn("_row", F.monotonically_increasing_id()), "chained")

    # Depth first without holding a tree: nodes are sorted by their path, in which only nodes that open a branch count.
    # A path is made once for each node, so all paths together are no longer than the conversations.
    picked = stored(chained.groupBy("node_id").agg(F.min("_row").alias("_row")).select(
        "_row", F.lit(True).alias("_picked")), "picked")
    chosen = chained.join(picked, "_row")
    forks = stored(chosen.where("parent_id IS NOT NULL").groupBy("parent_id").agg(F.count("*").alias("_n")).where(
        "_n > 1").select("parent_id", F.lit(True).alias("_fork")), "forks")
    steps = chained.select("conv_id", "place", "_row", "node_id", "parent_id").join(picked, "_row", "left")
    inner = stored(steps.where("parent_id IS NOT NULL"), "steps").join(forks, "parent_id", "left")
    opens = inner.withColumn("_opens", F.col("_fork").isNotNull()).unionByName(
        steps.where("parent_id IS NULL").withColumns({"_fork": F.lit(None).cast("boolean"), "_opens": F.lit(True)}))
    paths = opens.select("conv_id", "_row", "node_id", "_opens", "_picked", "place").repartition(
        "conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_paths, "_row long, _path array<long>")
    distinct = chosen.select("_row", "node_id", "parent_id", "segment", "role", "place").join(paths, "_row").drop("_row")
    laid = distinct.repartitionByRange("_path", "place").sortWithinPartitions("_path", "place")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in laid.schema.fields)
    laid = stored(laid.mapInArrow(functools.partial(_laid_out, ranks_file=ranks_file),
                                  kinds + ", ids binary, n_tokens long, _at long, _part int"), "laid")
    before = laid.groupBy("_part").agg(F.sum("n_tokens").alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)))
    trained = F.col("role") == TRAINED
    text = F.length(F.regexp_replace("role", r"[\\#<:]", "xx")) + len(OPEN + MID)
    nodes = laid.join(F.broadcast(before.select("_part", "_before")), "_part").select(
        "node_id", "parent_id", "role", "segment", text.alias("text_start"),
        (F.length("segment") - len(CLOSE)).alias("text_end"), trained.alias("trained"), "ids", "n_tokens",
        (F.col("_before") + F.col("_at")).alias("start"))
    sizes = stored(nodes.select("node_id", "n_tokens", "start"), "sizes")
    turns = chained.select("conv_id", "place", "node_id").join(sizes, "node_id")
    along = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    turns = stored(turns.select("conv_id", "place", "node_id", "start", "n_tokens", F.coalesce(
        F.sum("n_tokens").over(along), F.lit(0)).alias("position")), "turns")
    positions = turns.groupBy("node_id").agg(F.min("position").alias("position"))
    return stored(nodes.join(positions, "node_id"), "nodes"), turns


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations from sorted rows (conv_id, place, segment, text_start, text_end, trained)."""
    last, held = object(), None
    out: list[tuple] = []

    def finish() -> None:
        if held:
            out.append((last, held[0], held[1].hexdigest(), held[2], held[3].hexdigest(), held[4]))

    for batch in batches:
        for conv, place, segment, a, b, trained in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if place == 0:
                finish()
                last, held = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = read_turn(segment)
            held[0] += 1
            held[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if trained:
                learnt = _BACK.sub(r"\1", segment[a:b])
                held[2] += len(learnt)
                held[3].update(learnt.encode("utf-8", "surrogatepass"))
            held[4] += len(segment)
        yield _report(out, batch.schema.field(0).type)
        out.clear()
        kind = batch.schema.field(0).type
    if held:
        finish()
        yield _report(out, kind)


def _report(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    columns = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per conversation, read from the tree: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. Only running digests are held, so a conversation may have any number of turns."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", "place", "node_id").join(
        nodes.select("node_id", "segment", "text_start", "text_end", "trained"), "node_id").drop("node_id")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.mapInArrow(_read_back, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                                          "loss_sha256 string, formatted_chars long")


_ESCAPED = r"length(regexp_replace({}, '([\\#<{}])', 'xx', 'g'))"
CHAT_SQL = rf"""WITH c AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM (
  SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '{{hostile}}' UNION ALL
  SELECT -7, 1, 'assistant', '{{hostile}}') q)
SELECT conv_id, COUNT(*) AS n_turns, sha256(STRING_AGG(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
  AS turns_sha256, CAST(COALESCE(SUM(length(text)) FILTER (role = '{TRAINED}'), 0) AS BIGINT) AS loss_chars,
  sha256(COALESCE(STRING_AGG(text, '' ORDER BY turn, role, text) FILTER (role = '{TRAINED}'), '')) AS loss_sha256,
  CAST(SUM({len(OPEN + MID + CLOSE)} + {_ESCAPED.format('role', ':')} + {_ESCAPED.format('text', '')}) AS BIGINT)
  AS formatted_chars FROM c GROUP BY conv_id"""
