"""Periodic runs in the words of a text, by suffix trees.

A run is a stretch that no neighbour extends with its smallest period, which fits at least twice. Every run has a
repetition of its Lyndon root in it: the longest Lyndon word that begins at some place, in the order of the words or in the
reverse order. These candidates (two for each place) are extended to both sides by the longest common extension, which
suffix trees of the sequence and of its reversal answer in constant time.

The trees are built over the parts of a text in which runs can lie. In a run of at least ``least`` words with period q,
max(least - q, q) words in a row are followed, q words later, by the same ones, and those windows cover it; so a run
lies in a stretch covered by windows of ceil(least / 2) words that occur twice or more in the text, and texts without
such windows have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ratergrid.llm.common import BLANK_CLASS, quoted, whole_text
from ratergrid.llm.suffix_tree import Extension, SuffixTree

#: A run has at least so many words.
LEAST = 12
_SALT = np.random.default_rng(17).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def lyndon_lengths(order: np.ndarray) -> np.ndarray:
    """For each place the length of the longest Lyndon word that begins there: up to the next smaller suffix.

    ``order`` are the suffixes in their order, the empty one first.
    """
    n = len(order) - 1
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.arange(n + 1)
    ranks, out, waiting = rank.tolist(), [0] * n, []
    for i, r in enumerate(ranks):
        while waiting and ranks[waiting[-1]] > r:
            k = waiting.pop()
            out[k] = i - k
        waiting.append(i)
    return np.array(out, np.int64)


def runs_of(seq: list[int], least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs of ``least`` words or more, by start, then period."""
    n = len(seq)
    if n < least:
        return np.zeros((0, 3), np.int64)
    forward = SuffixTree(seq)
    depths, places, order = forward.tour()
    roots = [lyndon_lengths(order), lyndon_lengths(forward.tour(backward=True)[2])]
    ahead, back = Extension(depths, places), Extension(*SuffixTree(seq[::-1]).tour()[:2])
    i = np.tile(np.arange(n), 2)
    period = np.concatenate(roots)
    start = i - back(n - i, n - i - period)
    end = i + period + ahead(i, i + period)
    whole = end - start >= np.maximum(least, 2 * period)
    return np.unique(np.stack([start, end - start, period], axis=1)[whole], axis=0)


def repetitive_parts(codes: np.ndarray, window: int) -> Iterator[tuple[int, int]]:
    """Maximal stretches covered by windows that occur more than once (a hash that collides only lengthens them)."""
    n = len(codes) - window + 1
    if n < 2:
        return
    salted = codes.astype(np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(window):
        total += (salted[k:k + n] ^ np.uint64(k << 40)) * _SALT[k % 64]
        total ^= total >> np.uint64(29)
    order = np.argsort(total, kind="stable")
    same = total[order[1:]] == total[order[:-1]]
    if not same.any():
        return
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    cuts = np.flatnonzero(np.diff(at) > window)
    for a, b in zip(np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(at) - 1]])):
        yield int(at[a]), int(at[b]) + window


def text_runs(words: list, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of the runs of a list of words, by start, then period."""
    code: dict = {}
    codes = np.array([code.setdefault(w, len(code)) for w in words], np.int64)
    found = [np.zeros((0, 3), np.int64)]
    for a, b in repetitive_parts(codes, (least + 1) // 2):
        if b - a >= least:
            symbols = np.unique(codes[a:b], return_inverse=True)[1] + 1
            found.append(runs_of(symbols.tolist(), least) + [a, 0, 0])
    return np.concatenate(found)


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay: those that no run holds beyond its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:n]) == 0


def _scan(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, tables, texts = [0], [], []
        for text in batch.column(1):
            words = text.as_py().encode("utf-8", "surrogatepass").split()
            runs = text_runs(words, least)
            if len(runs):
                words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()]
                tables.append(runs)
            offsets.append(offsets[-1] + len(runs))
            texts.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        rows = np.concatenate([np.zeros((0, 3), np.int64), *tables])
        runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(np.ascontiguousarray(rows[:, k])) for k in range(3)], names=["start", "length", "period"]))
        yield pa.RecordBatch.from_arrays([batch.column(0), runs, pa.array(texts, pa.string())],
                                         names=["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, runs (array of start, length, period by start, then period), collapsed (the
    text without what runs repeat, words joined by one space).

    Words lie between the six blanks and are compared as they are. NULL and empty texts have no runs and an empty
    collapsed text; repeated rows are worked on each; an empty table gives no rows. Other columns are not read. Memory
    is that of one batch and the trees of one repetitive part of a text (about 1 KB a word of it).
    """
    if least < 2:
        raise ValueError("a run has at least two words")
    source = docs.select(F.col(quoted(id_col)).alias("doc_id"), whole_text(text_col).alias("_text"))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(lambda it: _scan(it, least), f"doc_id {kind}, "
                             "runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_repeated_ends(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the texts of ``documents``, of which one in ten repeats a part of itself up to its end.

    With h the crc32 of the id as text (NULL: empty) and g = h div 10, texts of h divisible by 10 go on from word
    a = g mod n with the p words from there over and over, p = 1 + (n - a) div (3 + g mod 8).
    """
    docs = docs.select("doc_id", whole_text("text").alias("text"), F.crc32(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("_h"))
    words = F.filter(F.split("text", BLANK_CLASS + "+"), lambda w: w != "")
    some = docs.where("_h % 10 = 0").withColumns({"_words": words, "_g": F.expr("_h div 10")})
    some = some.withColumn("_n", F.size("_words"))
    some = some.withColumn("_a", F.expr("CAST(IF(_n = 0, 0, _g % _n) AS INT)"))
    some = some.withColumn("_p", F.expr("CAST(1 + (_n - _a) div (3 + _g % 8) AS INT)"))
    tail = F.expr("slice(flatten(array_repeat(slice(_words, _a + 1, _p), CAST((_n - _a) div _p + 1 AS INT))), 1, _n - _a)")
    some = some.select("doc_id", F.when(F.col("_n") > 0, F.array_join(F.concat(
        F.expr("slice(_words, 1, _a)"), tail), " ")).otherwise(F.col("text")).alias("text"))
    return docs.where("_h % 10 != 0").select("doc_id", "text").unionByName(some)


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def runs_report(docs: DataFrame) -> DataFrame:
    """Runs of ``documents`` (some with repeated ends) as counts and digests, with the longest run."""
    found = periodic_runs(with_repeated_ends(docs))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[
        r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    return found.withColumn("_best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"),
        (-F.col("_best.less")).alias("length"), F.col("_best.period").alias("period"),
        F.expr("-1000 * _best.less div _best.period").alias("exponent_milli"),
        _digest(F.array_join(lines, "")).alias("runs_sha256"), _digest(F.col("collapsed")).alias("collapsed_sha256"))
