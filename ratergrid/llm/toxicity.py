"""Toxicity by a factorization machine over hashed terms.

A term is a word, without case, or one of its openings of 3 to 8 letters, hashed to one of 2^20 buckets. The
machine has a weight and a short vector for each bucket; the products of two vectors stand for pairs of terms
(an insult beside the mention of a group) that a sum of weights can't see. Terms are present or absent, so
neither the length of a text nor repetition alone changes its score.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ratergrid.llm.common import WordCache, fold, quoted, whole_text
from ratergrid.llm.sample import labelled_texts

BUCKETS, FACTORS = 1 << 20, 4
#: Bounds of the fit: labelled documents read, and terms kept (those that tell the classes apart best).
SAMPLE_ROWS, KEPT_TERMS = 8000, 2048
#: Least chi-square of a kept term: below it, chance explains the difference.
LEAST_CHI2 = 12.0
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
_WORD = re.compile(r"[^\W\d_]+")


def word_terms(word: str) -> list[int]:
    """Buckets of a word and of its openings."""
    return [zlib.crc32(t.encode()) % BUCKETS for t in
            ["=" + word, *("^" + word[:n] for n in range(3, min(8, len(word)) + 1))]]


class Terms:
    """Distinct terms of texts: buckets, or the indexes that ``kept`` has for some of them."""

    def __init__(self, kept: dict[int, int] | None = None):
        def make(word: str) -> tuple[int, ...]:
            return tuple(word_terms(word) if kept is None else (kept[t] for t in word_terms(word) if t in kept))

        self.by_word = WordCache(make).__getitem__

    def of(self, text: str) -> list[int]:
        """The distinct terms of a whole text."""
        return sorted({t for terms in map(self.by_word, set(_WORD.findall(text.lower()))) for t in terms})


@dataclass(frozen=True)
class Machine:
    """``index`` of the kept buckets, their weights and vectors, and the bias."""

    index: dict[int, int]
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def logit(self, terms: list[int]) -> float:
        v = self.vectors[terms]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v ** 2).sum(axis=0)).sum())
        return self.bias + float(self.weights[terms].sum()) + pairs


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(bags: list[np.ndarray], labels: np.ndarray, kept_terms: int = KEPT_TERMS, factors: int = FACTORS,
        epochs: int = 60, rate: float = 0.05, decay: float = 2e-5, seed: int = 7,
        least: float = LEAST_CHI2) -> Machine:
    """Adam on the logistic loss. Without both classes the score is the share of label 1 (0 without rows)."""
    n, ones = len(bags), int(labels.sum()) if len(labels) else 0
    bias = float(np.log((ones + 0.5) / (n - ones + 0.5))) if n else -30.0
    if not 0 < ones < n:
        return Machine({}, bias, np.zeros(0), np.zeros((0, factors)))
    seen, hits = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bag, label in zip(bags, labels):  # a bag has each term once
        seen[bag] += 1
        hits[bag] += label
    share = ones / n
    score = np.full(BUCKETS, -1.0)
    used = np.flatnonzero(seen >= 3)
    k = seen[used]
    score[used] = (hits[used] - k * share) ** 2 / (k * share * (1 - share)) * (1 - k / (n + 1))
    best = np.sort(used[np.argsort(-score[used], kind="stable")[:kept_terms]])
    best = best[score[best] > least]
    place = np.full(BUCKETS, -1, np.int32)
    place[best] = np.arange(len(best))
    x = np.zeros((n, len(best)), np.uint8)
    for row, bag in zip(x, bags):
        at = place[bag]
        row[at[at >= 0]] = 1

    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(best), np.float32), rng.normal(0, 0.01, (len(best), factors)).astype(np.float32)
    b = np.float32(bias)
    m = [np.zeros_like(w), np.zeros_like(v)]
    s = [np.zeros_like(w), np.zeros_like(v)]
    step = 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(n), max(1, n // 512)):
            xp, yp = x[part].astype(np.float32), labels[part]
            xv = xp @ v
            out = b + xp @ w + 0.5 * ((xv ** 2).sum(1) - (xp @ (v ** 2)).sum(1))
            g = ((sigmoid(out) - yp) / len(part)).astype(np.float32)
            grads = [xp.T @ g + decay * w,
                     xp.T @ (g[:, None] * xv) - (xp.T @ g)[:, None] * v + 10 * decay * v]
            step += 1
            b -= np.float32(rate * g.sum())
            for i, (p, grad) in enumerate(zip((w, v), grads)):
                m[i] += 0.1 * (grad - m[i])
                s[i] += 0.001 * (grad ** 2 - s[i])
                p -= rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(s[i] / (1 - 0.999 ** step)) + 1e-6)
    return Machine({int(t): i for i, t in enumerate(best)}, float(b), w, v)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = Terms()
    for batch in batches:
        found = [np.array(terms.of(t.as_py()), np.int32).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["_label", "_terms"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", rows: int = SAMPLE_ROWS,
                 id_col: str = "doc_id", text_col: str = "text", kept_terms: int = KEPT_TERMS) -> Machine:
    """Fit on at most ``rows`` labelled documents outside the held-out fold, with at most ``kept_terms`` terms."""
    sample = labelled_texts(docs, labels, label_col, rows, FOLDS, HELD_OUT, id_col, text_col)
    got = sample.select(F.col("_label").cast("int").alias("_label"), "_text").mapInArrow(
        _bags, "_label int, _terms binary").collect()
    got.sort(key=lambda r: (bytes(r["_terms"]), r["_label"]))
    return fit([np.frombuffer(r["_terms"], np.int32) for r in got], np.array([r["_label"] for r in got], float), kept_terms)


def _score(batches: Iterator[pa.RecordBatch], machine: Machine) -> Iterator[pa.RecordBatch]:
    terms = Terms(machine.index)
    for batch in batches:
        scores = sigmoid(np.array([machine.logit(terms.of(t.as_py())) for t in batch.column(1)], float))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])


def toxicity_scores(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    The score depends on the text alone. NULL and empty texts, or texts without a known term, get the score
    of the bias; repeated rows get one row each, equal texts equal scores; a NULL id is kept. An empty table gives
    no rows. Columns besides the two named are not read.
    """
    source = docs.select(F.col(quoted(id_col)).alias("doc_id"), whole_text(text_col).alias("_text"))
    kind = source.schema[0].dataType.simpleString()
    scored = source.mapInArrow(functools.partial(_score, machine=machine), f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
