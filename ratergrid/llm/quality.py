"""Quality by attention over the passages of a document (multiple-instance learning).

Every passage of 50 words is encoded from its statistics; gated attention gives it a weight, the weighted sum of
the encodings stands for the document, and a logistic layer scores it. Only document labels are needed: the
gradient through the attention finds the passages that decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ratergrid.llm.common import fold, quoted, whole_text
from ratergrid.llm.passages import FEATURES, bags
from ratergrid.llm.sample import labelled_texts

HIDDEN, GATE = 16, 8
#: Bounds of the fit: labelled documents read, and passages of one of them (of a longer one as many are taken, evenly spread).
SAMPLE_ROWS, SAMPLE_PASSAGES = 6000, 400
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3


@dataclass(frozen=True)
class Attention:
    """Scaling of the features and the layers: encoder, the two halves of the gate, attention, output."""

    mean: np.ndarray
    scale: np.ndarray
    layers: dict[str, np.ndarray]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodings and attention logits of passages."""
        p = self.layers
        h = np.tanh((x - self.mean) / self.scale @ p["enc"] + p["enc_b"])
        return h, (np.tanh(h @ p["v"]) * sigmoid(h @ p["u"])) @ p["att"]

    def head(self, z: np.ndarray) -> np.ndarray:
        return sigmoid(z @ self.layers["out"] + self.layers["out_b"][0])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def attend(h: np.ndarray, logits: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """Attention weights and weighted sums of the documents that begin at ``starts``."""
    e = np.exp(logits - np.repeat(np.maximum.reduceat(logits, starts), sizes))
    a = e / np.repeat(np.add.reduceat(e, starts), sizes)
    return a, np.add.reduceat(a[:, None] * h, starts, axis=0)


def fit(x: np.ndarray, sizes: np.ndarray, labels: np.ndarray, epochs: int = 60, rate: float = 0.01,
        decay: float = 1e-4, seed: int = 5) -> Attention:
    """Adam on the logistic loss over documents of ``sizes`` passages each. Without both classes the score is
    the share of label 1 (0.5 without rows)."""
    n, d = len(sizes), len(FEATURES)
    rng = np.random.default_rng(seed)
    shape = {"enc": (d, HIDDEN), "enc_b": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "att": (GATE,),
             "out": (HIDDEN,), "out_b": (1,)}
    p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) * (len(s) > 1 or k in ("att", "out")) for k, s in shape.items()}
    ones = labels.sum() if n else 0
    p["out_b"][:] = np.log((ones + 0.5) / (n - ones + 0.5))
    if not 0 < ones < n:
        return Attention(np.zeros(d), np.ones(d), {k: v * (k == "out_b") for k, v in p.items()})
    model = Attention(x.mean(axis=0, dtype=float), x.std(axis=0, dtype=float) + 1e-3, p)
    x = (x - model.mean) / model.scale
    ends = np.cumsum(sizes)
    begins = ends - sizes
    m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(n), max(1, n // 64)):
            rows = np.concatenate([np.arange(begins[i], ends[i]) for i in part])
            size = sizes[part]
            start = np.cumsum(size) - size
            xb, y = x[rows], labels[part]
            h = np.tanh(xb @ p["enc"] + p["enc_b"])
            t, q = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
            a, z = attend(h, (t * q) @ p["att"], start, size)
            g = (sigmoid(z @ p["out"] + p["out_b"][0]) - y) / len(part)
            gz = np.repeat(g[:, None] * p["out"], size, axis=0)
            ga = (gz * h).sum(axis=1)
            gl = a * (ga - np.repeat(np.add.reduceat(a * ga, start), size))
            gt, gq = gl[:, None] * p["att"] * q * (1 - t ** 2), gl[:, None] * p["att"] * t * q * (1 - q)
            gh = (a[:, None] * gz + gt @ p["v"].T + gq @ p["u"].T) * (1 - h ** 2)
            grads = {"enc": xb.T @ gh, "enc_b": gh.sum(axis=0), "v": h.T @ gt, "u": h.T @ gq,
                     "att": (t * q).T @ gl, "out": z.T @ g, "out_b": np.array([g.sum()])}
            step += 1
            for k, grad in grads.items():
                grad = grad + decay * p[k]
                m[k] += 0.1 * (grad - m[k])
                s[k] += 0.001 * (grad ** 2 - s[k])
                p[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def _bags(batches: Iterator[pa.RecordBatch], passages: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column(0).to_pylist()
        for x, doc in bags(batch.column(1)):
            found, first, size = np.unique(doc, return_index=True, return_counts=True)
            picks = [a + (np.arange(n) if n <= passages else np.linspace(0, n - 1, passages).astype(int))
                     for a, n in zip(first, size)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([labels[i] for i in found], pa.int32()), pa.array([x[p].tobytes() for p in picks], pa.binary())],
                names=["_label", "_passages"])


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = SAMPLE_ROWS,
                id_col: str = "doc_id", text_col: str = "text", passages: int = SAMPLE_PASSAGES) -> Attention:
    """Fit on at most ``rows`` labelled documents outside the held-out fold, and ``passages`` of each."""
    sample = labelled_texts(docs, labels, label_col, rows, FOLDS, HELD_OUT, id_col, text_col)
    got = sample.select(F.col("_label").cast("int").alias("_label"), "_text").mapInArrow(
        lambda batches: _bags(batches, passages), "_label int, _passages binary").collect()
    got.sort(key=lambda r: (bytes(r["_passages"]), r["_label"]))
    x = [np.frombuffer(r["_passages"], np.float32).reshape(-1, len(FEATURES)) for r in got]
    return fit(np.concatenate(x) if x else np.zeros((0, len(FEATURES))), np.array([len(b) for b in x], int),
               np.array([r["_label"] for r in got], float))


def score_column(column: pa.Array, model: Attention) -> np.ndarray:
    """Scores of whole texts. A text is attended over all its passages, also when it comes in several slices:
    per slice only the largest logit, the sum of weights and the weighted sum are held."""
    n = len(column)
    top, total, z = np.full(n, -np.inf), np.zeros(n), np.zeros((n, HIDDEN))
    for x, doc in bags(column):
        h, logits = model.encode(x)
        found, start = np.unique(doc, return_index=True)
        size = np.diff(np.append(start, len(doc)))
        high = np.maximum(top[found], np.maximum.reduceat(logits, start))
        e = np.exp(logits - np.repeat(high, size))
        shrink = np.exp(top[found] - high)
        total[found] = total[found] * shrink + np.add.reduceat(e, start)
        z[found] = z[found] * shrink[:, None] + np.add.reduceat(e[:, None] * h, start, axis=0)
        top[found] = high
    return model.head(z / np.maximum(total, 1e-300)[:, None])


def score_udf(model: Attention):
    """The score of a text column, as a function over Arrow batches."""
    return F.arrow_udf(lambda texts: pa.array(score_column(texts, model), pa.float64()), "double")


def quality_scores(docs: DataFrame, model: Attention, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    The score depends on the text alone. NULL and empty texts, and texts of blanks, count as one passage whose
    statistics are all zero; repeated rows get one row each, equal texts equal scores; a NULL id is kept. An empty
    table gives no rows. Columns besides the two named are not read.
    """
    scored = docs.select(F.col(quoted(id_col)).alias("doc_id"), score_udf(model)(whole_text(text_col)).alias("score"))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Attention, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that are not rejected, with their columns as they are."""
    return docs.where(score_udf(model)(whole_text(text_col)) >= threshold)
