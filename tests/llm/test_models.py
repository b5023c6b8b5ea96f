import random

import numpy as np
import pyarrow as pa
import pytest

from ratergrid.llm import quality, toxicity
from ratergrid.llm.common import fold_of
from ratergrid.llm.passages import FEATURES, bags

WORDS = [a + b for a in "ba ke lo mi nu pe ra so ti vu".split() for b in "dan fer gul hin jor kas lem".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(700):
        bad, rude = rng.random() < 0.2, rng.random() < 0.2
        words = prose(rng, rng.randrange(5, 300)).split()
        if rude:
            words.insert(rng.randrange(len(words)), "Vexo" + rng.choice(["rin", "tal", "mus", "bek", "dol"]) + "!")
        if bad:
            at = rng.randrange(len(words) + 1)
            words[at:at] = [f"{w}%%%" for w in prose(rng, 60).split()]
        docs.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(rude)))
    docs += [(1000, None), (1001, ""), (None, "no id"), (0, docs[0][1])]
    labels += [(None, 1, 1), (3, None, None), (9999, 1, 1)]
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


@pytest.mark.parametrize("op, label, parts, held", [
    ("quality", "quality", 5, 0), ("toxicity", "toxic", 3, 1)])
def test_held_out_accuracy(corpus, op, label, parts, held):
    docs, labels = corpus
    fit, score = {"quality": (quality.fit_quality, quality.quality_scores),
                  "toxicity": (toxicity.fit_toxicity, toxicity.toxicity_scores)}[op]
    got = score(docs, fit(docs, labels)).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    limit = 0.3 if op == "quality" else 0.7
    assert (got.predicted == (got.score >= limit).astype(int)).all()
    known = got.dropna(subset=["doc_id"])
    assert (known.held_out == [fold_of(int(i), parts) == held for i in known.doc_id]).all()
    assert got[got.doc_id == 0].score.nunique() == 1 and got[got.doc_id.isin([1000, 1001])].score.nunique() == 1
    m = known[known.held_out].merge(labels.toPandas().dropna(), on="doc_id")
    assert (m.predicted == m[label]).mean() > 0.95


@pytest.mark.parametrize("fit, score", [(quality.fit_quality, quality.quality_scores),
                                        (toxicity.fit_toxicity, toxicity.toxicity_scores)])
def test_without_labels_or_rows(spark, corpus, odd, none, fit, score):
    docs, labels = corpus
    assert score(none, fit(none, labels)).count() == 0
    one_class = labels.withColumns({c: labels.doc_id * 0 + 1 for c in ("quality", "toxic")})
    for model in (fit(docs, labels.limit(0)), fit(docs, one_class)):
        got = score(odd, model).toPandas()
        assert len(got) == odd.count() and got.score.nunique() == 1
    assert score(odd, fit(docs, labels)).toPandas().score.between(0, 1).all()


def test_machine_learns_pairs():
    """Two terms that are harmless alone: the weights can't tell, the pair vectors can."""
    rng = np.random.default_rng(0)
    bags_, labels = [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.5
        bags_.append(np.array(sorted([1] * int(a) + [2] * int(b) + rng.choice(np.arange(10, 40), 6, replace=False).tolist()), np.int32))
        labels.append(float(a and b))
    m = toxicity.fit(bags_, np.array(labels), least=0)
    logit = lambda t: m.logit([m.index[i] for i in t])
    alone = max(logit([1]), logit([2]))
    v = m.vectors[[m.index[1], m.index[2]]]
    assert logit([1, 2]) > 1 > 0 > alone and v[0] @ v[1] > 0.5


def test_attention_finds_the_passage():
    rng = np.random.default_rng(1)
    d = len(FEATURES)
    sizes = rng.integers(1, 9, 500)
    x, y = rng.normal(0, 1, (sizes.sum(), d)), np.zeros(500)
    starts = np.cumsum(sizes) - sizes
    marked = {}
    for i in range(0, 500, 2):
        marked[i] = starts[i] + rng.integers(sizes[i])
        x[marked[i], 3] += 6
        y[i] = 1
    model = quality.fit(x, sizes, y)
    hits = 0
    for i, at in marked.items():
        _, logits = model.encode(x[starts[i]:starts[i] + sizes[i]])
        hits += starts[i] + logits.argmax() == at
    assert hits / len(marked) > 0.9


def test_slices_give_the_score_of_the_whole():
    rng = random.Random(2)
    text = prose(rng, 20_000)
    model = quality.Attention(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), {
        k: np.random.default_rng(3).normal(0, 0.3, s) for k, s in {
            "enc": (len(FEATURES), 16), "enc_b": (16,), "v": (16, 8), "u": (16, 8), "att": (8,), "out": (16,),
            "out_b": (1,)}.items()})
    column = pa.array([text, "", "a b"])
    x, doc = (np.concatenate(z) for z in zip(*bags(column)))
    h, logits = model.encode(x)
    want = []
    for i in range(3):
        a = np.exp(logits[doc == i])
        want.append(model.head((a / a.sum()) @ h[doc == i]))
    assert np.allclose(quality.score_column(column, model), want)


def test_passages_of_long_and_odd_texts():
    import ratergrid.llm.passages as P

    texts = ["", " ", "one", "a " * 120, "é" * 300, None]
    x, doc = (np.concatenate(z) for z in zip(*bags(pa.array([t or "" for t in texts]))))
    assert np.bincount(doc).tolist() == [1, 1, 1, 3, 1, 1] and np.isfinite(x).all()
    assert P.SLICE >= 1 << 16


def test_pair_sum_against_all_pairs():
    """The machine's fast sum over interactions is the sum over all pairs of terms, written out."""
    rng = np.random.default_rng(3)
    machine = toxicity.Machine({i: i for i in range(9)}, 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    for size in range(10):
        terms = sorted(rng.choice(9, size, replace=False).tolist())
        want = 0.3 + sum(machine.weights[i] for i in terms) + sum(
            float(machine.vectors[i] @ machine.vectors[j]) for i in terms for j in terms if i < j)
        assert machine.logit(terms) == pytest.approx(want)


def test_scores_against_all_pairs(spark, corpus):
    """Scores of a fitted machine over a table are those of the explicit sums over each text's known terms."""
    docs, labels = corpus
    machine = toxicity.fit_toxicity(docs, labels)
    terms = toxicity.Terms(machine.index)
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id BETWEEN 1 AND 120").collect()}
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, machine).where("doc_id BETWEEN 1 AND 120").collect()}
    for doc, text in texts.items():
        of = terms.of(text)
        logit = machine.bias + sum(float(machine.weights[i]) for i in of) + sum(
            float(machine.vectors[i] @ machine.vectors[j]) for k, i in enumerate(of) for j in of[:k])
        assert got[doc] == pytest.approx(1 / (1 + np.exp(-np.clip(logit, -30, 30))), abs=1e-5)


def test_long_texts_are_fitted_on_evenly_spread_passages():
    text = " ".join(f"w{i}" for i in range(50 * 30))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 0], pa.int32()), pa.array([text, "short one"])], names=["_label", "_text"])
    (out,) = quality._bags([batch], 10)
    x = np.concatenate([b for b, _ in bags(batch.column(1))])
    got = [np.frombuffer(p, np.float32).reshape(-1, len(FEATURES)) for p in out.column(1).to_pylist()]
    assert out.column(0).to_pylist() == [1, 0] and [len(g) for g in got] == [10, 1]
    assert np.array_equal(got[0], x[np.linspace(0, 29, 10).astype(int)])


def test_bounds_of_the_fits_are_parameters(corpus):
    docs, labels = corpus
    assert len(toxicity.fit_toxicity(docs, labels, kept_terms=5).index) <= 5
    assert quality.fit_quality(docs, labels, rows=50, passages=2).layers
