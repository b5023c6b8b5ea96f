import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from ratergrid.llm.periodic import kept_words, lyndon_lengths, periodic_runs, runs_of, runs_report, text_runs
from ratergrid.llm.suffix_tree import Extension, RangeMin, SuffixTree

DOCS = "doc_id long, text string"


def runs_brute(words, least=12):
    """All runs, by every period: stretches in which words q apart are the same, without those of a smaller period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            k = i
            while k + q < n and words[k] == words[k + q]:
                k += 1
            if k + q - i >= 2 * q:
                found.setdefault((i, k + q - i), q)  # the smallest period comes first
            i = max(k, i + 1)
    return sorted((a, m, q) for (a, m), q in found.items() if m >= least)


def report_brute(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = runs_brute(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{a},{m},{q}\n" for a, m, q in runs).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60), st.integers(2, 12))
def test_runs_against_all_periods(seq, least):
    want = [tuple(r) for r in runs_brute(seq, least)]
    assert [tuple(r) for r in runs_of(seq, least).tolist()] == want
    assert [tuple(r) for r in text_runs(seq, least).tolist()] == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=40))
def test_trees(seq):
    n = len(seq)
    tree = SuffixTree(seq)
    assert len(tree.start) <= 2 * (n + 1) and len(tree.leaves) == n + 1
    depths, places, order = tree.tour()
    suffixes = [tuple(seq[i:]) for i in range(n + 1)]
    assert order.tolist() == sorted(range(n + 1), key=lambda i: suffixes[i])
    backward = tree.tour(backward=True)[2].tolist()
    assert backward == sorted(range(n + 1), key=lambda i: [-c for c in suffixes[i]])
    pairs = [(i, j) for i in range(n + 1) for j in range(n + 1) if i != j]
    got = Extension(depths, places)(*np.array(pairs).T)
    for (i, j), k in zip(pairs, got.tolist()):
        assert seq[i:i + k] == seq[j:j + k] and (max(i, j) + k == n or seq[i + k] != seq[j + k])
    for i, k in enumerate(lyndon_lengths(order).tolist()):
        word = seq[i:i + k]
        assert all(word < word[m:] for m in range(1, k))
        assert not any(all(seq[i:j] < seq[m:j] for m in range(i + 1, j)) for j in range(i + k + 1, n + 1))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=300), st.randoms())
def test_range_minima(values, rng):
    low = [rng.randrange(len(values)) for _ in range(50)]
    high = [rng.randrange(a, len(values)) for a in low]
    got = RangeMin(np.array(values))(np.array(low), np.array(high)).tolist()
    assert got == [min(values[a:b + 1]) for a, b in zip(low, high)]


def made_docs():
    rng = random.Random(5)
    docs = []
    for i in range(150):
        words = [rng.choice(["a", "b", "c", "dé", "漢", "e.", "F"]) for _ in range(rng.randrange(90))]
        for _ in range(rng.randrange(3)):
            at, size = rng.randrange(len(words) + 1), rng.randrange(1, 12)
            words[at:at] = [rng.choice("uvwxyz") for _ in range(size)] * rng.randrange(2, 9)
        docs.append((i, rng.choice([" ", "\n", " \t", "\x0b", "\x0c\r"]).join(words)))
    root = [f"w{k}" for k in range(700)]
    return docs + [(None, "x " * 30), (None, None), (1, docs[1][1]), (200, ""), (201, None), (202, " \n "), (204, "x"), (205, "\x85 \xa0 \x1f " * 9),
                   (206, " ".join(root * 5 + root[:3])), (207, "same " * 20_000), (208, " ".join(f"v{k}" for k in range(30_000)))]


def test_report_against_brute_force(spark):
    docs = made_docs()
    got = runs_report(spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS runs", "'x' AS collapsed", "2 AS _h").repartition(5))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for c, t in got.dtypes[:6]} == {"bigint"}
    large = {206, 207, 208}
    large = {206, 207, 208}
    small = [d for d in docs if d[0] not in large]
    rows = [tuple(r) for r in got.collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((r for r in rows if r[0] not in large), key=key) == sorted((report_brute(*d) for d in small), key=key)
    assert len({r[1] for r in rows}) > 3 and {r[0]: r[1:6] for r in rows if r[0] == 207} == {207: (1, 0, 20_000, 1, 20_000_000)}
    assert {r[0]: r[1:5] for r in rows if r[0] == 206} == {206: (1, 0, 3503, 700)} and len(rows) == len(docs)


def test_own_length_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b a b c c")], DOCS)
    row = periodic_runs(df, least=2).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 4, 2), (4, 2, 1)] and row["collapsed"] == "a b c"
    assert periodic_runs(df.limit(0)).count() == 0 and runs_report(df.limit(0)).count() == 0
    assert kept_words(0, np.zeros((0, 3), np.int64)).tolist() == []
    with pytest.raises(ValueError):
        periodic_runs(df, least=1)
