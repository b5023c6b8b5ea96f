import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest

from ratergrid.llm.common import keep_rows
from ratergrid.llm.components import compose, connect
from ratergrid.llm.exact_dedup import exact_dedup, merge_counts
from ratergrid.llm.near_dedup import near_dedup, near_dedup_survivors
from ratergrid.llm.shingles import Circulant, mix64
from brute import near_brute


@pytest.mark.parametrize("counters", [2, 1024])
def test_exact_dedup_odd(spark, odd, none, counters):
    got = exact_dedup(odd, counters=counters).toPandas()
    assert len(got) == odd.count()
    blank = got[got.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert len(blank) == 4 and blank.keep_id.eq(3).all() and blank.kept.sum() == 1
    same = got[got.text_sha256 == hashlib.sha256(b"plainwordsstandhereandgoon").hexdigest()]
    assert len(same) == 4 and same.keep_id.eq(5).all() and same[same.kept].doc_id.tolist() == [5]
    assert exact_dedup(none).count() == 0


@pytest.mark.parametrize("counters", [3, 64])
def test_exact_dedup_brute(spark, counters):
    rng = random.Random(5)
    rows = [(i, "hot  text" if rng.random() < 0.4 else f"t {rng.randrange(40)}" + " " * rng.randrange(3))
            for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(docs, counters=counters).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[ \t-\r]", "", t), []).append((-len(t), i))
    want = {i: (min(g)[1], len(g), min(g)[1] == i) for g in groups.values() for _, i in g}
    assert got == want


def test_misra_gries_keeps_frequent():
    rng = np.random.default_rng(1)
    stream = np.concatenate([np.full(300, 7), np.full(200, 8), rng.integers(100, 10_000, 500)])
    rng.shuffle(stream)
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in np.array_split(stream, 13):
        both, where = np.unique(np.concatenate([keys, part]), return_inverse=True)
        total = np.bincount(where, np.concatenate([counts, np.ones(len(part))])).astype(np.int64)
        keys, counts = merge_counts(both, total, 6)
        assert len(keys) <= 6
    assert {7, 8} <= set(keys.tolist())


def test_repeated_ids_keep_one_row(spark, odd):
    kept = keep_rows(odd, exact_dedup(odd).where("kept"), "doc_id", "text")
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids) == [3, 5, 6, 7, 8, 9]


def test_near_dedup_odd(spark, odd, none):
    got = near_dedup(odd).toPandas()
    got["kept"] = got.kept.astype(bool)
    assert len(got) == odd.count()
    empty = got[got.n_shingles == 0]
    assert len(empty) == 4 and empty.kept.all()
    plain = got[got.component_id == 4]
    assert len(plain) == 4 and plain.kept.sum() == 2
    assert got[got.doc_id == 7].n_shingles.tolist() == [1]
    assert set(got[got.doc_id.isin([6, 9])].component_id) == {6}
    assert near_dedup(none).count() == 0
    stay = sorted(str(r["doc_id"]) for r in near_dedup_survivors(odd).collect())
    assert stay == ["1", "2", "3", "4", "6", "7", "8", "None"]


def test_near_dedup_brute(spark):
    """Groups with edits of every size, chains, exact copies and short texts."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for size in (1, 3, 4, 5, 6, 9, 20, 60, 150):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(40 if size < 100 else 120):
            copy = list(base)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.3:
                base = copy
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else "\t".join(copy))
    rng.shuffle(texts)
    docs = pd.DataFrame({"doc_id": np.arange(len(texts)) * 3, "text": texts})
    got = near_dedup(spark.createDataFrame(docs).repartition(5)).toPandas().merge(near_brute(docs), on="doc_id")
    assert len(got) == len(docs)
    assert (got.n_shingles == got.want_n).all() and (got.component_id == got.want_component).all()


def test_bucket_of_many_unlinked(spark, monkeypatch):
    """Blocks smaller than a bucket still compare every pair."""
    import ratergrid.llm.near_dedup as N

    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "SKETCH_BLOCK", 32)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(80)]
    texts = []
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randrange(2, 7)):
            copy[rng.randrange(80)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    got = near_dedup(spark.createDataFrame(docs)).toPandas().merge(near_brute(docs), on="doc_id")
    assert (got.component_id == got.want_component).all() and got.component_id.nunique() > 3


def _sketched(rng, n, queries, sketches):
    """One block in which rows have the given sketches and components of their own."""
    import pyarrow as pa

    columns = {"_key": [1] * n, "_q": [0] * n, "_t": [0] * n, "_query": queries, "_node": list(range(n)),
               "_comp": list(range(n)), "_n": [100] * n}
    return pa.table({**columns, **{f"_s{i}": sketches[:, i] for i in range(4)}})


def test_block_of_unlike_sketches_is_dropped():
    """4,096 unlinked nodes of one bucket leave nothing for full sets; the fan-out before is two rows a node."""
    from ratergrid.llm.near_dedup import SKETCH_BLOCK, _candidates

    rng = np.random.default_rng(4)
    sketches = rng.integers(-2**63, 2**63, (4096, 4))
    both = _sketched(rng, 8192, [True] * 4096 + [False] * 4096, np.concatenate([sketches, sketches]))
    comp = np.tile(np.arange(4096), 2)
    both = both.set_column(both.schema.get_field_index("_comp"), "_comp", [comp])
    assert SKETCH_BLOCK >= 4096 and _candidates(both).num_rows == 0


def test_candidates_of_a_block_are_every_pair_of_like_sketches():
    from ratergrid.llm.near_dedup import BLOCK, LEAST_AGREEING, _candidates

    rng = np.random.default_rng(5)
    groups = rng.integers(-2**63, 2**63, (200, 4))
    sketches = groups[rng.integers(0, 200, 1500)].copy()
    for _ in range(20):  # up to 20 bits differ from the group's
        at = rng.integers(0, 4, 1500)
        sketches[np.arange(1500), at] ^= np.int64(1) << rng.integers(0, 63, 1500)
    queries = rng.random(1500) < 0.5
    got = _candidates(_sketched(rng, 1500, queries.tolist(), sketches)).to_pandas()
    met = set()
    for _, block in got.groupby("_part"):
        asks, others = block[block._query]._node, block[~block._query]._node
        assert len(asks) <= BLOCK and len(others) <= BLOCK
        met |= {(a, b) for a in asks for b in others}
    bits = np.unpackbits(sketches.view(np.uint8).reshape(1500, -1), axis=1)
    like = {(a, b) for a in np.flatnonzero(queries) for b in np.flatnonzero(~queries)
            if (bits[a] == bits[b]).sum() >= LEAST_AGREEING}
    assert like and like <= met and len(got) <= 3 * 1500


def test_circulant_signature_estimates_similarity():
    c = Circulant(size=1 << 16, length=256)
    a = mix64(np.arange(400, dtype=np.uint64))
    b = mix64(np.arange(60, 460, dtype=np.uint64))
    agree = (c.signature(a) == c.signature(b)).mean()
    assert abs(agree - 340 / 460) < 0.1


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 140)] + [(200, 150), (150, 149)]
    df = spark.createDataFrame(links, "_a long, _b long")
    nodes = spark.createDataFrame([(n,) for n in sorted({x for e in links for x in e} | {999})], "_node long")
    got = {r["_node"]: r["_comp"] for r in compose(nodes, connect(df)).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[x] for x in range(100, 140)} == {100}
    assert got[200] == got[150] == 149 and got[999] == 999


def test_text_ids_with_frequent_digests(spark):
    rows = [(f"a{i:03d}", "same words" if i % 2 else f"text {i}") for i in range(60)] + [(None, "same  words"), ("b", None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {(r["doc_id"], r["group_size"]): r for r in exact_dedup(df, counters=4).collect()}
    assert got[None, 31]["kept"] and got["a001", 31]["keep_id"] is None  # the longest as written stays, whatever its id
    same = spark.createDataFrame([r for r in rows if r[1] == "same words"] + [(None, "same words")], "doc_id string, text string")
    kept = [r for r in exact_dedup(same, counters=4).collect() if r["kept"]]
    assert [r["doc_id"] for r in kept] == ["a001"] and kept[0]["group_size"] == 31


@pytest.mark.parametrize("order", ["rising", "shuffled"])
def test_long_chains_take_few_rounds(spark, monkeypatch, order):
    import ratergrid.llm.components as C

    written = []
    keep = C.stored
    monkeypatch.setattr(C, "stored", lambda df, label: (written.append(label), keep(df, label))[1])
    names = list(range(2048))
    if order == "shuffled":
        random.Random(2).shuffle(names)
    df = spark.createDataFrame(list(zip(names, names[1:])), "_a long, _b long")
    maps = connect(df)
    nodes = spark.createDataFrame([(n,) for n in names], "_node long")
    assert {r["_comp"] for r in compose(nodes, maps).collect()} == {0}
    assert len(maps) <= 8 and written.count("jump") <= (13 if order == "rising" else 30)
