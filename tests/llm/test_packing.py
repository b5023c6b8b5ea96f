import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from ratergrid.llm import packing
from ratergrid.llm.packing import CAPACITY, cut, pack_documents, piece_class
from ratergrid.llm.tokens import encoder

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def ids(data):
    return np.frombuffer(data, np.uint32).tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab é漢🙂1'.!\n\t\r\x1c\x85\xa0 <|>s ", "  ", " the", "'ll", "<|endoftext|>"]),
                max_size=40).map("".join))
def test_cached_encoding_is_exact(reference, text):
    assert ids(encoder().ids(text)) == reference(text)


def test_whole_prose(reference):
    rng = random.Random(1)
    text = " ".join(rng.choice(["Über", "naïve", "it's", "x1", "--", "end.", "a\nb", "12,5"]) for _ in range(5000))
    for t in (text, text.replace(" ", "  ", 3), " " + text + " ", "\n" + text):
        assert ids(encoder().ids(t)) == reference(t)


@given(st.integers(1, 5000))
def test_cuts_fill_their_slots(n):
    pieces = cut(n)
    assert sum(pieces) == n and max(pieces) <= CAPACITY
    for p in pieces[:-1]:
        assert p in (CAPACITY, CAPACITY // piece_class(p, CAPACITY))
    last = pieces[-1]
    assert CAPACITY // piece_class(last, CAPACITY) - last <= max(packing.SLACK, CAPACITY // packing.SMALL)


def checked(df, want, capacity=CAPACITY):
    got = df.toPandas()
    for key, group in got.groupby("doc_id"):
        group = group.sort_values("start")
        assert len(want[key]) > 1 or (group.length.cumsum() - group.length == group.start).all()
    total = sorted(tuple(ids(b"".join(g.sort_values("start").ids))) for k, g in got.groupby("doc_id") if len(want[k]) == 1)
    assert total == sorted(tuple(w[0]) for k, w in want.items() if len(w) == 1 and k is not None)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.length.cumsum() - s.length == s.offset).all() and s.length.sum() <= capacity
    assert (got.ids.map(len) == 4 * got.length).all()
    return got


def test_round_trip_over_many_workers(spark, reference, monkeypatch):
    """Three levels of workers that meet, also when their groups land in far apart partitions."""
    monkeypatch.setattr(packing, "FAN_IN", 3)
    plain = type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda self, n, *cols: plain(self, max(n, 40), *cols))
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "12", "x"]) for _ in range(int(rng.paretovariate(0.8)) * 60 % 4000)))
            for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(11)
    got = checked(pack_documents(df), {i: [reference(t) + [0]] for i, t in rows})
    used = got.groupby("sequence_id").length.sum()
    assert (CAPACITY * len(used) - used.sum()) / used.sum() < 0.04
    full = got.groupby("sequence_id").length.agg(["size", "min", "max"])
    same = full["min"].map(lambda n: piece_class(n, CAPACITY)) == full["max"].map(lambda n: piece_class(n, CAPACITY))
    assert (full["size"][same] <= full["max"][same].map(lambda n: piece_class(n, CAPACITY))).mean() > 0.9


def test_odd_rows(spark, reference, odd, none):
    want = {}
    for r in odd.collect():
        want.setdefault(r["doc_id"], []).append(reference(r["text"] or "") + [0])
    got = checked(pack_documents(odd), want)
    assert got.length.sum() == sum(len(w) for ws in want.values() for w in ws)
    assert got[got.doc_id == 1].doc_tokens.tolist() == [1]
    assert pack_documents(none).count() == 0


@pytest.fixture(scope="module")
def loaded():
    """The tokenizer as its file has it."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab é漢1'.!\n\t\x85\xa0 <|>s ", "  ", " the", "<|endoftext|>", " <|endoftext|>", "<|endoftext|"]),
                max_size=40).map("".join))
def test_marked_encoding_is_that_of_the_loaded_tokenizer(loaded, text):
    assert ids(encoder().marked_ids(text)) == loaded(text)


def test_packed_special_string_has_its_id(spark, loaded):
    text = "a <|endoftext|> b<|endoftext|>"
    assert loaded(text) == [64, 220, 50256, 275, 50256]
    got = pack_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert ids(got["ids"]) == [*loaded(text), 0] and got["doc_tokens"] == 6
