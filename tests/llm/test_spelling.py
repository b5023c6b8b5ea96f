import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from ratergrid.llm.spelling import (SPELLING_SQL, letter_runs, near_words, spelling_forms, spelling_report, vocabulary)

DOCS = "doc_id long, text string"


def variants(word, letters):
    """All strings one edit away."""
    for i in range(len(word) + 1):
        for c in letters:
            yield word[:i] + c + word[i:]
            yield word[:i] + c + word[i + 1:]
        yield word[:i] + word[i + 1:]


def near_brute(words):
    letters, known = set("".join(words)), set(words)
    return {frozenset((w, v)) for w in words for v in variants(w, letters) if v in known and v != w}


def report_brute(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: [] for w in n}
    for pair in near_brute(list(n)):
        a, b = pair
        near[a].append(b)
        near[b].append(a)
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def words_df(spark, words):
    return spark.createDataFrame([(w, 1) for w in words], "word string, n long")


@pytest.mark.parametrize("small_group", [1, 4, 10_000])
def test_near_words_against_all_edits(spark, small_group):
    rng = random.Random(small_group)
    words = {"".join(rng.choice("abß") for _ in range(rng.randrange(7, 11))) for _ in range(250)}
    words |= {"aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aab" * 3, "ab" * 4, "ab" * 4 + "a"}
    got = [frozenset(r) for r in near_words(words_df(spark, words), small_group).collect()]
    assert len(got) == len(set(got)) and set(got) == near_brute(list(words))


def test_a_beginning_that_all_words_share_makes_few_candidates(spark, monkeypatch):
    from ratergrid.llm import spelling

    rng = random.Random(3)
    words = {"interchange" + "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(11)) for _ in range(3000)}
    words |= {w[:15] + "z" + w[16:] for w in sorted(words)[:50]}
    widths = []
    keep = spelling._verified
    monkeypatch.setattr(spelling, "_verified", lambda met: (widths.append(met.groupBy("_key").count().selectExpr(
        "sum(count * count) AS n").first()["n"] or 0), keep(met))[1])
    got = {frozenset(r) for r in near_words(words_df(spark, words)).collect()}
    assert got == near_brute(list(words)) and len(got) >= 50
    assert sum(widths) < 60 * len(words)


def made_docs():
    rng = random.Random(8)
    base = ["thousand", "Straße-Übergang", "naïveté", "ÀÉÎÕÜß×÷", "repeating", "lettering", "Mississippi", "wonderful"]
    docs = [(i, " ".join(rng.choice(base) + rng.choice(["", "", "s", ".", "1"]) for _ in range(60))) for i in range(120)]
    odd = [(None, "wonderful wonderful"), (None, None), (900, ""), (901, None), (3, docs[3][1]), (902, "x" * 5000 + " " + "x" * 5000),
           (906, ("x" * 4999 + " ") * 2), (904, "Interesting " * 40 + "Interestin Interestin nteresting nteresting")]
    return docs + odd


def test_report_against_brute_force_and_sql(spark):
    docs = made_docs()
    got = spelling_report(spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS word", "2 AS n", "'x' AS run").repartition(5))
    rows = {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got.collect()}
    assert rows == report_brute(docs)
    assert any(r[1] and r[1] == r[2] for r in rows) and any(len(r[0]) > 4000 and r[4] == 1 for r in rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    assert set(con.execute(f"SELECT word, form, root, n, n_near, form_n FROM ({SPELLING_SQL})").fetchall()) == rows


def test_forms_are_followed_to_the_last_and_ties_go_to_the_smallest(spark):
    rows = [("abcdefga", 3), ("abcdefgb", 30), ("abcdefgbc", 300), ("abcdefgbcd", 3000), ("abcdefgbd", 300), ("zzzzzzzz", 5)]
    df = spark.createDataFrame(rows, "word string, n long").selectExpr("*", "9 AS form", "8 AS root")
    got = {r["word"]: (r["form"], r["root"]) for r in spelling_forms(df).collect()}
    assert got["abcdefga"] == ("abcdefgb", "abcdefgbcd") and got["abcdefgb"] == ("abcdefgbc", "abcdefgbcd")
    assert got["abcdefgbd"] == ("abcdefgbcd", "abcdefgbcd") and got["zzzzzzzz"] == (None, "zzzzzzzz")


def test_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert letter_runs(none).count() == 0 and spelling_forms(vocabulary(letter_runs(none))).count() == 0
    assert spelling_report(none).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    with pytest.raises(ValueError, match="factor"):
        spelling_forms(none.selectExpr("text AS word", "doc_id AS n"), factor=1)
