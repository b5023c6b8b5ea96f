import hashlib
import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from ratergrid.llm.personal_data import FAST, KINDS, PERSONAL_DATA_SQL, personal_data_report, scan_personal_data
from ratergrid.llm.spans import with_places, with_running_totals

DOCS = "doc_id long, text string"
PIECES = ["a.b@c.de", "x@y", "a@b.c_d@e.fg", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "010.0001.1.255", "4111 1111 1111 1111",
          "4111-1111-1111-1112", "4785380592391139", "4785380592391139 4785380592391139", "7", "12 34", "+1 (555) 555-0100", "+12", "+1234567890123456",
          "+49 30 1234567-", "+1+1+1", "words", "é漢🙂", ".", "a.@b..c", "%%@a-b.c-", "\n", "1..2.3.4", "00 00 00 00 00 00 00 00"]


def luhn(digits):
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def base_brute(text):
    spans = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                    "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                spans.append((k, m.start(), m.end(), m[0]))
    return spans


def sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    result = con.execute(PERSONAL_DATA_SQL)
    return {r[0]: dict(zip([d[0] for d in result.description], r)) for r in result.fetchall()}


@pytest.fixture(scope="module")
def corpus():
    """Random pieces, and texts in which cue words stand before seeds and before identifiers of no kind."""
    rng = random.Random(4)
    rows = [(i, rng.choice([" ", "", ",", "  "]).join(rng.choice(PIECES) for _ in range(rng.randrange(14)))) for i in range(300)]
    plain = ["the", "was", "on", "time", "at"]
    for i in range(300, 400):
        words = [rng.choice(plain) for _ in range(20)]
        number = f"{rng.randrange(10**6, 10**7)}"
        phone = rng.choice([f"+1 555 {number}", f"+1 555 {number}", f"0171 {number[:3]} {number[3:]}", f"({number[:3]}) {number}"])
        words[rng.randrange(20)] = f"Mobile: {phone}."
        if i % 3 == 0:
            words[rng.randrange(20)] = f"reach me at {rng.choice(plain)}{i}@{rng.choice(['host', 'mail.example.org', 'mail.example.org'])}"
        if i % 4 == 0:
            words[rng.randrange(20)] = f"the {rng.randrange(10**6, 10**7)}"
        if i % 5 == 0:
            words[rng.randrange(20)] = f"cell {phone}"
        rows.append((i, " ".join(words)))
    return rows + [(400, None), (401, ""), (402, " \n"), (403, "x" * 20_000 + " a@b.cd " + "9" * 20_000 + " " + "1 " * 3000)]


def test_base_spans_against_python_and_all_against_sql(spark, corpus):
    df = spark.createDataFrame(corpus, DOCS).repartition(4)
    scanned = {r["doc_id"]: r for r in scan_personal_data(df).collect()}
    got = {r["doc_id"]: r.asDict() for r in personal_data_report(df).collect()}
    assert got == sql(corpus)
    for doc, text in corpus:
        want = base_brute(text)
        assert [tuple(s) for s in scanned[doc]["base"]] == want
        listed = ",".join(f"{list(KINDS)[k]}:{a}:{b}" for k, a, b, _ in want)
        assert got[doc]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(want) <= {tuple(s) for s in scanned[doc]["spans"]}
        assert sorted(scanned[doc]["spans"]) == scanned[doc]["spans"]
        for s in scanned[doc]["spans"]:
            assert text[s["start"]:s["end"]] == s["value"]


def test_contexts_find_identifiers_of_no_pattern(spark, corpus):
    found = {r["doc_id"]: {(s["kind"], s["value"]) for s in r["spans"]} - {(s["kind"], s["value"]) for s in r["base"]}
             for r in scan_personal_data(spark.createDataFrame(corpus, DOCS)).collect()}
    local = {doc for doc, text in corpus if re.search(r"Mobile: [0(]", text or "")}
    hosts = {doc for doc, text in corpus if re.search(r"reach me at \w+@host", text or "")}
    assert len(local) > 20 and len(hosts) > 5
    assert all(any(k == 3 for k, _ in found[doc]) for doc in local)
    assert all(any(k == 0 and v.endswith("@host") for k, v in found[doc]) for doc in hosts)
    for doc, text in corpus:  # numbers after a common word are left alone
        for number in re.findall(r"the (\d{7})\b", text or ""):
            assert number not in {v for _, v in found[doc]}


def test_clean_texts_are_left_alone(spark):
    rows = [(i, f"chapter {i} has {i * 1000} words and part {100000 + i} of 123456 at 12:30") for i in range(50)]
    rows += [(100 + i, f"see the +1 555 000-{1000 + i} now") for i in range(3)]
    assert all(not r["n_learned"] for r in scan_personal_data(spark.createDataFrame(rows, DOCS)).collect())


@pytest.mark.parametrize("kind", list(KINDS))
def test_patterns_that_never_go_back_match_the_same(spark, kind):
    rng = random.Random(kind)
    alphabet = "a1.@+- (_%"
    rows = [("".join(rng.choice(alphabet) for _ in range(rng.randrange(40))),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "text string")
    got = df.select("text", F.regexp_extract_all("text", F.lit(FAST[kind]), F.lit(0)).alias("v")).collect()
    for r in got:
        assert r["v"] == [m[0] for m in re.finditer(KINDS[kind], r["text"])]


def test_very_many_hits_and_very_long_words(spark):
    texts = [" ".join(f"u{i}@h.de" for i in range(100_000)), "a" * 1_000_000, "1" * 1_000_000, "1." * 300_000, "1 " * 300_000, "+1" * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(4).cache()
    df.count()
    start = time.perf_counter()
    got = {r["doc_id"]: r for r in personal_data_report(df).select("doc_id", "n_email", "n_ip").collect()}
    assert got[0]["n_email"] == 100_000 and got[3]["n_ip"] == 75_000
    assert time.perf_counter() - start < 60
    df.unpersist()


def test_running_totals(spark):
    rng = random.Random(1)
    rows = [([rng.randrange(9) for _ in range(n)],) for n in (0, 1, 127, 128, 129, 256, 1000)] + [(None,)]
    for r in with_running_totals(spark.createDataFrame(rows, "a array<bigint>"), "t", F.col("a")).collect():
        assert r["t"] == (None if r["a"] is None else [sum(r["a"][:i + 1]) for i in range(len(r["a"]))])
    one = with_places(spark.createDataFrame([("xaé🙂aab",)], "t string"), "p", F.col("t"), "a+", gaps=True).first()["p"]
    assert [tuple(p) for p in one] == [(1, 2, "a", "x"), (4, 6, "aa", "é🙂")]


def test_odd_rows(odd, none):
    got = scan_personal_data(odd).collect()
    assert len(got) == odd.count() and not any(r["spans"] for r in got)
    assert scan_personal_data(none).count() == 0
