import random

import pytest

from ratergrid.llm.common import WordCache, drop_rows
from ratergrid.llm.decontamination import contamination, windows, word_code

WORDS = "river stone cloud ember field glass harbor lantern meadow orchard pebble quarry saddle timber valley".split()


def found(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): (r["coverage"], r["verbatim"]) for r in contamination(d, b, **more).collect()}


def test_other_values_are_caught_and_inconsistent_ones_not(spark):
    item = "A train leaves the station and Maria pays 12 dollars for 3 tickets while Maria keeps 12 dollars in her pocket."
    same = item.replace("Maria", "Otto").replace("12", "45").replace(" 3 ", " 7 ").replace("dollars", "euros")
    torn = item.replace("Maria pays 12", "Otto pays 45").replace("Maria keeps 12", "Anna keeps 99")
    docs = [(1, f"Some words before this. {item} And behind it."), (2, f"Before.\n{same}"), (3, f"Before. {torn}"),
            (4, "A train leaves the station and nobody pays.")]
    got = found(spark, docs, [(7, item)])
    assert got[1, 7] == (1.0, True) and got[2, 7] == (1.0, False)
    assert (3, 7) not in got and (4, 7) not in got


def test_placeholders_alone_do_not_match(spark):
    got = found(spark, [(1, "10 20 30 40 50 60 70"), (2, "1 2 3 4 5 6 7")], [(1, "1 2 3 4 5 6 7")])
    assert list(got) == [(2, 1)]


def test_brute_force(spark):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(6, 25)))) for i in range(30)]
    docs = []
    for i in range(200):
        text = [rng.choice(WORDS) for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.4:
            part = rng.choice(items)[1].split()
            for _ in range(rng.randrange(3)):
                part[rng.randrange(len(part))] = rng.choice(WORDS)
            at = rng.randrange(len(text) + 1)
            text[at:at] = part * rng.choice([1, 1, 2])
        docs.append((i, " ".join(text)))
    want = {}
    grams = lambda t: [tuple(w[i:i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))] if t else []
    for d, text in docs:
        have = set(grams(text))
        for i, item in items:
            share = sum(g in have for g in grams(item)) / len(grams(item))
            if share >= 0.75:
                want[d, i] = share
    got = found(spark, docs, items)
    assert {k: v[0] for k, v in got.items()} == pytest.approx(want)


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "plain words stand here and go on"), (2, None), (3, ""), (None, "x")],
                                  "item_id long, text string")
    got = contamination(odd, bench)
    assert sorted(str(r["doc_id"]) for r in got.where("item_id = 1").collect()) == ["4", "4", "5", "None"]
    assert [r["doc_id"] for r in got.where("item_id IS NULL").collect()] == [7]
    left = drop_rows(odd, got, "doc_id", "text")
    assert left.columns == odd.columns and left.count() == odd.count() - 5
    assert contamination(none, bench).count() == 0 and contamination(odd, bench.limit(0)).count() == 0


def test_windows_of_short_texts():
    w = WordCache(word_code)
    assert [len(windows(t, w)[0]) for t in ("", "...", "one", "one two three four", "a b c d e f")] == [0, 0, 1, 1, 2]
    assert windows("one two", w)[0][0] != windows("one two three", w)[0][0]


def test_names_that_open_sentences_and_short_items(spark):
    apples = "Tom has 3 apples. Tom buys 4 more apples. Tom gives 2 apples to Jane. How many apples does Tom have?"
    france, two = "What is the capital of France?", "Who wrote Hamlet?"
    docs = [(1, "Quiz.\n" + apples.replace("Tom", "Mia")), (2, f"Quiz night\n{france}"), (3, f"Quiz night\n{france} Paris, of course."),
            (4, f"Here we ask. {two} Nobody knows."), (5, two), (6, "Who wrote Macbeth, and who wrote that it was Hamlet?")]
    got = found(spark, docs, [(1, apples), (2, france), (3, two)])
    assert got == {(1, 1): (1.0, False), (2, 2): (1.0, True), (3, 2): (1.0, True), (4, 3): (1.0, True), (5, 3): (1.0, True)}


def test_a_conflict_costs_only_its_windows(spark):
    plain = " ".join(f"{a} {b}" for a, b in zip(WORDS, reversed(WORDS)))
    twice, pair = f"{WORDS[0]} 12 {plain} and 12 remain", f"{WORDS[0]} with 3 {plain} until 5 remain"
    docs = [(1, twice.replace("and 12", "and 13")), (2, pair.replace(" 3 ", " 4 ").replace(" 5 ", " 4 "))]
    got = found(spark, docs, [(1, twice), (2, pair)])
    n, m = len(twice.split()) - 4, len(pair.split()) - 4
    assert (got[1, 1], got[2, 2]) == (((n - 2) / n, True), ((m - 5) / m, True))


def test_items_of_one_or_two_words_find_only_themselves(spark):
    docs = [(1, "The weather in Paris was fine, and New York was cold."), (2, "Paris"), (3, "New York."), (4, "York")]
    assert found(spark, docs, [(1, "Paris"), (2, "New York")]) == {(2, 1): (1.0, True), (3, 2): (1.0, True)}
    more = [(5, "So we fly to New York today.")]
    assert found(spark, docs + more, [(3, "fly to New York")]) == {(5, 3): (1.0, True)}
