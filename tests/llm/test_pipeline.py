import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from brute import shingles  # noqa: E402


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(21)
    words = [a + b for a in "ba ke lo mi nu pe ra so ti vu".split() for b in "dan fer gul hin jor kas lem".split()]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bench = [(i, prose(25)) for i in range(8)]
    docs, labels, junk, leaks = [], [], set(), set()
    for i in range(400):
        text, draw = prose(rng.randrange(20, 200)), rng.random()
        if draw < 0.15:
            text = " ".join(f"{w}$$$" for w in text.split())
            junk.add(i)
        elif draw < 0.25:
            text += ". " + rng.choice(bench)[1] + "."
            leaks.add(i)
        elif draw < 0.35 and docs:
            text = docs[-1][1].replace(" ", "  ", 2)
        elif draw < 0.45 and docs:
            copy = docs[-1][1].split()
            copy[rng.randrange(len(copy))] = "changed"
            text = " ".join(copy)
        if i and draw >= 0.25 and draw < 0.45:
            for group in (junk, leaks):
                group.update({i} if i - 1 in group else ())
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(i not in junk), 0))
    docs += [(900, None, None, None, None), (901, "", None, None, 0), docs[0], (None, prose(50), "en", "s", 1)]
    sf = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumn(
        "kept", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1)).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    table = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    good = corpus_pipeline.quality(spark, table, sf)
    assert good.columns == table.columns
    accepted = {r["doc_id"]: r["text"] or "" for r in good.collect()}
    assert set(accepted) >= {d[0] for d in docs if d[0] is not None and d[0] < 400} - junk
    assert len(set(accepted) & junk) <= 2

    groups = {}
    for i, t in accepted.items():
        groups.setdefault("".join(t.split()), []).append((-len(t), i is None, i or 0, i))
    exact = {min(g)[3] for g in groups.values()}
    order = sorted(exact, key=lambda i: (i is None, i or 0))
    sets, parent = {i: shingles(accepted[i]) for i in order}, {i: i for i in order}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(order):
        for b in order[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)), key=lambda i: (i is None, i or 0))
                parent[y] = x
    near = {root(i) for i in order}
    clean = {i for i in near if not any(
        sum(g in sets[i] for g in shingles(t)) >= 0.75 * len(shingles(t)) for _, t in bench)}

    out = corpus_pipeline.run(spark, sf).toPandas()
    got = {None if i != i else int(i) for i in out.doc_id}
    assert got == clean
    assert out.groupby("doc_id").length.sum().eq(out.groupby("doc_id").doc_tokens.first()).all()
    assert out.groupby("sequence_id").length.sum().max() <= 1024


def test_pipeline_of_empty_tables(spark, tmp_path):
    sf = str(tmp_path)
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"),
                         ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{sf}/{name}.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
