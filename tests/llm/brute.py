"""Brute-force versions that the operators are held against."""

import pandas as pd


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near_brute(docs: pd.DataFrame) -> pd.DataFrame:
    sets = [shingles(t) for t in docs.text]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(docs.doc_id):
        least[root(i)] = min(least.get(root(i), d), d)
    return pd.DataFrame({"doc_id": docs.doc_id, "want_n": [len(s) for s in sets],
                         "want_component": [least[root(i)] for i in range(len(sets))]})
