"""The grouped prefix join against brute force."""

import random
import re

from pairloom.llm.components import components
from pairloom.llm.jaccard import near_duplicates


def brute(texts, ids, k=5):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    out = []
    for i, s in enumerate(sets):
        same = [ids[j] for j in range(len(sets)) if root(j) == root(i) and ids[j] is not None]
        out.append((ids[i], len(s), min(same) if same and s else ids[i]))
    return out


def documents(seed):
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(3000)}é" for _ in range(n)]
    texts = [None, "", " \t\n", "one two", "One two", "one two three four five", "ONE two three four five"]
    passage = words(30)
    for _ in range(25):
        texts.append(" ".join(words(rng.randrange(2, 60)) + passage))
    for size in (60, 300):
        base = words(size)
        for _ in range(40):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = words(1)
            texts.append(" ".join(copy))
    chain = words(100)
    for i in range(12):  # neighbours link, the ends do not
        texts.append("  ".join(chain[i * 6 :] + [f"c{j}" for j in range(i * 6)]))
    return texts + texts[:20]


def test_matches_brute_force(spark):
    for seed in (1, 2):
        texts = documents(seed)
        ids = [None if i % 17 == 0 else (i * 7) % 251 for i in range(len(texts))]
        df = spark.createDataFrame(list(zip(ids, texts, texts)), "doc_id long, text string, node string").repartition(4)
        got = near_duplicates(df).select("id", "n", "component").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(brute(texts, ids), key=repr)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(200, 260)] + [(259, 300), (7, 7)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    got = dict(map(tuple, components(df).collect()))
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in [*range(200, 260), 300]}}
