"""Repeated strings against brute force."""

import hashlib
import random

from pairloom.llm.repeats import difference_set, remove_repeats


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def documents(seed, length):
    rng = random.Random(seed)
    words = lambda n: "".join(rng.choice(["ab", "é", "xyz ", "q\n", "漢"]) for _ in range(n))
    base, passage = words(400), words(60)
    texts = [None, "", "short", base, base, base[:300] + "!" + base[300:], "a" * (2 * length), "ab" * length]
    for _ in range(12):
        at = rng.randrange(len(base))
        texts.append(words(rng.randrange(80)) + base[at : at + rng.randrange(200)] + words(rng.randrange(50)))
        texts.append(words(rng.randrange(30)) + passage + words(rng.randrange(30)))
    texts += [base[5:], passage + passage, words(3000), base + base]
    return texts


def test_difference_sets():
    for q in (2, 3, 5, 7, 11):
        v, d = difference_set(q)
        assert v == q * q + q + 1 and {(i - j) % v for i in d for j in d} == set(range(v))


def test_matches_brute_force(spark):
    for seed, length, order in ((1, 60, 5), (2, 60, 2), (3, 150, 11)):
        texts = documents(seed, length)
        rows = [(i if i % 5 else None, t, "x") for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(3)
        got = remove_repeats(df, length, order).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert sorted(map(tuple, got)) == sorted(brute(texts, length))


def test_whole_length_and_empty(spark):
    texts = documents(4, 400)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = remove_repeats(df).orderBy("id").select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert list(map(tuple, got)) == brute(texts, 400)
    assert remove_repeats(df.limit(0)).count() == 0
