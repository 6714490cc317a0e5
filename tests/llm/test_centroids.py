"""Clusters against a plain recomputation in Python integers."""

import hashlib
import math

import numpy as np
import pytest

from pairloom.llm.centroids import Bisectors, cluster

NAMES = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def brute(rows, count=8, rounds=10, dims=4, scale=1024, seed=3):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in kept]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:count]]
    gap = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    nearest = lambda x: min(range(len(centroids)), key=lambda c: (gap(x, centroids[c]), c))
    for _ in range(rounds):
        parts = [[x for _, x in kept if nearest(x) == c] for c in range(len(centroids))]
        centroids = [[sum(e) // len(p) for e in zip(*p)] if p else c for p, c in zip(parts, centroids)]
    found = [(i, nearest(x), gap(x, centroids[nearest(x)])) for i, x in kept]
    total = lambda c: sum(d for _, k, d in found if c is None or k == c)
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return [(i, c, d, total(c), total(None), digest(c)) for i, c, d in found]


def check(spark, rows, **sizes):
    # Extra columns carry the names of results.
    df = spark.createDataFrame([(i, v, "x", 7) for i, v in rows], "vec_id long, embedding array<double>, cluster string, ids int")
    got = cluster(df.repartition(3), dims=4, **sizes)
    assert got.columns == NAMES
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, **sizes), key=key)


def test_against_plain_arithmetic(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(4) + 3 * (i % 5)).tolist()) for i in range(150)]
    check(spark, rows)
    check(spark, rows, count=3, rounds=2)


def test_ties_copies_and_odd_rows(spark):
    grid = [(i, [float(i % 3), float(i % 2), 0.0, -0.5]) for i in range(60)]  # many equal distances
    odd = [(100, None), (101, []), (102, [1.0] * 3), (103, [1.0] * 5), (104, [1.0, None, 1.0, 1.0])]
    odd += [(105, [float("nan")] * 4), (106, [float("inf")] * 4), (None, [1.0, 1.0, 1.0, 1.0]), (7, [5.0] * 4), (7, [5.0] * 4), (7, [4.0] * 4)]
    check(spark, grid + odd)
    check(spark, grid[:3] + [(None, [2.0] * 4)])  # fewer vectors than centroids
    check(spark, [(i, [1.0] * 4) for i in range(20)])  # clusters that stay empty
    check(spark, [(1, None)])
    check(spark, [])


def test_tournament_is_exact_beyond_doubles():
    rng = np.random.default_rng(2)
    for large in (1 << 10, 1 << 26):
        c = rng.integers(-large, large, (6, 8))
        x = np.concatenate((rng.integers(-large, large, (300, 8)), (c[0] + c[1])[None] // 2, c))
        best, distance = Bisectors(c).assign(x)
        for row, b, d in zip(x.tolist(), best.tolist(), distance.tolist()):
            gaps = [sum((p - q) ** 2 for p, q in zip(row, z)) for z in c.tolist()]
            assert d == min(gaps) and b == gaps.index(d)


def test_too_large(spark):
    df = spark.createDataFrame([(1, [1e30] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        cluster(df, dims=4)
