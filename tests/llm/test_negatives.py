"""Hard negatives against brute force; the tree's bounds."""

import math

import numpy as np
import pytest

import pairloom.llm.negatives as ng

NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, positives=5, negatives=10, every=100):
    kept = set()
    for i, v, label in rows:
        if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v):
            kept.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)))
    score = lambda a, b: sum(p * q for p, q in zip(a[2], b[2]))
    out = []
    for a in kept:
        if a[0] % every == 0:
            ranked = sorted((-score(a, b), b[0], b) for b in kept if b != a)
            for p, pid, _ in [r for r in ranked if r[2][1] == a[1]][:positives]:
                fits = [(n, nid) for n, nid, b in ranked if b[1] != a[1] and 30 * -p <= 100 * -n <= 90 * -p]
                out += [(a[0], pid, k + 1, nid, -p, -n) for k, (n, nid) in enumerate(fits[:negatives])]
    return sorted(out)


def check(spark, rows, **options):
    schema = "vec_id long, embedding array<double>, label int, pack int, cells string"
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], schema).repartition(3)
    got = ng.hard_negatives(df, **options)
    assert got.columns == NAMES
    rows = sorted(map(tuple, got.collect()))
    assert rows == brute([r[:3] for r in df.collect()], **options)
    return rows


@pytest.fixture
def small_tree(monkeypatch):
    monkeypatch.setattr(ng, "LEAF", 40)
    monkeypatch.setattr(ng, "BLOCK_CELLS", 16 * 30)
    monkeypatch.setattr(ng, "PACK", 7)


def clustered(rng, n, dims=6):
    centres = rng.standard_normal((12, dims)) * 2
    return [(i, (centres[i % 12] + 0.2 * rng.standard_normal(dims)).tolist(), int(rng.integers(0, 4))) for i in range(n)]


def test_against_brute_force(spark, small_tree):
    rng = np.random.default_rng(8)
    assert check(spark, clustered(rng, 900), every=20)
    flat = [(i, rng.standard_normal(16).tolist(), int(rng.integers(0, 10))) for i in range(500)]
    assert check(spark, flat, every=10)


def test_odd_rows(spark, small_tree):
    rng = np.random.default_rng(9)
    rows = clustered(rng, 150)
    rows += [(1000 + i, rows[0][1], 0) for i in range(60)] + [(2000 + i, rows[0][1], 1 + i % 3) for i in range(60)]  # copies, ties
    rows += [(3000, None, 1), (3100, [None] * 6, 1), (3200, [1.0] * 6, None), (None, [1.0] * 6, 1), (3300, [float("nan")] * 6, 1)]
    rows += [(3400, [float("-inf")] * 6, 1), (3500, [0.0] * 6, 2), (3600, [], 2), (3700, [1.0, 2.0], 2), (3701, [1.0, 2.0, 0.5] * 4, 2)]
    rows += [rows[100], rows[100], (100, [0.3] * 6, 3), (100, rows[100][1], 2), (0, rows[0][1], rows[0][2]), (-100, [-1.0] * 6, -4)]
    assert check(spark, rows, every=50)


def test_empty_and_small(spark):
    assert check(spark, []) == []
    assert check(spark, [(0, [1.0, 0.0], 1)]) == []
    assert check(spark, [(100, [], 1), (101, [], 1), (102, [], 3)]) == [(100, 101, 1, 102, 0, 0)]


def test_rings_leave_leaves_out(spark, small_tree):
    rng = np.random.default_rng(10)
    rows = clustered(rng, 900)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    points = ng.integer_rows(df).selectExpr("label", "cells", "array(id) AS ids")
    points = points.mapInArrow(ng._with_norm, "label int, cells binary, ids array<long>, norm double").cache()
    tree = ng.plant(points)
    blocks = ng.pack_blocks(points, tree)
    ng.measure(blocks, tree)
    x = ng.matrix([bytes(r.cells) for r in points.collect()], tree.width)
    leaves = tree.leaves(ng.lift(x, tree.largest))
    assert len(set(leaves.tolist())) > 8
    visited = 0
    scores = x[:40] @ x.T
    for low, high in ((0.9, 1.0), (0.3, 0.6), (-0.2, 0.1)):
        most = scores.max(axis=1)
        windows = np.stack((np.ceil(low * most), np.floor(high * most)), axis=1)[:, None, :]
        reached = tree.reached(x[:40], windows)
        for i in range(40):
            inside = (scores[i] >= windows[i, 0, 0]) & (scores[i] <= windows[i, 0, 1])
            going = {leaf for leaf, some in reached.items() if i in some}
            assert set(leaves[inside].tolist()) <= going  # nothing is lost
            visited += len(going)
    assert visited < 0.5 * 120 * len(set(leaves.tolist()))
    points.unpersist()
