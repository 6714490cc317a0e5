"""Mixing: targets, what each source takes, positions; null sources, empty texts and tables."""

import random

import pytest

from pairloom.llm import mixing as mx


def brute_targets(sizes):
    """Share by weight, cut at twice the size, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        for s in full or open_:
            out[s] = 2.0 * sizes[s] if full else level * weight[s]
        if not full:
            break
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def documents(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        source = rng.choice(["b", "a", "a", "a", "é", "Z", None, "tiny" if i % 50 == 0 else "a"])
        rows.append((None if i % 40 == 0 else i % 300, None if i % 33 == 0 else "w " * rng.randrange(30), source))
    return rows + [(1, "", "empty")]


def test_targets_and_taken(spark):
    rows = documents(1)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, size string").repartition(5)
    got = mx.curriculum(df.drop("size")).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = brute_targets(sizes)
    for source, size in sizes.items():
        mine = [r for r in got if r.source == source]
        assert all(r.source_size == size and r.target == pytest.approx(want[source]) for r in mine)
        assert sum(r.taken for r in mine) == int(want[source] + 1e-9)
    assert all(0 <= r.taken <= 2 * r.size and len(r.positions) == (-(-r.taken // r.size) if r.size else 0) for r in got)
    assert all(0 <= p <= 1 for r in got for p in r.positions)
    again = mx.curriculum(df.drop("size").repartition(2)).collect()
    key = lambda r: repr((r.doc_id, r.source, r.size, r.taken, r.positions))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_order_follows_the_schedules(spark):
    rows = [(i, "w " * 10, "abc"[i % 3]) for i in range(900)]
    mixed = mx.curriculum(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    order = mx.training_order(mixed.drop("text")).collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    assert sum(r.words for r in order) == sum(r.taken for r in mixed.collect())
    # The first source fades, the third one grows: at time u they have had start * u + (end - start) * u * u / 2.
    for source, start, end in (("a", 1.5, 0.5), ("b", 1.0, 1.0), ("c", 0.5, 1.5)):
        mine = [r for r in order if r.source == source]
        early = sum(r.words for r in mine if r.position < 0.5) / sum(r.words for r in mine)
        assert early == pytest.approx(start * 0.5 + (end - start) * 0.125, abs=0.02)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mx.curriculum(df).count() == 0
    only = spark.createDataFrame([(1, None, None), (2, "", None)], "doc_id long, text string, source string")
    assert {(r.size, r.taken, r.target) for r in mx.curriculum(only).collect()} == {(0, 0, 0.0)}


def test_documents_in_training_order(spark):
    rows = documents(2) + [(7, "", "b")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    mixed = mx.curriculum(df).drop("text")
    got = mx.first_positions(mixed).collect()
    firsts = [r.first_position for r in got]
    assert firsts == sorted(firsts, key=lambda p: (p is None, p or 0)) and None in firsts
    key = lambda *row: repr(row)
    want = [key(r.doc_id, r.source, r.size, r.taken, r.positions[0] if r.positions else None) for r in mixed.collect()]
    assert any(r.taken > r.size for r in got)
    assert sorted(key(r.doc_id, r.source, r.size, r.taken, r.first_position) for r in got) == sorted(want)
