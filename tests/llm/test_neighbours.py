"""Neighbours along Hilbert curves: the curve itself, exact small tables, recall on a larger one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm.neighbours import hilbert_keys, nearest, run_length


def brute(rows, top, every):
    kept = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in kept:
        if q % every == 0:
            scored = sorted((-float((x * y).sum()), i) for i, y in kept if i != q and len(y) == len(x))
            out[q] = [(i, -s) for s, i in scored[:top]]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (5, 2)])
def test_curve_visits_neighbouring_cells(dims, bits):
    side = np.arange(1 << bits)
    cells = np.stack(np.meshgrid(*[side] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_small_table_is_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(12) * rng.random()).tolist()) for i in range(180)]
    rows += [(200 + i, rows[0][1]) for i in range(45)]  # copies: ties by id
    rows += [(300, None), (320, [0.0] * 12), (340, [None] + [1.0] * 11), (360, [float("nan")] * 12), (380, [float("inf")] * 12)]
    rows += [(None, [1.0] * 12), (400, []), (420, [1.0, 2.0]), (421, [2.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    got, want = result(nearest(df)), brute(rows, 20, 20)
    assert {q: [i for i, _ in found] for q, found in got.items()} == {q: [i for i, _ in f] for q, f in want.items() if f}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in got for a, b in zip(got[q], want[q], strict=True))
    assert nearest(df.limit(0)).count() == 0


def test_recall(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(32).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = result(nearest(df, run=128, curves=20)), brute(rows, 20, 20)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9


def test_runs_follow_the_table(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, 20, 100)

    def recall(**sizes):
        got = result(nearest(df, every=100, curves=10, run=16, group=4, **sizes))
        return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))

    # Fixed runs miss most neighbours of a table this size; runs that grow with it, over many blocks, find them.
    assert recall(points_of_run=6000) < 0.6
    assert recall(points_of_run=300) >= 0.9
    grown = spark.createDataFrame([(n,) for n in (0, 51_200, 512_000)], "n long").select(run_length(F.col("n")).alias("run"))
    assert [r.run for r in grown.collect()] == [1024, 1024, 9127]
