import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions import vectors as vf
from pairloom.operators import blocks, stretches
from pairloom.operators import vectors as vec
from pairloom.operators.blocks import batch_products


def frame(spark, **columns):
    names = list(columns)
    rows = list(zip(*[[v.tolist() if hasattr(v, "tolist") else v for v in columns[n]] for n in names]))
    return spark.createDataFrame(rows, names)


@pytest.fixture
def rng():
    return np.random.default_rng(3)


def unit(rng, n, d):
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r[0] for r in df.select(vf.l2_normalize("v")).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_dot_and_guided(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 0.0, 1.0])], "c array<double>, u array<double>")
    row = df.select(vf.dot("c", "u").alias("d"), vf.guided("c", "u", 2.0, 2).alias("g")).first()
    assert row.d == 4.0 and row.g == [1.0, 4.0, 3.0]


def test_sinusoidal(spark):
    df = spark.createDataFrame([(5.0,)], "t double")
    row = df.select(
        vf.sinusoidal("t", 5).alias("odd"), vf.sinusoidal("t", 4, order="sin_cos").alias("pos")
    ).first()
    rates = np.exp(-np.log(10000) * np.arange(2) / 2)
    assert np.allclose(row.odd, [*np.cos(5 * rates), *np.sin(5 * rates), 0])
    assert np.allclose(row.pos, [*np.sin(5 * rates), *np.cos(5 * rates)])
    with pytest.raises(ValueError):
        vf.sinusoidal("t", 5, order="sin_cos")


def test_batch_products(spark, rng):
    x, y = rng.normal(size=(10, 3)), rng.normal(size=(10, 3))
    df = frame(spark, i=list(range(10)), b=[i // 4 for i in range(10)], x=x, y=y)
    for r in batch_products(df, ["b"], "i", "x", "y").collect():
        members = [i for i in range(10) if i // 4 == r.b]
        assert members[r.member] == r.i
        assert np.allclose(r.products, [x[r.i] @ y[j] for j in members])


def test_top_k_ties_go_to_the_lower_place(spark):
    df = spark.createDataFrame([([0.5, 0.9, 0.9 + 1e-12, 0.1],)], "s array<double>")
    row = df.select(vec.top_k("s", 2).alias("top"), vec.top_k("s", 9, largest=False).alias("low")).first()
    assert [t.place for t in row.top] == [1, 2] and [t.place for t in row.low] == [3, 0, 1, 2]


def test_soft_targets(spark, rng):
    s = rng.normal(size=6)
    df = spark.createDataFrame([(s.tolist(), 2)], "s array<double>, own int")
    got = np.array(df.select(vec.soft_targets("s", "own", 0.2, 0.4)).first()[0])
    p = np.exp(s / 0.2) / np.exp(s / 0.2).sum()
    assert np.allclose(got, 0.4 * p + 0.6 * (np.arange(6) == 2)) and abs(got.sum() - 1) < 1e-12


def test_alpha_ramp_and_temperature():
    assert vec.ramp_alpha(0.4, 0, 5, 10) == 0.2 and vec.ramp_alpha(0.4, 0, 20, 10) == 0.4
    assert vec.ramp_alpha(0.4, 1, 0, 10) == 0.4
    assert (vec.clamp_temp(0.01), vec.clamp_temp(0.2), vec.clamp_temp(3)) == (0.07, 0.2, 0.5)


@pytest.mark.parametrize("steps,ramp,chunk", [(2, None, 32), (20, 15, 8), (0, None, 32), (11, None, 1), (7, None, 3), (60, None, 16)])
def test_contrastive_loss(spark, rng, steps, ramp, chunk, monkeypatch):
    monkeypatch.setattr(vec, "CHUNK_BATCHES", chunk)
    batches, size, per_step = 40, 4, 3
    v1, v2 = unit(rng, batches * size, 5), unit(rng, batches * size, 5)
    b = np.repeat(np.arange(batches), size)
    m = np.tile(np.arange(size), batches)
    df = frame(spark, b=b, m=m, x=v1, y=v2)
    q = steps * per_step
    got = vec.contrastive_loss(df, "b", "m", "x", "y", q, 0.1, 0.4, per_step, ramp).collect()
    assert len(got) == batches

    def one(query, pool, alpha):
        logits = query @ pool.T / 0.1
        p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
        target = alpha * p
        target[np.arange(size), np.arange(size)] += 1 - alpha
        return -(np.log(p) * target).sum(1).mean()

    for r in got:
        own = b == r.batch_no
        bank = (b < r.batch_no) & (b >= r.batch_no - steps) & (m < per_step)
        alpha = 0.4 if ramp is None else 0.4 * min(1, r.batch_no / ramp)
        want = one(v2[own], np.concatenate([v1[own], v1[bank]]), alpha)
        want += one(v1[own], np.concatenate([v2[own], v2[bank]]), alpha)
        assert abs(r.loss - want) < 1e-9 and r.candidates == own.sum() + bank.sum()


def test_memory_bank(spark):
    rows = [(b, m) for b in range(50) for m in range(4 if b % 2 else 2)]
    df = spark.createDataFrame(rows, "b int, m int")
    got = {r.b: r for r in vec.memory_bank(df, "b", "m", q=9, per_step=3).collect()}
    for b in range(50):
        before = [x for x in rows if b - 3 <= x[0] < b and x[1] < 3]
        assert got[b].bank_rows == len(before) and got[b].rows == (4 if b % 2 else 2)
        assert got[b].bank_from == (max(b - 3, 0) if b else None)
    with pytest.raises(ValueError):
        vec.memory_bank(df, "b", "m", q=10, per_step=3)


@pytest.mark.parametrize("decay", [0.995, 0.5, 0.0, 1.0])
def test_ema_over_many_stretches(spark, rng, decay, monkeypatch):
    monkeypatch.setattr(stretches, "SAMPLED", 1)
    x = rng.normal(size=700)
    keys = ["hot" if i % 7 else "cold" for i in range(700)]
    df = frame(spark, k=keys, o=list(range(700)), x=x)
    got = {r.k: r.ema for r in vec.ema(df, ["k"], "o", "x", decay, depth=50).collect()}
    assert got == pytest.approx({r.k: r.ema for r in vec.ema(df, ["k"], "o", "x", decay).collect()})  # in one piece
    for key in ("hot", "cold"):
        series = [v for v, k in zip(x, keys) if k == key]
        m = series[0]
        for v in series:
            m = decay * m + (1 - decay) * v
        assert abs(got[key] - m) < 1e-9


def test_moments_and_frechet(spark, rng):
    a, b = rng.normal(size=(120, 4)), rng.normal(size=(90, 4)) * 1.5 + 0.3
    da, db = frame(spark, v=a).repartition(5), frame(spark, v=b).repartition(3)
    cells = {(r.i, r.j): r for r in vec.vector_moments(da, "v").collect()}
    cov = np.cov(a.T)
    assert all(abs(cells[i, j].cov - cov[i, j]) < 1e-9 for i in range(4) for j in range(4))
    assert vec.frechet_distance(da, da, "v").first()[0] == pytest.approx(0, abs=1e-6)
    c1, c2 = cov, np.cov(b.T)
    product = np.sqrt(np.linalg.eigvals(c1 @ c2).astype(complex)).real.sum()
    want = ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(c1 + c2) - 2 * product
    assert vec.frechet_distance(da, db, "v").first()[0] == pytest.approx(want, rel=1e-8)


def test_moments_by_group(spark, rng):
    a = rng.normal(size=(60, 3))
    df = frame(spark, v=a, g=[i % 2 for i in range(60)])
    rows = vec.vector_moments(df, "v", F.col("g")).filter("i = 0 AND j = 2").collect()
    for r in rows:
        part = a[int(r.grp) :: 2]
        assert r.n == 30 and abs(r.cov - np.cov(part.T)[0, 2]) < 1e-9


def test_moments_with_offset_and_null_rows(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.random((500, 3)) + 1e8
    rows = [(v.tolist(),) for v in x] + [(None,), ([1.0, None, 2.0],)]
    df = spark.createDataFrame(rows, "v array<double>").repartition(5)
    got = {(r.i, r.j): (r.n, r.cov) for r in vec.vector_moments(df, "v").collect()}
    want = np.cov(x, rowvar=False)
    assert all(n == 500 and abs(c - want[k]) < 1e-6 for k, (n, c) in got.items()) and len(got) == 9


def test_products_with_null_vectors(spark):
    from pairloom.operators.blocks import batch_products

    rows = [(0, i, [float(i), 1.0]) if i != 2 else (0, i, None) for i in range(4)]
    df = spark.createDataFrame(rows, "b int, i int, x array<double>").withColumn("y", F.col("x"))
    got = {r.i: r.products for r in batch_products(df, ["b"], "i", "x", "y").collect()}
    assert got[1] == [1.0, 2.0, None, 4.0] and got[2] == [None] * 4


def test_frechet_of_an_empty_side_is_null(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([2.0, 1.0],), ([0.0, 1.0],)], "x array<double>")
    rows = vec.frechet_distance(df, df.limit(0), "x").collect()
    assert [r.frechet for r in rows] == [None]


def best_of(left, right, k, largest):
    order = np.argsort(np.round(-left @ right.T if largest else left @ right.T, 9), axis=1, kind="stable")
    return order[:, :k].tolist()


@pytest.mark.parametrize("largest", [True, False])
def test_fused_selection_equals_products(spark, rng, monkeypatch, largest):
    monkeypatch.setattr(blocks, "CANDIDATES", 300)
    monkeypatch.setattr(blocks, "QUERIES", 37)
    x, y = rng.normal(size=(700, 5)), rng.normal(size=(700, 5))
    y[300:400] = y[:100]  # ties across chunks
    rows = [(i, i % 3 // 2, x[i].tolist(), None if i in (6, 9) else y[i].tolist()) for i in range(700)]
    df = spark.createDataFrame(rows, "o int, b int, x array<double>, y array<double>")
    got = vec.nearest(df, ["b"], "o", "x", "y", 4, largest).collect()
    assert len(got) == 700
    for b in (0, 1):
        here = [i for i in range(700) if i % 3 // 2 == b]
        there = [p for p, i in enumerate(here) if i not in (6, 9)]
        want = best_of(x[here], y[[here[p] for p in there]], 4, largest)
        for r in (r for r in got if r.b == b):
            assert here[r.member] == r.o
            assert [f.place for f in r.best] == [there[p] for p in want[r.member]]
            assert np.allclose([f.score for f in r.best], [x[r.o] @ y[here[f.place]] for f in r.best])
    small = vec.nearest(df.filter("o < 2"), ["b"], "o", "x", "y", 4).collect()
    assert all(len(r.best) == 2 for r in small)


def test_a_large_batch_needs_no_square(rng):
    import tracemalloc

    x = rng.normal(size=(100_000, 8))
    tracemalloc.start()
    for lo in range(0, 1024, blocks.QUERIES):  # what a task does, query block by query block
        blocks.best_products(x[lo : lo + blocks.QUERIES], x, 3, -1.0, 9, np.zeros(blocks.QUERIES))
    assert tracemalloc.get_traced_memory()[1] < 300e6  # the square has 80 GB
    tracemalloc.stop()


def test_bank_of_the_original_size_is_split(spark, rng):
    """16,384 rows of bank: no pair of chunks holds more than CHUNK_BATCHES batches of it, and the loss is right."""
    batches, size, steps = 300, 8, 256
    v1, v2 = unit(rng, batches * size, 16), unit(rng, batches * size, 16)
    b, m = np.repeat(np.arange(batches), size), np.tile(np.arange(size), batches)
    got = vec.contrastive_loss(frame(spark, b=b, m=m, x=v1, y=v2), "b", "m", "x", "y", steps * size, 0.1, 0.4, size)
    r = got.filter("batch_no = 290").first()
    own, pool = b == 290, (b <= 290) & (b >= 290 - steps)
    want = 0
    for query, views in ((v2[own], v1), (v1[own], v2)):
        logits = query @ np.concatenate((views[own], views[pool & ~own])).T / 0.1
        logp = logits - np.log(np.exp(logits).sum(1, keepdims=True))
        target = 0.4 * np.exp(logp)
        target[np.arange(size), np.arange(size)] += 0.6
        want -= (logp * target).sum(1).mean()
    assert abs(r.loss - want) < 1e-9 and r.candidates == pool.sum()


def test_moments_of_many_groups_in_little_memory(spark, rng, monkeypatch):
    x, groups = rng.normal(size=(900, 3)), [f"g{(i * 37) % 150}" for i in range(900)]
    df = frame(spark, v=x, g=groups).coalesce(2)
    whole = {(r.grp, r.i, r.j): (r.n, r.mean_i, r.cov) for r in vec.vector_moments(df, "v", F.col("g")).collect()}
    monkeypatch.setattr(vec, "HELD", 8 * 9 * 20)  # twenty groups at a time
    split = {(r.grp, r.i, r.j): (r.n, r.mean_i, r.cov) for r in vec.vector_moments(df, "v", F.col("g")).collect()}
    assert len(split) == 150 * 9 and set(split) == set(whole)
    assert all(split[k] == pytest.approx(whole[k]) for k in whole)
    mine = x[[i for i in range(900) if groups[i] == "g5"]]
    assert np.allclose([split["g5", i, j][2] for i in range(3) for j in range(3)], np.cov(mine.T).ravel())


def test_a_task_sends_matrices_on_in_time(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(vec, "TaskContext", type("C", (), {"get": staticmethod(lambda: type("T", (), {"partitionId": lambda self: 3})())}))
    d, n = 8, 100_000
    x = np.random.default_rng(1).normal(size=(n, d))
    monkeypatch.setattr(vec, "HELD", 8 * d * d * 1000)
    batches = (
        pa.record_batch({"grp": [str(i) for i in range(lo, lo + 10_000)], "vec": x[lo : lo + 10_000].tolist()}) for lo in range(0, n, 10_000)
    )
    sizes = [b.num_rows for b in vec._partial_moments(batches)]
    assert sum(sizes) == n and max(sizes) <= 1000  # 100,000 groups, a thousand matrices held
