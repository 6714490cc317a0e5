import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions.rand import normal_vector, uniform_int
from pairloom.operators import noise
from pairloom.operators import retrieval as ret

DIMS, ROUNDS, SEED = 6, 4, 11


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(23, DIMS))
    x[5] = x[3]  # two copies in one batch
    rows = [(i, i // 8, x[i].tolist()) for i in range(23)]
    df = spark.createDataFrame(rows, "pos bigint, b bigint, q array<double>").withColumn("c", F.col("q"))
    coefs = noise.schedule(spark)
    scored = ret.score_candidates(df, coefs, "b", "pos", "q", "c", DIMS, ROUNDS, SEED)
    draws = spark.range(23).withColumnRenamed("id", "pos").withColumn(
        "r", F.explode(F.sequence(F.lit(0), F.lit(ROUNDS - 1)))
    ).select(
        "pos",
        "r",
        uniform_int(SEED, 50, 950, "r", "pos").alias("t"),
        normal_vector(SEED + 1, DIMS, "r", "pos").alias("e"),
    )
    ab = {r.t: r.alpha_bar for r in coefs.collect()}
    want = {}
    for d in draws.collect():
        a = ab[d.t]
        x_t = np.sqrt(a) * x[d.pos] + np.sqrt(1 - a) * np.array(d.e)
        batch = [i for i in range(23) if i // 8 == d.pos // 8]
        error = np.array([((x_t - np.sqrt(a) * x[i]) ** 2).mean() / (1 - a) for i in batch])
        want[d.pos] = want.get(d.pos, 0) + error
    return scored, want


def test_folded_scores_equal_the_sum_over_rounds(case):
    scored, want = case
    rows = scored.collect()
    assert len(rows) == 23
    for r in rows:
        assert r.member == r.pos % 8 and np.allclose(r.scores, want[r.pos], rtol=1e-9)


def test_hits_and_ties(case):
    scored, want = case
    rows = {r.pos: r for r in ret.hits(scored).collect()}
    for pos, w in want.items():
        best = int(np.argmin(np.round(w, 9)))
        assert rows[pos].best == best and rows[pos].hit == int(best == pos % 8)
    # A copy at a higher place never beats the lower one.
    assert rows[5].best != 5


def test_top_candidates(case):
    scored, want = case
    everything = ret.top_candidates(scored, 3, hits_only=False).collect()
    for pos, w in want.items():
        got = sorted((r["rank"], r.place) for r in everything if r.pos == pos)
        assert [p for _, p in got] == np.argsort(np.round(w, 9), kind="stable")[:3].tolist()
    hit = {r.pos for r in ret.hits(scored).filter("hit = 1").collect()}
    assert {r.pos for r in ret.top_candidates(scored, 3).collect()} == hit


def test_best_candidates_equal_all_scores(spark, case):
    scored, want = case
    rng = np.random.default_rng(8)
    x = rng.normal(size=(23, DIMS))
    x[5] = x[3]
    df = spark.createDataFrame([(i, i // 8, x[i].tolist()) for i in range(23)], "pos bigint, b bigint, q array<double>")
    best = ret.best_candidates(df.withColumn("c", F.col("q")), noise.schedule(spark), "b", "pos", "q", "c", DIMS, ROUNDS, SEED, k=3)
    rows = {r.pos: r for r in best.collect()}
    for pos, w in want.items():
        order = np.argsort(np.round(w, 9), kind="stable")[:3].tolist()
        assert [f.place for f in rows[pos].found] == order and rows[pos].best == order[0]
        assert np.allclose([f.score for f in rows[pos].found], w[order], rtol=1e-9) and rows[pos].hit == int(order[0] == pos % 8)
    ranked = ret.ranked_candidates(best).collect()
    assert {r.pos for r in ranked} == {p for p in rows if rows[p].hit} and all(len([r for r in ranked if r.pos == p]) == 3 for p in rows if rows[p].hit)


def test_single_candidate_batch_always_hits(spark):
    df = spark.createDataFrame([(0, 0, [1.0] * DIMS)], "pos bigint, b bigint, q array<double>")
    df = df.withColumn("c", F.col("q"))
    scored = ret.score_candidates(df, noise.schedule(spark), "b", "pos", "q", "c", DIMS, 2, SEED)
    assert tuple(ret.accuracy(ret.hits(scored)).first()) == (1, 1.0)


def test_one_shuffle_by_batch(case):
    plan = case[0]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1


def test_fold_holds_few_queries_at_a_time():
    """An Arrow batch has up to 10,000 queries; the noise of all of them, 10 rounds each, would take hundreds of MB."""
    import tracemalloc

    rng = np.random.default_rng(3)
    rows, rounds, dims = 2 * ret.FOLD_ROWS + 3000, 10, 64
    x, ab = rng.standard_normal((rows, dims)), rng.uniform(0.1, 0.9, (rows, rounds))
    words = [rng.integers(0, 2**32, rows * rounds) for _ in range(2)]
    tracemalloc.start()
    out = ret.fold_rows(x, ab, words, dims)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.start()
    tracemalloc.reset_peak()
    whole = ret._fold_rows(x, ab, words, dims)
    at_once = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(out, whole) and peak < out.nbytes + 20e6 < at_once / 3
    assert ret.fold_rows(x[:0], ab[:0], [w[:0] for w in words], dims).shape == (0, dims + 2)
