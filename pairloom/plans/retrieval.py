"""Retrieval accuracy of noised vectors: the flagship plan and its steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import batching, noise
from pairloom.operators import retrieval as ret
from pairloom.operators.rows import unnest
from pairloom.plans import fixtures as fx
from pairloom.plans import sql
from pairloom.plans.registry import query

ROUNDS, LO, HI = 10, 50, 950
_SEED = fx.SEED + 10

_SCORES = (
    f"{fx.BATCHED_CTE}, {sql.coefs_cte('sched', sql.betas('linear', fx.STEPS))}, "
    f"rounds AS (SELECT pos, batch_no, x, unnest(range(0, {ROUNDS})) AS rnd FROM batched), "
    f"drawn AS (SELECT *, {sql.u_int(_SEED, LO, HI, 'rnd', 'pos')} AS t, "
    f"{sql.normals(_SEED + 1, fx.DIMS, 'rnd', 'pos')} AS e FROM rounds), "
    "noisy AS (SELECT pos, batch_no, sab, ab, list_transform(range(1, 65), lambda i: sab * x[i] + somab * e[i]) AS xt "
    "FROM drawn JOIN sched USING (t)), "
    "errors AS (SELECT q.pos, c.member AS place, list_sum(list_transform(range(1, 65), "
    "lambda i: pow(q.xt[i] - q.sab * c.x[i], 2))) / 64 / (1 - q.ab) AS err "
    "FROM noisy q JOIN batched c ON q.batch_no = c.batch_no), "
    "scored AS (SELECT pos, place, sum(err) AS score FROM errors GROUP BY pos, place), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY round(score, 9), place) AS rn FROM scored), "
    "hit_rows AS (SELECT b.pos, b.vec_id, b.batch_no, b.member, r.place AS best, (r.place = b.member)::INT AS hit "
    "FROM batched b JOIN ranked r ON r.pos = b.pos WHERE rn = 1)"
)


def scored(spark: SparkSession, sf: str, score=ret.score_candidates, **options) -> DataFrame:
    """Candidate scores per query: each vector is noised and searched in its own batch."""
    batches = fx.batched_vectors(spark, sf).select(
        "pos", "batch_no", "vec_id", F.col("x").alias("query"), F.col("x").alias("candidate")
    )
    coefs = noise.schedule(spark, "linear", fx.STEPS)
    return score(batches, coefs, "batch_no", "pos", "query", "candidate", fx.DIMS, ROUNDS, _SEED, LO, HI, **options)


def best(spark: SparkSession, sf: str, k: int = 1) -> DataFrame:
    """The best candidates per query."""
    return scored(spark, sf, ret.best_candidates, k=k)


@query("retrieval_scores", f"WITH {_SCORES} SELECT pos, place, {sql.r6('score')} AS score FROM scored")
def retrieval_scores(spark, sf):
    rows = unnest(scored(spark, sf), ["pos"], "scores", "score", "place")
    return rows.withColumn("score", F.round("score", 6))


@query("retrieval_hits", f"WITH {_SCORES} SELECT pos, vec_id, batch_no, member, best, hit FROM hit_rows")
def retrieval_hits(spark, sf):
    return best(spark, sf).select("pos", "vec_id", "batch_no", "member", "best", "hit")


@query(
    "retrieval_top3",
    f"WITH {_SCORES} SELECT h.pos, h.vec_id, r.rn - 1 AS rank, r.place, {sql.r6('r.score')} AS score "
    "FROM hit_rows h JOIN ranked r ON r.pos = h.pos AND r.rn <= 3 WHERE h.hit = 1",
)
def retrieval_top3(spark, sf):
    rows = ret.ranked_candidates(best(spark, sf, 3))
    return rows.select("pos", "vec_id", "rank", "place", F.round("score", 6).alias("score"))


@query(
    "retrieval_accuracy",
    f"WITH {_SCORES}, firsts AS (SELECT * FROM hit_rows QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY pos) = 1) "
    f"SELECT count(*) AS n_queries, {sql.r6('avg(hit)')} AS accuracy FROM firsts",
)
def retrieval_accuracy(spark, sf):
    """Accuracy per batch; a vector that was repeated to fill the tail counts once."""
    hit_rows = best(spark, sf).select("vec_id", "pos", "hit")
    firsts = batching.keep_first(hit_rows, ["vec_id"], "pos")
    return ret.accuracy(firsts).withColumn("accuracy", F.round("accuracy", 6))
