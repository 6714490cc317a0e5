"""Vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import vectors as vf
from pairloom.operators import vectors as vec
from pairloom.operators.rows import unnest
from pairloom.plans import fixtures as fx
from pairloom.plans import sql
from pairloom.plans.registry import query, table

_R = range(fx.DIMS)
_DOT = "list_sum(list_transform(range(1, 65), lambda i: a.x[i] * b.y[i]))"
TEMP, ALPHA, BANK = 0.07, 0.4, 128


@query(
    "normalize",
    "WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE * (label - 4)) AS x FROM embeddings), "
    "n AS (SELECT vec_id, x, greatest(sqrt(list_sum(list_transform(x, lambda e: e * e))), 1e-12) AS norm FROM v), "
    "e AS (SELECT vec_id, unnest(range(0, 64)) AS dim, unnest(x) / norm AS value FROM n) "
    f"SELECT vec_id, dim, {sql.r6('value')} AS value FROM e",
)
def normalize(spark, sf):
    # Label 4 makes zero vectors.
    scaled = fx.vectors(spark, sf).select(
        "vec_id", F.transform("x", lambda e: e * (F.col("label") - 4)).alias("x")
    )
    unit = unnest(scaled, ["vec_id"], vf.l2_normalize("x"), "value", "dim")
    return unit.withColumn("value", F.round("value", 6) + F.lit(0.0))


_SIMS = (
    f"{fx.TWO_VIEWS_CTE}, sims AS (SELECT a.batch_no, a.pos, a.vec_id, a.member, b.member AS place, "
    f"{_DOT} AS sim FROM views a JOIN views b ON a.batch_no = b.batch_no)"
)


def _sims(spark, sf):
    views = fx.two_views(spark, sf).select("batch_no", "pos", "vec_id", "x", "y")
    return vec.similarity(views, ["batch_no"], "pos", "x", "y")


@query(
    "pair_similarity_topk",
    f"WITH {_SIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY round(-sim, 9), place) AS rn FROM sims) "
    f"SELECT pos, vec_id, rn - 1 AS rank, place, {sql.r6('sim')} AS score FROM r WHERE rn <= 3",
)
def pair_similarity_topk(spark, sf):
    views = fx.two_views(spark, sf).select("batch_no", "pos", "vec_id", "x", "y")
    best = unnest(vec.nearest(views, ["batch_no"], "pos", "x", "y", 3), ["pos", "vec_id"], "best", "c", "rank")
    return best.select("pos", "vec_id", "rank", "c.place", F.round("c.score", 6).alias("score"))


@query(
    "soft_targets",
    f"WITH {_SIMS}, m AS (SELECT *, max(sim) OVER (PARTITION BY pos) AS top FROM sims), "
    f"e AS (SELECT *, exp((sim - top) / {TEMP}) AS ex FROM m), "
    "p AS (SELECT *, ex / sum(ex) OVER (PARTITION BY pos) AS prob FROM e), "
    f"w AS (SELECT pos, place, {ALPHA} * prob + CASE WHEN member = place THEN {1 - ALPHA} ELSE 0 END AS weight FROM p) "
    f"SELECT pos, place, {sql.r6('weight')} AS weight FROM w",
)
def soft_targets(spark, sf):
    # A temperature below the allowed range is lifted to its lower end.
    weights = vec.soft_targets("sim", "member", 0.01, ALPHA)
    rows = unnest(_sims(spark, sf), ["pos"], weights, "weight", "place")
    return rows.withColumn("weight", F.round("weight", 6))


def _direction(name: str, query_view: str, pool_view: str, live_view: str | None = None, alpha: str = str(ALPHA)) -> str:
    """Soft targets from ``query_view``, logits from ``live_view``."""

    def product(view: str) -> str:
        return f"list_sum(list_transform(range(1, 65), lambda i: a.{view}[i] * b.{pool_view}[i]))"

    return (
        f"{name}_l AS (SELECT a.batch_no, a.pos, a.pos = b.pos AS own, {product(query_view)} / {TEMP} AS soft, "
        f"{product(live_view or query_view)} / {TEMP} AS logit "
        f"FROM views a JOIN views b ON b.batch_no BETWEEN a.batch_no - {BANK // fx.BATCH} AND a.batch_no), "
        f"{name}_m AS (SELECT *, max(logit) OVER (PARTITION BY pos) AS top, max(soft) OVER (PARTITION BY pos) AS high FROM {name}_l), "
        f"{name}_p AS (SELECT *, logit - top - ln(sum(exp(logit - top)) OVER (PARTITION BY pos)) AS lp, "
        f"exp(soft - high) / sum(exp(soft - high)) OVER (PARTITION BY pos) AS share FROM {name}_m), "
        f"{name}_r AS (SELECT batch_no, pos, count(*) AS n, "
        f"-sum(lp * ({alpha} * share + CASE WHEN own THEN 1 - {alpha} ELSE 0 END)) AS loss FROM {name}_p GROUP BY ALL), "
        f"{name} AS (SELECT batch_no, max(n) AS candidates, avg(loss) AS loss FROM {name}_r GROUP BY batch_no)"
    )


@query(
    "contrastive_loss",
    f"WITH {fx.TWO_VIEWS_CTE.replace('views AS', 'plain_views AS').replace('raw_plain_views', 'raw_views')}, "
    "views AS (SELECT *, list_reverse(x) AS u, list_reverse(y) AS v FROM plain_views), "
    f"{_direction('d12', 'x', 'y', 'u')}, {_direction('d21', 'y', 'x', 'v')} "
    f"SELECT batch_no, d12.candidates, {sql.r6('d12.loss + d21.loss')} AS loss FROM d12 JOIN d21 USING (batch_no)",
)
def contrastive_loss(spark, sf):
    views = fx.two_views(spark, sf).withColumn("member", F.col("pos") % fx.BATCH)
    # Four different inputs: the live features are the momentum features back to front.
    views = views.withColumns({"u": F.reverse("x"), "v": F.reverse("y")})
    out = vec.contrastive_loss(views, "batch_no", "member", "x", "y", BANK, TEMP, ALPHA, live1="u", live2="v")
    return out.withColumn("loss", F.round("loss", 6))


RAMP = 20
_RAMPED = f"({ALPHA} * least(1.0::DOUBLE, batch_no / {RAMP}.0::DOUBLE))"


@query(
    "contrastive_ramp",
    f"WITH {fx.TWO_VIEWS_CTE}, {_direction('d12', 'x', 'y', alpha=_RAMPED)}, {_direction('d21', 'y', 'x', alpha=_RAMPED)} "
    f"SELECT batch_no, d12.candidates, {sql.r6('d12.loss + d21.loss')} AS loss FROM d12 JOIN d21 USING (batch_no)",
)
def contrastive_ramp(spark, sf):
    """The first epoch: alpha grows over the first batches."""
    views = fx.two_views(spark, sf).withColumn("member", F.col("pos") % fx.BATCH)
    out = vec.contrastive_loss(views, "batch_no", "member", "x", "y", BANK, TEMP, ALPHA, ramp_batches=RAMP)
    return out.withColumn("loss", F.round("loss", 6))


@query(
    "ema_value",
    "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, "
    "count(*) OVER (PARTITION BY event_type) AS n FROM events) "
    "SELECT event_type, max(n) AS n, "
    f"{sql.r6('sum(CASE WHEN i = 1 THEN pow(0.995, n - 1) ELSE 0.005 * pow(0.995, n - i) END * value)')} AS ema "
    "FROM r GROUP BY event_type",
)
def ema_value(spark, sf):
    out = vec.ema(table(spark, sf, "events"), ["event_type"], "event_id", "value", 0.995, ties=["event_id"])
    return out.withColumn("ema", F.round("ema", 6))


@query(
    "vector_moments",
    f"WITH {fx.VECTORS_CTE}, p AS (SELECT label, x, unnest(range(0, 64)) AS i FROM vecs), "
    "q AS (SELECT label, x, i, unnest(range(0, 64)) AS j FROM p), "
    "s AS (SELECT label::VARCHAR AS grp, i, j, count(*) AS n, avg(x[i + 1]) AS mean_i, avg(x[j + 1]) AS mean_j, "
    "covar_samp(x[i + 1], x[j + 1]) AS cov FROM q GROUP BY ALL) "
    f"SELECT grp, i::INT AS i, j::INT AS j, n, {sql.r6('mean_i')} AS mean_i, {sql.r6('cov')} AS cov FROM s",
)
def vector_moments(spark, sf):
    moments = vec.vector_moments(fx.vectors(spark, sf), "x", F.col("label"))
    return moments.select(
        "grp", "i", "j", "n", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("mean_i", "cov")]
    )


# The root of the product of the covariances by a coupled Newton-Schulz iteration: of y and z, both 64 x 64, y
# goes to the root of the scaled product and z to its inverse.
_FRECHET = f"""WITH RECURSIVE {fx.VECTORS_CTE},
sides AS (SELECT label < 5 AS first, x FROM vecs),
cells AS (SELECT first, x, unnest(range(1, 65)) AS i FROM sides),
means AS (SELECT first, i, avg(x[i]) AS m FROM cells GROUP BY ALL),
covs AS (SELECT first, i, j, covar_samp(x[i], x[j]) AS c FROM (SELECT *, unnest(range(1, 65)) AS j FROM cells) GROUP BY ALL),
product AS (SELECT a.i, b.j, sum(a.c * b.c) AS p FROM covs a JOIN covs b ON a.j = b.i WHERE a.first AND NOT b.first GROUP BY ALL),
scale AS (SELECT sqrt(sum(p * p)) AS s FROM product),
root(step, i, j, y, z) AS (
  SELECT 0, i, j, p / s, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0 END FROM product, scale
  UNION ALL
  SELECT n.step + 1, n.i, n.j, n.y, n.z FROM (
    WITH t AS (
      SELECT a.step, a.i, b.j, CASE WHEN a.i = b.j THEN 1.5 ELSE 0 END - 0.5 * sum(a.z * b.y) AS v
      FROM root a JOIN root b ON a.j = b.i GROUP BY a.step, a.i, b.j),
    ny AS (SELECT a.i, t.j, sum(a.y * t.v) AS y FROM root a JOIN t ON a.j = t.i GROUP BY ALL),
    nz AS (SELECT t.step, t.i, b.j, sum(t.v * b.z) AS z FROM t JOIN root b ON t.j = b.i GROUP BY ALL)
    SELECT nz.step, i, j, y, z FROM ny JOIN nz USING (i, j)) n
  WHERE n.step < 30)
SELECT round((SELECT sum((a.m - b.m) ** 2) FROM means a JOIN means b USING (i) WHERE a.first AND NOT b.first)
  + (SELECT sum(c) FROM covs WHERE i = j)
  - 2 * (SELECT sum(y) * sqrt(any_value(s)) FROM root, scale WHERE step = 30 AND i = j), 6) AS frechet"""


@query("frechet_labels", _FRECHET)
def frechet_labels(spark, sf):
    v = fx.vectors(spark, sf)
    return vec.frechet_distance(v.filter("label < 5"), v.filter("label >= 5"), "x").withColumn(
        "frechet", F.round("frechet", 6)
    )


def _wave(i: int, fn: str) -> str:
    rate = 10000.0 ** (-i / 4)
    return sql.r6(f"{fn}(h * {rate!r}::DOUBLE)")


@query(
    "time_features",
    "WITH h AS (SELECT event_id, hour(ts)::DOUBLE AS h FROM events) SELECT event_id, "
    + ", ".join(f"{_wave(i, 'cos')} AS w{i}" for i in range(4))
    + ", "
    + ", ".join(f"{_wave(i, 'sin')} AS w{i + 4}" for i in range(4))
    + ", 0.0::DOUBLE AS w8, "
    + ", ".join(f"{_wave(i, 'sin')} AS p{i}, {_wave(i, 'cos')} AS p{i + 4}" for i in range(4))
    + " FROM h",
)
def time_features(spark, sf):
    hour = F.hour("ts")
    rows = table(spark, sf, "events").select(
        "event_id", vf.sinusoidal(hour, 9).alias("w"), vf.sinusoidal(hour, 8, order="sin_cos").alias("p")
    )
    waves = [(F.round(F.col("w")[i], 6) + F.lit(0.0)).alias(f"w{i}") for i in range(9)]
    places = [(F.round(F.col("p")[i], 6) + F.lit(0.0)).alias(f"p{i}") for i in range(8)]
    return rows.select("event_id", *waves, *places)


@query(
    "guided_combine",
    f"WITH {fx.PREDICTIONS_CTE} SELECT vec_id, t, dim, "
    f"{sql.r6('CASE WHEN dim < 32 THEN eps + 7.5 * (eps_hat - eps) ELSE eps_hat END')} AS value FROM preds",
)
def guided_combine(spark, sf):
    both = fx.predictions(spark, sf, fx.respaced(spark)).select("vec_id", "t", "eps_hat", "eps")
    rows = unnest(both, ["vec_id", "t"], vf.guided("eps_hat", "eps", 7.5, 32), "value", "dim")
    return rows.withColumn("value", F.round("value", 6) + F.lit(0.0))
