"""Noise schedules and loss reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions.rand import uniform_int
from pairloom.operators import losses, noise
from pairloom.operators.rows import unnest
from pairloom.plans import fixtures as fx
from pairloom.plans import sql
from pairloom.plans.registry import query, table
from pairloom.session import spread

_BASE = sql.coefs_cte("sched", sql.betas("linear", fx.STEPS))
_DRAW = f"drawn AS (SELECT event_id, {sql.u_int(fx.SEED, 0, 999, 'event_id')} AS t FROM events)"


def _drawn(spark, sf, lo=0, hi=fx.STEPS - 1):
    return noise.draw_timestep(table(spark, sf, "events").select("event_id"), ["event_id"], lo, hi, fx.SEED)


def _r(name: str, digits: int = 6):
    return (F.round(name, digits) + F.lit(0.0)).alias(name)


_NAMED = " UNION ALL ".join(
    f"SELECT '{n}' AS schedule, * FROM ({sql.betas(n, fx.STEPS)})" for n in noise.SCHEDULES
)


@query(
    "beta_tables",
    f"WITH {_DRAW}, b AS ({_NAMED}) SELECT schedule, event_id, t, {sql.r6('beta', 10)} AS beta FROM drawn JOIN b USING (t)",
)
def beta_tables(spark, sf):
    """The beta of every schedule at the step drawn for each event."""
    tables = [
        noise.beta_schedule(spark, n, fx.STEPS).withColumn("schedule", F.lit(n)) for n in noise.SCHEDULES
    ]
    named = tables[0]
    for other in tables[1:]:
        named = named.unionByName(other)
    rows = noise.with_schedule(_drawn(spark, sf), noise.held(named), ["schedule", "beta"])
    return rows.select("schedule", "event_id", "t", _r("beta", 10))


_COEFS = {
    "alpha_bar": "ab",
    "alpha_bar_prev": "abp",
    "alpha_bar_next": "abn",
    "sqrt_alpha_bar": "sab",
    "sqrt_one_minus_alpha_bar": "somab",
    "log_one_minus_alpha_bar": "lomab",
    "sqrt_recip_alpha_bar": "rab",
    "sqrt_recipm1_alpha_bar": "rm1",
    "posterior_variance": "pv",
    "posterior_log_variance": "plv",
    "posterior_mean_coef1": "c1",
    "posterior_mean_coef2": "c2",
    "fixed_large_variance": "flv",
}


@query(
    "noise_coefficients",
    f"WITH {_DRAW}, "
    + ", ".join(sql.coefs_cte(f"sched{i}", sql.betas(n, fx.STEPS)) for i, n in enumerate(noise.SCHEDULES))
    + ", named AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS schedule, * FROM sched{i}" for i, n in enumerate(noise.SCHEDULES))
    + ") SELECT schedule, event_id, t, "
    + ", ".join(f"{sql.r6(short)} AS {name}" for name, short in _COEFS.items())
    + " FROM drawn JOIN named USING (t)",
)
def noise_coefficients(spark, sf):
    """All coefficients of every schedule at the step drawn for each event."""
    tables = [noise.schedule(spark, n).withColumn("schedule", F.lit(n)) for n in noise.SCHEDULES]
    named = tables[0]
    for other in tables[1:]:
        named = named.unionByName(other)
    rows = noise.with_schedule(_drawn(spark, sf), noise.held(named), ["schedule", *_COEFS])
    return rows.select("schedule", "event_id", "t", *[_r(c) for c in _COEFS])


# Sections of 334, 333 and 333 steps.
_SECTIONS = [10, 5, 84]
# Whole strides: 9 of 37, 4 of 83, 83 of 4.
_KEPT = [*range(0, 334, 37), *range(334, 667, 83), *range(667, 1000, 4)]


@query(
    "respaced_schedule",
    f"WITH {sql.coefs_cte('base', sql.betas('linear', fx.STEPS))}, "
    f"short AS ({sql.respaced_betas('base', _KEPT)}), "
    f"drawn AS (SELECT event_id, {sql.u_int(fx.SEED, 0, len(_KEPT) - 1, 'event_id')} AS t FROM events) "
    f"SELECT event_id, t, old_t, {sql.r6('beta', 10)} AS beta FROM drawn JOIN short USING (t)",
)
def respaced_schedule(spark, sf):
    """Old step and new beta at the short step drawn for each event."""
    short = noise.schedule(spark, "linear", fx.STEPS, _SECTIONS)
    rows = noise.with_schedule(_drawn(spark, sf, 0, len(_KEPT) - 1), short, ["old_t", "beta"])
    return rows.select("event_id", "t", "old_t", _r("beta", 10))


_STRIDE = list(range(0, fx.STEPS, 20))


@query(
    "respaced_by_stride",
    f"WITH {sql.coefs_cte('base', sql.betas('linear', fx.STEPS))}, "
    f"short AS ({sql.respaced_betas('base', _STRIDE)}), "
    f"drawn AS (SELECT event_id, {sql.u_int(fx.SEED, 0, len(_STRIDE) - 1, 'event_id')} AS t FROM events) "
    f"SELECT event_id, t, old_t, {sql.r6('beta', 10)} AS beta FROM drawn JOIN short USING (t)",
)
def respaced_by_stride(spark, sf):
    """The schedule of 50 steps at one whole stride."""
    short = noise.schedule(spark, "linear", fx.STEPS, "ddim50")
    rows = noise.with_schedule(_drawn(spark, sf, 0, len(_STRIDE) - 1), short, ["old_t", "beta"])
    return rows.select("event_id", "t", "old_t", _r("beta", 10))


@query(
    "draw_timestep",
    f"SELECT event_id, {sql.u_int(fx.SEED, 0, 999, 'event_id')} AS t_train, "
    f"{sql.u_int(fx.SEED, 50, 950, 'event_id')} AS t_retrieve, {sql.u_int(fx.SEED, 100, 900, 'event_id')} AS t_edit FROM events",
)
def draw_timestep(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        *[
            uniform_int(fx.SEED, lo, hi, "event_id").alias(name)
            for name, lo, hi in (("t_train", 0, 999), ("t_retrieve", 50, 950), ("t_edit", 100, 900))
        ],
    )


_WEIGHTS = (
    "recent AS (SELECT event_type, value FROM events QUALIFY row_number() OVER "
    "(PARTITION BY event_type ORDER BY event_id DESC) <= 10), "
    "rms AS (SELECT event_type, count(*) AS n_losses, sqrt(sum(value * value) / 10) AS r FROM recent GROUP BY event_type), "
    "weights AS (SELECT event_type, n_losses, CASE WHEN (SELECT min(n_losses) FROM rms) < 10 THEN 1.0 ELSE "
    "r / (SELECT sum(r) FROM rms) * 0.999 + 0.001 / (SELECT count(*) FROM rms) END AS weight FROM rms)"
)


def _weights(spark, sf):
    return noise.loss_weights(table(spark, sf, "events"), "event_type", "event_id", "value")


@query("loss_weights", f"WITH {_WEIGHTS} SELECT event_type, n_losses, {sql.r6('weight')} AS weight FROM weights")
def loss_weights(spark, sf):
    return _weights(spark, sf).select("event_type", "n_losses", _r("weight"))


@query(
    "importance_draw",
    f"WITH {_WEIGHTS}, upto AS (SELECT *, sum(weight) OVER (ORDER BY event_type) / sum(weight) OVER () AS hi, "
    "sum(weight) OVER () / (count(*) OVER () * weight) AS row_weight FROM weights), "
    "spans AS (SELECT event_type, row_weight, coalesce(lag(hi) OVER (ORDER BY event_type), 0) AS lo, "
    "CASE WHEN lead(event_type) OVER (ORDER BY event_type) IS NULL THEN 2 ELSE hi END AS hi FROM upto), "
    f"drawn AS (SELECT event_id, {sql.u(fx.SEED, 'event_id')} AS u FROM events) "
    f"SELECT event_id, event_type, {sql.r6('row_weight')} AS row_weight FROM drawn JOIN spans ON u >= lo AND u < hi",
)
def importance_draw(spark, sf):
    events = table(spark, sf, "events").select("event_id")
    drawn = noise.importance_draw(events, "event_id", _weights(spark, sf), "event_type", fx.SEED)
    return drawn.select("event_id", "event_type", _r("row_weight"))


@query(
    "forward_noise",
    f"WITH {_BASE}, {fx.VECTORS_CTE}, "
    f"drawn AS (SELECT vec_id, x, {sql.u_int(fx.SEED, 0, 999, 'vec_id')} AS t, "
    f"{sql.normals(fx.SEED + 1, fx.DIMS, 'vec_id')} AS e FROM vecs), "
    "entries AS (SELECT vec_id, t, unnest(range(0, 64)) AS dim, unnest(x) AS x, unnest(e) AS eps FROM drawn) "
    f"SELECT vec_id, t, dim, {sql.r6('sab * x + somab * eps')} AS x_t, {sql.r6('sab * x')} AS q_mean, "
    f"{sql.r6('1 - ab')} AS q_variance, {sql.r6('lomab')} AS q_log_variance FROM entries JOIN sched USING (t)",
)
def forward_noise(spark, sf):
    rows = noise.draw_timestep(spread(fx.vectors(spark, sf), "vec_id"), ["vec_id"], 0, fx.STEPS - 1, fx.SEED)
    noisy = noise.add_noise(rows, noise.schedule(spark), ["vec_id"], "x", fx.DIMS, fx.SEED + 1)
    keep = ["vec_id", "t", "q_variance", "q_log_variance"]
    flat = unnest(noisy, keep, F.arrays_zip("x_t", "q_mean"), "e", "dim").select(*keep, "dim", "e.*")
    return flat.select("vec_id", "t", "dim", *[_r(c) for c in ("x_t", "q_mean", "q_variance", "q_log_variance")])


_CLIP = "least(greatest(rab * x_t - rm1 * eps_hat, -1), 1)"
_LOGVAR = "((v + 1) / 2 * ln(beta) + (1 - (v + 1) / 2) * plv)"
_VARIANCES = {"learned_range": _LOGVAR, "fixed_large": "ln(flv)", "fixed_small": "plv"}


@query(
    "reconstruct_x0",
    f"WITH {fx.PREDICTIONS_CTE}, p AS (SELECT *, {_CLIP} AS x0 FROM preds) SELECT vec_id, t, dim, "
    f"{sql.r6('x0')} AS pred_x0, {sql.r6('(rab * x_t - x0) / rm1')} AS pred_eps, "
    f"{sql.r6('c1 * x0 + c2 * x_t')} AS mean, {sql.r6(_LOGVAR)} AS log_variance FROM p",
)
def reconstruct_x0(spark, sf):
    coefs = fx.respaced(spark)
    out = noise.reconstruct(fx.predictions(spark, sf, coefs), coefs, clip=True)
    names = ("pred_x0", "pred_eps", "mean", "log_variance")
    flat = unnest(out, ["vec_id", "t"], F.arrays_zip(*names), "e", "dim")
    return flat.select("vec_id", "t", "dim", "e.*").select("vec_id", "t", "dim", *[_r(c) for c in names])


_CDF = "0.5 * (1 + tanh(sqrt(2 / pi()) * ({0} + 0.044715 * pow({0}, 3))))"


def _terms(clip: bool, predicts: str = "eps", variance: str = "learned_range", name: str = "terms") -> str:
    """CTE ``name``: loss terms per vector and step."""
    x0 = "eps_hat" if predicts == "x0" else "rab * x_t - rm1 * eps_hat"
    x0 = f"least(greatest({x0}, -1), 1)" if clip else x0
    target = {"eps": "eps", "x0": "x", "prev_mean": "tm"}[predicts]
    kl = "0.5 * (-1 + lv - plv + exp(plv - lv) + pow(tm - m, 2) * exp(-lv))"
    nll = (
        "-CASE WHEN x < -0.999 THEN ln(greatest(above, 1e-12)) WHEN x > 0.999 THEN ln(greatest(1 - below, 1e-12)) "
        "ELSE ln(greatest(above - below, 1e-12)) END"
    )
    return (
        f"{name}0 AS (SELECT *, {x0} AS x0, {_VARIANCES[variance]} AS lv FROM preds), "
        f"{name}1 AS (SELECT *, c1 * x + c2 * x_t AS tm, c1 * x0 + c2 * x_t AS m, exp(-0.5 * lv) AS inv FROM {name}0), "
        f"{name}2 AS (SELECT *, inv * (x - m + 1.0 / 255.0) AS hi, inv * (x - m - 1.0 / 255.0) AS lo FROM {name}1), "
        f"{name}3 AS (SELECT *, {_CDF.format('hi')} AS above, {_CDF.format('lo')} AS below FROM {name}2), "
        f"{name} AS (SELECT vec_id, t, avg(pow({target} - eps_hat, 2)) AS mse, avg(pow(x0 - x, 2)) AS x0_mse, "
        "avg(pow((rab * x_t - x0) / rm1 - eps, 2)) AS eps_mse, "
        f"avg(CASE WHEN t = 0 THEN {nll} ELSE {kl} END) / ln(2) AS vb FROM {name}3 GROUP BY vec_id, t)"
    )


@query(
    "loss_by_timestep",
    f"WITH {fx.PREDICTIONS_CTE}, {_terms(False)} SELECT t, count(*) AS n, {sql.r6('avg(mse)')} AS mse, "
    f"{sql.r6('avg(x0_mse)')} AS x0_mse, {sql.r6('avg(eps_mse)')} AS eps_mse, {sql.r6('avg(vb)')} AS vb, "
    f"{sql.r6('avg(mse + vb * 10 / 1000.0)')} AS loss FROM terms GROUP BY t",
)
def loss_by_timestep(spark, sf):
    coefs = fx.respaced(spark)
    terms = losses.loss_terms(fx.predictions(spark, sf, coefs), coefs, ["vec_id"])
    report = losses.loss_report(terms, "rescaled_mse", steps=10)
    return report.select("t", "n", *[_r(c) for c in ("mse", "x0_mse", "eps_mse", "vb", "loss")])


_LAST = "(SELECT ab FROM sched ORDER BY t DESC LIMIT 1)"


@query(
    "bits_per_dim",
    f"WITH {fx.PREDICTIONS_CTE}, {_terms(True)}, "
    "sums AS (SELECT vec_id, count(*) AS n_steps, sum(vb) AS vb FROM terms GROUP BY vec_id), "
    "prior AS (SELECT vec_id, 0.5 * (-1 - ln(1 - ab) + (1 - ab) + ab * list_sum(list_transform(x, lambda e: e * e)) / 64) / ln(2) "
    f"AS prior_bpd FROM vecs, (SELECT {_LAST} AS ab)) "
    f"SELECT vec_id, n_steps, {sql.r6('vb')} AS vb, {sql.r6('prior_bpd')} AS prior_bpd, "
    f"{sql.r6('vb + prior_bpd')} AS total_bpd FROM sums JOIN prior USING (vec_id)",
)
def bits_per_dim(spark, sf):
    coefs = fx.respaced(spark)
    terms = losses.loss_terms(fx.predictions(spark, sf, coefs), coefs, ["vec_id"], clip=True)
    out = losses.bits_per_dim(terms, coefs, ["vec_id"])
    return out.select("vec_id", "n_steps", *[_r(c) for c in ("vb", "prior_bpd", "total_bpd")])


_BY_KIND = {"mse": "mse", "mse_vb": "mse + vb", "rescaled_mse": "mse + vb * 10 / 1000.0", "kl": "vb", "rescaled_kl": "vb * 10"}


@query(
    "loss_kinds",
    f"WITH {fx.PREDICTIONS_CTE}, {_terms(True)} SELECT t, "
    + ", ".join(f"{sql.r6(f'avg({loss})')} AS {kind}" for kind, loss in _BY_KIND.items())
    + " FROM terms GROUP BY t",
)
def loss_kinds(spark, sf):
    """Each kind of loss by step, with clipped reconstructions."""
    coefs = fx.respaced(spark)
    terms = losses.loss_terms(fx.predictions(spark, sf, coefs), coefs, ["vec_id"], clip=True)
    kinds = [F.avg(losses.loss_of(kind, 10)).alias(kind) for kind in losses.LOSS_KINDS]
    return terms.groupBy("t").agg(*kinds).select("t", *[_r(kind) for kind in losses.LOSS_KINDS])


# What the output stands for, with each kind of variance.
_TARGETS = [("eps", "fixed_large"), ("x0", "learned_range"), ("x0", "fixed_small"), ("prev_mean", "fixed_large"), ("prev_mean", "fixed_small")]


@query(
    "loss_targets",
    f"WITH {fx.PREDICTIONS_CTE}, "
    + ", ".join(_terms(False, target, variance, f"terms{i}_") for i, (target, variance) in enumerate(_TARGETS))
    + " "
    + " UNION ALL ".join(
        f"SELECT '{target}' AS target, '{variance}' AS variance, t, {sql.r6('avg(mse)')} AS mse, {sql.r6('avg(x0_mse)')} AS x0_mse, "
        f"{sql.r6('avg(eps_mse)')} AS eps_mse, {sql.r6('avg(vb)')} AS vb FROM terms{i}_ GROUP BY t"
        for i, (target, variance) in enumerate(_TARGETS)
    ),
)
def loss_targets(spark, sf):
    """The other targets and the fixed variances, without clipping."""
    coefs = fx.respaced(spark)
    logged = fx.predictions(spark, sf, coefs)
    frames = []
    for target, variance in _TARGETS:
        terms = losses.loss_terms(logged, coefs, ["vec_id"], target, variance)
        report = losses.loss_report(terms, "mse", steps=10)
        frames.append(report.select(F.lit(target).alias("target"), F.lit(variance).alias("variance"), "t", *map(_r, ("mse", "x0_mse", "eps_mse", "vb"))))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


@query(
    "reconstruct_fixed",
    f"WITH {fx.PREDICTIONS_CTE}, p AS (SELECT *, rab * x_t - rm1 * eps_hat AS x0 FROM preds) "
    + " UNION ALL ".join(
        f"SELECT '{kind}' AS variance, vec_id, t, dim, {sql.r6('x0')} AS pred_x0, {sql.r6('c1 * x0 + c2 * x_t')} AS mean, "
        f"{sql.r6(_VARIANCES[kind])} AS log_variance FROM p"
        for kind in ("fixed_large", "fixed_small")
    ),
)
def reconstruct_fixed(spark, sf):
    """Both fixed variances, without clipping."""
    coefs = fx.respaced(spark)
    frames = []
    for kind in ("fixed_large", "fixed_small"):
        out = noise.reconstruct(fx.predictions(spark, sf, coefs), coefs, clip=False, variance=kind)
        names = ("pred_x0", "mean", "log_variance")
        flat = unnest(out, ["vec_id", "t"], F.arrays_zip(*names), "e", "dim").select("vec_id", "t", "dim", "e.*")
        frames.append(flat.select(F.lit(kind).alias("variance"), "vec_id", "t", "dim", *[_r(c) for c in names]))
    return frames[0].unionByName(frames[1])
