"""Inputs that the queries derive from the given tables, with the same steps as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.rand import normal_vector, uniform_vector
from pairloom.functions.text import one_line
from pairloom.functions.tokens import CLS, PAD, SEP, UNK, Vocabulary
from pairloom.functions.vectors import combine, to_double
from pairloom.operators import batching, noise
from pairloom.plans import sql
from pairloom.plans.registry import table
from pairloom.session import spread

SEED = 7
DIMS = 64
BATCH = 64
STEPS = 1000
RESPACED = "10"
# The steps that 10 of 1000 keeps: 999 / 9 = 111 exactly.
RESPACED_STEPS = [111 * i for i in range(10)]

_PAIRS = (
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi "
    "ri ro ic ne ea ra ce li ch ll be ma si om ur"
).split()
VOCAB = Vocabulary(
    (
        PAD,
        UNK,
        CLS,
        SEP,
        *"abcdefghijklmnopqrstuvwxyz",
        *"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        *"0123456789",
        *" .,!?'#-()[]",
        *_PAIRS,
    )
)


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of 1 to 4 tab fields from ``documents``; 4 fields are malformed."""
    d = table(spark, sf, "documents")
    item = F.concat_ws(".", "source", "lang")
    text = one_line("text")
    kind = F.col("doc_id") % 4
    line = (
        F.when(kind == 0, item)
        .when(kind == 1, F.concat_ws("\t", item, text))
        .when(kind == 2, F.concat_ws("\t", F.col("doc_id").cast("string"), item, text))
        .otherwise(F.concat_ws("\t", F.col("doc_id").cast("string"), item, text, F.lit("extra")))
    )
    return d.select("doc_id", line.alias("line"))


_ITEM = "source || '.' || lang"
_T = "chr(9)"
RECORDS_CTE = (
    "records AS (SELECT doc_id, CASE doc_id % 4 "
    f"WHEN 0 THEN {_ITEM} WHEN 1 THEN {_ITEM} || {_T} || {sql.one_line('text')} "
    f"WHEN 2 THEN doc_id || {_T} || {_ITEM} || {_T} || {sql.one_line('text')} "
    f"ELSE doc_id || {_T} || {_ITEM} || {_T} || {sql.one_line('text')} || {_T} || 'extra' END AS line "
    "FROM documents)"
)


def whole_records(spark: SparkSession, sf: str) -> DataFrame:
    """A well-formed line of three fields for every document."""
    d = table(spark, sf, "documents")
    item = F.concat_ws(".", "source", "lang")
    return d.select("doc_id", F.concat_ws("\t", F.col("doc_id").cast("string"), item, one_line("text")).alias("line"))


WHOLE_RECORDS_CTE = (
    f"records AS (SELECT doc_id, doc_id || {_T} || {_ITEM} || {_T} || {sql.one_line('text')} AS line FROM documents)"
)


def part_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """``pair_id, target, pred``: the label of a part and of the next one by key."""
    p = table(spark, sf, "part").select(
        "p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand", F.concat(F.lit("("), "p_size", F.lit(")"))).alias("label")
    )
    following = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("label").alias("pred"))
    return p.join(following, "p_partkey").select(
        F.col("p_partkey").alias("pair_id"), F.col("label").alias("target"), "pred"
    )


PART_PAIRS_CTE = (
    "labelled AS (SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand || ' (' || p_size || ')' AS label FROM part), "
    "pairs AS (SELECT a.p_partkey AS pair_id, a.label AS target, b.label AS pred "
    "FROM labelled a JOIN labelled b ON b.p_partkey = a.p_partkey + 1)"
)


def talk_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """``pair_id, target, pred``: a turn of a conversation and the next one, whole texts."""
    c = table(spark, sf, "conversations")
    following = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("pred"))
    return c.join(following, ["conv_id", "turn"]).select(
        F.concat_ws("-", "conv_id", "turn").alias("pair_id"), F.col("text").alias("target"), "pred"
    )


TALK_PAIRS_CTE = (
    "pairs AS (SELECT a.conv_id || '-' || a.turn AS pair_id, a.text AS target, b.text AS pred "
    "FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"
)


def pair_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``line_id, line``: user turn, tab, answer; turns without an answer have no tab."""
    c = table(spark, sf, "conversations")
    user = c.filter("role = 'user'").select("conv_id", "turn", one_line("text").alias("asked"))
    answer = c.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), one_line("text").alias("answered")
    )
    return user.join(answer, ["conv_id", "turn"], "left").select(
        F.concat_ws("-", "conv_id", "turn").alias("line_id"), F.concat_ws("\t", "asked", "answered").alias("line")
    )


PAIR_LINES_CTE = (
    f"asks AS (SELECT conv_id, turn, {sql.one_line('text')} AS asked FROM conversations WHERE role = 'user'), "
    f"answers AS (SELECT conv_id, turn - 1 AS turn, {sql.one_line('text')} AS answered "
    "FROM conversations WHERE role = 'assistant'), "
    "pair_lines AS (SELECT conv_id || '-' || turn AS line_id, asked || coalesce(chr(9) || answered, '') AS line "
    "FROM asks LEFT JOIN answers USING (conv_id, turn))"
)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", to_double("embedding").alias("x"))


VECTORS_CTE = "vecs AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"


def batched_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """``embeddings``, tail filled, shuffled, in full batches: ``pos, batch_no, slot, vec_id, copy, x``."""
    padded = batching.pad_tail(vectors(spark, sf), "vec_id", BATCH)
    sharded = batching.assign_shards(padded, ["vec_id", "copy"], 1, SEED)
    return batching.assign_batches(sharded, BATCH, drop_last=True).select(
        "pos", "batch_no", "vec_id", "copy", "label", "x"
    )


BATCHED_CTE = (
    f"{VECTORS_CTE}, "
    "padded AS (SELECT *, 0 AS copy FROM vecs UNION ALL SELECT vec_id, label, x, 1 FROM "
    "(SELECT *, row_number() OVER (ORDER BY vec_id) AS rn FROM vecs) "
    f"WHERE rn <= {BATCH} - (SELECT count(*) FROM vecs) % {BATCH}), "
    f"placed AS (SELECT *, row_number() OVER (ORDER BY {sql.u(SEED, 'vec_id', 'copy')}, vec_id, copy) - 1 AS pos "
    "FROM padded), "
    f"batched AS (SELECT *, pos // {BATCH} AS batch_no, pos % {BATCH} AS member FROM placed "
    f"WHERE (pos // {BATCH} + 1) * {BATCH} <= (SELECT count(*) FROM placed))"
)


def two_views(spark: SparkSession, sf: str) -> DataFrame:
    """``batched_vectors`` with a noisy second view ``y = x + 0.05 normal`` per position."""
    return batched_vectors(spark, sf).withColumn(
        "y", combine("x", normal_vector(SEED + 2, DIMS, "pos"), F.lit(1.0), F.lit(0.05))
    )


TWO_VIEWS_CTE = (
    f"{BATCHED_CTE}, "
    f"raw_views AS (SELECT *, {sql.normals(SEED + 2, DIMS, 'pos')} AS e FROM batched), "
    f"views AS (SELECT pos, batch_no, member, vec_id, x, list_transform(range(1, {DIMS + 1}), "
    "lambda i: x[i] + 0.05 * e[i]) AS y FROM raw_views)"
)


def respaced(spark: SparkSession) -> DataFrame:
    """Coefficients of the respaced schedule (10 steps)."""
    return noise.schedule(spark, "linear", STEPS, RESPACED)


RESPACED_CTE = (
    f"{sql.coefs_cte('base', sql.betas('linear', STEPS))}, "
    f"{sql.coefs_cte('sched', sql.respaced_betas('base', RESPACED_STEPS))}"
)


def predictions(spark: SparkSession, sf: str, coefs: DataFrame) -> DataFrame:
    """Logged predictions: every vector at each of the 10 steps.

    ``eps_hat`` is the true noise and a tenth of another one; ``v`` is uniform in [-1, 1).
    """
    rows = spread(vectors(spark, sf), "vec_id").withColumn("t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint"))))
    noisy = noise.add_noise(rows, coefs, ["vec_id", "t"], "x", DIMS, SEED + 3)
    other = normal_vector(SEED + 4, DIMS, "vec_id", "t")
    return noisy.select(
        "vec_id",
        "t",
        "x",
        "eps",
        "x_t",
        combine("eps", other, F.lit(1.0), F.lit(0.1)).alias("eps_hat"),
        F.transform(uniform_vector(SEED + 5, DIMS, "vec_id", "t"), lambda w: 2.0 * w - 1.0).alias("v"),
    )


# One row per vector, step and entry.
PREDICTIONS_CTE = (
    f"{RESPACED_CTE}, {VECTORS_CTE}, "
    f"steps AS (SELECT vec_id, x, unnest(range(0, 10)) AS t FROM vecs), "
    f"draws AS (SELECT vec_id, t, x, {sql.normals(SEED + 3, DIMS, 'vec_id', 't')} AS e, "
    f"{sql.normals(SEED + 4, DIMS, 'vec_id', 't')} AS o, {sql.uniforms(SEED + 5, DIMS, 'vec_id', 't')} AS w FROM steps), "
    "entries AS (SELECT vec_id, t, unnest(range(0, 64)) AS dim, unnest(x) AS x, unnest(e) AS eps, unnest(o) AS o, "
    "unnest(w) AS w FROM draws), "
    "preds AS (SELECT vec_id, t, dim, x, eps, sab * x + somab * eps AS x_t, eps + 0.1 * o AS eps_hat, "
    "2 * w - 1 AS v, s.* EXCLUDE (t) FROM entries JOIN sched s USING (t))"
)


def train_log(spark: SparkSession, sf: str) -> DataFrame:
    """``worker, step, loss, ts, event_id`` from ``events``; steps count from 1 per worker."""
    e = table(spark, sf, "events").select(
        (F.col("user_id") % 4).alias("worker"), "event_id", F.col("value").alias("loss"), "ts"
    )
    placed = batching.grouped_positions(e, ["worker"], "event_id", ["event_id"], out="at")
    return placed.withColumn("step", F.col("at") + 1).drop("at")


TRAIN_LOG_CTE = (
    "train_log AS (SELECT user_id % 4 AS worker, event_id, value AS loss, ts, "
    "row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS step FROM events)"
)
