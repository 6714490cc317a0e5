"""Training logs, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.operators import logs
from pairloom.operators.rows import unnest
from pairloom.plans import fixtures as fx
from pairloom.plans import sql
from pairloom.plans.registry import query, table
from pairloom.streaming import streams

_SECONDS = "epoch_us({0}) / 1000000.0::DOUBLE"


@query(
    "windowed_loss",
    f"WITH {fx.TRAIN_LOG_CTE}, w AS (SELECT worker, (step - 1) // 100 AS win, count(*) AS n, avg(loss) AS mean_loss, "
    f"min({_SECONDS.format('ts')}) AS started, max({_SECONDS.format('ts')}) AS ended FROM train_log GROUP BY ALL HAVING count(*) = 100), "
    "s AS (SELECT a.*, 100.0::DOUBLE / nullif(a.ended - coalesce(b.ended, a.started), 0) AS speed FROM w a "
    "LEFT JOIN w b ON b.worker = a.worker AND b.win = a.win - 1) "
    f"SELECT (win + 1) * 100 AS step, count(*) AS workers, {sql.r6('avg(mean_loss)')} AS mean_loss, "
    f"{sql.r6('arg_min(speed, worker)')} AS steps_per_sec FROM s GROUP BY win",
)
def windowed_loss(spark, sf):
    out = logs.windowed_loss(fx.train_log(spark, sf), "step", "loss", "worker", "ts", 100)
    return out.select(
        "step", "workers", F.round("mean_loss", 6).alias("mean_loss"), F.round("steps_per_sec", 6).alias("steps_per_sec")
    )


@query(
    "trailing_mean",
    "WITH r AS (SELECT event_type, value FROM events QUALIFY row_number() OVER "
    "(PARTITION BY event_type ORDER BY event_id DESC) <= 1000) "
    f"SELECT event_type, count(*) AS n, {sql.r6('avg(value)')} AS trailing_mean FROM r GROUP BY event_type",
)
def trailing_mean(spark, sf):
    out = logs.trailing_mean(table(spark, sf, "events"), ["event_type"], "event_id", "value", 1000)
    return out.withColumn("trailing_mean", F.round("trailing_mean", 6))


@query(
    "trailing_mean_long",
    "WITH e AS (SELECT CASE WHEN event_id % 3 > 0 THEN event_type END AS kind, event_id, value FROM events), "
    "r AS (SELECT kind, value FROM e QUALIFY row_number() OVER (PARTITION BY kind ORDER BY event_id DESC) <= 2500) "
    f"SELECT kind, count(*) AS n, {sql.r6('avg(value)')} AS trailing_mean FROM r GROUP BY kind",
)
def trailing_mean_long(spark, sf):
    """More rows than Spark's rank limit, and a third of all rows without a key."""
    kind = F.when(F.col("event_id") % 3 > 0, F.col("event_type"))
    out = logs.trailing_mean(table(spark, sf, "events").withColumn("kind", kind), ["kind"], "event_id", "value", 2500)
    return out.withColumn("trailing_mean", F.round("trailing_mean", 6))


def _stream(spark, sf):
    schema = table(spark, sf, "events").schema
    # The table may be a file or a folder of part files; a pattern may stand for either.
    raw = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_window",
    "WITH w AS (SELECT date_trunc('day', ts) AS d, event_type, count(*) AS n, avg(value) AS m FROM events GROUP BY ALL) "
    f"SELECT strftime(d, '%Y-%m-%d') AS day, event_type, n, {sql.r6('m')} AS mean_loss FROM w "
    "WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
)
def stream_window(spark, sf):
    means = streams.stream_windowed_mean(_stream(spark, sf), "ts", "value", "1 day", "1 hour", ["event_type"])
    closed = streams.run_available(spark, means, "window")
    return closed.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"),
        "event_type",
        "n",
        F.round("mean_loss", 6).alias("mean_loss"),
    )


@query("stream_dedup_keys", "SELECT DISTINCT user_id FROM events")
def stream_dedup_keys(spark, sf):
    """State for two days of keys; a user who comes back later is given again, so the output is made distinct at last."""
    keys = streams.stream_keep_first(_stream(spark, sf), ["user_id"], "ts", "2 days")
    return streams.run_available(spark, keys, "keys").distinct()


@query(
    "stream_loss_history",
    "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn, "
    "count(*) OVER (PARTITION BY event_type) AS n FROM events) "
    f"SELECT event_type AS key, n AS n_seen, 10 - rn AS place, {sql.r6('value')} AS loss FROM r WHERE rn <= 10",
)
def stream_loss_history(spark, sf):
    history = streams.stream_loss_history(_stream(spark, sf), "event_type", "event_id", "value")
    snapshots = streams.run_latest(spark, history, ["key", "salt"], "history")
    latest = streams.latest_history(snapshots)
    rows = unnest(latest, ["key", "n_seen"], "losses", "loss", "place")
    return rows.withColumn("loss", F.round("loss", 6))
