"""Summaries of training logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.batching import last_rows
from pairloom.operators.rows import unnest_structs


def windowed_loss(
    df: DataFrame, step: str, loss: str, worker: str, ts: str | None = None, every: int = 100
) -> DataFrame:
    """Every ``every`` steps: the mean loss per worker, averaged over the workers.

    ``step`` counts from 1 per worker. A window that is not full for a worker is not reported for
    it. With ``ts``, ``steps_per_sec`` is the speed of the lowest worker since its last report (in
    its first window, since its first step).
    """
    aggs = [F.count("*").alias("n"), F.avg(loss).alias("mean_loss")]
    if ts is not None:
        seconds = F.col(ts).cast("timestamp").cast("double")
        aggs += [F.min(seconds).alias("started"), F.max(seconds).alias("ended")]
    per_worker = (
        df.groupBy(F.col(worker).alias("worker"), F.floor((F.col(step) - 1) / every).alias("window_no"))
        .agg(*aggs)
        .filter(F.col("n") == every)
    )
    if ts is not None:
        # Each window also tells the next one when it ended. The two meet in a small aggregate: the
        # log is read once, and no worker is sorted in one task.
        none = F.lit(None).cast("double")
        own = F.struct("window_no", "mean_loss", "started", "ended", none.alias("since"))
        told = F.struct(
            (F.col("window_no") + 1).alias("window_no"),
            none.alias("mean_loss"),
            none.alias("started"),
            none.alias("ended"),
            F.col("ended").alias("since"),
        )
        per_worker = (
            unnest_structs(per_worker, ["worker"], F.array(own, told), "window_no")
            .groupBy("worker", "window_no")
            .agg(*[F.max(c).alias(c) for c in ("mean_loss", "started", "ended", "since")])
            .filter(F.col("mean_loss").isNotNull())
            .withColumn(
                "speed",
                F.try_divide(F.lit(float(every)), F.col("ended") - F.coalesce("since", "started")),
            )
        )
    out = [F.count("*").alias("workers"), F.avg("mean_loss").alias("mean_loss")]
    if ts is not None:
        out.append(F.min_by("speed", "worker").alias("steps_per_sec"))
    return (
        per_worker.groupBy("window_no")
        .agg(*out)
        .withColumn("step", (F.col("window_no") + 1) * every)
        .drop("window_no")
    )


def trailing_mean(df: DataFrame, keys: list[str], order: str, value: str, n: int = 1000) -> DataFrame:
    """Mean of the last ``n`` values per key."""
    return (
        last_rows(df.select(*keys, order, value), keys, order, n)
        .groupBy(*keys)
        .agg(F.count("*").alias("n"), F.avg(value).alias("trailing_mean"))
    )
