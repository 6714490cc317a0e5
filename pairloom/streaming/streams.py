"""The three incremental computations as streams: window means, keep-first keys, loss history.

State lies on disk (RocksDB) and is bounded: by the watermark for windows and keys, by ``n`` numbers per key for
histories, whose changed keys replace their rows in a table instead of being appended to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pairloom.session import scratch_dir

_HISTORY = "key string, salt int, n bigint, orders array<bigint>, losses array<double>"


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """RocksDB for the queries started inside; the setting of the session comes back afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def stream_windowed_mean(
    stream: DataFrame, ts: str, value: str, window: str, delay: str, keys: list[str] | None = None
) -> DataFrame:
    """Mean of ``value`` per tumbling event-time window; rows later than ``delay`` are dropped."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, window), *(keys or []))
        .agg(F.count("*").alias("n"), F.avg(value).alias("mean_loss"))
        .select(F.col("window.start").alias("window_start"), *(keys or []), "n", "mean_loss")
    )


def stream_keep_first(stream: DataFrame, key: list[str], ts: str, delay: str, salts: int = 16) -> DataFrame:
    """Keys that are seen for the first time within ``delay`` of event time.

    A key is remembered until the watermark has passed its first row by ``delay``, so the state holds the keys of that long
    and no more, however long the stream runs; a key that comes again later is given again.

    A stream drops duplicates only behind the shuffle. So a first round drops them per key and
    group of scan tasks, and the second one gets at most ``salts`` rows per key and batch. The
    groups only decide where a copy is dropped, not whether.
    """
    salt = F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt")
    groups = stream.withWatermark(ts, delay).select(*key, ts, salt)
    first = groups.dropDuplicatesWithinWatermark([*key, "_salt"])
    return first.dropDuplicatesWithinWatermark(key).select(*key)


def stream_loss_history(
    stream: DataFrame, key: str, order: str, loss: str, n: int = 10, salts: int = 16
) -> DataFrame:
    """The last ``n`` losses per key: in each micro-batch, a snapshot of every key that it changed.

    Run it with `run_latest`, which keeps the newest snapshot of each key and nothing else. A key is spread
    over ``salts`` state groups, so a hot key is no hot task; each keeps its own
    last ``n``, and `latest_history` merges them. State is ``n`` numbers per group.
    """

    def update(
        group: tuple, chunks: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        count, orders, losses = state.get if state.exists else (0, [], [])
        kept = pd.DataFrame({"o": list(orders), "l": list(losses)})
        for chunk in chunks:
            count += len(chunk)
            fresh = chunk[["o", "l"]].nlargest(n, "o")
            kept = (pd.concat([kept, fresh]) if len(kept) else fresh).nlargest(n, "o")
        kept = kept.sort_values("o")
        orders, losses = kept["o"].astype("int64").tolist(), kept["l"].astype(float).tolist()
        state.update((count, orders, losses))
        yield pd.DataFrame(
            {"key": [group[0]], "salt": [group[1]], "n": [count], "orders": [orders], "losses": [losses]}
        )

    rows = stream.select(
        F.col(key).cast("string").alias("key"),
        F.pmod(F.xxhash64(order), F.lit(salts)).cast("int").alias("salt"),
        F.col(order).cast("bigint").alias("o"),
        F.col(loss).cast("double").alias("l"),
    )
    return rows.groupBy("key", "salt").applyInPandasWithState(
        update,
        _HISTORY,
        "n bigint, orders array<bigint>, losses array<double>",
        "update",
        GroupStateTimeout.NoTimeout,
    )


def latest_history(snapshots: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` losses per key from one snapshot per key and salt: ``key, n_seen, losses`` in order."""
    pairs = F.flatten(F.collect_list(F.arrays_zip(F.col("orders").alias("o"), F.col("losses").alias("l"))))
    merged = snapshots.groupBy("key").agg(F.sum("n").alias("n_seen"), F.sort_array(pairs, False).alias("p"))
    return merged.select(
        "key", "n_seen", F.reverse(F.transform(F.slice("p", 1, n), lambda e: e["l"])).alias("losses")
    )


def run_available(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over what is there now, into files in the shared folder, and read them back."""
    root = scratch_dir(spark, label)
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{root}/state")
        .option("path", f"{root}/rows")
        .trigger(availableNow=True)
    )
    with _state_on_disk(spark):
        writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def run_latest(spark: SparkSession, stream: DataFrame, keys: list[str], label: str, root: str | None = None) -> DataFrame:
    """Run a stream in update mode over what is there now; the newest row of each of ``keys``, nulls compared too.

    Batch b reads the table of the batch before, replaces the rows whose keys it changed and writes a table of its own; older ones
    than the one before are removed. So what lies on disk grows with the keys, not with the batches, and a batch
    that is run again after a failure finds its input unchanged. With ``root`` a later call goes on where this one ended.
    """
    root = root or scratch_dir(spark, label)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions() -> list[int]:
        found = files.globStatus(hadoop(f"{root}/table-*/_SUCCESS")) or []
        return sorted(int(f.getPath().getParent().getName().rsplit("-", 1)[1]) for f in found)

    def table(version: int) -> DataFrame:
        return spark.read.schema(stream.schema).parquet(f"{root}/table-{version}")

    def merge(changed: DataFrame, batch: int) -> None:
        rows = changed
        before = [v for v in versions() if v < batch]
        if before:
            same = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
            kept = table(before[-1]).alias("old").join(changed.select(*keys).alias("new"), same, "left_anti")
            rows = kept.unionByName(changed)
        rows.write.mode("overwrite").parquet(f"{root}/table-{batch}")
        for old in before[:-1]:
            files.delete(hadoop(f"{root}/table-{old}"), True)

    writer = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", f"{root}/state")
        .foreachBatch(merge)
        .trigger(availableNow=True)
    )
    with _state_on_disk(spark):
        writer.start().awaitTermination()
    done = versions()
    return table(done[-1]) if done else spark.createDataFrame([], stream.schema)
