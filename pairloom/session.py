"""Session helpers: a local session for tests and benches, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", app: str = "pairloom", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_roots: dict[str, str] = {}


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Every executor must see the folder, so on a cluster the setting is required. Only a local
    master may fall back to a temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _local_roots.setdefault(app, "") or tempfile.mkdtemp(prefix="pairloom-")
        _local_roots[app] = root
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def place(df: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """Shuffle by ``keys`` ahead of heavy work on small rows, to at least ``least`` partitions.

    The width is explicit, because adaptive execution merges partitions by bytes and would give
    one task all of the work.
    """
    return df.repartition(max(shuffle_width(df.sparkSession), least), *keys)


def planned_bytes(df: DataFrame) -> int:
    """The size of a frame as the optimizer estimates it; no job runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def split_bytes(spark: SparkSession) -> int:
    """The largest split of a file scan."""
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(limit)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle by ``keys`` where the frame is too small to fill a split for each core.

    Meant for heavy work on a small file; a large table has tasks enough and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if planned_bytes(df) >= cores * split_bytes(df.sparkSession) else df.repartition(cores, *keys)
