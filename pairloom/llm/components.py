"""Connected components of a table of edges, by alternating stars."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.session import scratch_dir


_tables: list[str] = []


def written(df: DataFrame, label: str, compression: str | None = None, by: str | None = None) -> DataFrame:
    """Cut the lineage: a table in the shared folder, with a folder for each value of ``by``."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path, partitionBy=by, compression=compression)
    _tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def dropped(spark: SparkSession) -> None:
    """Remove the table that was written last; nothing may read it again."""
    _remove(spark, _tables.pop())


def decided(spark: SparkSession, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Write what ``build`` returns, and remove the tables that were written on the way.

    Nothing that is kept may still read them; the result does not, since it is a table itself.
    """
    mark = len(_tables)
    result = written(build(), label)
    for path in _tables[mark:-1]:
        _remove(spark, path)
    del _tables[mark:-1]
    return result


def spanning(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of edges as stars of the same components."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        pairs = [(x, root(x)) for x in list(parent)]
        pairs = [(x, r) for x, r in pairs if x != r]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["u", "v"]
        )


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node of its component) for every node of ``edges`` (u, v).

    Each round links every node to the smallest one around it (large star, small star); the number
    of rounds is logarithmic. The smallest neighbour is an aggregate with a partial step, so a node
    with very many edges is no hot spot; batches of edges shrink to stars before the first shuffle.
    """
    now = written(
        edges.select(F.col("u").cast("long"), F.col("v").cast("long"))
        .filter("u <> v")
        .mapInArrow(spanning, "u long, v long")
        .distinct(),
        "edges",
    )
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = written(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
