"""Repeatable order, shards and batches.

A position in a global order is found without one task that sorts everything: rows fall into
buckets by a value that keeps the order, the bucket sizes give each bucket its offset, and rows
are ranked inside their bucket only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.rand import uniform
from pairloom.operators.stretches import DEPTH, STRETCH, TIE, cut_stretches, same_keys
from pairloom.session import shuffle_width


def union_sources(*frames: DataFrame) -> DataFrame:
    """Concatenate by column name and number the sources in ``source_no``."""
    tagged = [f.withColumn("source_no", F.lit(i)) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def shuffle_head(df: DataFrame, key: str, seed: int, n: int | None = None) -> DataFrame:
    """Keyed shuffle; with ``n``, its first rows (a top-n, not a full sort)."""
    order = df.orderBy(uniform(seed, key), key)
    return order if n is None else order.limit(n)


def shuffle_positions(
    df: DataFrame, key: list[str], seed: int, epoch: int = 0, buckets: int | None = None, out: str = "pos"
) -> DataFrame:
    """Position of every row in a keyed shuffle, 0 to n-1. ``key`` must be unique.

    The sort value is uniform in [0, 1), so equal slices of it are equal buckets whatever the data.
    The offset table has at most ``buckets`` rows and is broadcast.
    """
    return _shuffle_positions(df, key, seed + epoch, buckets, out).drop("_total")


def _shuffle_positions(
    df: DataFrame, key: list[str], seed: int, buckets: int | None, out: str
) -> DataFrame:
    """The positions, and the row count in ``_total``: the bucket sizes give both in one pass."""
    buckets = buckets or 4 * shuffle_width(df.sparkSession)
    keyed = df.withColumn("_u", uniform(seed, *key)).withColumn(
        "_bucket", F.floor(F.col("_u") * buckets).cast("int")
    )
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("_bucket")
        .count()
        .select(
            "_bucket",
            F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"),
            F.sum("count").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"),
        )
    )
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_u", *key))
    return (
        keyed.withColumn("_rank", inside)
        # Every bucket has its offset. The outer join and the coalesce keep the optimizer from
        # testing the bucket for null first, which would take every digest twice.
        .join(F.broadcast(offsets), "_bucket", "left")
        .withColumns(
            {
                out: F.coalesce("_offset", F.lit(0)) + F.col("_rank") - 1,
                "_total": F.coalesce("_total", F.lit(0)),
            }
        )
        .drop("_u", "_bucket", "_rank", "_offset")
    )


def grouped_positions(
    df: DataFrame, keys: list[str], order: str, ties: list[str] | None = None, out: str = "pos", depth: int = DEPTH
) -> DataFrame:
    """Position of every row among the rows of its keys by ``order``, equal values by a hash of ``ties`` (all columns if not given).

    Keys with a large share of the rows are cut in stretches of equal size (``cut_stretches``) and ranked by many tasks,
    whatever the values of ``order`` are. Null keys form a key of their own, and rows without an order come last in their
    key; every row has a position. The rows are shuffled once: only keys that are cut, whose number is bounded, need offsets.
    """
    cut = cut_stretches(df, keys, order, ties, depth)
    before = Window.partitionBy(*keys).orderBy(STRETCH).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.filter(F.col(STRETCH).isNotNull())
        .groupBy(*keys, STRETCH)
        .count()
        .select(
            *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
            F.col(STRETCH).alias("_at"),
            F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"),
        )
    )
    inside = F.row_number().over(Window.partitionBy(*keys, STRETCH).orderBy(F.asc_nulls_last(order), TIE))
    return (
        cut.withColumn("_rank", inside)
        .join(F.broadcast(offsets), same_keys(keys) & (F.col(STRETCH) == F.col("_at")), "left")
        .withColumn(out, F.coalesce("_offset", F.lit(0)) + F.col("_rank") - 1)
        .drop(STRETCH, TIE, "_rank", "_offset", "_at", *[f"_key{i}" for i in range(len(keys))])
    )


def last_rows(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last ``n`` rows per key by ``order``; rows without an order come before all others.

    A key is dealt into lots by a hash of its order: the last ``n`` of the key are among the last ``n``
    of its lots. So many tasks rank a hot key, whatever ``n`` is, and at most ``n`` rows per lot meet. Null
    keys form a key of their own.
    """
    lots = 4 * shuffle_width(df.sparkSession)
    newest = F.desc_nulls_last(order)
    dealt = df.withColumn("_lot", F.pmod(F.xxhash64(order), F.lit(lots)))
    in_lot = F.row_number().over(Window.partitionBy(*keys, "_lot").orderBy(newest))
    few = dealt.withColumn("_rank", in_lot).filter(F.col("_rank") <= n)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(newest))
    return few.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank", "_lot")


def pad_tail(df: DataFrame, order: str, size: int, exact: bool = False, ties: list[str] | None = None) -> DataFrame:
    """Append copies of the first ``size - n % size`` rows; ``copy`` tells 0 from 1.

    Where ``size`` divides ``n`` that is one whole extra batch; ``exact`` leaves it out. ``order``, with the columns ``ties``
    behind it, must tell the first rows apart, or the job stops. Only these columns are read to find the last row to be copied
    (a top-``size``); the rows themselves pass once, and those up to it come twice.
    """
    key = F.struct(order, *(ties or []))
    missing = F.lit(size) - df.agg(F.count("*")).scalar() % size
    if exact:
        missing = missing % size
    first = df.select(key.alias("_key")).orderBy("_key").limit(size + 1).agg(F.array_sort(F.collect_list("_key")).alias("_keys"))
    first = first.withColumn("_n", F.least(missing, F.size("_keys")).cast("int"))
    last, following = F.get("_keys", F.col("_n") - 1), F.get("_keys", F.col("_n"))
    same = F.raise_error(F.lit(f"rows of one {order} can not be told apart"))
    bound = first.select(F.when((F.col("_n") > 0) & (last == following), same).otherwise(last)).scalar()
    # Without a row to copy there is no bound, and the comparison is null.
    twice = F.when(key <= F.col("_bound"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.withColumn("_bound", bound).select(*df.columns, F.explode_outer(twice).alias("copy"))


def assign_shards(
    df: DataFrame, key: list[str], world: int, seed: int, epoch: int = 0, buckets: int | None = None
) -> DataFrame:
    """Shuffle, wrap around until every shard has the same size, row i to shard ``i mod world``.

    Adds ``pos``, ``shard``, ``slot`` (the place inside the shard) and ``shard_size``.
    """
    placed = _shuffle_positions(df, key, seed + epoch, buckets, "pos").withColumn(
        "shard_size", F.ceil(F.col("_total") / world)
    )
    if world > 1:
        # Later laps over the order fill the places from _total on.
        places = F.sequence(F.col("pos"), F.col("shard_size") * world - 1, F.col("_total"))
        placed = placed.withColumn("pos", F.explode(places))
    return placed.withColumns(
        {"shard": F.col("pos") % world, "slot": F.floor(F.col("pos") / world)}
    ).drop("_total")


def assign_batches(df: DataFrame, size: int, drop_last: bool) -> DataFrame:
    """Number the batches of each shard. ``drop_last`` leaves out a short last batch.

    All shards have the same size, so a short batch shows without counting its rows.
    """
    numbered = df.withColumn("batch_no", F.floor(F.col("slot") / size))
    if not drop_last:
        return numbered
    return numbered.filter((F.col("batch_no") + 1) * size <= F.col("shard_size"))


def zip_pairs(left: DataFrame, right: DataFrame, pos: str) -> DataFrame:
    """Align two frames by position. A position that only one side has is an error."""
    l, r = left.alias("l"), right.alias("r")
    both = l.join(r, F.col(f"l.{pos}") == F.col(f"r.{pos}"), "full_outer")
    paired = F.col(f"l.{pos}").isNotNull() & F.col(f"r.{pos}").isNotNull()
    checked = F.when(paired, F.col(f"l.{pos}")).otherwise(
        F.raise_error(F.lit("the two sides differ in length"))
    )
    columns = [F.col(f"l.{c}") for c in left.columns if c != pos]
    columns += [F.col(f"r.{c}") for c in right.columns if c != pos]
    return both.select(checked.alias(pos), *columns)


def keep_first(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of every key in order of arrival; a row without an order loses to any other.

    ``row_number() = 1`` keeps one row per key and task before the shuffle (WindowGroupLimit), so
    a key with many copies is no hot spot.
    """
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.asc_nulls_last(order)))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
