"""Equal-depth stretches: cut the rows of each key in ordered parts of about equal size.

Whatever has to rank the rows of a key does so stretch by stretch, so a key with a third of all rows is many tasks. The
bounds of a key are quantiles of a sample, not steps of its value range: the rows whose hashes are the smallest of the key,
which every task can cut down to by itself. Values that fill several stretches on their own are told apart by the hash of the
row, so rows of one order value are spread, too. As the sample depends on nothing but the rows, every evaluation gives the
same bounds.

A key gets stretches in proportion to its share of all rows: ``PARTS_PER_TASK`` for each shuffle partition that it would
fill, of at least ``depth`` rows. All keys together thus have at most twice as many bounds as that, and keys with less
than one share, however many there are, have none. That bounds what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions.util import let
from pairloom.session import shuffle_width

PARTS_PER_TASK = 4
DEPTH = 100_000  # fewest rows of a stretch
MOST = 1024  # stretches of a key
SAMPLED = 16  # one row in so many can get into the sample of its key
SAMPLE = 4 * MOST  # rows of a key's sample
STEP = 32  # bounds are searched in two steps of this many

STRETCH, TIE = "_stretch", "_tie"


def _hashable(df: DataFrame) -> list[str]:
    def fits(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return fits(kind.elementType)
        if isinstance(kind, T.StructType):
            return all(fits(f.dataType) for f in kind.fields)
        return not isinstance(kind, (T.MapType, T.VariantType))

    return [f.name for f in df.schema if fits(f.dataType)]


def _bounds(df: DataFrame, keys: list[str], order: str, width: int, depth: int) -> DataFrame:
    """Keys with at least two shares of the rows, and their stretches' upper bounds in order."""
    total = df.agg(F.count("*")).scalar()
    hashed = Window.partitionBy(*keys).orderBy(TIE)
    few = df.filter(F.pmod(TIE, F.lit(SAMPLED)) == 0).withColumn("_rank", F.row_number().over(hashed)).filter(F.col("_rank") <= SAMPLE)
    sampled = few.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.max(_share(TIE)).alias("_upto"), F.array_sort(F.collect_list(order)).alias("_q")
    )
    # A full sample is that part of the key's rows whose hashes lie below its last one.
    rows = F.when(F.col("_n") < SAMPLE, F.col("_n")).otherwise(F.col("_n") / F.col("_upto")) * SAMPLED
    parts = F.least(rows / F.greatest(total, F.lit(1)) * PARTS_PER_TASK * width, rows / depth, F.lit(MOST))
    bounds = F.transform(
        F.sequence(F.lit(1), F.col("_parts") - 1),
        lambda i: F.element_at("_q", (F.floor(i * F.size("_q") / F.col("_parts")) + 1).cast("int")),
    )
    hot = sampled.withColumn("_parts", F.ceil(parts).cast("int")).filter("_parts > 1")
    none = F.array().cast(T.ArrayType(df.schema[order].dataType))  # for a key without any order value
    return hot.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
        "_parts",
        F.when(F.size("_q") > 0, bounds).otherwise(none).alias("_bounds"),
    )


def _share(tie: str) -> Column:
    """The hash of a row as a number from 0 to 1."""
    return F.col(tie).cast("double") / 2.0**64 + 0.5


def same_keys(keys: list[str]) -> Column:
    """Join condition: the keys agree with ``_key0``, ``_key1``, ..., nulls too."""
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return same


def _spread(parts: Column) -> Column:
    """A number below ``parts`` that grows with the hash of the row."""
    return F.least(F.floor(_share(TIE) * parts), parts - 1).cast("int")


def _find(bounds: Column, value: Column) -> Column:
    """How many bounds are below ``value``, and how many equal it, as a struct.

    Two short searches, through every ``STEP``-th bound and then through one step, instead of one through all.
    """
    every = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(bounds) - 1) / STEP).cast("int")), lambda i: F.get(bounds, i * STEP)
    )

    def count(test) -> Column:
        """Bounds that pass ``test``, which holds up to some place and for none behind it."""
        coarse = F.greatest(F.size(F.filter(every, test)) - 1, F.lit(0)) * STEP
        return let(coarse, lambda at: at + F.size(F.filter(F.slice(bounds, at + 1, STEP), test)))

    below, upto = count(lambda b: b < value), count(lambda b: b <= value)
    return F.struct(below.alias("below"), (upto - below).alias("same"))


def cut_stretches(df: DataFrame, keys: list[str], order: str, ties: list[str] | None = None, depth: int = DEPTH) -> DataFrame:
    """Add ``_stretch`` and ``_tie``.

    Inside a key the rows ordered by (``_stretch``, ``order``, ``_tie``) are ordered by ``order`` with nulls last and equal
    values by the hash of ``ties`` (all columns that can be hashed, if not given). ``_stretch`` is null for keys that are not cut.
    """
    tied = df.withColumn(TIE, F.xxhash64(*(ties or _hashable(df))))
    slim = tied.select(*dict.fromkeys((*keys, order)), TIE)
    bounds = _bounds(slim, keys, order, shuffle_width(df.sparkSession), depth)
    joined = tied.join(F.broadcast(bounds), same_keys(keys), "left")
    place = let(
        _find(F.col("_bounds"), F.col(order)),
        lambda f: f["below"] + F.when(f["same"] > 0, _spread(f["same"] + 1)).otherwise(F.lit(0)),
    )
    last = F.size("_bounds") + 1 + _spread(F.col("_parts"))
    stretch = F.when(F.col("_parts").isNotNull(), F.when(F.col(order).isNull(), last).otherwise(place))
    return joined.withColumn(STRETCH, stretch).drop("_bounds", "_parts", *[f"_key{i}" for i in range(len(keys))])
