"""A time-varying curriculum over sources, in DataFrame operations only.

Every source has a share of the training words (``targets``) and a schedule: its weight runs from
``start`` to ``end`` over training time 0 to 1. The integral of the schedule tells how much of the
target is wanted up to a time; inverting it gives each document, by its place in its source's keyed
order, the time at which it is due. Documents sorted by that time are the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.rand import uniform
from pairloom.session import shuffle_width

# By rank of the source, repeating: its weight, and its schedule at the start and the end (mean 1).
WEIGHTS = (5.0, 2.0, 1.0)
START, END = (1.5, 1.0, 0.5), (0.5, 1.0, 1.5)
SHARE, MOST = 1.5, 2.0
SEED = 606
WORD = r"[^\x20\x09-\x0D]+"


def _cycle(values: tuple[float, ...], rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (rank % len(values) + 1).cast("int"))


def targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """``source``, ``source_size``, ``rank``, ``target`` from rows of ``source``, ``size``.

    All sources share ``share`` times all words by weight. A target stops at ``most`` times its source's
    size; the excess goes to the others by weight, until none is above. With the sources in order of
    the level at which they stop, those that stop are the first ones, so one pass of running sums
    finds the level. The table has one row per source.
    """
    all_ = Window.orderBy("ratio", "rank")
    before = all_.rowsBetween(Window.unboundedPreceding, -1)
    whole = all_.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
        .withColumn("weight", _cycle(weights, F.col("rank")))
        .withColumn("most", F.col("source_size") * F.lit(most))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("stopped", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("lighter", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("total", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("weights", F.sum("weight").over(whole))
        .withColumn("level", (F.col("total") - F.col("stopped")) / (F.col("weights") - F.col("lighter")))
        .withColumn("open", F.max(F.col("level") <= F.col("ratio")).over(all_.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("chosen", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(whole))
    )
    target = F.when(F.coalesce("open", F.lit(False)), F.least("most", F.col("chosen") * F.col("weight"))).otherwise(
        F.col("most")
    )
    return sources.select("source", "source_size", "rank", target.alias("target"))


def _due(words: Column, target: Column, start: Column, end: Column) -> Column:
    """Time at which ``words`` of the target are reached.

    The demand up to time u is target * (start * u + (end - start) * u * u / 2).
    """
    share = words / target
    return F.lit(2.0) * share / (start + F.sqrt(start * start + F.lit(2.0) * (end - start) * share))


def curriculum(docs: DataFrame, seed: int = SEED, start: tuple = START, end: tuple = END, most: float = MOST) -> DataFrame:
    """What the mix takes of each document, and when.

    Adds to the columns of ``docs`` (``doc_id``, ``text``, ``source`` are needed): ``size`` (words; null text: 0),
    ``source_size``, ``target``, ``taken`` and ``positions`` (the time of each lap that takes of the document; empty if
    none does). A source is read in a keyed order, lap by lap, up to the whole words of its target, so each
    source takes just that and no document is more than one lap ahead of another. Rows without a
    source form a source of their own; rows that agree in ``doc_id``, ``source`` and size are interchangeable.

    A hot source is cut into buckets by the key of its order: bucket sums give each bucket its offset,
    and rows are summed inside their bucket only.
    """
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    buckets = 4 * shuffle_width(docs.sparkSession)
    sized = docs.withColumn("size", words).withColumn("_u", uniform(seed, "doc_id", "source"))
    sized = sized.withColumn("_bucket", F.floor(F.col("_u") * buckets).cast("int"))
    sums = sized.groupBy("source", "_bucket").agg(F.sum("size").alias("size"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("source").alias("_source"),
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("_offset"),
    )
    plan = targets(sums, most=most).withColumnRenamed("source", "_s")
    offsets = offsets.join(plan, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    inside = (
        Window.partitionBy("source", "_bucket")
        .orderBy("_u", F.asc_nulls_last("doc_id"), "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = sized.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b"))
    )
    at = F.col("_offset") + F.col("_in")
    whole = F.floor("target")
    laps = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(F.lit(0))
    rest = whole - laps * F.col("source_size")
    taken = laps * F.col("size") + F.greatest(F.lit(0), F.least("size", rest - at))
    rank = F.col("rank")
    turns = F.ceil(F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0)).cast("int")
    due = lambda lap: _due(
        at + lap * F.col("source_size"), F.col("target"), _cycle(start, rank), _cycle(end, rank)
    )
    laps_taken = F.when(F.lit(1) <= turns, F.sequence(F.lit(0), turns - 1)).otherwise(F.array().cast("array<int>"))
    return (
        placed.withColumn("taken", taken.cast("long"))
        .withColumn("positions", F.transform(laps_taken, due))
        .drop("_u", "_bucket", "_in", "_source", "_b", "_offset", "rank")
    )


def training_order(mixed: DataFrame, untaken: bool = False) -> DataFrame:
    """One row per lap that takes of a document, range-sorted by ``position``; ``untaken`` keeps the others, without a lap."""
    size = F.col("size")
    explode = F.posexplode_outer if untaken else F.posexplode
    laps = mixed.select(*mixed.columns, explode("positions").alias("lap", "position")).drop("positions")
    words = F.when(F.col("lap").isNotNull(), F.least(size, F.col("taken") - F.col("lap") * size))
    return laps.withColumn("words", words).orderBy("position", F.asc_nulls_last("doc_id"), "lap")


def first_positions(mixed: DataFrame) -> DataFrame:
    """One row per document from its laps in ``training_order``, range-sorted by ``first_position`` (null: not taken, last).

    ``taken`` is the sum of the words of its laps. Rows that agree in all columns are put together and dealt out again.
    """
    laps = training_order(mixed.withColumn("_first", F.get("positions", F.lit(0))), untaken=True)
    own = [c for c in mixed.columns if c not in ("taken", "positions")]
    copies = F.sum(F.when(F.coalesce("lap", F.lit(0)) == 0, 1).otherwise(0)).cast("int")
    documents = laps.groupBy(*own, "_first").agg(
        F.min("position").alias("first_position"), F.coalesce(F.sum("words"), F.lit(0)).alias("_words"), copies.alias("_copies")
    )
    return (
        documents.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .withColumn("taken", F.expr("_words div _copies"))
        .orderBy(F.asc_nulls_last("first_position"), F.asc_nulls_last("doc_id"))
        .select(*own, "taken", "first_position")
    )
