"""Approximate nearest neighbours by inner product along shifted Hilbert curves.

Inner product is turned into distance on a sphere: a candidate x becomes (x, sqrt(m*m - |x|*|x|)) / m with the
largest norm m, a query q becomes (q, 0) / |q|; the nearest point is the one with the largest product.
Each curve projects the points onto a few random directions, shifts them and orders them by the
Hilbert key of their cell. Spark range-partitions every curve by key. The ranks of a curve are cut into equal
runs; a query is compared with its own run and both neighbours in exact arithmetic, so it meets at
least one whole run of keys on either side on every curve. The best of all curves are merged. Runs grow with the
counted points: neighbours spread along a curve nearly as fast as the table grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.components import written
from pairloom.session import shuffle_width

TOP = 20
CURVES = 20
DIMS, BITS = 8, 7  # 56 bits of key
RUN = 1024  # ranks of a run up to POINTS points; a query meets its own run and one on either side
POINTS = 51_200
GROWTH = 0.95  # beyond, runs grow with this power of the points; 0.92 to 0.97 kept recall level on isotropic vectors of 64 entries
GROUP = 8  # the stored points of one task, in runs of RUN
ASKED = 256  # queries that are compared at a time
SEED = 55


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of integer cells (rows) with ``bits`` bits per coordinate.

    Gray-code descent: from the highest bit on, each coordinate with a set bit mirrors the lower bits of the
    first one, each other one swaps them with it; the Gray code of what remains is undone at the end.
    """
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    for bit in range(bits - 1, 0, -1):
        q = one << np.uint64(bit)
        low = q - one
        for i in range(dims):
            is_set = (x[i] & q) > 0
            swap = np.where(is_set, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(is_set, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        q = one << np.uint64(bit)
        turn = np.where(x[-1] & q, turn ^ (q - one), turn)
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[i] >> np.uint64(bit)) & one)
    return key.astype(np.int64)


def directions(width: int, curve: int, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal directions of a curve and its shift, the same on every executor."""
    rng = np.random.default_rng([seed, curve, width])
    basis, _ = np.linalg.qr(rng.standard_normal((width, min(dims, width))))
    return basis, rng.random(basis.shape[1])


def curve_keys(points: np.ndarray, curve: int, dims: int = DIMS, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """Keys of unit vectors on one curve."""
    basis, shift = directions(points.shape[1], curve, dims, seed)
    # A projection of a unit vector has a spread of 1 / sqrt(width); cells cover five of them, shifted by up to one.
    spread = 1 / np.sqrt(points.shape[1])
    scaled = (points @ basis) / (6 * spread) + 0.5 + (shift - 0.5) / 3
    cells = np.clip((scaled * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1)
    return hilbert_keys(cells, bits)


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(values, np.float64).reshape(rows, -1) if rows else np.zeros((0, 1))


def _distinct_vectors(vectors: DataFrame, top: int, every: int) -> DataFrame:
    """One row per different vector: its key (``first``, ``h``), ``width``, its ``top + 1`` smallest ids, ``asked``.

    More ids of one vector can never be among ``top`` results, since ties go to smaller ids. The rank limit
    also runs before the shuffle, so a vector with very many copies is no hot spot.
    """
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    few = vectors.withColumn("rank", rank).filter(F.col("rank") <= top + 1)
    ids = few.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    asked = vectors.groupBy("vec").agg(F.max(F.col("id") % every == 0).alias("asked"))
    return ids.join(asked, "vec").select(
        F.element_at("ids", 1).alias("first"), F.xxhash64("vec").alias("h"), F.size("vec").alias("width"), "vec", "ids", "asked"
    )


def run_length(points: Column, run: int = RUN, points_of_run: int = POINTS) -> Column:
    """Ranks of a run on a curve of ``points`` points."""
    return F.ceil(F.lit(run) * F.pow(F.greatest(points / F.lit(points_of_run), F.lit(1.0)), F.lit(GROWTH))).cast("long")


def nearest(
    table: DataFrame, top: int = TOP, every: int = 20, curves: int = CURVES, run: int = RUN, group: int = GROUP, seed: int = SEED,
    points_of_run: int = POINTS,
) -> DataFrame:
    """For each row of ``vec_id``, ``embedding`` with an id divisible by ``every``: its ``top`` nearest rows found.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (inner product in double precision), the largest
    first, ties to the smaller id. A query never finds rows of its own id; copies of its vector count. Vectors that
    are null, zero or hold null or non-finite components take no part, nor do rows without an id; vectors
    meet only vectors of their own width. Each point lies on ``curves`` curves, and a query is compared with at most
    three runs of each. A run has ``run`` ranks for up to ``points_of_run`` different vectors of a width and grows
    with the power ``GROWTH`` of their number beyond.
    """
    spark = table.sparkSession
    item = table.schema["embedding"].dataType.elementType.simpleString()
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    vectors = table.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vec")).filter(
        F.col("id").isNotNull() & F.coalesce(finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    )
    points = written(_distinct_vectors(vectors, top, every), "points")
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    largest = points.agg(F.max(F.sqrt(norm))).first()[0] or 1.0
    parts = 4 * shuffle_width(spark)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.asarray(batch.column("width"))
            for width in np.unique(widths):
                part = batch.filter(pa.array(widths == width))
                x = _matrix(part.column("vec"), part.num_rows)
                size = np.linalg.norm(x, axis=1) / largest
                stored = np.column_stack((x / largest, np.sqrt(np.maximum(0, 1 - size**2))))
                asked = np.asarray(part.column("asked"))
                wanted = np.column_stack((x / largest / size[:, None], np.zeros(len(x))))[asked]
                questions = part.filter(pa.array(asked))
                for curve in range(curves):
                    for kind, rows, at in ((0, part, stored), (1, questions, wanted)):
                        if rows.num_rows:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(at), curve), pa.int32()), rows.column("width"),
                                 pa.array(curve_keys(at, curve, seed=seed)), pa.array(np.full(len(at), kind), pa.int32()),
                                 rows.column("first"), rows.column("h"), rows.column("vec"), rows.column("ids")],
                                names=["curve", "width", "key", "kind", "first", "h", "vec", "ids"],
                            )

    order = ["curve", "width", "key", "kind", "first", "h"]
    keyed = f"curve int, width int, key long, kind int, first long, h long, vec array<{item}>, ids array<long>"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ranks among the stored points of a curve, inside a range partition."""
        from pyspark import TaskContext

        part, seen, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            curve = np.stack((np.asarray(batch.column("curve")), np.asarray(batch.column("width"))), 1)
            stored = np.asarray(batch.column("kind")) == 0
            rank = np.empty(len(curve), np.int64)
            edges = np.flatnonzero((np.diff(curve, axis=0) != 0).any(axis=1)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(curve)], strict=True):
                if lo == hi:
                    continue
                if last is None or tuple(curve[lo]) != last:
                    seen, last = 0, tuple(curve[lo])
                rank[lo:hi] = seen + np.cumsum(stored[lo:hi]) - stored[lo:hi]
                seen += int(stored[lo:hi].sum())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(rank), part), pa.int32()), pa.array(rank)],
                names=[*batch.schema.names, "part", "rank"],
            )

    ranged = points.mapInArrow(keys, keyed).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = written(ranged.mapInArrow(number, f"{keyed}, part int, rank long"), "ranged")
    all_ = Window.partitionBy("curve", "width")
    before = all_.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("curve", "width", "part").agg(F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).alias("n"))
    offsets = counts.select(
        "curve", "width", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(all_).alias("points")
    ).withColumn("run", run_length(F.col("points"), run, points_of_run))
    placed = ranged.join(offsets, ["curve", "width", "part"]).withColumn("rank", F.col("offset") + F.col("rank"))
    # A stored point lies in one block; a query goes to every block that its three runs touch.
    size, own = run * group, F.floor(F.col("rank") / F.col("run"))
    low = F.greatest((own - 1) * F.col("run"), F.lit(0))
    high = F.least((own + 2) * F.col("run"), F.col("points")) - 1
    near = F.when(F.col("kind") == 0, F.array(F.floor(F.col("rank") / size))).otherwise(
        F.sequence(F.floor(low / size), F.floor(high / size))
    )
    blocks = placed.withColumn("block", F.explode(near)).drop("part", "offset", "key", "points")

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("kind", "ascending"), ("rank", "ascending")])
        kind, rank = np.asarray(rows["kind"]), np.asarray(rows["rank"])
        stored, asked = rows.slice(0, int((kind == 0).sum())), rows.slice(int((kind == 0).sum()))
        x, q = _matrix(stored["vec"], stored.num_rows), _matrix(asked["vec"], asked.num_rows)
        at, wanted = rank[kind == 0], rank[kind == 1]
        first = np.asarray(stored["first"])
        ids = stored["ids"].to_pylist()
        out = []
        length = rows["run"][0].as_py()  # one per curve and width
        edges = np.flatnonzero(np.diff(wanted // length)) + 1
        for mine in (
            part[i : i + ASKED] for part in np.split(np.arange(len(wanted)), edges) for i in range(0, len(part), ASKED)
        ):
            r = wanted[mine[0]] // length
            lo, hi = np.searchsorted(at, (r - 1) * length), np.searchsorted(at, (r + 2) * length)
            if lo == hi:
                continue
            scores = q[mine] @ x[lo:hi].T
            keep = min(top + 1, hi - lo)
            # A little below the last one kept, so that rounding inside the block product drops no tie.
            floor = np.partition(scores, hi - lo - keep, axis=1)[:, hi - lo - keep]
            floor = floor - 1e-12 * np.abs(floor) - 1e-300
            for i, row in enumerate(mine):
                best = np.flatnonzero(scores[i] >= floor[i]) + lo
                exact = (x[best] * q[row]).sum(axis=1)
                best, exact = (v[np.lexsort((first[best], -exact))][: top + 1] for v in (best, exact))
                found = sorted((-s, j) for b, s in zip(best.tolist(), exact.tolist(), strict=True) for j in ids[b])[: top + 1]
                out.append((asked["first"][row].as_py(), asked["h"][row].as_py(), [{"down": s, "id": j} for s, j in found]))
        hit = pa.list_(pa.struct([("down", pa.float64()), ("id", pa.int64())]))
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        types = (pa.int64(), pa.int64(), hit)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["first", "h", "found"])

    found = blocks.groupBy("curve", "width", "block").applyInArrow(
        compare, "first long, h long, found array<struct<down:double,id:long>>"
    )
    best = found.groupBy("first", "h").agg(  # at most ``top + 1`` per curve and block
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), 1, top + 1).alias("found")
    )
    answers = points.filter("asked").select("first", "h", "vec").join(best, ["first", "h"]).select("h", "vec", "found")
    queries = vectors.filter(F.col("id") % every == 0).withColumn("h", F.xxhash64("vec"))
    results = queries.join(answers, ["h", "vec"]).select(
        F.col("id").alias("query_id"),
        F.posexplode(F.slice(F.filter("found", lambda f: f["id"] != F.col("id")), 1, top)).alias("pos", "hit"),
    )
    return results.select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.down")).alias("score")
    )
