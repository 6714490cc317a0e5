"""Centroid clustering of integer vectors, each assigned by a tournament of bisecting planes.

For centroids i < j the plane between them has the integer normal 2 (c_j - c_i) and the threshold
|c_j|^2 - |c_i|^2: a vector is strictly nearer to j if its product with the normal is above the threshold, and i, the
smaller number, wins on the plane itself. A vector meets the centroids in the order of their numbers, the loser of each
test is out, so k - 1 tests find the nearest one; only its distance is then computed.

Vectors are packed once as integers into a table of the shared folder. A round is one pass over it: each task adds
up its vectors by cluster, and one row per cluster and task is all that leaves it. Only the k centroids and
their sums reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.components import written

CENTROIDS, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, 3
EXACT = float(1 << 52)  # sums of products below this are exact in double precision
SUMS = pa.schema([("cluster", pa.int32()), ("sums", pa.list_(pa.decimal128(38, 0)))])


def integer_cells(vectors: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are ``width`` finite components, and those rows as integers floor(scale * x)."""
    kept = pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False).to_numpy(zero_copy_only=False)
    flat = vectors.filter(pa.array(kept)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(int(kept.sum()), width)  # a null component is NaN here
    finite = np.isfinite(x).all(axis=1)
    kept[kept] = finite
    cells = np.floor(scale * x[finite])
    largest = np.abs(cells).max(initial=0.0)
    if largest >= 1 << 30 or width * (2 * int(largest)) ** 2 >= 1 << 63:
        raise ValueError(f"a component of {largest / scale} is too large for exact integer distances")
    return kept, cells.astype(np.int32)


def pack_vectors(table: DataFrame, dims: int, scale: int) -> DataFrame:
    """Kept vectors as blocks (``ids``, ``cells``: 32-bit integers), one per Arrow batch, as a written table."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, cells = integer_cells(batch.column("vec"), dims, scale)
            if len(cells):
                ids = batch.column("id").filter(pa.array(kept)).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids], pa.list_(pa.int64())), pa.array([cells.tobytes()], pa.binary())], names=["ids", "cells"]
                )

    rows = table.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vec"))
    return written(rows.mapInArrow(pack, "ids array<long>, cells binary"), "vectors")


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[list, np.ndarray]]:
    for batch in batches:
        for ids, cells in zip(batch.column("ids"), batch.column("cells"), strict=True):
            yield ids.as_py(), np.frombuffer(cells.as_py(), np.int32).reshape(-1, dims).astype(np.int64)


def first_centroids(blocks: DataFrame, count: int, dims: int, seed: int) -> np.ndarray:
    """The ``count`` vectors with the smallest hash of seed and id, in that order; equal hashes by their components."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = []
        for ids, cells in _blocks(batches, dims):
            hashed = [(i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), at) for at, i in enumerate(ids)]
            hashed.sort()
            # Rows of one id may differ in their components; all that tie with the last one stay until those are compared.
            cut = hashed[min(count, len(hashed)) - 1][:2]
            near = [(none, h, cells[at].tolist()) for none, h, at in hashed if (none, h) <= cut]
            best = sorted(best + near)[:count]
        columns = list(zip(*best, strict=True)) if best else [[], [], []]
        types = (pa.bool_(), pa.string(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["none", "hash", "cells"]
        )

    found = blocks.mapInArrow(smallest, "none boolean, hash string, cells array<long>")
    rows = found.orderBy("none", "hash", "cells").limit(count).collect()
    return np.array([r["cells"] for r in rows], np.int64).reshape(-1, dims)


class Bisectors:
    """Normals and thresholds of all pairs of centroids."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        norms = (centroids**2).sum(axis=1)
        self.normals = 2 * (centroids[None, :, :] - centroids[:, None, :])
        self.thresholds = norms[None, :] - norms[:, None]
        self.longest = np.sqrt((self.normals.astype(np.float64) ** 2).sum(axis=2).max(initial=0.0))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of every row and its squared distance."""
        if not len(x):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        length = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max())
        # The same sums either way: doubles are exact here, and much faster.
        kind = np.float64 if length * self.longest < EXACT else np.int64
        rows, normals = x.astype(kind), self.normals.astype(kind)
        best = np.zeros(len(x), np.int64)
        for rival in range(1, len(self.centroids)):
            holders = best.copy()
            for holder in np.unique(holders):
                mine = np.flatnonzero(holders == holder)
                best[mine[rows[mine] @ normals[holder, rival] > self.thresholds[holder, rival]]] = rival
        return best, ((x - self.centroids[best]) ** 2).sum(axis=1)


def cluster_sums(blocks: DataFrame, centroids: np.ndarray) -> dict[int, list[int]]:
    """Per non-empty cluster: the sum of every component, the number of vectors, the sum of squared distances."""
    count, dims = centroids.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = Bisectors(centroids)
        sums: dict[int, list[int]] = {}
        for _, x in _blocks(batches, dims):
            best, distance = planes.assign(x)
            for c in np.unique(best).tolist():
                mine = best == c
                new = [*x[mine].sum(axis=0).tolist(), int(mine.sum()), sum(distance[mine].tolist())]
                sums[c] = [a + b for a, b in zip(sums.get(c, [0] * len(new)), new, strict=True)]
        values = [[Decimal(v) for v in s] for s in sums.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), f.type) if f.name == "cluster" else pa.array(values, f.type) for f in SUMS], schema=SUMS
        )

    parts = blocks.mapInArrow(add_up, "cluster int, sums array<decimal(38,0)>")
    entries = parts.select("cluster", F.posexplode("sums").alias("pos", "value"))
    total: dict[int, list[int]] = {}
    for r in entries.groupBy("cluster", "pos").agg(F.sum("value").alias("value")).collect():  # (dims + 2) * count rows
        total.setdefault(r["cluster"], [0] * (dims + 2))[r["pos"]] = int(r["value"])
    return total


def cluster(
    table: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED
) -> DataFrame:
    """Clusters of the vectors of ``vec_id``, ``embedding`` with exactly ``dims`` components, none null or non-finite.

    Components become integers floor(scale * x); those whose squared distances could exceed a long raise an error. The first centroids are the
    ``count`` vectors with the smallest hexadecimal sha256 of ``seed:vec_id`` (null ids last, equal hashes by their
    components; all vectors if there are fewer, repeated rows count each). Every round assigns the vectors, ties to the
    smaller number, and moves each non-empty centroid to floor(sum / count) of its vectors, component by component. Returns ``vec_id``, ``cluster``,
    ``distance`` (squared), ``cluster_inertia``, ``inertia`` and ``centroid_sha256``, one row per kept vector, none for an
    empty table. Other columns of the table are not read.
    """
    spark = table.sparkSession
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    blocks = pack_vectors(table, dims, scale)
    centroids = first_centroids(blocks, count, dims, seed)
    if not len(centroids):
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        for c, sums in cluster_sums(blocks, centroids).items():
            centroids[c] = [s // sums[dims] for s in sums[:dims]]
    final = cluster_sums(blocks, centroids)
    inertia = np.array([final[c][-1] if c in final else 0 for c in range(len(centroids))], object)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    whole = int(inertia.sum())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = Bisectors(centroids)
        for ids, x in _blocks(batches, dims):
            best, distance = planes.assign(x)
            columns = [ids, best, distance, inertia[best].tolist(), [whole] * len(ids), [names[c] for c in best.tolist()]]
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    return blocks.mapInArrow(answer, schema)
