"""Dense products inside a batch: Spark groups the rows, numpy multiplies the block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


CHUNK = 1024
QUERIES, CANDIDATES = 256, 8192  # of one product in ``batch_best``: 16 MB of scores


def matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    """A list<double> column as a rows x dims matrix, without a copy per row.

    A null list is a row of NaN, and so is a null entry; lists of different lengths raise.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    present = column.is_valid().to_numpy(zero_copy_only=False)
    widths = np.unique(pc.list_value_length(column).drop_null().to_numpy())
    if len(widths) > 1:
        raise ValueError(f"vectors of different lengths in one block: {widths[:5].tolist()}")
    width = int(widths[0]) if len(widths) else 0
    if present.all():
        return flat.reshape(rows, width)
    out = np.full((rows, width), np.nan)
    out[present] = flat.reshape(-1, width)
    return out


def list_column(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    offsets = np.arange(rows + 1, dtype=np.int32) * width
    flat = np.ascontiguousarray(values).ravel()
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, mask=np.isnan(flat)))


def batch_products(df: DataFrame, batch: list[str], order: str, left: str, right: str) -> DataFrame:
    """For each row, the dot products of its ``left`` with the ``right`` of every row of its batch.

    The result keeps the other columns, drops ``left`` and ``right`` and adds ``member`` (the place
    in the batch by ``order``) and ``products`` (by ``member``). A batch is a fixed number of rows,
    so the work is linear in the table; the pairs are never rows of their own. A product with a null
    vector is null. The result holds the square of each batch: for the best few of a large batch, use ``batch_best``.
    """
    kept = [c for c in df.columns if c not in (left, right)]
    schema = T.StructType(
        [df.schema[c] for c in kept]
        + [
            T.StructField("member", T.LongType()),
            T.StructField("products", T.ArrayType(T.DoubleType())),
        ]
    )

    def multiply(block: pa.Table) -> pa.Table:
        block = block.sort_by(order)
        rows = block.num_rows
        lefts, rights = matrix(block[left], rows), matrix(block[right], rows).T
        out = block.select(kept)
        out = out.append_column("member", pa.array(np.arange(rows, dtype=np.int64)))
        parts = [list_column(lefts[i : i + CHUNK] @ rights) for i in range(0, rows, CHUNK)]
        return out.append_column("products", pa.chunked_array(parts))

    doubles = df.withColumns(
        {left: F.col(left).cast("array<double>"), right: F.col(right).cast("array<double>")}
    )
    return doubles.groupBy(*batch).applyInArrow(multiply, schema)


def _first(rank: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` lowest ranks of every row, in order, equal ones by place."""
    rows, width = rank.shape
    if width <= max(4 * k, 256):
        return np.argsort(rank, axis=1, kind="stable")[:, :k]
    last = np.partition(rank, k - 1, axis=1)[:, k - 1]
    out = np.empty((rows, k), np.int64)
    for i in range(rows):
        at = np.flatnonzero(rank[i] <= last[i]) if not np.isnan(last[i]) else np.arange(width)
        out[i] = at[np.argsort(rank[i, at], kind="stable")[:k]]
    return out


def best_products(
    lefts: np.ndarray, rights: np.ndarray, k: int, sign: float, digits: int, offset: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``lefts``: places and scores of its best ``k`` rows of ``rights``; NaN behind the last one.

    The best of a chunk of candidates and the best so far are merged, so only one chunk of scores exists at a time.
    """
    places, scores = np.zeros((len(lefts), 0), np.int64), np.zeros((len(lefts), 0))
    for lo in range(0, len(rights), CANDIDATES):
        new = lefts @ rights[lo : lo + CANDIDATES].T + offset[:, None]
        at = _first(np.round(sign * new, digits), min(k, new.shape[1]))
        places = np.concatenate((places, at + lo), axis=1)
        scores = np.concatenate((scores, np.take_along_axis(new, at, axis=1)), axis=1)
        if lo:
            at = _first(np.round(sign * scores, digits), min(k, scores.shape[1]))
            places, scores = (np.take_along_axis(v, at, axis=1) for v in (places, scores))
    return places, scores


def batch_best(
    df: DataFrame, batch: list[str], order: str, left: str, right: str, k: int, largest: bool = True, digits: int = 9,
    offset: str | None = None,
) -> DataFrame:
    """For each row, the best ``k`` of the dot products that ``batch_products`` gives, without their square.

    Adds ``member`` and ``best``, an array of structs (``place``, ``score``), the best first. ``offset`` is a column that is
    added to all scores of a row. Scores that agree to ``digits`` places are ties, and the lower place wins. Products with a null vector
    are left out. A task holds the vectors of a batch and one chunk of scores, however large the batch is.
    """
    kept = [c for c in df.columns if c not in (left, right, offset)]
    found = T.ArrayType(T.StructType([T.StructField("place", T.LongType()), T.StructField("score", T.DoubleType())]))
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("member", T.LongType()), T.StructField("best", found)])

    def select(block: pa.Table) -> pa.Table:
        block = block.sort_by(order)
        rows = block.num_rows
        lefts, rights = matrix(block[left], rows), matrix(block[right], rows)
        more = np.asarray(block[offset], dtype=np.float64) if offset else np.zeros(rows)
        parts = []
        for lo in range(0, rows, QUERIES):
            some = slice(lo, lo + QUERIES)
            places, scores = best_products(lefts[some], rights, k, -1.0 if largest else 1.0, digits, more[some])
            there = ~np.isnan(scores)
            offsets = np.concatenate(([0], np.cumsum(there.sum(axis=1)))).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(places[there]), pa.array(scores[there])], ["place", "score"])
            parts.append(pa.ListArray.from_arrays(pa.array(offsets), pairs))
        out = block.select(kept).append_column("member", pa.array(np.arange(rows, dtype=np.int64)))
        return out.append_column("best", pa.chunked_array(parts))

    doubles = {c: F.col(c).cast("array<double>") for c in (left, right)}
    return df.withColumns(doubles | ({offset: F.col(offset).cast("double")} if offset else {})).groupBy(*batch).applyInArrow(select, schema)
