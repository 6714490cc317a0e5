"""Keyed randomness: the same seed and keys always give the same draw, on any partitioning.

A draw is a function of a digest of its keys, so a lost task recomputes the same rows and the plan
needs no order, no state and no generator per partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.util import as_col

_TINY = 1e-12


def _digest(seed: int, *keys: Column | str) -> Column:
    parts = [as_col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def _hex_number(text: Column, start: int, width: int) -> Column:
    return F.conv(F.substring(text, start, width), 16, 10).cast("bigint")


def uniform(seed: int, *keys: Column | str) -> Column:
    """Uniform in [0, 1) with 52 random bits."""
    return _hex_number(_digest(seed, *keys), 1, 13) / F.lit(float(2**52))


def uniform_int(seed: int, lo: int, hi: int, *keys: Column | str) -> Column:
    """Integer in ``[lo, hi]``, both ends included."""
    return (F.lit(lo) + F.floor(uniform(seed, *keys) * (hi - lo + 1))).cast("bigint")


# A step between entries and the multipliers of a public 32-bit integer mixer.
STRIDE, MIX_A, MIX_B = 0x9E3779B9, 0x21F0AAAD, 0x735A2D97
_MASK = 0xFFFFFFFF


def row_words(seed: int, *keys: Column | str) -> tuple[Column, Column]:
    """Two 32-bit words of the digest of a row's keys."""
    digest = _digest(seed, *keys)
    return _hex_number(digest, 1, 8), _hex_number(digest, 9, 8)


def _mix(x: np.ndarray) -> np.ndarray:
    mask = np.uint64(_MASK)
    x = ((x ^ (x >> np.uint64(16))) * np.uint64(MIX_A)) & mask
    x = ((x ^ (x >> np.uint64(15))) * np.uint64(MIX_B)) & mask
    return x ^ (x >> np.uint64(15))


def _numbers(words: pa.Array) -> np.ndarray:
    return words.to_numpy(zero_copy_only=False)


def _uniforms(first: np.ndarray, second: np.ndarray, entries: int) -> np.ndarray:
    """A row of uniforms per pair of words: both words are mixed with the number of the entry."""
    a, b = (w.astype(np.uint64)[:, None] for w in (first, second))
    steps = np.arange(entries, dtype=np.uint64) * np.uint64(STRIDE)
    return _mix(_mix((a + steps) & np.uint64(_MASK)) ^ b).astype(np.float64) / 2.0**32


def _lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    offsets = pa.array(np.arange(0, rows * width + 1, width, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values).ravel()))


def uniform_vector(seed: int, dims: int, *keys: Column | str) -> Column:
    """``dims`` uniforms in [0, 1) per row, with 32 random bits each."""

    @F.arrow_udf("array<double>")
    def draw(first: pa.Array, second: pa.Array) -> pa.Array:
        return _lists(_uniforms(_numbers(first), _numbers(second), dims))

    return draw(*row_words(seed, *keys))


def normals_of(first: np.ndarray, second: np.ndarray, dims: int) -> np.ndarray:
    """Inside a task: a row of standard normals per pair of words, by Box-Muller."""
    u = _uniforms(first, second, dims + dims % 2)
    radius = np.sqrt(-2.0 * np.log(np.maximum(u[:, 0::2], _TINY)))
    angle = 2.0 * np.pi * u[:, 1::2]
    pairs = np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=2)
    return pairs.reshape(len(u), -1)[:, :dims]


def normal_vector(seed: int, dims: int, *keys: Column | str) -> Column:
    """``dims`` standard normals per row.

    Spark digests the keys of a row; numpy draws the entries of a whole Arrow batch. The same draws
    as higher-order functions run interpreted, entry by entry, and take several times as long.
    """

    @F.arrow_udf("array<double>")
    def draw(first: pa.Array, second: pa.Array) -> pa.Array:
        return _lists(normals_of(_numbers(first), _numbers(second), dims))

    return draw(*row_words(seed, *keys))
