"""Expressions on arrays of numbers. All arithmetic is in double."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.util import as_col, let


def to_double(vec: Column | str) -> Column:
    return as_col(vec).cast("array<double>")


def total(vec: Column | str) -> Column:
    return F.aggregate(as_col(vec), F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(to_double(a), to_double(b), lambda x, y: x * y))


def sum_of_squares(vec: Column | str) -> Column:
    return F.aggregate(to_double(vec), F.lit(0.0), lambda acc, v: acc + v * v)


def l2_normalize(vec: Column | str) -> Column:
    """Unit length; a zero vector stays zero."""
    return let(
        F.greatest(F.sqrt(sum_of_squares(vec)), F.lit(1e-12)),
        lambda norm: F.transform(to_double(vec), lambda v: v / norm),
    )


def combine(a: Column | str, b: Column | str, wa: Column, wb: Column) -> Column:
    """``wa * a + wb * b``, element by element."""
    return F.zip_with(as_col(a), as_col(b), lambda x, y: wa * x + wb * y)


def sinusoidal(value: Column | str, dim: int, max_period: float = 10000.0, order: str = "cos_sin") -> Column:
    """Waves of a number at geometric frequencies.

    ``cos_sin``: cosines, then sines, and a zero at the end of an odd ``dim``. ``sin_cos``: sines,
    then cosines; ``dim`` must be even.
    """
    if order not in ("cos_sin", "sin_cos"):
        raise ValueError(f"unknown order: {order}")
    if order == "sin_cos" and dim % 2:
        raise ValueError("sin_cos needs an even dim")
    half = dim // 2
    value = as_col(value).cast("double")
    rates = [math.exp(-math.log(max_period) * i / half) for i in range(half)]
    cosines = [F.cos(value * F.lit(r)) for r in rates]
    sines = [F.sin(value * F.lit(r)) for r in rates]
    if order == "sin_cos":
        return F.array(*sines, *cosines)
    return F.array(*cosines, *sines, *([F.lit(0.0)] if dim % 2 else []))


def guided(cond: Column | str, uncond: Column | str, scale: float, channels: int) -> Column:
    """Move ``uncond`` towards ``cond`` by ``scale`` on the first ``channels`` entries.

    The entries behind them are ``cond``'s own.
    """
    cond, uncond = as_col(cond), as_col(uncond)
    return F.transform(
        F.arrays_zip(cond.alias("c"), uncond.alias("u")),
        lambda p, i: F.when(i < channels, p["u"] + scale * (p["c"] - p["u"])).otherwise(p["c"]),
    )
