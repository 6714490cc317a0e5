"""Arrays to rows.

A plain ``explode`` makes the optimizer add a ``size(array) > 0`` filter below it, and pushing that
filter down copies the expression of the array, however costly. The outer form adds no filter; the
row it makes for an empty array is dropped afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, keep: list[Column | str], array: Column | str, value: str, pos: str) -> DataFrame:
    """One row per element: ``keep``, the place ``pos`` and the element ``value``."""
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, value)).filter(F.col(pos).isNotNull())
    return rows.withColumn(pos, F.col(pos).cast("bigint"))


def unnest_structs(df: DataFrame, keep: list[Column | str], array: Column, present: str) -> DataFrame:
    """One row per struct of an array, its fields as columns; the field ``present`` is never null."""
    return df.select(*keep, F.inline_outer(array)).filter(F.col(present).isNotNull())
