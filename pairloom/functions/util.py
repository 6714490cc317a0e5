"""Small expression helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body``.

    A Column that is used twice is evaluated twice wherever the optimizer cannot share it (inside
    higher-order functions it never can), so an expensive one is bound as a lambda variable.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
