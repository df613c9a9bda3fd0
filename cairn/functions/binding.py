"""Name an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    The optimizer copies a column's definition into every filter it pushes down.  A chain of columns
    that each use the previous one several times would grow exponentially; bound this way it stays
    linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
