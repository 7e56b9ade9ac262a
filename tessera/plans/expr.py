"""Expression helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used.

    Keeps plans small where an expression would otherwise be copied at each use,
    and hoists it out of functions that run for each item of an array.
    """
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)
