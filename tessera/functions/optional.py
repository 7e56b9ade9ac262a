"""Optional and either values: null, and a tagged struct."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.plans.expr import let


def map_present(x: Column, f: Callable[[Column], Column]) -> Column:
    return F.when(x.isNotNull(), f(x))


def where_present(x: Column, test: Callable[[Column], Column]) -> Column:
    """Null unless the test passes."""
    return F.when(test(x), x)


def or_else(x: Column, other: Column) -> Column:
    return F.coalesce(x, other)


def or_error(x: Column, message: str) -> Column:
    return F.coalesce(x, F.raise_error(F.lit(message)))


def left(x: Column, right_type: str) -> Column:
    return F.struct(F.lit(True).alias("is_left"), x.alias("left"), F.lit(None).cast(right_type).alias("right"))


def right(x: Column, left_type: str) -> Column:
    return F.struct(F.lit(False).alias("is_left"), F.lit(None).cast(left_type).alias("left"), x.alias("right"))


def iff(test: Column, if_true: Column, if_false: Column) -> Column:
    """Right of the one if the test passes, else left of the other."""
    return F.struct((~test).alias("is_left"), F.when(~test, if_false).alias("left"), F.when(test, if_true).alias("right"))


def fold(e: Column, on_left: Callable, on_right: Callable) -> Column:
    return let(e, lambda v: F.when(v["is_left"], on_left(v["left"])).otherwise(on_right(v["right"])))


def map_either(e: Column, on_left: Callable = lambda c: c, on_right: Callable = lambda c: c) -> Column:
    return let(e, lambda v: F.struct(v["is_left"].alias("is_left"), F.when(v["is_left"], on_left(v["left"])).alias("left"), F.when(~v["is_left"], on_right(v["right"])).alias("right")))


def swap(e: Column) -> Column:
    return let(e, lambda v: F.struct((~v["is_left"]).alias("is_left"), v["right"].alias("left"), v["left"].alias("right")))


def map_default(m: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(m, key), default)


def map_computed(m: Column, key: Column, compute: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.try_element_at(m, key), compute(key))
