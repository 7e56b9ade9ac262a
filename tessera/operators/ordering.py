"""Comparators as sort keys, top-k, searches in sorted arrays."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.order import Columns, as_list, ordered


@dataclass(frozen=True)
class By:
    """A comparator: sort keys with directions and places of nulls.

    ``By.key(c)`` is the natural order of an expression; `then` adds keys,
    `reversed` turns the direction and the nulls' place of all.
    """

    keys: tuple[tuple[Column, bool, bool], ...]  # column, ascending, nulls first

    @staticmethod
    def key(column: Column | str, nulls_first: bool = True) -> By:
        return By(((F.col(column) if isinstance(column, str) else column, True, nulls_first),))

    @staticmethod
    def explicit(column: Column, values: Sequence) -> By:
        """By place in a list; a value that it lacks is an error."""
        return By.key(explicit_rank(column, values))

    def then(self, other: By) -> By:
        return By(self.keys + other.keys)

    def nulls(self, first: bool) -> By:
        return By(tuple((c, up, first) for c, up, _ in self.keys))

    def reversed(self) -> By:
        return By(tuple((c, not up, not first) for c, up, first in self.keys))

    def columns(self) -> list[Column]:
        name = {(True, True): "asc_nulls_first", (True, False): "asc_nulls_last", (False, True): "desc_nulls_first", (False, False): "desc_nulls_last"}
        return [getattr(c, name[up, first])() for c, up, first in self.keys]

    def test(self, a, b) -> Column:
        """Sign of the comparison of two rows' values: a and b map a key to its value on a side."""
        out = F.lit(0)
        for c, up, first in reversed(self.keys):
            x, y, one = a(c), b(c), 1 if up else -1
            out = F.when(x.isNull() & y.isNull(), out).when(x.isNull(), -1 if first else 1).when(y.isNull(), 1 if first else -1).when(x < y, -one).when(x > y, one).otherwise(out)
        return out


def explicit_rank(column: Column, values: Sequence) -> Column:
    place = F.array_position(F.array(*[F.lit(v) for v in values]), column)
    return F.when(place > 0, place - 1).otherwise(F.raise_error(F.concat(F.lit("not in the explicit order: "), column.cast("string"))))


def sort(df: DataFrame, by: By, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows in order; with start and end, those at places [start, end) of it."""
    out = df.orderBy(*by.columns())
    if start is None and end is None:
        return out
    if end is not None:
        out = out.limit(end)
    return out.offset(start or 0)


def largest(df: DataFrame, by: By, k: int) -> DataFrame:
    """The k largest rows, largest first; none for k <= 0."""
    return df.orderBy(*by.reversed().columns()).limit(max(k, 0))


def smallest(df: DataFrame, by: By, k: int) -> DataFrame:
    return df.orderBy(*by.columns()).limit(max(k, 0))


def largest_per(df: DataFrame, by: By, k: int, partition_by: Columns, rank: str = "rank") -> DataFrame:
    """The k largest rows of each key with their rank from 1; tasks keep k rows of a key before the exchange."""
    return df.withColumn(rank, F.row_number().over(ordered(by.reversed().columns(), partition_by))).where(F.col(rank) <= k)


def min_max(df: DataFrame, value: Column, by: Columns = ()) -> DataFrame:
    """keys, min, max in one pass; null for no rows."""
    return df.groupBy(*as_list(by)).agg(F.min(value).alias("min"), F.max(value).alias("max"))


def min_row(df: DataFrame, value: str, key: Column, ordinal: Column, by: Columns = ()) -> DataFrame:
    """keys, value of the smallest key; among equals the last in the ordinal's order."""
    return df.groupBy(*as_list(by)).agg(F.min_by(value, F.struct(key.alias("k"), (-ordinal).alias("o"))).alias(value))


def max_row(df: DataFrame, value: str, key: Column, ordinal: Column, by: Columns = ()) -> DataFrame:
    """keys, value of the largest key; among equals the last in the ordinal's order."""
    return df.groupBy(*as_list(by)).agg(F.max_by(value, F.struct(key.alias("k"), ordinal.alias("o"))).alias(value))


def is_ordered(df: DataFrame, value: str, *, order_by: Columns, partition_by: Columns, strict: bool = False) -> DataFrame:
    """keys, ordered: whether no adjacent pair falls (or, if strict, all rise)."""
    before = F.lag(value).over(ordered(order_by, partition_by))
    fine = before < F.col(value) if strict else before <= F.col(value)
    rows = df.select(*as_list(partition_by), F.coalesce(fine, F.lit(True)).alias("_fine"))
    return rows.groupBy(*as_list(partition_by)).agg(F.bool_and("_fine").alias("ordered"))


def between(x: Column, low: Column, high: Column) -> Column:
    return (x >= low) & (x <= high)


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(x, high))


def binary_search(array: Column, item: Column) -> Column:
    """0-based place of an equal item in a sorted array, or -1."""
    return F.array_position(array, item) - 1


def lower_bound(array: Column, item: Column) -> Column:
    """How many items are below."""
    return F.size(F.filter(array, lambda x: x < item))


def upper_bound(array: Column, item: Column) -> Column:
    """How many items are not above."""
    return F.size(F.filter(array, lambda x: x <= item))


def sorted_add(array: Column, item: Column) -> Column:
    return F.array_sort(F.concat(array, F.array(item)))


def sorted_remove(array: Column, item: Column) -> Column:
    """Without one equal item."""
    at = F.array_position(array, item).cast("int")
    return F.when(at > 0, F.concat(F.slice(array, F.lit(1), at - 1), F.slice(array, at + 1, F.size(array)))).otherwise(array)


def occurrences(array: Column, item: Column) -> Column:
    return F.size(F.filter(array, lambda x: x == item))
