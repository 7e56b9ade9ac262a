"""Bags, multimaps, one-to-one maps, set operations and bit lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.checks import bit_index, non_negative
from tessera.plans.order import Columns, as_list, ordered


# -- bags: a table of elements, or counted as (element, n) ---------------------


def bag(df: DataFrame, element: str) -> DataFrame:
    """element, n."""
    return df.groupBy(F.col(element).alias("element")).agg(F.count("*").alias("n"))


def _counts(a: DataFrame, b: DataFrame) -> DataFrame:
    x = a.select(F.col("element").alias("x"), F.col("n").alias("na"))
    y = b.select(F.col("element").alias("y"), F.col("n").alias("nb"))
    both = x.join(y, F.col("x").eqNullSafe(F.col("y")), "full")
    return both.select(F.coalesce("x", "y").alias("element"), F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb"))


def combine(a: DataFrame, b: DataFrame, count) -> DataFrame:
    """Counted bags a and b with count(element, na, nb) of each element; those of 0 vanish, below 0 is an error."""
    n = count(F.col("element"), F.col("na"), F.col("nb")).cast("long")
    checked = F.when(n < 0, F.raise_error(F.lit("a count must not be negative"))).otherwise(n)
    return _counts(a, b).select("element", checked.alias("n")).where("n <> 0")


def bag_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts add."""
    return a.select("element", "n").unionAll(b.select("element", "n")).groupBy("element").agg(F.sum("n").alias("n"))


def bag_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return combine(a, b, lambda e, x, y: F.least(x, y))


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return combine(a, b, lambda e, x, y: F.greatest(x - y, F.lit(0)))


def contains_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether bag a holds every element of bag b, as often at least."""
    return _counts(a, b).agg(F.coalesce(F.bool_and(F.col("na") >= F.col("nb")), F.lit(True)).alias("contains_all"))


def with_count(a: DataFrame, element: Column, n: int) -> DataFrame:
    """Counted bag a with n of one element; 0 removes it."""
    non_negative(n, "n")
    rest = a.where(~F.col("element").eqNullSafe(element))
    return rest.unionAll(a.sparkSession.range(1).select(element.cast(dict(a.dtypes)["element"]).alias("element"), F.lit(n).cast("long").alias("n"))) if n else rest


def add(a: DataFrame, element: Column, n: int = 1) -> DataFrame:
    non_negative(n, "n")
    return bag_union(a, a.sparkSession.range(1).select(element.cast(dict(a.dtypes)["element"]).alias("element"), F.lit(n).cast("long").alias("n"))).where("n > 0")


def remove(a: DataFrame, element: Column, n: int = 1) -> DataFrame:
    non_negative(n, "n")
    left = F.when(F.col("element").eqNullSafe(element), F.greatest(F.col("n") - n, F.lit(0))).otherwise(F.col("n"))
    return a.select("element", left.alias("n")).where("n > 0")


# -- multimaps: pairs (k, v), with an order where lists are wanted -----------------


def list_multimap(df: DataFrame, key: str, value: str, *, order_by: Columns) -> DataFrame:
    """key, values in order, repeats kept. A key's list is one row: for keys of bounded size."""
    entry = F.struct(*[F.col(c) if isinstance(c, str) else c for c in as_list(order_by)], F.col(value).alias("_v"))
    return df.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(entry)), lambda s: s["_v"]).alias("values"))


def set_multimap(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, distinct values, sorted."""
    return df.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("values"))


def multimap_add(pairs: DataFrame, more: DataFrame) -> DataFrame:
    return pairs.unionByName(more)


def multimap_remove(pairs: DataFrame, gone: DataFrame, on: Columns) -> DataFrame:
    """Without the pairs that match on the columns (of key and value, or of key alone)."""
    return pairs.join(gone, as_list(on), "left_anti")


def multimap_replace(pairs: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The keys of ``new`` hold its values alone."""
    return pairs.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def bimap(df: DataFrame, key: str, value: str, *, order_by: Columns, rounds: int = 100) -> DataFrame:
    """One-to-one pairs as if put in order, each evicting what holds its key or its value.

    A pair stays if no later pair has its key or value: whatever evicts a pair
    is later, and an evicted pair has already evicted what came before it.
    """
    mark = F.lit(1)
    last_of_key = df.withColumn("_k", F.lead(mark).over(ordered(order_by, key)))
    later = last_of_key.withColumn("_v", F.lead(mark).over(ordered(order_by, value)))
    return later.where("_k is null and _v is null").drop("_k", "_v")


def inverse(pairs: DataFrame, key: str, value: str) -> DataFrame:
    return pairs.select(F.col(value).alias(key), F.col(key).alias(value))


# -- bit lists: arrays of booleans, or 64-bit words ----------------------------


def bits_of(word: Column, width: int) -> Column:
    """The lowest ``width`` bits of a number, lowest first."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.call_function("shiftright", word.cast("long"), i).bitwiseAND(F.lit(1).cast("long")) == 1)


def _both(a: Column, b: Column, make) -> Column:
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, make)).otherwise(F.raise_error(F.lit("bit lists of different lengths")))


def bits_and(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: x & y)


def bits_or(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: x | y)


def bits_minus(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: x & ~y)


def bits_not(a: Column) -> Column:
    return F.transform(a, lambda x: ~x)


def bits_shift(a: Column, by: int) -> Column:
    """Shifted up by so many places (down if negative), filled with zeros, as long as before."""
    zeros = F.array_repeat(F.lit(False), min(abs(by), 1 << 20))
    if by >= 0:
        return F.slice(F.concat(zeros, a), F.lit(1), F.size(a))
    return F.slice(F.concat(F.slice(a, F.lit(1 - by), F.size(a)), zeros), F.lit(1), F.size(a))


def bits_flip(a: Column, index: int) -> Column:
    return F.transform(a, lambda x, i: F.when(i == index, ~x).otherwise(x))


def bits_fill(a: Column, start: int, end: int, value: bool) -> Column:
    return F.transform(a, lambda x, i: F.when((i >= start) & (i < end), F.lit(value)).otherwise(x))


def bits_count(a: Column, expected: bool = True) -> Column:
    return F.size(F.filter(a, lambda x: x == expected))


def bits_indices(a: Column, expected: bool = True) -> Column:
    return F.filter(F.transform(a, lambda x, i: F.when(x == expected, i)), lambda i: i.isNotNull())


def set_bit(x: Column, index: int) -> Column:
    return x.bitwiseOR(F.lit(1 << bit_index(index)).cast("long"))


def clear_bit(x: Column, index: int) -> Column:
    return x.bitwiseAND(F.lit(~(1 << bit_index(index))).cast("long"))


def toggle_bit(x: Column, index: int) -> Column:
    return x.bitwiseXOR(F.lit(1 << bit_index(index)).cast("long"))


def bit_count32(x: Column) -> Column:
    """Set bits among the lowest 32."""
    return F.bit_count(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def has_single_bit(x: Column) -> Column:
    return (x != 0) & (x.bitwiseAND(x - 1) == 0)


def _top_bit(x: Column) -> Column:
    """Place of the highest set bit of a positive number."""
    return F.length(F.bin(x)) - 1


def bit_floor(x: Column) -> Column:
    """The largest power of two not above x; 0 for 0."""
    return F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), _top_bit(x))).otherwise(F.lit(0).cast("long"))


def bit_ceil(x: Column) -> Column:
    """The smallest power of two not below x; 1 for 0."""
    return F.when(x > 1, F.call_function("shiftleft", F.lit(1).cast("long"), _top_bit(x - 1) + 1)).otherwise(F.lit(1).cast("long"))
