"""Sources that are rules rather than files: ranges, calendars, random rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def integer_range(spark: SparkSession, start: int, end: int, step: int = 1) -> DataFrame:
    """value from start to before end; a step of 0 is an error, one away from end gives no rows."""
    if step == 0:
        raise ValueError("step must not be 0")
    return spark.range(start, end, step).select(F.col("id").alias("value"))


def range_of_length(spark: SparkSession, length: int, start: int = 0, step: int = 1) -> DataFrame:
    if length < 0:
        raise ValueError("length must not be negative")
    return spark.range(length).select((F.lit(start) + F.col("id") * step).alias("value"))


def double_range(spark: SparkSession, start: float, end: float, step: float = 1.0) -> DataFrame:
    """value = start + i * step (nothing accumulates); the end is left out within 1e-16 of a step."""
    if step == 0:
        raise ValueError("step must not be 0")
    ratio = (end - start) / step
    whole = int(ratio)
    n = max(0, whole + (0 if ratio - whole < 1e-16 else 1))
    return spark.range(n).select((F.lit(float(start)) + F.col("id") * F.lit(float(step))).alias("value"))


def decimal_range(spark: SparkSession, start: int, end: int, step: int = 1) -> DataFrame:
    """Whole numbers of up to 38 digits."""
    if step == 0:
        raise ValueError("step must not be 0")
    n = max(0, -((start - end) // step) if step > 0 else -((end - start) // -step))
    kind = "decimal(38,0)"
    return spark.range(n).select((F.lit(str(start)).cast(kind) + (F.col("id").cast("decimal(19,0)") * F.lit(str(step)).cast("decimal(18,0)")).cast(kind)).cast(kind).alias("value"))


def range_at(start: Column, step: Column, length: Column, index: Column) -> Column:
    """The item at a place of a range; null outside it."""
    return F.when((index >= 0) & (index < length), start + index * step)


def range_sublist(spark: SparkSession, length: int, start: int, step: int, first: int, end: int) -> DataFrame:
    """The items at places [first, end) of a range of so many items: a range again, nothing is made and dropped."""
    if not 0 <= first <= end <= length:
        raise ValueError("need 0 <= first <= end <= length")
    return range_of_length(spark, end - first, start + first * step, step)


def range_contains(start: Column, end: Column, step: int, value: Column) -> Column:
    """Whether value is one of start, start + step, … before end."""
    inside = (value >= start) & (value < end) if step > 0 else (value <= start) & (value > end)
    return inside & (F.pmod(value - start, F.lit(abs(step))) == 0)


def indices(array: Column, step: int = 1) -> Column:
    """0-based places of an array, from the back for a negative step."""
    n = F.size(array)
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(every if step > 0 else F.reverse(every), lambda _, i: i % abs(step) == 0)


def at_random(df: DataFrame, seed: int | None = None) -> DataFrame:
    """One row, any with the same probability; none of an empty table."""
    return df.withColumn("_r", F.rand(seed)).orderBy("_r").limit(1).drop("_r")


def from_lists(df: DataFrame, vertex: str, others: str, incoming: bool = False) -> DataFrame:
    """Edges src, dst, ord from a column of neighbours: successors, or predecessors if ``incoming``."""
    out = df.select(F.col(vertex).alias("v"), F.posexplode(others).alias("ord", "o"))
    return out.select(*((F.col("o").alias("src"), F.col("v").alias("dst")) if incoming else (F.col("v").alias("src"), F.col("o").alias("dst"))), F.col("ord").cast("long").alias("ord"))
