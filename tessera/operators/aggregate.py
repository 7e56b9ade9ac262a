"""Prefix sums, numeric folds and similar aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.plans.order import Columns, as_list, global_index, ordered


def prefix_sum(df: DataFrame, value: str, *, order_by: Columns, partition_by: Columns = ()) -> DataFrame:
    """Adds running (up to and with the row) and prefix (before it); in two phases without partition_by."""
    if as_list(partition_by):
        w = ordered(order_by, partition_by).rowsBetween(Window.unboundedPreceding, 0)
        out = df.withColumn("running", F.sum(value).over(w))
    else:
        out = global_index(df, order_by, "_index", F.col(value)).drop("_index")
    return out.withColumn("prefix", F.col("running") - F.coalesce(F.col(value), F.lit(0)))


def range_sum(df: DataFrame, value: str, start: int, end: int, *, order_by: Columns) -> DataFrame:
    """total of the values at places [start, end)."""
    if not 0 <= start <= end:
        raise ValueError("need 0 <= start <= end")
    return global_index(df, order_by, "_index").where((F.col("_index") >= start) & (F.col("_index") < end)).agg(F.sum(value).alias("total"))


def gcd_pair(a: Column, b: Column) -> Column:
    """Greatest common divisor of two 64-bit numbers, by Euclid's algorithm: 92 steps always do."""
    start = F.struct(F.abs(a.cast("long")).alias("x"), F.abs(b.cast("long")).alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.when(s["y"] == 0, F.lit(1).cast("long")).otherwise(s["y"])).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["x"])


def lcm_pair(a: Column, b: Column) -> Column:
    """Least common multiple; 0 with 0."""
    g, x = gcd_pair(a, b), F.abs(a.cast("long"))
    return F.when(g == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", x, F.greatest(g, F.lit(1).cast("long"))) * F.abs(b.cast("long")))


def gcd_of(df: DataFrame, value: str, by: Columns = ()) -> DataFrame:
    """keys, gcd of each group: of each task's distinct values first, so a group's size does not matter."""
    return _fold(df, value, by, "gcd")


def lcm_of(df: DataFrame, value: str, by: Columns = ()) -> DataFrame:
    """keys, lcm of each group."""
    return _fold(df, value, by, "lcm")


def _fold(df: DataFrame, value: str, by: Columns, kind: str) -> DataFrame:
    import math

    fold = math.gcd if kind == "gcd" else math.lcm
    keys = as_list(by)
    rows = df.select(*keys, F.col(value).cast("long").alias("_v")).where("_v is not null")

    def partial(batches):
        import pandas as pd

        seen: dict = {}
        for batch in batches:
            for *k, v in batch.itertuples(index=False, name=None):
                k = tuple(k)
                seen[k] = fold(seen.get(k, v), v)
        if seen:
            yield pd.DataFrame([(*k, v) for k, v in seen.items()], columns=[*keys, "_v"])

    small = rows.mapInPandas(partial, rows.schema)  # a row for each key and task

    def final(pdf):
        import pandas as pd

        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), fold(*map(int, pdf["_v"]))]], columns=[*keys, kind])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_v"] + [f"{kind} long"])
    return small.groupBy(*keys).applyInPandas(final, schema)


def polynomial(coefficients: Column, x: Column) -> Column:
    """Sum of coefficient i times x to the i, the lowest first."""
    return F.aggregate(F.reverse(coefficients), F.lit(0).cast("double"), lambda acc, c: acc * x + c)
