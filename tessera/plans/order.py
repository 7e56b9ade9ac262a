"""Order: tables have none, so every ordered operator names its own.

``order_by`` must be a total order (end it with a unique column); with
``partition_by`` the operator works within each key.  Without, an index over the
whole table is made in two phases, so no single task ever sees all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

Columns = str | Column | Sequence[str | Column]


def as_list(columns: Columns) -> list:
    return list(columns) if isinstance(columns, (list, tuple)) else [columns] if columns is not None else []


def ordered(order_by: Columns, partition_by: Columns = ()) -> WindowSpec:
    if not as_list(order_by):
        raise ValueError("an ordered operator needs order_by")
    return Window.partitionBy(*as_list(partition_by)).orderBy(*as_list(order_by))


def global_index(df: DataFrame, order_by: Columns, name: str = "index", running: Column | None = None, running_name: str = "running") -> DataFrame:
    """Adds the 0-based place of each row in a total order (and an inclusive running sum).

    Rows are range-partitioned and sorted; each partition's count (and sum) is
    collected (a row for a partition) and added to the places inside it.
    """
    keys = as_list(order_by)
    measure = running if running is not None else F.lit(0)
    laid = df.withColumn("_m", measure).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id())
    laid = laid.persist(StorageLevel.MEMORY_AND_DISK)
    sums = {r["_p"]: (r["n"], r["s"]) for r in laid.groupBy("_p").agg(F.count("*").alias("n"), F.sum("_m").alias("s")).collect()}
    at, total, rows = 0, None, []
    for p in sorted(sums):
        rows.append((p, at, total))
        at += sums[p][0]
        s = sums[p][1]
        total = s if total is None else total if s is None else total + s
    kind = dict(laid.groupBy().agg(F.sum("_m").alias("s")).dtypes)["s"]
    offsets = df.sparkSession.createDataFrame(rows or [(-1, 0, None)], f"_q int, _at bigint, _before {kind}")
    inside = Window.partitionBy("_p").orderBy(*keys)
    out = laid.join(F.broadcast(offsets), F.col("_p") == F.col("_q")).withColumn(name, F.row_number().over(inside) - 1 + F.col("_at"))
    if running is not None:
        out = out.withColumn(running_name, F.sum("_m").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("_before", F.lit(0).cast(kind)))
    return out.drop("_m", "_p", "_q", "_at", "_before")


def indexed(df: DataFrame, order_by: Columns, partition_by: Columns = (), name: str = "index", start: int = 0, step: int = 1) -> DataFrame:
    """Adds start, start + step, … in order."""
    if as_list(partition_by):
        return df.withColumn(name, ((F.row_number().over(ordered(order_by, partition_by)) - 1) * step + start).cast("long"))
    out = global_index(df, order_by, "_index")
    return out.withColumn(name, (F.col("_index") * step + start).cast("long")).drop("_index")
