"""Operators on ordered sequences: windows, chunks, runs, zips, products, selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.plans.checks import non_negative, positive
from tessera.plans.order import Columns, as_list, indexed, ordered


def window(df: DataFrame, value: str, size: int, *, order_by: Columns, partition_by: Columns, step: int = 1, partial: bool = False) -> DataFrame:
    """Sliding windows of ``size`` values each ``step`` rows: keys, start, items.

    With ``partial`` the first incomplete window follows as well, and no more.
    """
    positive(size, "size")
    positive(step, "step")
    w = ordered(order_by, partition_by)
    keys = as_list(partition_by)
    items = F.collect_list(value).over(w.rowsBetween(0, size - 1))
    rows = df.select(*keys, (F.row_number().over(w) - 1).cast("long").alias("start"), items.alias("items"), F.count("*").over(w.rowsBetween(0, size - 1)).alias("_n"))
    starts = rows.where(F.col("start") % step == 0)
    if not partial:
        return starts.where(F.col("_n") == size).drop("_n")
    # the first incomplete start follows a complete one, or is the first row
    return starts.where((F.col("_n") == size) | (F.col("start") == 0) | (F.col("_n") + step >= size)).drop("_n")


def chunked(df: DataFrame, value: str, size: int, *, order_by: Columns, partition_by: Columns, padding: Column | None = None) -> DataFrame:
    """Consecutive chunks of ``size`` values: keys, chunk, items; the last may be short, or padded."""
    positive(size, "size")
    keys = as_list(partition_by)
    rows = indexed(df, order_by, partition_by, "_i").withColumn("chunk", F.floor(F.col("_i") / size))
    out = rows.groupBy(*keys, "chunk").agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", F.col(value).alias("v")))), lambda s: s["v"]).alias("items"))
    if padding is not None:
        out = out.withColumn("items", F.concat("items", F.array_repeat(padding, F.lit(size) - F.size("items"))))
    return out


def pairwise(df: DataFrame, value: str, *, order_by: Columns, partition_by: Columns) -> DataFrame:
    """Adjacent values: keys, first, second."""
    w = ordered(order_by, partition_by)
    rows = df.select(*as_list(partition_by), F.lag(value).over(w).alias("first"), F.col(value).alias("second"), F.row_number().over(w).alias("_n"))
    return rows.where("_n > 1").drop("_n")


def run_groups(df: DataFrame, key: str, *, order_by: Columns, partition_by: Columns) -> DataFrame:
    """Adjacent rows with equal keys: keys, run, key, n. Not a hash grouping: a key may come again."""
    w = ordered(order_by, partition_by)
    parts = as_list(partition_by)
    fresh = F.when((F.row_number().over(w) > 1) & F.col(key).eqNullSafe(F.lag(key).over(w)), 0).otherwise(1)
    rows = df.select(*parts, key, *[c for c in as_list(order_by) if isinstance(c, str) and c not in [*parts, key]], fresh.alias("_new"))
    runs = rows.withColumn("run", (F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long"))
    return runs.groupBy(*parts, "run", key).agg(F.count("*").alias("n"))


def zipped(left: DataFrame, right: DataFrame, left_value: str, right_value: str, *, left_order: Columns, right_order: Columns, how: str = "inner", left_padding: Column | None = None, right_padding: Column | None = None) -> DataFrame:
    """Values at equal places: index, a, b. ``how`` "inner" stops at the shorter, "outer" pads (with null by default)."""
    if how not in ("inner", "outer"):
        raise ValueError("how must be inner or outer")
    a = indexed(left, left_order, (), "_i").select(F.col("_i").alias("ia"), F.col(left_value).alias("a"))
    b = indexed(right, right_order, (), "_i").select(F.col("_i").alias("ib"), F.col(right_value).alias("b"))
    out = a.join(b, F.col("ia") == F.col("ib"), how).withColumn("index", F.coalesce("ia", "ib"))
    va = F.when(F.col("ia").isNull(), left_padding).otherwise(F.col("a")) if left_padding is not None else F.col("a")
    vb = F.when(F.col("ib").isNull(), right_padding).otherwise(F.col("b")) if right_padding is not None else F.col("b")
    return out.select("index", va.alias("a"), vb.alias("b"))


def product(*frames: DataFrame) -> DataFrame:
    """Every combination of the frames' rows, as the caller's own choice; their columns must differ."""
    names = [c for f in frames for c in f.columns]
    if len(set(names)) < len(names):
        raise ValueError("the frames' columns must differ")
    return reduce(DataFrame.crossJoin, frames)


def _unlike(positions: list[str], make) -> Column:
    tests = [make(F.col(a), F.col(b)) for i, a in enumerate(positions) for b in positions[i + 1 :]]
    return reduce(lambda x, y: x & y, tests, F.lit(True))


def _selections(df: DataFrame, value: str, k: int, order_by: Columns, keys: list, compare) -> DataFrame:
    base = indexed(df, order_by, keys, "_i")
    frames = [base.select(*[F.col(c).alias(f"_k{n}_{c}" if n else c) for c in keys], F.col("_i").alias(f"_i{n}"), F.col(value).alias(f"_v{n}")) for n in range(k)]
    out = frames[0]
    for n in range(1, k):
        same = [F.col(c) == F.col(f"_k{n}_{c}") for c in keys]
        out = out.join(frames[n], reduce(lambda x, y: x & y, [*same, *compare(n)]))
    return out.select(*keys, F.array(*[f"_i{n}" for n in range(k)]).alias("places"), F.array(*[f"_v{n}" for n in range(k)]).alias("items"))


def combinations(df: DataFrame, value: str, k: int, *, order_by: Columns, partition_by: Columns, repetitions: bool = False) -> DataFrame:
    """k-combinations in each partition: keys, places, items, in the order of places. k = 0: one empty list for a key."""
    non_negative(k, "k")
    keys = as_list(partition_by)
    if k == 0:
        kind = dict(df.dtypes)[value]
        return df.select(*keys).distinct().withColumn("places", F.array().cast("array<bigint>")).withColumn("items", F.array().cast(f"array<{kind}>"))
    return _selections(df, value, k, order_by, keys, lambda n: [F.col(f"_i{n - 1}") <= F.col(f"_i{n}") if repetitions else F.col(f"_i{n - 1}") < F.col(f"_i{n}")])


def permutations(df: DataFrame, value: str, k: int, *, order_by: Columns, partition_by: Columns) -> DataFrame:
    """k-permutations in each partition: keys, places, items. k = 0: nothing."""
    non_negative(k, "k")
    keys = as_list(partition_by)
    if k == 0:
        return combinations(df, value, 0, order_by=order_by, partition_by=partition_by).limit(0)
    return _selections(df, value, k, order_by, keys, lambda n: [F.col(f"_i{m}") != F.col(f"_i{n}") for m in range(n)])


def power_set(array: Column, most: int = 20) -> Column:
    """All subsets of an array (of at most ``most`` items), by size and then place."""
    n = F.size(array)
    bits = F.sequence(F.lit(0).cast("long"), F.when(n <= most, F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1).otherwise(F.raise_error(F.lit(f"more than {most} items"))))
    places = F.transform(bits, lambda b: F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.call_function("shiftright", b, i - 1).bitwiseAND(F.lit(1).cast("long")) == 1))
    by_size = F.array_sort(F.transform(places, lambda p: F.struct(F.size(p).alias("n"), p.alias("p"))))
    return F.transform(by_size, lambda s: F.transform(s["p"], lambda i: F.element_at(array, i)))


def next_permutation(array: Column, back: bool = False) -> Column:
    """The next (or previous) arrangement in lexicographic order; null if there is none."""
    n = F.size(array)
    beats = (lambda a, b: a > b) if back else (lambda a, b: a < b)
    falls = F.filter(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: beats(F.element_at(array, i), F.element_at(array, i + 1)))
    i = F.array_max(falls)
    j = F.array_max(F.filter(F.sequence(F.lit(1), n), lambda k: (k > i) & beats(F.element_at(array, i), F.element_at(array, k))))
    swapped = F.transform(array, lambda x, k: F.when(k + 1 == i, F.element_at(array, j)).when(k + 1 == j, F.element_at(array, i)).otherwise(x))
    return F.when(i.isNotNull(), F.concat(F.slice(swapped, F.lit(1), i), F.reverse(F.slice(swapped, i + 1, n))))


def unique(df: DataFrame, key: Columns, *, order_by: Columns) -> DataFrame:
    """The first row of each key in the order."""
    keys = as_list(key)
    w = ordered(order_by, keys)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def partition(df: DataFrame, test: Column, value: str, *, order_by: Columns, partition_by: Columns = ()) -> DataFrame:
    """Lists of the values that pass and of those that do not, in order: keys, truthy, falsey."""
    entry = F.struct(*[F.col(c) if isinstance(c, str) else c for c in as_list(order_by)], F.col(value).alias("_v"))

    def gathered(condition: Column) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(condition, entry))), lambda s: s["_v"])

    passed = F.coalesce(test, F.lit(False))
    return df.groupBy(*as_list(partition_by)).agg(gathered(passed).alias("truthy"), gathered(~passed).alias("falsey"))


def to_map(df: DataFrame, key: str, value: str, *, order_by: Columns) -> DataFrame:
    """key, value with the last value of each key."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*as_list(order_by))).alias("value"))


def repeated(df: DataFrame, count: int, name: str = "repetition") -> DataFrame:
    """The rows ``count`` times over, numbered; unbounded repetition has no table."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(non_negative(count, "count") - 1)) if count else F.array().cast("array<int>")))


def rle_encode(df: DataFrame, value: str, *, order_by: Columns, partition_by: Columns) -> DataFrame:
    """keys, encoded: the length, then for each run its value, or minus its length and its value."""
    keys = as_list(partition_by)
    runs = run_groups(df, value, order_by=order_by, partition_by=partition_by)
    piece = F.when(F.col("n") == 1, F.array(F.col(value).cast("long"))).otherwise(F.array(-F.col("n"), F.col(value).cast("long")))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("run", piece.alias("p")))), lambda s: s["p"])
    return runs.groupBy(*keys).agg(F.concat(F.array(F.sum("n")), F.flatten(listed)).alias("encoded"))


def rle_decode(encoded: Column) -> Column:
    """The array that `rle_encode` encoded; values must not be negative."""
    body = F.slice(encoded, F.lit(2), F.size(encoded))
    start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(1).cast("long").alias("times"))

    def step(acc: Column, x: Column) -> Column:
        return F.when(x < 0, F.struct(acc["out"].alias("out"), (-x).alias("times"))).otherwise(F.struct(F.concat(acc["out"], F.array_repeat(x, acc["times"].cast("int"))).alias("out"), F.lit(1).cast("long").alias("times")))

    return F.aggregate(body, start, step, lambda acc: acc["out"])


def iterate(start: Column, step, count: int) -> Column:
    """start, step(start), … as an array of ``count`` items; the bound is needed."""
    positive(count, "count")
    return F.aggregate(F.sequence(F.lit(1), F.lit(count - 1)) if count > 1 else F.array().cast("array<int>"), F.array(start), lambda acc, _: F.concat(acc, F.array(step(F.element_at(acc, -1)))))


# -- arrays -----------------------------------------------------------------


def rotate(array: Column, steps: int) -> Column:
    """Rotated right by ``steps``; left if negative."""
    n = F.size(array)
    k = F.pmod(F.lit(steps), F.when(n > 0, n).otherwise(F.lit(1)))
    return F.concat(F.slice(array, n - k + 1, k), F.slice(array, F.lit(1), n - k))


def separated(array: Column, separator: Column, before: Column | None = None, after: Column | None = None) -> Column:
    """The items with a separator in each gap, and something before and after if there are items."""
    mixed = F.flatten(F.transform(array, lambda x, i: F.when(i == 0, F.array(x)).otherwise(F.array(separator, x))))
    whole = F.concat(*[p for p in (F.array(before) if before is not None else None, mixed, F.array(after) if after is not None else None) if p is not None])
    return F.when(F.size(array) > 0, whole).otherwise(array)


def take_to(array: Column, item: Column) -> Column:
    """Items before the first ``item``; all if there is none."""
    at = F.array_position(array, item)
    return F.when(at > 0, F.slice(array, F.lit(1), (at - 1).cast("int"))).otherwise(array)


def take_last(array: Column, n: int) -> Column:
    return F.slice(array, F.greatest(F.size(array) - n, F.lit(0)) + 1, F.lit(n)) if n else F.slice(array, 1, 0)


def take_last_to(array: Column, item: Column) -> Column:
    """Items after the last ``item``; all if there is none."""
    return F.reverse(take_to(F.reverse(array), item))


def skip_to(array: Column, item: Column) -> Column:
    """Items after the first ``item``; none if there is none."""
    at = F.array_position(array, item)
    return F.when(at > 0, F.slice(array, (at + 1).cast("int"), F.size(array))).otherwise(F.slice(array, 1, 0))


def skip_last(array: Column, n: int) -> Column:
    return F.slice(array, F.lit(1), F.greatest(F.size(array) - n, F.lit(0)))


def skip_last_to(array: Column, item: Column) -> Column:
    """Items before the last ``item``; none if there is none."""
    return F.reverse(skip_to(F.reverse(array), item))


def deep_flatten(array: Column, levels: int) -> Column:
    """Flattened so many levels: nesting is part of a column's type, so it is known."""
    for _ in range(non_negative(levels, "levels")):
        array = F.flatten(array)
    return array
