"""Differences of sequences: matches, edit operations, ratios, text diffs, close matches."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher, context_diff, ndiff, unified_diff

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MATCH = "array<struct<a:int,b:int,size:int>>"
OPERATION = "struct<type:string,a1:int,a2:int,b1:int,b2:int>"


def _matcher(a, b, junk: frozenset, auto_junk: bool) -> SequenceMatcher:
    return SequenceMatcher(junk.__contains__ if junk else None, list(a), list(b), auto_junk)


def _udf(make: Callable, kind: str, junk=(), auto_junk: bool = True):
    bad = frozenset(junk)

    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else make(_matcher(x, y, bad, auto_junk)) for x, y in zip(a, b)], dtype=object)

    return run


def matches(a: Column, b: Column, junk=(), auto_junk: bool = True) -> Column:
    """Matching blocks of two arrays (or strings), ended by one of size 0."""
    return _udf(lambda m: [{"a": x.a, "b": x.b, "size": x.size} for x in m.get_matching_blocks()], MATCH, junk, auto_junk)(a, b)


def longest_match(a: Column, b: Column, junk=(), auto_junk: bool = True) -> Column:
    """[a, b, size] of the longest matching block."""
    return _udf(lambda m: list(m.find_longest_match()), "array<int>", junk, auto_junk)(a, b)


def operations(a: Column, b: Column, junk=(), auto_junk: bool = True) -> Column:
    """replace, delete, insert and equal runs that turn a into b."""
    return _udf(lambda m: [dict(zip(("type", "a1", "a2", "b1", "b2"), o)) for o in m.get_opcodes()], f"array<{OPERATION}>", junk, auto_junk)(a, b)


def grouped_operations(a: Column, b: Column, context: int = 3) -> Column:
    """The operations in groups with so many equal items around changes."""
    return _udf(lambda m: [[dict(zip(("type", "a1", "a2", "b1", "b2"), o)) for o in g] for g in m.get_grouped_opcodes(context)], f"array<array<{OPERATION}>>")(a, b)


def ratio(a: Column, b: Column, junk=(), auto_junk: bool = True) -> Column:
    """2 * matched / total; 1 for two empty sequences."""
    return _udf(lambda m: m.ratio(), "double", junk, auto_junk)(a, b)


def quick_ratio(a: Column, b: Column) -> Column:
    """An upper bound of the ratio from the bags of items: 2 * common / total, by counting either once."""
    from collections import Counter

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p, q):
            total = len(p) + len(q)
            return 2.0 * (Counter(p) & Counter(q)).total() / total if total else 1.0

        return pd.Series([None if p is None or q is None else one(p, q) for p, q in zip(x, y)], dtype=object)

    return run(a, b)


def real_quick_ratio(a: Column, b: Column) -> Column:
    """An upper bound of the ratio from the lengths alone."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.least(F.size(a), F.size(b)) / F.greatest(total, F.lit(1)))


def _letters(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))


def _marks(letters: Column, share: float) -> Column:
    """The first of an array's letters, numbered among equals, in rising order: so many that two arrays with that share of them in common share one."""
    ranked = F.array_sort(letters)
    numbered = F.transform(ranked, lambda x, i: F.concat(x, (i - F.array_position(ranked, x) + 1).cast("string")))
    least = F.greatest(F.ceil(F.size(letters) * F.lit(share) - F.lit(1e-9)), F.lit(1))
    return F.slice(numbered, F.lit(1), (F.size(letters) - least + 1).cast("int"))


def close_matches(words: DataFrame, queries: DataFrame, word: str, query: str, count: int = 3, cutoff: float = 0.6) -> DataFrame:
    """query, word, ratio: each query's ``count`` closest words with a ratio of at least ``cutoff``.

    A ratio of c takes c / (2 - c) of either's letters in common.  So words and
    queries meet in the first of their ordered letters, as many as such pairs
    surely share one of; the rest is never compared.  Only a cutoff of 0 takes
    all pairs.
    """
    if count <= 0 or not 0 <= cutoff <= 1:
        raise ValueError("count must be positive and cutoff from 0 to 1")
    share = cutoff / (2 - cutoff)
    a = words.select(F.col(word).alias("word")).distinct().withColumn("wa", _letters(F.col("word")))
    b = queries.select(F.col(query).alias("query")).distinct().withColumn("qa", _letters(F.col("query")))
    if cutoff:
        met = a.where("word <> ''").withColumn("_m", F.explode(_marks(F.col("wa"), share))).join(b.where("query <> ''").withColumn("_n", F.explode(_marks(F.col("qa"), share))), F.col("_m") == F.col("_n"))
        empty = a.where("word = ''").join(b.where("query = ''").withColumn("_e", F.lit("")), F.col("word") == F.col("_e")).drop("_e")  # two empty ones are equal
        met = met.drop("_m", "_n").dropDuplicates(["word", "query"]).unionByName(empty)
    else:
        met = b.crossJoin(a)
    near = met.where(real_quick_ratio(F.col("wa"), F.col("qa")) >= cutoff)
    rated = near.withColumn("ratio", ratio(F.col("wa"), F.col("qa"))).where(F.col("ratio") >= cutoff)
    ranked = rated.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("ratio"), "word")))
    return ranked.where(F.col("_n") <= count).select("query", "word", "ratio")


def _normal(a: list[str], b: list[str]) -> list[str]:
    def span(lo: int, hi: int) -> str:
        return str(hi) if hi - lo <= 1 else f"{lo + 1},{hi}"

    out = []
    for kind, a1, a2, b1, b2 in SequenceMatcher(None, a, b).get_opcodes():
        if kind == "equal":
            continue
        left = str(a1) if kind == "insert" else span(a1, a2)
        right = str(b1) if kind == "delete" else span(b1, b2)
        out.append(left + {"replace": "c", "delete": "d", "insert": "a"}[kind] + right)
        out += [f"< {x}" for x in a[a1:a2]]
        if kind == "replace":
            out.append("---")
        out += [f"> {x}" for x in b[b1:b2]]
    return out


_FORMATS: dict[str, Callable] = {
    "normal": lambda a, b, n, la, lb: _normal(a, b),
    "unified": lambda a, b, n, la, lb: list(unified_diff(a, b, la, lb, lineterm="", n=n)),
    "context": lambda a, b, n, la, lb: list(context_diff(a, b, la, lb, lineterm="", n=n)),
    "readable": lambda a, b, n, la, lb: [x.rstrip("\n") for x in ndiff(a, b)],
}


def diff(a: Column, b: Column, form: str = "unified", context: int = 3, labels: tuple[str, str] = ("source", "target")) -> Column:
    """Lines of the difference of two texts: normal, unified, context or readable."""
    if form not in _FORMATS:
        raise ValueError(f"form must be one of {', '.join(_FORMATS)}")

    @F.pandas_udf("array<string>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else _FORMATS[form](p.split("\n"), q.split("\n"), context, *labels) for p, q in zip(x, y)], dtype=object)

    return run(a, b)
