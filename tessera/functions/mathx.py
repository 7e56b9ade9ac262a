"""Mathematics: elementary, hyperbolic, floating point, combinatorial and prime functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAN = float("nan")


def _lit(x: float) -> Column:
    return F.lit(x)


def log(x: Column) -> Column:
    """Natural logarithm with the IEEE results of 0 and of negative numbers, where Spark's is null."""
    return F.when(x > 0, F.ln(x)).when(x == 0, _lit(float("-inf"))).when(x.isNotNull(), _lit(_NAN))


def log_base(x: Column, base: float) -> Column:
    return log(x) / F.lit(float(np.log(base)))


def coth(x: Column) -> Column:
    """Null at 0."""
    return F.try_divide(F.lit(1.0), F.tanh(x))


def sech(x: Column) -> Column:
    return 1 / F.cosh(x)


def csch(x: Column) -> Column:
    """Null at 0."""
    return F.try_divide(F.lit(1.0), F.sinh(x))


def acoth(x: Column) -> Column:
    return F.atanh(F.try_divide(F.lit(1.0), x))


def asech(x: Column) -> Column:
    return F.acosh(F.try_divide(F.lit(1.0), x))


def acsch(x: Column) -> Column:
    return F.asinh(F.try_divide(F.lit(1.0), x))


def close_to(a: Column, b: Column, epsilon: float) -> Column:
    """|a - b| <= epsilon; false where either is not finite."""
    finite = lambda x: ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return finite(a) & finite(b) & (F.abs(a - b) <= epsilon)


@F.pandas_udf(T.DoubleType())
def next_up(x: pd.Series) -> pd.Series:
    return pd.Series(np.nextafter(x.to_numpy(float), np.inf))


@F.pandas_udf(T.DoubleType())
def next_down(x: pd.Series) -> pd.Series:
    return pd.Series(np.nextafter(x.to_numpy(float), -np.inf))


@F.pandas_udf(T.DoubleType())
def next_towards(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series(np.nextafter(x.to_numpy(float), y.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def ulp(x: pd.Series) -> pd.Series:
    v = np.abs(x.to_numpy(float))
    return pd.Series(np.where(np.isinf(v), np.inf, np.spacing(np.where(np.isinf(v), 0, v))))


def binomial(n: Column, k: Column) -> Column:
    """n over k as decimal(38,0); an error unless 0 <= k <= n."""
    n, k = n.cast("long"), k.cast("long")
    low = F.least(k, n - k)
    steps = F.when(low > 0, F.sequence(F.lit(1).cast("long"), low)).otherwise(F.array().cast("array<bigint>"))
    exact = "decimal(38,0)"
    # acc * (n - low + i) / i is whole at each step
    made = F.aggregate(steps, F.lit(1).cast(exact), lambda acc, i: F.call_function("div", acc * (n - low + i).cast("decimal(18,0)"), i.cast("decimal(18,0)")).cast(exact))
    return F.when((k < 0) | (k > n), F.raise_error(F.lit("binomial needs 0 <= k <= n"))).otherwise(made)


def factorial(n: Column) -> Column:
    """n! as decimal(38,0), for n to 33; beyond it overflows with an error."""
    n = n.cast("int")
    steps = F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    made = F.aggregate(steps, F.lit(1).cast("decimal(38,0)"), lambda acc, i: (acc * i.cast("decimal(3,0)")).cast("decimal(38,0)"))
    return F.when((n < 0) | (n > 33), F.raise_error(F.lit("factorial needs 0 <= n <= 33"))).otherwise(made)


@F.pandas_udf(T.StringType())
def big_factorial(n: pd.Series) -> pd.Series:
    """n! in digits, for any n."""
    import math

    return n.map(lambda v: str(math.factorial(int(v))), na_action="ignore")


def digits(x: Column, base: int = 10) -> Column:
    """Digits of |x|, the lowest first; [0] for 0."""
    if not 2 <= base <= 36:
        raise ValueError("base must be from 2 to 36")
    shown = F.conv(F.abs(x.cast("long")).cast("string"), 10, base)
    return F.transform(F.split(F.reverse(shown), ""), lambda c: F.conv(c, base, 10).cast("int"))


# The first twelve primes, which tell for every 64-bit number whether it is one.
_WITNESSES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)


def _prime(n: int) -> bool:
    """Miller-Rabin."""
    if n < 2:
        return False
    for p in _WITNESSES:
        if n % p == 0:
            return n == p
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in _WITNESSES:
        y = pow(a, d, n)
        if y in (1, n - 1):
            continue
        for _ in range(s - 1):
            y = y * y % n
            if y == n - 1:
                break
        else:
            return False
    return True


def _divisor(n: int) -> int:
    """A divisor of an odd composite number, by Pollard's walks: about the fourth root of n steps."""
    from math import gcd, isqrt

    if isqrt(n) ** 2 == n:
        return isqrt(n)
    for c in range(1, n):
        slow = fast = 2
        while True:
            product, steps = 1, []
            for _ in range(64):  # a gcd for so many steps together
                slow = (slow * slow + c) % n
                fast = (fast * fast + c) % n
                fast = (fast * fast + c) % n
                steps.append(abs(slow - fast))
                product = product * steps[-1] % n
            if (g := gcd(product, n)) == 1:
                continue
            g = next(x for s in steps if (x := gcd(s, n)) > 1)
            if g < n:
                return g
            break
    raise AssertionError("a composite number has a divisor")


def _factors(n: int) -> list[int]:
    out, todo = [], []
    for p in _WITNESSES:
        while n > 1 and n % p == 0:
            out.append(p)
            n //= p
    if n > 1:
        todo.append(n)
    while todo:
        n = todo.pop()
        if _prime(n):
            out.append(n)
        else:
            d = _divisor(n)
            todo += [d, n // d]
    return sorted(out)


@F.pandas_udf(T.BooleanType())
def is_prime(x: pd.Series) -> pd.Series:
    """Certain for 64-bit numbers."""
    return x.map(lambda n: _prime(int(n)), na_action="ignore").astype(object)


def primes(spark: SparkSession, most: int) -> DataFrame:
    """value: the primes up to ``most``. Segments of numbers are sieved independently by the primes to its root."""
    root = int(most**0.5) + 1
    small = [p for p in range(2, root + 1) if all(p % q for q in range(2, int(p**0.5) + 1))]
    segment = max(1 << 16, root)

    def sieve(batches):
        for batch in batches:
            for k in batch["id"]:
                lo, hi = k * segment, min(most + 1, (k + 1) * segment)
                prime = np.ones(hi - lo, bool)
                prime[: max(0, 2 - lo)] = False
                for p in small:
                    first = max(p * p, -(-lo // p) * p)
                    if first < hi:
                        prime[first - lo :: p] = False
                yield pd.DataFrame({"value": np.flatnonzero(prime) + lo})

    return spark.range(most // segment + 1 if most >= 2 else 0).mapInPandas(sieve, "value long")


def prime_factors(df: DataFrame, value: str) -> DataFrame:
    """Adds factors: the prime factors with repeats, rising; empty for 1 and below."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def split(x: pd.Series) -> pd.Series:
        return x.map(lambda n: None if n is None or pd.isna(n) else _factors(int(n)) if n > 1 else [])

    return df.withColumn("factors", split(value))
