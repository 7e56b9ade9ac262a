"""Complex numbers, fractions and quaternions as structs of plain columns."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.mathx import close_to, log
from tessera.operators.aggregate import gcd_pair
from tessera.plans.expr import let

# -- complex: struct(a, b) = a + b i ------------------------------------------------


def cx(a, b=0.0) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.struct(as_column(a).cast("double").alias("a"), as_column(b).cast("double").alias("b"))


def cx_polar(radius: Column, angle: Column) -> Column:
    return cx(radius * F.cos(angle), radius * F.sin(angle))


def cx_add(x: Column, y: Column) -> Column:
    return cx(x["a"] + y["a"], x["b"] + y["b"])


def cx_sub(x: Column, y: Column) -> Column:
    return cx(x["a"] - y["a"], x["b"] - y["b"])


def cx_mul(x: Column, y: Column) -> Column:
    return cx(x["a"] * y["a"] - x["b"] * y["b"], x["a"] * y["b"] + x["b"] * y["a"])


def cx_neg(x: Column) -> Column:
    return cx(-x["a"], -x["b"])


def cx_conj(x: Column) -> Column:
    return cx(x["a"], -x["b"])


def cx_norm(x: Column) -> Column:
    """a² + b²."""
    return x["a"] * x["a"] + x["b"] * x["b"]


def cx_abs(x: Column) -> Column:
    return F.sqrt(cx_norm(x))


def cx_arg(x: Column) -> Column:
    return F.atan2(x["b"], x["a"])


def cx_recip(x: Column) -> Column:
    n = cx_norm(x)
    return cx(F.try_divide(x["a"], n), F.try_divide(-x["b"], n))


def cx_div(x: Column, y: Column) -> Column:
    return cx_mul(x, cx_recip(y))


def cx_exp(x: Column) -> Column:
    return cx_polar(F.exp(x["a"]), x["b"])


def cx_log(x: Column) -> Column:
    return cx(log(cx_abs(x)), cx_arg(x))


def cx_square(x: Column) -> Column:
    return cx_mul(x, x)


def cx_sqrt(x: Column) -> Column:
    return cx_polar(F.sqrt(cx_abs(x)), cx_arg(x) / 2)


def cx_pow(x: Column, y: Column) -> Column:
    return cx_exp(cx_mul(y, cx_log(x)))


def cx_roots(x: Column, n: int) -> Column:
    """The n n-th roots."""
    if n == 0:
        raise ValueError("n must not be 0")
    radius, angle = F.pow(cx_abs(x), F.lit(1.0 / n)), cx_arg(x) / n
    return F.transform(F.sequence(F.lit(0), F.lit(abs(n) - 1)), lambda k: cx_polar(radius, angle + k * (2 * math.pi / n)))


def cx_sin(x: Column) -> Column:
    return cx(F.sin(x["a"]) * F.cosh(x["b"]), F.cos(x["a"]) * F.sinh(x["b"]))


def cx_cos(x: Column) -> Column:
    return cx(F.cos(x["a"]) * F.cosh(x["b"]), -F.sin(x["a"]) * F.sinh(x["b"]))


def cx_tan(x: Column) -> Column:
    return cx_div(cx_sin(x), cx_cos(x))


def cx_sinh(x: Column) -> Column:
    return cx(F.sinh(x["a"]) * F.cos(x["b"]), F.cosh(x["a"]) * F.sin(x["b"]))


def cx_cosh(x: Column) -> Column:
    return cx(F.cosh(x["a"]) * F.cos(x["b"]), F.sinh(x["a"]) * F.sin(x["b"]))


def cx_tanh(x: Column) -> Column:
    return cx_div(cx_sinh(x), cx_cosh(x))


def cx_round(x: Column, how: str = "round") -> Column:
    """round (half away from zero), floor, ceil or truncate of both parts."""
    make = {"round": lambda v: F.signum(v) * F.floor(F.abs(v) + 0.5), "floor": F.floor, "ceil": F.ceil, "truncate": lambda v: F.signum(v) * F.floor(F.abs(v))}[how]
    return cx(make(x["a"]), make(x["b"]))


def cx_close_to(x: Column, y: Column, epsilon: float) -> Column:
    return close_to(cx_abs(cx_sub(x, y)), F.lit(0.0), epsilon)


def cx_parse(s: Column) -> Column:
    """From texts such as "1", "-2i", "3+4i"; null if it is none."""
    return _from_units(s, ("", "i"), lambda v: cx(v[""], v["i"]))


def _from_units(s: Column, units: tuple[str, ...], make) -> Column:
    bare = F.regexp_replace(s, r"\s+", "")
    letters = "".join(units)
    number = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
    term = rf"[+-]?(?:{number}\*?[{letters}]?|[{letters}])"
    terms = F.regexp_extract_all(bare, F.lit(term), F.lit(0))

    def value(t: Column) -> Column:
        digits = F.regexp_replace(t, rf"\*?[{letters}]", "")
        return F.when(digits.isin("", "+"), F.lit(1.0)).when(digits == "-", F.lit(-1.0)).otherwise(digits.try_cast("double"))

    def of(unit: str) -> Column:
        own = F.filter(terms, lambda t: t.rlike(f"{unit}$") if unit else ~t.rlike(f"[{letters}]$"))
        return F.aggregate(own, F.lit(0.0), lambda acc, t: acc + value(t))

    found = {u: of(u) for u in units}
    return F.when(bare.rlike(rf"^{term}(?:[+-](?:{number}\*?[{letters}]?|[{letters}]))*$"), make(found))


# -- fractions: struct(a, b) = a / b, reduced, b > 0; 1/0, -1/0 and 0/0 are infinite and not a number --------


def fr(a: Column, b: Column | int = 1) -> Column:
    b = F.lit(b) if isinstance(b, int) else b

    def reduced(v: Column) -> Column:
        x, y = v["a"], v["b"]
        by = F.greatest(v["g"], F.lit(1).cast("long"))
        sign = F.when(y < 0, F.lit(-1).cast("long")).otherwise(F.lit(1).cast("long"))
        whole = lambda n: F.call_function("div", n * sign, by)
        return F.struct(F.when(y == 0, F.signum(x).cast("long")).otherwise(whole(x)).alias("a"), F.when(y == 0, F.lit(0).cast("long")).otherwise(whole(y)).alias("b"))

    pair = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    with_gcd = lambda v: F.struct(v["a"].alias("a"), v["b"].alias("b"), gcd_pair(v["a"], v["b"]).alias("g"))
    return let(pair, lambda v: let(with_gcd(v), reduced))


def fr_add(x: Column, y: Column) -> Column:
    return fr(x["a"] * y["b"] + y["a"] * x["b"], x["b"] * y["b"])


def fr_sub(x: Column, y: Column) -> Column:
    return fr(x["a"] * y["b"] - y["a"] * x["b"], x["b"] * y["b"])


def fr_mul(x: Column, y: Column) -> Column:
    return fr(x["a"] * y["a"], x["b"] * y["b"])


def fr_div(x: Column, y: Column) -> Column:
    return fr(x["a"] * y["b"], x["b"] * y["a"])


def fr_neg(x: Column) -> Column:
    return fr(-x["a"], x["b"])


def fr_recip(x: Column) -> Column:
    return fr(x["b"], x["a"])


def fr_pow(x: Column, n: int) -> Column:
    one = F.struct(F.lit(1).cast("long").alias("a"), F.lit(1).cast("long").alias("b"))
    base = fr_recip(x) if n < 0 else x
    return F.aggregate(F.sequence(F.lit(1), F.lit(abs(n))), one, lambda acc, _: fr_mul(acc, base)) if n else one


def fr_compare(x: Column, y: Column) -> Column:
    """-1, 0 or 1, by exact cross products."""
    wide = lambda v: v.cast("decimal(19,0)")
    return F.signum((wide(x["a"]) * wide(y["b"]) - wide(y["a"]) * wide(x["b"])).cast("double")).cast("int")


def fr_to_double(x: Column) -> Column:
    inf = F.lit(float("inf"))
    return F.when(x["b"] == 0, F.when(x["a"] > 0, inf).when(x["a"] < 0, -inf).otherwise(F.lit(float("nan")))).otherwise(x["a"] / F.when(x["b"] == 0, F.lit(1)).otherwise(x["b"]))


def fr_truncate(x: Column) -> Column:
    return F.call_function("div", x["a"], x["b"])


def fr_floor(x: Column) -> Column:
    return F.call_function("div", x["a"] - F.pmod(x["a"], x["b"]), x["b"])


def fr_text(x: Column) -> Column:
    return F.when(x["b"] == 1, x["a"].cast("string")).otherwise(F.concat_ws("/", x["a"].cast("string"), x["b"].cast("string")))


def fr_parse(s: Column) -> Column:
    """From "a" or "a/b"; null if it is neither."""
    bare = F.regexp_replace(s, r"\s+", "")
    parts = F.split(bare, "/")
    return F.when(bare.rlike(r"^[+-]?[0-9]{1,18}(?:/[+-]?[0-9]{1,18})?$"), fr(parts[0].try_cast("long"), F.coalesce(F.get(parts, F.lit(1)).try_cast("long"), F.lit(1).cast("long"))))


_FRACTION = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def fr_from_double(x: Column, most: int = 1_000_000_000, error: float = 0.0) -> Column:
    """The first convergent within ``error``, or the last whose denominator is not above ``most``."""

    @F.pandas_udf(_FRACTION)
    def run(v: pd.Series) -> pd.DataFrame:
        out = []
        for value in v:
            if value is None or math.isnan(value):
                out.append((0, 0))
                continue
            if math.isinf(value):
                out.append((1 if value > 0 else -1, 0))
                continue
            sign, rest = (-1, -value) if value < 0 else (1, value)
            goal, (p0, q0), (p1, q1) = rest, (0, 1), (1, 0)
            for _ in range(64):
                whole = math.floor(rest)
                p2, q2 = whole * p1 + p0, whole * q1 + q0
                if q2 > most or p2 >= 1 << 63:
                    break
                (p0, q0), (p1, q1) = (p1, q1), (p2, q2)
                if abs(goal - p1 / q1) <= error or rest == whole:
                    break
                rest = 1 / (rest - whole)
            out.append((sign * p1, q1))
        return pd.DataFrame(out, columns=["a", "b"])

    return run(x)


def farey(spark: SparkSession, n: int, ascending: bool = True) -> DataFrame:
    """place, a, b: the reduced fractions from 0 to 1 with denominators to n, in order."""
    if n <= 0:
        raise ValueError("n must be positive")
    b = spark.range(1, n + 1).select(F.col("id").alias("b"))
    rows = b.withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b")))).where((gcd_pair(F.col("a"), F.col("b")) == 1))
    from tessera.plans.order import global_index

    key = F.col("a") / F.col("b")
    rows = rows.withColumn("_v", key if ascending else -key)
    return global_index(rows, ["_v"], "place").select("place", "a", "b")


def positive_fractions(spark: SparkSession, count: int) -> DataFrame:
    """place, a, b: the first ``count`` positive fractions, level by level of the Calkin-Wilf tree.

    The path to a place is its binary digits after the first: 0 goes to a/(a+b), 1 to (a+b)/b.
    """
    place = F.col("id") + 1
    one = F.lit(1).cast("long")
    path = F.split(F.substring(F.bin(place), F.lit(2), F.length(F.bin(place))), "")
    step = lambda s, d: F.when(d == "0", F.struct(s["a"].alias("a"), (s["a"] + s["b"]).alias("b"))).when(d == "1", F.struct((s["a"] + s["b"]).alias("a"), s["b"].alias("b"))).otherwise(s)
    made = F.aggregate(path, F.struct(one.alias("a"), one.alias("b")), step)
    return spark.range(count).select(F.col("id").alias("place"), made["a"].alias("a"), made["b"].alias("b"))


# -- quaternions: struct(w, x, y, z) --------------------------------------------------


def qt(w, x=0.0, y=0.0, z=0.0) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(*[as_column(v).cast("double").alias(n) for n, v in zip("wxyz", (w, x, y, z))])


def _each(make, *qs: Column) -> Column:
    return qt(*[make(*[q[n] for q in qs]) for n in "wxyz"])


def qt_add(p: Column, q: Column) -> Column:
    return _each(lambda a, b: a + b, p, q)


def qt_sub(p: Column, q: Column) -> Column:
    return _each(lambda a, b: a - b, p, q)


def qt_scale(q: Column, s: Column) -> Column:
    return _each(lambda a: a * s, q)


def qt_mul(p: Column, q: Column) -> Column:
    """Hamilton's product."""
    pw, px, py, pz = (p[n] for n in "wxyz")
    qw, qx, qy, qz = (q[n] for n in "wxyz")
    return qt(pw * qw - px * qx - py * qy - pz * qz, pw * qx + px * qw + py * qz - pz * qy, pw * qy - px * qz + py * qw + pz * qx, pw * qz + px * qy - py * qx + pz * qw)


def qt_conj(q: Column) -> Column:
    return qt(q["w"], -q["x"], -q["y"], -q["z"])


def qt_norm(q: Column) -> Column:
    return q["w"] * q["w"] + q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"]


def qt_abs(q: Column) -> Column:
    return F.sqrt(qt_norm(q))


def qt_recip(q: Column) -> Column:
    n = qt_norm(q)
    return _each(lambda a: F.try_divide(a, n), qt_conj(q))


def qt_div(p: Column, q: Column) -> Column:
    return qt_mul(p, qt_recip(q))


def qt_normalize(q: Column) -> Column:
    n = qt_abs(q)
    return _each(lambda a: F.try_divide(a, n), q)


def _vector(q: Column) -> Column:
    return F.sqrt(q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"])


def qt_exp(q: Column) -> Column:
    v, e = _vector(q), F.exp(q["w"])
    k = F.coalesce(F.try_divide(e * F.sin(v), v), F.lit(0.0))
    return qt(e * F.cos(v), q["x"] * k, q["y"] * k, q["z"] * k)


def qt_log(q: Column) -> Column:
    v, n = _vector(q), qt_abs(q)
    k = F.coalesce(F.try_divide(F.acos(F.try_divide(q["w"], n)), v), F.lit(0.0))
    return qt(log(n), q["x"] * k, q["y"] * k, q["z"] * k)


def qt_pow(p: Column, q: Column) -> Column:
    return qt_exp(qt_mul(qt_log(p), q))


def qt_from_axis(x: Column, y: Column, z: Column, angle: Column) -> Column:
    """A turn by an angle round an axis."""
    s = F.try_divide(F.sin(angle / 2), F.sqrt(x * x + y * y + z * z))
    return qt(F.cos(angle / 2), x * s, y * s, z * s)


def qt_from_euler(yaw: Column, pitch: Column, roll: Column) -> Column:
    half = lambda a: (F.cos(a / 2), F.sin(a / 2))
    (cy, sy), (cp, sp), (cr, sr) = half(yaw), half(pitch), half(roll)
    return qt(cr * cp * cy + sr * sp * sy, sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy)


def qt_from_vectors(a: list[Column], b: list[Column]) -> Column:
    """The turn from one direction to another."""
    dot = sum((p * q for p, q in zip(a, b)), F.lit(0.0))
    size = F.sqrt(sum((p * p for p in a), F.lit(0.0)) * sum((p * p for p in b), F.lit(0.0)))
    return qt_normalize(qt(size + dot, a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]))


def qt_parse(s: Column) -> Column:
    """From texts such as "1+2i-3j+k"; null if it is none."""
    return _from_units(s, ("", "i", "j", "k"), lambda v: qt(v[""], v["i"], v["j"], v["k"]))
