"""Queries on mathematics, numbers, ranges and functional values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import mathx, numbers
from tessera.plans.registry import query
from tessera.sources import generators as gen


def _r(c, n=9):
    return F.round(c, n)


@query("range_integer", "select range as value from range(3, 50, 4)")
def _(t):
    return gen.integer_range(t.spark, 3, 50, 4)


@query("range_falling", "select range as value from range(50, 3, -7)")
def _(t):
    return gen.integer_range(t.spark, 50, 3, -7)


@query("range_length", "select 7 + 3 * range as value from range(20)")
def _(t):
    return gen.range_of_length(t.spark, 20, 7, 3)


@query("range_double", "select 0.5::double + range * 0.1::double as value from range(25)")
def _(t):
    return gen.double_range(t.spark, 0.5, 3.0, 0.1)


@query("range_decimal", "select cast(cast('10000000000000000000000' as decimal(38,0)) + range * 7 as varchar) as value from range(10)")
def _(t):
    return gen.decimal_range(t.spark, 10**22, 10**22 + 70, 7).select(F.col("value").cast("string").alias("value"))


@query("range_reversed", "select range as value from range(0, 20) order by 1 desc")
def _(t):
    return gen.integer_range(t.spark, 0, 20).orderBy(F.desc("value"))


@query("range_contains_index", "select o_orderkey, o_orderkey >= 10 and o_orderkey < 700 and (o_orderkey - 10) % 3 = 0 as inside, case when o_orderkey % 40 < 30 then 5 + (o_orderkey % 40) * 2 end as item from orders")
def _(t):
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", gen.range_contains(F.lit(10), F.lit(700), 3, k).alias("inside"), gen.range_at(F.lit(5), F.lit(2), F.lit(30), k % 40).alias("item"))


@query("range_indices", "select p_partkey, array_to_string(range(0, p_size % 6), ',') as up, array_to_string(list_reverse(range(0, p_size % 6)), ',') as down from part")
def _(t):
    a = F.array_repeat(F.lit(1), F.col("p_size") % 6)
    show = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return t.part.select("p_partkey", show(gen.indices(a)).alias("up"), show(gen.indices(a, -1)).alias("down"))


@query("range_sublist", "select range as value from range(10, 100, 5) limit 4 offset 3")
def _(t):
    return gen.range_sublist(t.spark, 18, 10, 5, 3, 7)


@query("math_elementary", "select p_partkey, round(sqrt(p_size), 9) as root, round(power(p_size, 1.5), 6) as power, round(exp(p_size / 50.0), 9) as e, round(ln(p_size), 9) as l, round(sin(p_size), 9) as s, round(atan2(p_size, 3), 9) as a, round(degrees(p_size / 7.0::double), 8) as d, round(radians(p_size), 9) as r from part")
def _(t):
    x = F.col("p_size").cast("double")
    return t.part.select("p_partkey", _r(F.sqrt(x)).alias("root"), _r(F.pow(x, F.lit(1.5)), 6).alias("power"), _r(F.exp(x / 50)).alias("e"), _r(mathx.log(x)).alias("l"), _r(F.sin(x)).alias("s"), _r(F.atan2(x, F.lit(3.0))).alias("a"), _r(F.degrees(x / 7), 8).alias("d"), _r(F.radians(x)).alias("r"))


@query("math_log_edge", "select event_id, case when event_id % 3 = 0 then '-inf' when event_id % 3 = 1 then 'nan' else 'finite' end as kind from events")
def _(t):
    x = F.when(F.col("event_id") % 3 == 0, 0.0).when(F.col("event_id") % 3 == 1, -1.0).otherwise(2.0)
    l = mathx.log(x)
    return t.events.select("event_id", F.when(F.isnan(l), "nan").when(l == float("-inf"), "-inf").otherwise("finite").alias("kind"))


@query("math_hyperbolic", "with v as (select p_partkey, p_size / 20.0::double as x from part) select p_partkey, round(sinh(x), 9) as sinh, round(cosh(x), 9) as cosh, round(tanh(x), 9) as tanh, round(asinh(x), 9) as asinh, round(acosh(x + 1), 9) as acosh, round(atanh(x / 3), 9) as atanh, round(1 / tanh(x), 8) as coth, round(1 / cosh(x), 9) as sech, round(1 / sinh(x), 8) as csch, round(atanh(1 / (x + 1)), 9) as acoth, round(asinh(1 / x), 8) as acsch, round(acosh(1 / (x / 3)), 8) as asech from v where x > 0")
def _(t):
    v = t.part.select("p_partkey", (F.col("p_size") / 20.0).alias("x")).where("x > 0")
    x = F.col("x")
    return v.select("p_partkey", _r(F.sinh(x)).alias("sinh"), _r(F.cosh(x)).alias("cosh"), _r(F.tanh(x)).alias("tanh"), _r(F.asinh(x)).alias("asinh"), _r(F.acosh(x + 1)).alias("acosh"), _r(F.atanh(x / 3)).alias("atanh"), _r(mathx.coth(x), 8).alias("coth"), _r(mathx.sech(x)).alias("sech"), _r(mathx.csch(x), 8).alias("csch"), _r(mathx.acoth(x + 1)).alias("acoth"), _r(mathx.acsch(x), 8).alias("acsch"), _r(mathx.asech(x / 3), 8).alias("asech"))


@query("math_neighbours", "select p_partkey, p_retailprice as same, true as between, power(2::double, floor(log2(p_retailprice)) - 52) as ulp from part")
def _(t):
    x = F.col("p_retailprice")
    up, down = mathx.next_up(x), mathx.next_down(x)
    return t.part.select("p_partkey", mathx.next_down(up).alias("same"), ((down < x) & (x < up) & (mathx.next_towards(x, F.lit(1e9)) == up)).alias("between"), mathx.ulp(x).alias("ulp"))


@query("math_close_to", "select p_partkey, abs(p_retailprice - 1000) <= 100 as close from part")
def _(t):
    return t.part.select("p_partkey", mathx.close_to(F.col("p_retailprice"), F.lit(1000.0), 100.0).alias("close"))


@query("math_binomial_factorial", "select p_partkey, cast(case p_size % 5 when 0 then 1 when 1 then p_size when 2 then p_size * (p_size - 1) // 2 when 3 then p_size * (p_size - 1) * (p_size - 2) // 6 else p_size * (p_size - 1) * (p_size - 2) * (p_size - 3) // 24 end as varchar) as choose, cast(factorial(p_size % 20) as varchar) as fact from part")
def _(t):
    n = F.col("p_size")
    return t.part.select("p_partkey", mathx.binomial(n, n % 5).cast("string").alias("choose"), mathx.factorial(n % 20).cast("string").alias("fact"))


@query("math_big_factorial", "select p_partkey, cast(factorial(p_size % 30) as varchar) as fact from part")
def _(t):
    return t.part.select("p_partkey", mathx.big_factorial((F.col("p_size") % 30)).alias("fact"))


@query("math_digits", "select o_orderkey, array_to_string(string_split(reverse(cast(o_orderkey as varchar)), ''), ',') as ten, array_to_string(string_split(reverse(bin(o_orderkey)), ''), ',') as two from orders")
def _(t):
    show = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", show(mathx.digits(k)).alias("ten"), show(mathx.digits(k, 2)).alias("two"))


_PRIME = "(select range as n from range(2, 2001) where not exists (select 1 from range(2, 45) d(k) where k < range and range % k = 0))"


@query("math_primes", f"select n as value from {_PRIME}")
def _(t):
    return mathx.primes(t.spark, 2000)


@query("math_is_prime", "select p_partkey, p_partkey > 1 and not exists (select 1 from range(2, 1000) d(k) where k * k <= p_partkey and p_partkey % k = 0) as prime from part")
def _(t):
    return t.part.select("p_partkey", mathx.is_prime("p_partkey").alias("prime"))


@query("math_prime_factors", "select p_partkey, p_partkey as product from part where p_partkey > 0")
def _(t):
    out = mathx.prime_factors(t.part.where("p_partkey > 0").select("p_partkey"), "p_partkey")
    return out.select("p_partkey", F.aggregate("factors", F.lit(1).cast("long"), lambda a, x: a * x).alias("product"))


def _cx(t):
    return t.part.select("p_partkey", numbers.cx(F.col("p_size"), (F.col("p_partkey") % 7) - 3).alias("x"), numbers.cx(F.col("p_partkey") % 5 + 1, F.lit(2.0)).alias("y"))


_CX = "with v as (select p_partkey, cast(p_size as double) as a, (p_partkey % 7 - 3)::double as b, (p_partkey % 5 + 1)::double as c, 2::double as d from part) "


@query("complex_arithmetic", _CX + "select p_partkey, a + c as add_a, b - d as sub_b, a * c - b * d as mul_a, a * d + b * c as mul_b, round((a * c + b * d) / (c * c + d * d), 9) as div_a, round((b * c - a * d) / (c * c + d * d), 9) as div_b, a * a + b * b as norm, -b as conj_b, round(sqrt(a * a + b * b), 9) as size, round(atan2(b, a), 9) as arg from v")
def _(t):
    n, x, y = numbers, F.col("x"), F.col("y")
    return _cx(t).select("p_partkey", n.cx_add(x, y)["a"].alias("add_a"), n.cx_sub(x, y)["b"].alias("sub_b"), n.cx_mul(x, y)["a"].alias("mul_a"), n.cx_mul(x, y)["b"].alias("mul_b"), _r(n.cx_div(x, y)["a"]).alias("div_a"), _r(n.cx_div(x, y)["b"]).alias("div_b"), n.cx_norm(x).alias("norm"), n.cx_conj(x)["b"].alias("conj_b"), _r(n.cx_abs(x)).alias("size"), _r(n.cx_arg(x)).alias("arg"))


@query("complex_functions", _CX + "select p_partkey, a as root_a, round(b, 8) as root_b, round(a, 8) as exp_log, round(a * a - b * b, 6) as square, 1.0::double as unit, 3 as roots from v where a > 0")
def _(t):
    n, x = numbers, F.col("x")
    root = n.cx_sqrt(x)
    unit = n.cx_add(n.cx_square(n.cx_sin(x)), n.cx_square(n.cx_cos(x)))
    small = n.cx(x["a"] / 50, x["b"] / 50)
    unit = n.cx_add(n.cx_square(n.cx_sin(small)), n.cx_square(n.cx_cos(small)))
    return _cx(t).where("x.a > 0").select("p_partkey", _r(n.cx_square(root)["a"], 8).alias("root_a"), _r(n.cx_square(root)["b"], 8).alias("root_b"), _r(n.cx_exp(n.cx_log(x))["a"], 8).alias("exp_log"), _r(n.cx_pow(x, n.cx(2.0))["a"], 6).alias("square"), _r(unit["a"]).alias("unit"), F.size(n.cx_roots(x, 3)).alias("roots"))


@query("complex_rounding_parse", _CX + "select p_partkey, sign(a / 4) * floor(abs(a / 4) + 0.5) as rounded, floor(b / 2) as floored, a as parsed_a, b as parsed_b, true as close from v")
def _(t):
    n, x = numbers, F.col("x")
    s = F.concat(x["a"].cast("string"), F.when(x["b"] < 0, "").otherwise("+"), x["b"].cast("string"), F.lit("i"))
    p = n.cx_parse(s)
    return _cx(t).select("p_partkey", n.cx_round(n.cx(x["a"] / 4, x["b"]))["a"].alias("rounded"), n.cx_round(n.cx(x["a"], x["b"] / 2), "floor")["b"].alias("floored"), p["a"].alias("parsed_a"), p["b"].alias("parsed_b"), n.cx_close_to(x, p, 1e-9).alias("close"))


def _fr(t):
    return t.part.select("p_partkey", numbers.fr(F.col("p_size"), F.lit(12)).alias("x"), numbers.fr(F.col("p_partkey") % 9 - 4, F.lit(10)).alias("y"))


_FR = "with v as (select p_partkey, cast(p_size as bigint) as n, p_partkey % 9 - 4 as m from part) "


def _reduced(num, den, name):
    return f"cast(({num}) // gcd({num}, {den}) as varchar) || case when ({den}) // gcd({num}, {den}) = 1 then '' else '/' || cast(({den}) // gcd({num}, {den}) as varchar) end as {name}"


@query("fraction_arithmetic", _FR + f"select p_partkey, {_reduced('n * 10 + m * 12', '120', 'add')}, {_reduced('n * 10 - m * 12', '120', 'sub')}, {_reduced('n * m', '120', 'mul')}, cast(sign(n * 10 - m * 12) as integer) as cmp, n / 12.0::double as value, n // 12 as whole from v")
def _(t):
    n, x, y = numbers, F.col("x"), F.col("y")
    return _fr(t).select("p_partkey", n.fr_text(n.fr_add(x, y)).alias("add"), n.fr_text(n.fr_sub(x, y)).alias("sub"), n.fr_text(n.fr_mul(x, y)).alias("mul"), n.fr_compare(x, y).alias("cmp"), n.fr_to_double(x).alias("value"), n.fr_floor(x).alias("whole"))


@query("fraction_other", _FR + "select p_partkey, 1.0::double as one, case when m > 0 then 'inf' when m < 0 then '-inf' else 'nan' end as over_zero, n * n * n as cube, '3/4' as parsed from v where n > 0")
def _(t):
    n, x = numbers, F.col("x")
    over = n.fr_to_double(n.fr(F.col("p_partkey") % 9 - 4, F.lit(0)))
    return _fr(t).where("x.a > 0").select("p_partkey", n.fr_to_double(n.fr_mul(x, n.fr_recip(x))).alias("one"), F.when(F.isnan(over), "nan").when(over > 0, "inf").otherwise("-inf").alias("over_zero"), n.fr_truncate(n.fr_pow(n.fr(n.fr_truncate(n.fr_mul(x, n.fr(F.lit(12))))), 3)).alias("cube"), n.fr_text(n.fr_parse(F.lit(" 6 / 8"))).alias("parsed"))


@query("fraction_from_double", "with d as (select distinct l_discount as d from lineitem) select d, cast(cast(round(d * 100) as bigint) // gcd(cast(round(d * 100) as bigint), 100) as varchar) || case when gcd(cast(round(d * 100) as bigint), 100) = 100 then '' else '/' || cast(100 // gcd(cast(round(d * 100) as bigint), 100) as varchar) end as f from d")
def _(t):
    d = t.lineitem.select(F.col("l_discount").alias("d")).distinct()
    return d.select("d", numbers.fr_text(numbers.fr_from_double(F.col("d"), 100000, 1e-9)).alias("f"))


@query("fraction_farey", "with f as (select a.range as a, b.range as b from range(0, 16) a, range(1, 16) b where a.range <= b.range and gcd(a.range, b.range) = 1) select row_number() over (order by a / b) - 1 as place, a, b from f")
def _(t):
    return numbers.farey(t.spark, 15)


@query("fraction_positive", "with recursive f(place, a, b) as (select 0, 1, 1 union all select k, case when d = 0 then a else a + b end, case when d = 0 then a + b else b end from f, (values (0), (1)) v(d), lateral (select (place + 1) * 2 + d - 1 as k) where k < 63) select cast(place as bigint) as place, cast(a as bigint) as a, cast(b as bigint) as b from f")
def _(t):
    return numbers.positive_fractions(t.spark, 63)


def _qt(t):
    c = F.col
    return t.part.select("p_partkey", numbers.qt(c("p_size"), c("p_partkey") % 3, c("p_partkey") % 4, c("p_partkey") % 5).alias("p"), numbers.qt(1.0, 2.0, c("p_partkey") % 2, -1.0).alias("q"))


_QT = "with v as (select p_partkey, p_size::double as w, (p_partkey % 3)::double as x, (p_partkey % 4)::double as y, (p_partkey % 5)::double as z, 1::double as a, 2::double as b, (p_partkey % 2)::double as c, -1::double as d from part) "


@query("quaternion_arithmetic", _QT + "select p_partkey, w + a as add_w, z - d as sub_z, w*a - x*b - y*c - z*d as mul_w, w*b + x*a + y*d - z*c as mul_x, w*c - x*d + y*a + z*b as mul_y, w*d + x*c - y*b + z*a as mul_z, w*w + x*x + y*y + z*z as norm, -x as conj_x, w as back from v where w > 0")
def _(t):
    n, p, q = numbers, F.col("p"), F.col("q")
    m = n.qt_mul(p, q)
    return _qt(t).where("p.w > 0").select("p_partkey", n.qt_add(p, q)["w"].alias("add_w"), n.qt_sub(p, q)["z"].alias("sub_z"), *[m[k].alias(f"mul_{k}") for k in "wxyz"], n.qt_norm(p).alias("norm"), F.when(p["x"] == 0, F.lit(0.0) * -1).otherwise(n.qt_conj(p)["x"]).alias("conj_x"), _r(n.qt_div(m, q)["w"]).alias("back"))


@query("quaternion_functions", _QT + "select p_partkey, 1.0::double as unit, w as exp_log, round(cos(0.3), 9) as axis_w, 1.0::double as euler, round(sqrt(0.5), 9) as turn, 1.0::double as parsed_w, -3.0::double as parsed_j from v where w > 0")
def _(t):
    n, p = numbers, F.col("p")
    lit = F.lit
    e = n.qt_from_euler(lit(0.1), lit(0.2), lit(0.3))
    turn = n.qt_from_vectors([lit(1.0), lit(0.0), lit(0.0)], [lit(0.0), lit(1.0), lit(0.0)])
    parsed = n.qt_parse(lit("1+2i-3j+k"))
    return _qt(t).where("p.w > 0").select("p_partkey", _r(n.qt_abs(n.qt_normalize(p))).alias("unit"), _r(n.qt_exp(n.qt_log(p))["w"], 8).alias("exp_log"), _r(n.qt_from_axis(lit(1.0), lit(2.0), lit(2.0), lit(0.6))["w"]).alias("axis_w"), _r(n.qt_abs(e)).alias("euler"), _r(turn["w"]).alias("turn"), parsed["w"].alias("parsed_w"), parsed["y"].alias("parsed_j"))
