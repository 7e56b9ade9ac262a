"""Queries on bags, multimaps, bit lists and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import bags
from tessera.plans.registry import query


def _pair(t):
    a = bags.bag(t.lineitem.where("l_returnflag = 'A'"), "l_partkey")
    b = bags.bag(t.lineitem.where("l_returnflag = 'R'"), "l_partkey")
    return a, b


_AB = "with a as (select l_partkey as element, count(*) as na from lineitem where l_returnflag = 'A' group by 1), b as (select l_partkey as element, count(*) as nb from lineitem where l_returnflag = 'R' group by 1), f as (select coalesce(a.element, b.element) as element, coalesce(na, 0) as na, coalesce(nb, 0) as nb from a full join b on a.element = b.element) "


@query("bag_count", "select l_partkey as element, count(*) as n from lineitem group by 1")
def _(t):
    return bags.bag(t.lineitem, "l_partkey")


@query("bag_element_count", "select count(*) filter (where event_type = 'click') as clicks, count(*) filter (where event_type = 'absent') as absent from events")
def _(t):
    return t.events.agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "absent").alias("absent"))


@query("bag_measures", "select count(*) as length, count(distinct event_type) as kinds from events")
def _(t):
    b = bags.bag(t.events, "event_type")
    return b.agg(F.sum("n").alias("length"), F.count("*").alias("kinds"))


@query("bag_union", _AB + "select element, cast(na + nb as bigint) as n from f")
def _(t):
    return bags.bag_union(*_pair(t))


@query("bag_intersection", _AB + "select element, least(na, nb) as n from f where least(na, nb) > 0")
def _(t):
    return bags.bag_intersection(*_pair(t))


@query("bag_difference", _AB + "select element, na - nb as n from f where na > nb")
def _(t):
    return bags.bag_difference(*_pair(t))


@query("bag_combine", _AB + "select element, na * 2 + nb as n from f")
def _(t):
    return bags.combine(*_pair(t), lambda e, a, b: a * 2 + b)


@query("bag_contains_all", _AB + "select coalesce(bool_and(na >= nb), true) as contains_all from f")
def _(t):
    return bags.contains_all(*_pair(t))


@query("bag_set_add_remove", """
with b as (select event_type as element, count(*) as n from events group by 1), c as (select element, case when element = 'click' then 7 else n end as n from b)
select element, cast(case element when 'view' then n + 5 when 'error' then greatest(n - 3, 0) else n end as bigint) as n from c where case element when 'error' then n > 3 else true end""")
def _(t):
    b = bags.with_count(bags.bag(t.events, "event_type"), F.lit("click"), 7)
    return bags.remove(bags.add(b, F.lit("view"), 5), F.lit("error"), 3)


@query("multimap_list", "select user_id, array_to_string(list(event_type order by ts, event_id), ',') as values from events group by 1")
def _(t):
    return bags.list_multimap(t.events, "user_id", "event_type", order_by=["ts", "event_id"]).withColumn("values", F.array_join("values", ","))


@query("multimap_set", "select user_id, array_to_string(list_sort(list(distinct event_type)), ',') as values from events group by 1")
def _(t):
    return bags.set_multimap(t.events, "user_id", "event_type").withColumn("values", F.array_join("values", ","))


@query("multimap_lookup", "select n_name, c_custkey from nation join customer on n_nationkey = c_nationkey where n_name like '%1%'")
def _(t):
    return t.nation.where(F.col("n_name").contains("1")).join(t.customer, F.col("n_nationkey") == F.col("c_nationkey")).select("n_name", "c_custkey")


@query("multimap_edit", """
with p as (select user_id, event_type from events where event_type in ('click', 'view') union all select user_id, event_type from events where event_type = 'error'),
g as (select distinct user_id, event_type from events where value > 99 and event_type = 'click'), n as (select user_id, 'new' as event_type from events where event_type = 'signup' and value > 99)
select user_id, event_type from p where not exists (select 1 from g where g.user_id = p.user_id and g.event_type = p.event_type) and user_id not in (select user_id from n) union all select * from n""")
def _(t):
    e = t.events
    pairs = bags.multimap_add(e.where("event_type in ('click', 'view')").select("user_id", "event_type"), e.where("event_type = 'error'").select("user_id", "event_type"))
    pairs = bags.multimap_remove(pairs, e.where("value > 99 and event_type = 'click'").select("user_id", "event_type").distinct(), ["user_id", "event_type"])
    return bags.multimap_replace(pairs, e.where("event_type = 'signup' and value > 99").select("user_id", F.lit("new").alias("event_type")), "user_id")


@query("bimap_put", """
with p as (select l_partkey as k, l_suppkey as v, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) as o from lineitem),
r as (select *, row_number() over (partition by k order by o desc) as a, row_number() over (partition by v order by o desc) as b from p)
select k, v, o from r where a = 1 and b = 1""")
def _(t):
    from tessera.plans.order import global_index

    p = global_index(t.lineitem, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"], "o")
    return bags.bimap(p.select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("v"), (F.col("o") + 1).alias("o")), "k", "v", order_by="o")


@query("bimap_inverse", "select n_name as n_nationkey, n_nationkey as n_name from nation")
def _(t):
    return bags.inverse(t.nation, "n_nationkey", "n_name")


_BITS = "with b as (select p_partkey, [(p_partkey >> i) & 1 = 1 for i in range(12)] as a, [((p_partkey * 37) >> i) & 1 = 1 for i in range(12)] as b from part) "


def _bits(t):
    return t.part.select("p_partkey", bags.bits_of(F.col("p_partkey"), 12).alias("a"), bags.bits_of(F.col("p_partkey") * 37, 12).alias("b"))


def _show(c):
    return F.array_join(F.transform(c, lambda x: F.when(x, "1").otherwise("0")), "")


def _sql_show(e):
    return f"array_to_string([case when x then '1' else '0' end for x in {e}], '')"


@query("bits_logic", _BITS + f"select p_partkey, {_sql_show('[a[i] and b[i] for i in range(1, 13)]')} as both, {_sql_show('[a[i] or b[i] for i in range(1, 13)]')} as either, {_sql_show('[a[i] and not b[i] for i in range(1, 13)]')} as minus, {_sql_show('[not a[i] for i in range(1, 13)]')} as neither from b")
def _(t):
    a, b = F.col("a"), F.col("b")
    return _bits(t).select("p_partkey", _show(bags.bits_and(a, b)).alias("both"), _show(bags.bits_or(a, b)).alias("either"), _show(bags.bits_minus(a, b)).alias("minus"), _show(bags.bits_not(a)).alias("neither"))


@query("bits_shift", _BITS + f"select p_partkey, '000' || {_sql_show('a[1:9]')} as up, {_sql_show('a[4:12]')} || '000' as down from b")
def _(t):
    return _bits(t).select("p_partkey", _show(bags.bits_shift(F.col("a"), 3)).alias("up"), _show(bags.bits_shift(F.col("a"), -3)).alias("down"))


@query("bits_edit", _BITS + f"select p_partkey, {_sql_show('[case when i = 5 then not a[i] else a[i] end for i in range(1, 13)]')} as flipped, {_sql_show('[case when i > 2 and i <= 6 then true else a[i] end for i in range(1, 13)]')} as filled, {_sql_show('a || b')} as joined from b")
def _(t):
    a = F.col("a")
    return _bits(t).select("p_partkey", _show(bags.bits_flip(a, 4)).alias("flipped"), _show(bags.bits_fill(a, 2, 6, True)).alias("filled"), _show(F.concat("a", "b")).alias("joined"))


@query("bits_count_indices", _BITS + "select p_partkey, len([x for x in a if x]) as ones, len([x for x in a if not x]) as zeros, array_to_string([i - 1 for i in range(1, 13) if a[i]], ',') as at from b")
def _(t):
    a = F.col("a")
    return _bits(t).select("p_partkey", bags.bits_count(a).cast("long").alias("ones"), bags.bits_count(a, False).cast("long").alias("zeros"), F.array_join(F.transform(bags.bits_indices(a), lambda i: i.cast("string")), ",").alias("at"))


@query("bits_of_numbers", """
select p_partkey, cast(bit_count(p_partkey & 4294967295) as integer) as ones, p_partkey <> 0 and p_partkey & (p_partkey - 1) = 0 as single, p_partkey | 8 as set3, p_partkey & ~cast(4 as bigint) as cleared2, xor(p_partkey, 1) as toggled0,
 cast(power(2, floor(log2(p_partkey))) as bigint) as floor2, cast(power(2, ceil(log2(p_partkey))) as bigint) as ceil2 from part where p_partkey > 0""")
def _(t):
    x = F.col("p_partkey")
    return t.part.where("p_partkey > 0").select(
        "p_partkey", bags.bit_count32(x).alias("ones"), bags.has_single_bit(x).alias("single"), bags.set_bit(x, 3).alias("set3"), bags.clear_bit(x, 2).alias("cleared2"), bags.toggle_bit(x, 0).alias("toggled0"), bags.bit_floor(x).alias("floor2"), bags.bit_ceil(x).alias("ceil2")
    )
