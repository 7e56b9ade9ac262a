"""Queries on orders, top-k, searches, intervals and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import aggregate, intervals, ordering
from tessera.operators.ordering import By
from tessera.plans.registry import query


@query("order_largest", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey desc limit 25")
def _(t):
    return ordering.largest(t.orders.select("o_orderkey", "o_totalprice"), By.key("o_totalprice").then(By.key("o_orderkey")), 25)


@query("order_smallest", "select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 25")
def _(t):
    return ordering.smallest(t.orders.select("o_orderkey", "o_totalprice"), By.key("o_totalprice").then(By.key("o_orderkey")), 25)


@query("order_largest_per_key", """
with r as (select l_suppkey, l_orderkey, l_extendedprice, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey desc, l_partkey desc) as rank from lineitem)
select l_suppkey, l_orderkey, l_extendedprice, cast(rank as integer) as rank from r where rank <= 3""")
def _(t):
    by = By.key("l_extendedprice").then(By.key("l_orderkey")).then(By.key("l_partkey"))
    return ordering.largest_per(t.lineitem.select("l_suppkey", "l_orderkey", "l_partkey", "l_extendedprice"), by, 3, "l_suppkey").drop("l_partkey")


@query("order_sort_range", "select o_orderkey from orders order by o_orderdate desc, o_orderkey desc limit 30 offset 20")
def _(t):
    return ordering.sort(t.orders.select("o_orderkey", "o_orderdate"), By.key("o_orderdate").then(By.key("o_orderkey")).reversed(), 20, 50).select("o_orderkey")


_PRIORITIES = ("4-NOT SPECIFIED", "2-HIGH", "1-URGENT", "5-LOW", "3-MEDIUM")


@query("order_explicit", "with p as (select o_orderkey, o_orderpriority from orders) select o_orderkey, list_position(['4-NOT SPECIFIED', '2-HIGH', '1-URGENT', '5-LOW', '3-MEDIUM'], o_orderpriority) - 1 as rank from p")
def _(t):
    return t.orders.select("o_orderkey", ordering.explicit_rank(F.col("o_orderpriority"), _PRIORITIES).cast("integer").alias("rank"))


@query("order_nulls", """
with v as (select o_orderkey, case when o_orderkey % 3 = 0 then null else o_custkey end as k from orders),
r as (select o_orderkey, row_number() over (order by k asc nulls first, o_orderkey) as a, row_number() over (order by k asc nulls last, o_orderkey) as b, row_number() over (order by k desc nulls last, o_orderkey desc) as c from v)
select * from r where a <= 40 or b <= 40 or c <= 40""")
def _(t):
    from tessera.plans.order import global_index

    v = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("k"))
    first = By.key("k").nulls(True).then(By.key("o_orderkey"))
    last = By.key("k").nulls(False).then(By.key("o_orderkey"))
    r = global_index(global_index(global_index(v, first.columns(), "a"), last.columns(), "b"), first.reversed().columns(), "c")
    return r.select("o_orderkey", *[(F.col(x) + 1).alias(x) for x in "abc"]).where("a <= 40 or b <= 40 or c <= 40")


@query("order_lexicographic", "with v as (select p_partkey, [p_size % 3, p_size % 4] || case when p_partkey % 2 = 0 then [1] else [] end as a from part) select p_partkey, row_number() over (order by a, p_partkey) - 1 as place from v")
def _(t):
    from tessera.plans.order import global_index

    a = F.concat(F.array(F.col("p_size") % 3, F.col("p_size") % 4), F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    return global_index(t.part.select("p_partkey", a.alias("a")), ["a", "p_partkey"], "place").select("p_partkey", "place")


@query("order_comparisons", "select l.o_orderkey as a, r.o_orderkey as b, cast(case when l.o_orderpriority < r.o_orderpriority then 1 when l.o_orderpriority > r.o_orderpriority then -1 when l.o_custkey < r.o_custkey then -1 when l.o_custkey > r.o_custkey then 1 else 0 end as integer) as sign from orders l join orders r on r.o_orderkey = l.o_orderkey + 1")
def _(t):
    l, r = t.orders.select("o_orderkey", "o_orderpriority", "o_custkey"), t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"), F.col("o_custkey").alias("c"))
    side = {"p": ("o_orderpriority", "p"), "c": ("o_custkey", "c")}
    p, c = F.col("p"), F.col("c")
    by = By.key(p).reversed().then(By.key(c))
    other = {id(p): "o_orderpriority", id(c): "o_custkey"}
    return l.join(r, F.col("k") == F.col("o_orderkey") + 1).select(F.col("o_orderkey").alias("a"), F.col("k").alias("b"), by.test(lambda x: F.col(other[id(x)]), lambda x: x).cast("integer").alias("sign"))


@query("order_min_max", "select event_type, min(value) as min, max(value) as max from events group by 1")
def _(t):
    return ordering.min_max(t.events, F.col("value"), "event_type")


@query("order_min_max_ties", "with r as (select event_type, event_id, event_id % 7 as k from events) select event_type, max(event_id) filter (where k = 0) as low, max(event_id) filter (where k = 6) as high from r group by 1")
def _(t):
    k = F.col("event_id") % 7
    low = ordering.min_row(t.events, "event_id", k, F.col("event_id"), "event_type").withColumnRenamed("event_id", "low")
    return low.join(ordering.max_row(t.events, "event_id", k, F.col("event_id"), "event_type").withColumnRenamed("event_id", "high"), "event_type")


@query("order_is_ordered", """
with w as (select user_id, event_id, lag(event_id) over u as before, value, lag(value) over u as v from events window u as (partition by user_id order by ts, event_id))
select user_id, bool_and(coalesce(before <= event_id, true)) as ordered, bool_and(coalesce(v < value, true)) as strict from w group by 1""")
def _(t):
    by = {"order_by": ["ts", "event_id"], "partition_by": "user_id"}
    return ordering.is_ordered(t.events, "event_id", **by).join(ordering.is_ordered(t.events, "value", strict=True, **by).withColumnRenamed("ordered", "strict"), "user_id")


@query("order_clip_between", "select event_id, value between 20 and 60 as inside, greatest(20.0::double, least(value, 60.0::double)) as clipped from events")
def _(t):
    lo, hi = F.lit(20.0), F.lit(60.0)
    return t.events.select("event_id", ordering.between(F.col("value"), lo, hi).alias("inside"), ordering.clip(F.col("value"), lo, hi).alias("clipped"))


_SORTED = "with a as (select user_id, list_sort(list(event_id % 50)) as a from events group by 1) "


def _sorted(t):
    return t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.col("event_id") % 50)).alias("a"))


@query("order_binary_search", _SORTED + "select user_id, cast(coalesce(list_position(a, 17), 0) - 1 as bigint) as found, cast(len([x for x in a if x < 17]) as integer) as lower, cast(len([x for x in a if x <= 17]) as integer) as upper from a")
def _(t):
    a, k = F.col("a"), F.lit(17).cast("long")
    return _sorted(t).select("user_id", ordering.binary_search(a, k).alias("found"), ordering.lower_bound(a, k).alias("lower"), ordering.upper_bound(a, k).alias("upper"))


@query("order_sorted_list", _SORTED + "select user_id, array_to_string(list_sort(a || [17]), ',') as added, array_to_string(case when list_position(a, 20) > 0 then a[1:list_position(a, 20) - 1] || a[list_position(a, 20) + 1:] else a end, ',') as removed, cast(len([x for x in a if x = 20]) as integer) as times from a")
def _(t):
    a = F.col("a")
    show = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    twenty = F.lit(20).cast("long")
    return _sorted(t).select("user_id", show(ordering.sorted_add(a, F.lit(17).cast("long"))).alias("added"), show(ordering.sorted_remove(a, twenty)).alias("removed"), ordering.occurrences(a, twenty).alias("times"))


@query("agg_gcd", "with d as (select p_brand, gcd_of from (select p_brand, list(distinct p_size * 6) as l from part group by 1), lateral (select list_reduce(l, lambda a, b: gcd(a, b)) as gcd_of)) select p_brand, cast(gcd_of as bigint) as gcd from d")
def _(t):
    return aggregate.gcd_of(t.part.select("p_brand", (F.col("p_size") * 6).alias("v")), "v", "p_brand")


@query("agg_lcm", "with d as (select p_brand, list(distinct p_size % 12 + 1) as l from part group by 1) select p_brand, cast(list_reduce(l, lambda a, b: lcm(a, b)) as bigint) as lcm from d")
def _(t):
    return aggregate.lcm_of(t.part.select("p_brand", (F.col("p_size") % 12 + 1).alias("v")), "v", "p_brand")


@query("agg_gcd_lcm_pairs", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, gcd(l_orderkey, l_partkey) as g, cast(lcm(l_partkey, l_suppkey) as bigint) as l from lineitem")
def _(t):
    c = F.col
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", aggregate.gcd_pair(c("l_orderkey"), c("l_partkey")).alias("g"), aggregate.lcm_pair(c("l_partkey"), c("l_suppkey")).alias("l"))


@query("agg_polynomial", "select p_partkey, cast(p_size as double) + (p_partkey % 7) * 10.0::double + (p_partkey % 5) * 100.0::double as value from part")
def _(t):
    return t.part.select("p_partkey", aggregate.polynomial(F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 7).cast("double"), (F.col("p_partkey") % 5).cast("double")), F.lit(10.0)).alias("value"))


_SPANS = "with s as (select l_suppkey, epoch(min(l_shipdate)) as lo, epoch(min(l_shipdate) + interval 200 day) as hi from lineitem group by 1) "
_DAY = "unix_seconds(timestamp({}))"


def _spans(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.min("l_shipdate").alias("m")).select("l_suppkey", F.expr("cast(unix_seconds(timestamp(m)) as double)").alias("lo"), F.expr("cast(unix_seconds(timestamp(m)) + 200 * 86400 as double)").alias("hi"))


@query("interval_stab_join", _SPANS + "select o_orderkey, l_suppkey from orders join s on epoch(o_orderdate) between lo and hi")
def _(t):
    points = t.orders.select("o_orderkey", F.expr("cast(unix_seconds(timestamp(o_orderdate)) as double)").alias("at"))
    return intervals.stab_join(points, _spans(t), "at", "lo", "hi").select("o_orderkey", "l_suppkey")


@query("interval_overlap_join", _SPANS + "select a.l_suppkey as a, b.l_suppkey as b from s a join s b on a.lo <= b.hi and b.lo <= a.hi and a.l_suppkey < b.l_suppkey")
def _(t):
    a = _spans(t)
    b = a.select(F.col("l_suppkey").alias("b"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    return intervals.overlap_join(a, b, ("lo", "hi"), ("lo2", "hi2")).where("l_suppkey < b").select(F.col("l_suppkey").alias("a"), "b")


@query("interval_predicates", """with v as (select p_partkey, cast(p_size as bigint) as lo, p_size + p_partkey % 9 as hi, cast(p_size % 13 as bigint) as lo2, cast(p_size % 13 + 15 as bigint) as hi2 from part)
select p_partkey, lo <= 20 and 20 <= hi as holds, lo <= lo2 and hi2 <= hi as encloses, lo <= hi2 and lo2 <= hi as meets, case when lo <= hi2 and lo2 <= hi then greatest(lo, lo2) end as cut_lo, case when lo <= hi2 and lo2 <= hi then least(hi, hi2) end as cut_hi,
 least(lo, lo2) as hull_lo, greatest(hi, hi2) as hull_hi, lo = hi as single from v""")
def _(t):
    v = t.part.selectExpr("p_partkey", "cast(p_size as bigint) as lo", "p_size + p_partkey % 9 as hi", "cast(p_size % 13 as bigint) as lo2", "cast(p_size % 13 + 15 as bigint) as hi2")
    ends = [F.col(c) for c in ("lo", "hi", "lo2", "hi2")]
    cut, hull = intervals.intersection(*ends), intervals.hull(*ends)
    return v.select("p_partkey", intervals.contains(ends[0], ends[1], F.lit(20)).alias("holds"), intervals.encloses(*ends).alias("encloses"), intervals.intersects(*ends).alias("meets"), cut["lower"].alias("cut_lo"), cut["upper"].alias("cut_hi"), hull["lower"].alias("hull_lo"), hull["upper"].alias("hull_hi"), intervals.is_single(ends[0], ends[1]).alias("single"))


@query("box_join", "with b as (select c_custkey % 40 as box, min(c_acctbal) as lo, min(c_acctbal) + 500 as hi from customer group by 1) select p_partkey, box from part, b where p_size between 10 and 20 and p_retailprice between lo and hi")
def _(t):
    boxes = t.customer.groupBy((F.col("c_custkey") % 40).alias("box")).agg(F.min("c_acctbal").alias("lo")).select("box", F.lit(10.0).alias("s0"), F.lit(20.0).alias("s1"), "lo", (F.col("lo") + 500).alias("hi"))
    parts = t.part.select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return intervals.box_join(parts, boxes, [("x", "x"), ("y", "y")], [("s0", "s1"), ("lo", "hi")]).select("p_partkey", "box")


_BOX = "with v as (select p_partkey, [p_size, p_partkey % 17]::double[] as lo, [p_size + 3, p_partkey % 17 + p_size % 2]::double[] as hi, [10, 5]::double[] as lo2, [30, 12]::double[] as hi2 from part) "


def _boxes(t):
    d = lambda *e: F.array(*[F.expr(f"cast({x} as double)") for x in e])
    return t.part.select("p_partkey", d("p_size", "p_partkey % 17").alias("lo"), d("p_size + 3", "p_partkey % 17 + p_size % 2").alias("hi"), d("10", "5").alias("lo2"), d("30", "12").alias("hi2"))


@query("box_predicates", _BOX + """select p_partkey, lo[1] <= 30 and 10 <= hi[1] and lo[2] <= 12 and 5 <= hi[2] as meets, lo2[1] <= lo[1] and hi[1] <= hi2[1] and lo2[2] <= lo[2] and hi[2] <= hi2[2] as inside,
 (hi[1] - lo[1]) * (hi[2] - lo[2]) as area, (lo[1] + hi[1]) / 2 as cx, (lo[2] + hi[2]) / 2 as cy, lo[1] = hi[1] and lo[2] = hi[2] as point, hi[2] - lo[2] as edge,
 least(lo[1], 10) as hull_x, greatest(hi[2], 12) as hull_y, case when lo[1] <= 30 and 10 <= hi[1] and lo[2] <= 12 and 5 <= hi[2] then greatest(lo[1], 10) end as cut_x from v""")
def _(t):
    lo, hi, lo2, hi2 = (F.col(c) for c in ("lo", "hi", "lo2", "hi2"))
    b = intervals
    return _boxes(t).select(
        "p_partkey", b.box_intersects(lo, hi, lo2, hi2).alias("meets"), b.box_contains(lo2, hi2, lo, hi).alias("inside"), b.box_area(lo, hi).alias("area"), b.box_center(lo, hi)[0].alias("cx"), b.box_center(lo, hi)[1].alias("cy"), b.box_is_point(lo, hi).alias("point"),
        b.box_edges(lo, hi)[1].alias("edge"), b.box_union(lo, hi, lo2, hi2)["lo"][0].alias("hull_x"), b.box_union(lo, hi, lo2, hi2)["hi"][1].alias("hull_y"), b.box_intersection(lo, hi, lo2, hi2)["lo"][0].alias("cut_x"),
    )


@query("box_bounds", """select p_brand, min(p_size) as lo0, min(p_retailprice) as lo1, max(p_size) as hi0, max(p_retailprice) as hi1, case when max(p_size) <= min(p_size + 45) then max(p_size) end as common from part group by 1""")
def _(t):
    p = t.part.withColumn("x", F.col("p_size")).withColumn("x2", F.col("p_size") + 45)
    d = lambda c: F.col(c)
    out = intervals.bounds_of(t.part.withColumn("s", F.col("p_size").cast("double")), ["s", "p_retailprice"], ["s", "p_retailprice"], ["p_brand"])
    shared = intervals.common_box(p, ["x"], ["x2"], ["p_brand"]).select(F.col("p_brand").alias("b"), F.get(F.col("lo"), F.lit(0)).alias("common"))
    return out.join(shared, F.col("p_brand") == F.col("b")).select("p_brand", F.col("lo")[0].cast("int").alias("lo0"), d("lo")[1].alias("lo1"), d("hi")[0].cast("int").alias("hi0"), d("hi")[1].alias("hi1"), "common")
