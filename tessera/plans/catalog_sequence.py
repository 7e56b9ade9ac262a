"""Queries on sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import sequence as seq
from tessera.plans.order import global_index, indexed
from tessera.plans.registry import query

BY_USER = {"order_by": ["ts", "event_id"], "partition_by": "user_id"}
JOIN = "array_to_string"


def _text(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query("seq_window", """
with w as (select user_id, row_number() over u - 1 as start, list(event_id) over (u rows between current row and 2 following) as l
  from events window u as (partition by user_id order by ts, event_id))
select user_id, start, array_to_string(l, ',') as items from w where start % 2 = 0 and len(l) = 3""")
def _(t):
    return seq.window(t.events, "event_id", 3, step=2, **BY_USER).withColumn("items", _text("items"))


@query("seq_window_partial", """
with w as (select user_id, row_number() over u - 1 as start, list(event_id) over (u rows between current row and 3 following) as l
  from events window u as (partition by user_id order by ts, event_id))
select user_id, start, array_to_string(l, ',') as items from w where start % 3 = 0 and (len(l) = 4 or start = 0 or len(l) + 3 >= 4)""")
def _(t):
    return seq.window(t.events, "event_id", 4, step=3, partial=True, **BY_USER).withColumn("items", _text("items"))


@query("seq_chunked", """
with w as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i from events)
select user_id, i // 7 as chunk, array_to_string(list(event_id order by i), ',') as items from w group by all""")
def _(t):
    return seq.chunked(t.events, "event_id", 7, **BY_USER).withColumn("items", _text("items"))


@query("seq_chunked_padding", """
with w as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i from events),
c as (select user_id, i // 7 as chunk, list(event_id order by i) as l from w group by all)
select user_id, chunk, array_to_string(l, ',') || repeat(',-1', 7 - len(l)) as items from c""")
def _(t):
    return seq.chunked(t.events, "event_id", 7, padding=F.lit(-1).cast("long"), **BY_USER).withColumn("items", _text("items"))


@query("seq_pairwise", """
with w as (select user_id, lag(event_id) over (partition by user_id order by ts, event_id) as first, event_id as second from events)
select * from w where first is not null""")
def _(t):
    return seq.pairwise(t.events, "event_id", **BY_USER)


@query("seq_run_groups", """
with w as (select *, case when event_type = lag(event_type) over u then 0 else 1 end as fresh from events window u as (partition by user_id order by ts, event_id)),
r as (select *, sum(fresh) over (partition by user_id order by ts, event_id) - 1 as run from w)
select user_id, cast(run as bigint) as run, event_type, count(*) as n from r group by all""")
def _(t):
    return seq.run_groups(t.events, "event_type", **BY_USER)


@query("seq_indexed", """select event_id, user_id, 10 + 5 * (row_number() over (partition by user_id order by ts, event_id) - 1) as index from events""")
def _(t):
    return indexed(t.events, ["ts", "event_id"], "user_id", start=10, step=5).select("event_id", "user_id", "index")


@query("seq_global_index", """select event_id, row_number() over (order by ts, event_id) - 1 as index from events""")
def _(t):
    return indexed(t.events.select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "index")


@query("seq_prefix_sum", """
select o_orderkey, cast(sum(o_custkey) over (order by o_orderdate, o_orderkey) as bigint) as running, cast(coalesce(sum(o_custkey) over (order by o_orderdate, o_orderkey rows between unbounded preceding and 1 preceding), 0) as bigint) as prefix from orders""")
def _(t):
    from tessera.operators.aggregate import prefix_sum

    return prefix_sum(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", order_by=["o_orderdate", "o_orderkey"]).select("o_orderkey", "running", "prefix")


@query("seq_range_sum", """
with r as (select o_custkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as i from orders)
select cast(sum(o_custkey) as bigint) as total from r where i >= 100 and i < 900""")
def _(t):
    from tessera.operators.aggregate import range_sum

    return range_sum(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", 100, 900, order_by=["o_orderdate", "o_orderkey"])


@query("seq_zip", """
with a as (select c_name, row_number() over (order by c_custkey) - 1 as i from customer), b as (select s_name, row_number() over (order by s_suppkey) - 1 as i from supplier)
select a.i as index, c_name as a, s_name as b from a join b using (i)""")
def _(t):
    return seq.zipped(t.customer, t.supplier, "c_name", "s_name", left_order="c_custkey", right_order="s_suppkey")


@query("seq_zip_partial", """
with a as (select c_name, row_number() over (order by c_custkey) - 1 as i from customer), b as (select s_name, row_number() over (order by s_suppkey) - 1 as i from supplier)
select coalesce(a.i, b.i) as index, c_name as a, s_name as b from a full join b on a.i = b.i""")
def _(t):
    return seq.zipped(t.customer, t.supplier, "c_name", "s_name", left_order="c_custkey", right_order="s_suppkey", how="outer")


@query("seq_zip_partial_with", """
with a as (select c_name, row_number() over (order by c_custkey) - 1 as i from customer), b as (select s_name, row_number() over (order by s_suppkey) - 1 as i from supplier)
select coalesce(a.i, b.i) as index, case when a.i is null then '<' else c_name end as a, case when b.i is null then '>' else s_name end as b from a full join b on a.i = b.i""")
def _(t):
    return seq.zipped(t.customer, t.supplier, "c_name", "s_name", left_order="c_custkey", right_order="s_suppkey", how="outer", left_padding=F.lit("<"), right_padding=F.lit(">"))


@query("seq_product", "select r_name, n_name from region, nation")
def _(t):
    return seq.product(t.region.select("r_name"), t.nation.select("n_name"))


@query("seq_product_repeat", "select a.r_name as a, b.r_name as b, c.r_name as c from region a, region b, region c")
def _(t):
    r = t.region.select("r_name")
    return seq.product(*[r.withColumnRenamed("r_name", x) for x in "abc"])


_NATIONS = "select n_regionkey, n_name, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as i from nation"


@query("seq_combinations", f"""with b as ({_NATIONS})
select x.n_regionkey, concat(x.i, ',', y.i) as places, concat(x.n_name, ',', y.n_name) as items from b x join b y on x.n_regionkey = y.n_regionkey and x.i < y.i""")
def _(t):
    return seq.combinations(t.nation, "n_name", 2, order_by="n_nationkey", partition_by="n_regionkey").withColumn("places", _text("places")).withColumn("items", _text("items"))


@query("seq_combinations_repetitions", f"""with b as ({_NATIONS})
select x.n_regionkey, concat(x.i, ',', y.i) as places, concat(x.n_name, ',', y.n_name) as items from b x join b y on x.n_regionkey = y.n_regionkey and x.i <= y.i""")
def _(t):
    return seq.combinations(t.nation, "n_name", 2, order_by="n_nationkey", partition_by="n_regionkey", repetitions=True).withColumn("places", _text("places")).withColumn("items", _text("items"))


@query("seq_permutations", f"""with b as ({_NATIONS})
select x.n_regionkey, concat(x.i, ',', y.i, ',', z.i) as places, concat(x.n_name, ',', y.n_name, ',', z.n_name) as items from b x join b y on x.n_regionkey = y.n_regionkey and x.i <> y.i
join b z on x.n_regionkey = z.n_regionkey and z.i <> x.i and z.i <> y.i""")
def _(t):
    return seq.permutations(t.nation, "n_name", 3, order_by="n_nationkey", partition_by="n_regionkey").withColumn("places", _text("places")).withColumn("items", _text("items"))


@query("seq_next_permutation", """
with p as (select p_partkey, [p_size % 3, p_size % 5, p_partkey % 4, 2] as a from part),
i as (select *, coalesce(list_max([k for k in range(1, 4) if a[k] < a[k + 1]]), 0) as i from p),
j as (select *, case when i > 0 then list_max([k for k in range(1, 5) if k > i and a[i] < a[k]]) end as j from i)
select p_partkey, case when i > 0 then array_to_string(
  [case when k = i then a[j] else a[k] end for k in range(1, 5) if k <= i] || list_reverse([case when k = j then a[i] else a[k] end for k in range(1, 5) if k > i]), ',') end as following from j""")
def _(t):
    a = F.array((F.col("p_size") % 3).cast("long"), (F.col("p_size") % 5).cast("long"), F.col("p_partkey") % 4, F.lit(2).cast("long"))
    return t.part.select("p_partkey", _text(seq.next_permutation(a)).alias("following"))


@query("seq_power_set", """
with a as (select r_regionkey, list(n_name order by n_nationkey) as l from nation join region on n_regionkey = r_regionkey group by 1),
s as (select r_regionkey, l, unnest(range(0, cast(power(2, len(l)) as bigint))) as b from a)
select r_regionkey, array_to_string([l[k] for k in range(1, len(l) + 1) if (b >> (k - 1)) & 1 = 1], ',') as subset from s""")
def _(t):
    lists = t.nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"]).alias("l"))
    return lists.select("r_regionkey", F.explode(seq.power_set(F.col("l"))).alias("s")).select("r_regionkey", F.array_join("s", ",").alias("subset"))


@query("seq_unique", """
with w as (select user_id, event_type, event_id, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events)
select user_id, event_type, event_id from w where n = 1""")
def _(t):
    return seq.unique(t.events.select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], order_by=["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("seq_partition", """
select user_id, array_to_string(list(event_id order by ts, event_id) filter (where value > 50), ',') as truthy, array_to_string(list(event_id order by ts, event_id) filter (where not value > 50), ',') as falsey
from events group by 1""")
def _(t):
    return seq.partition(t.events, F.col("value") > 50, "event_id", order_by=["ts", "event_id"], partition_by="user_id").select("user_id", F.when(F.size("truthy") > 0, _text("truthy")).alias("truthy"), F.when(F.size("falsey") > 0, _text("falsey")).alias("falsey"))


@query("seq_to_map", "select event_type, arg_max(event_id, ts) as value from events group by 1")
def _(t):
    return seq.to_map(t.events, "event_type", "event_id", order_by=["ts", "event_id"])


@query("seq_repeat", "select r_regionkey, cast(k as integer) as repetition from region, range(3) r(k)")
def _(t):
    return seq.repeated(t.region.select("r_regionkey"), 3)


@query("seq_repeat_element", "select p_partkey, array_to_string([p_brand for k in range(p_size % 4)], ',') as items from part")
def _(t):
    return t.part.select("p_partkey", F.array_join(F.array_repeat("p_brand", F.col("p_size") % 4), ",").alias("items"))


_RUNS = """with w as (select user_id, ts, event_id, event_id % 3 as v, case when event_id % 3 = lag(event_id % 3) over u then 0 else 1 end as fresh from events window u as (partition by user_id order by ts, event_id)),
r as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as run from w), g as (select user_id, run, v, count(*) as n from r group by all)
select user_id, concat(sum(n), ',', string_agg(case when n = 1 then cast(v as varchar) else concat(-n, ',', v) end, ',' order by run)) as encoded from g group by 1"""


@query("seq_rle_encode", _RUNS)
def _(t):
    e = t.events.select("user_id", "ts", "event_id", (F.col("event_id") % 3).alias("v"))
    return seq.rle_encode(e, "v", **BY_USER).withColumn("encoded", _text("encoded"))


@query("seq_rle_decode", "select user_id, string_agg(event_id % 3, ',' order by ts, event_id) as decoded from events group by 1")
def _(t):
    e = t.events.select("user_id", "ts", "event_id", (F.col("event_id") % 3).alias("v"))
    return seq.rle_encode(e, "v", **BY_USER).select("user_id", _text(seq.rle_decode(F.col("encoded"))).alias("decoded"))


@query("seq_iterate", """select p_partkey, concat_ws(',', p_size, (p_size * 3 + 1) % 101, (((p_size * 3 + 1) % 101) * 3 + 1) % 101, (((((p_size * 3 + 1) % 101) * 3 + 1) % 101) * 3 + 1) % 101) as items from part""")
def _(t):
    return t.part.select("p_partkey", _text(seq.iterate(F.col("p_size"), lambda x: (x * 3 + 1) % 101, 4)).alias("items"))


_ARR = "[p_size % 7, p_size % 5, p_size % 3, p_size % 11, p_size % 5]"


def _arr():
    return F.array(*[F.col("p_size") % k for k in (7, 5, 3, 11, 5)])


@query("seq_rotate", f"with a as (select p_partkey, {_ARR} as a from part) select p_partkey, array_to_string(a[4:5] || a[1:3], ',') as right2, array_to_string(a[2:5] || a[1:1], ',') as left1 from a")
def _(t):
    return t.part.select("p_partkey", _text(seq.rotate(_arr(), 2)).alias("right2"), _text(seq.rotate(_arr(), -1)).alias("left1"))


@query("seq_separated", f"with a as (select p_partkey, {_ARR} as a from part) select p_partkey, concat('<,', array_to_string(a, ',-1,'), ',>') as items from a")
def _(t):
    a = F.transform(_arr(), lambda x: x.cast("string"))
    return t.part.select("p_partkey", F.array_join(seq.separated(a, F.lit("-1"), F.lit("<"), F.lit(">")), ",").alias("items"))


@query("seq_take_skip", f"""
with a as (select p_partkey, {_ARR} as a from part), b as (select *, list_position(a, 2) as f, case when list_position(list_reverse(a), 2) > 0 then 6 - list_position(list_reverse(a), 2) else 0 end as l from a)
select p_partkey, array_to_string(case when f > 0 then a[1:f - 1] else a end, ',') as take_to, array_to_string(a[4:5], ',') as take_last, array_to_string(case when l > 0 then a[l + 1:5] else a end, ',') as take_last_to,
 array_to_string(case when f > 0 then a[f + 1:5] else [] end, ',') as skip_to, array_to_string(a[1:3], ',') as skip_last, array_to_string(case when l > 0 then a[1:l - 1] else [] end, ',') as skip_last_to from b""")
def _(t):
    a, two = _arr(), F.lit(2)
    return t.part.select("p_partkey", *[_text(c).alias(n) for n, c in (("take_to", seq.take_to(a, two)), ("take_last", seq.take_last(a, 2)), ("take_last_to", seq.take_last_to(a, two)), ("skip_to", seq.skip_to(a, two)), ("skip_last", seq.skip_last(a, 2)), ("skip_last_to", seq.skip_last_to(a, two)))])


@query("seq_flat_map", "select p_partkey, unnest(string_split(p_name, ' ')) as word from part")
def _(t):
    return t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


@query("seq_deep_flatten", f"with a as (select p_partkey, {_ARR} as a from part) select p_partkey, array_to_string(a || a, ',') as items from a")
def _(t):
    return t.part.select("p_partkey", _text(seq.deep_flatten(F.array(F.array(_arr()), F.array(_arr())), 2)).alias("items"))


@query("seq_count", "select user_id, count(*) filter (where value > 50) as above, count(*) filter (where event_type = 'click') as clicks from events group by 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.count_if(F.col("value") > 50).alias("above"), F.count_if(F.col("event_type") == "click").alias("clicks"))


@query("seq_at_random", "select cast(1 as bigint) as picked, true as member, cast(0 as bigint) as of_none")
def _(t):
    """What holds for any draw: one row, of the table; none of an empty table."""
    from tessera.sources.generators import at_random

    keys = t.customer.select("c_custkey")
    one = at_random(keys, seed=4).join(keys.withColumn("hit", F.lit(True)), "c_custkey", "left")
    return one.agg(F.count("*").alias("picked"), F.bool_and(F.coalesce("hit", F.lit(False))).alias("member")).crossJoin(at_random(keys.limit(0), seed=4).agg(F.count("*").alias("of_none")))
