"""Queries on differences, streams, caches, optional and either values, rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.functions import optional as opt
from tessera.functions import structs
from tessera.operators import caching, diff
from tessera.plans.matching_sql import BEST_OF_ALL, GROUPED, matching
from tessera.plans.registry import query
from tessera.streaming import stream


def _turns(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", F.lag("text").over(w).alias("before"), F.col("text").alias("after")).where("before is not null")


def _words(c):
    return F.split(c, " ")


_TURNS = "with w as (select conv_id, turn, lag(text) over (partition by conv_id order by turn) as before, text as after from conversations), p as (select * from w where before is not null) "


@query("diff_real_quick_ratio", _TURNS + "select conv_id, turn, 2.0::double * least(len(string_split(before, ' ')), len(string_split(after, ' '))) / (len(string_split(before, ' ')) + len(string_split(after, ' '))) as ratio from p")
def _(t):
    return _turns(t).select("conv_id", "turn", diff.real_quick_ratio(_words(F.col("before")), _words(F.col("after"))).alias("ratio"))


@query("diff_quick_ratio", _TURNS + """, a as (select conv_id, turn, unnest(string_split(before, ' ')) as w from p), b as (select conv_id, turn, unnest(string_split(after, ' ')) as w from p),
ca as (select conv_id, turn, w, count(*) as n from a group by all), cb as (select conv_id, turn, w, count(*) as n from b group by all),
m as (select conv_id, turn, sum(least(ca.n, cb.n)) as c from ca join cb using (conv_id, turn, w) group by 1, 2)
select p.conv_id, p.turn, 2.0::double * coalesce(c, 0) / (len(string_split(before, ' ')) + len(string_split(after, ' '))) as ratio from p left join m on p.conv_id = m.conv_id and p.turn = m.turn""")
def _(t):
    return _turns(t).select("conv_id", "turn", diff.quick_ratio(_words(F.col("before")), _words(F.col("after"))).alias("ratio"))


_PAIRS = _TURNS.removeprefix("with ").rstrip() + ", x as (select {{'c': conv_id, 't': turn}} as k, string_split(before, {0}) as a, string_split(after, {0}) as b from p)"
_WORDS, _LINES = matching(_PAIRS.format("' '")), matching(_PAIRS.format("chr(10)"))


@query("diff_ratio", _WORDS + " select k.c as conv_id, k.t as turn, 2.0::double * (select coalesce(sum(size), 0) from block where block.k = x.k) / (len(a) + len(b)) as ratio from x")
def _(t):
    return _turns(t).select("conv_id", "turn", diff.ratio(_words(F.col("before")), _words(F.col("after"))).alias("ratio"))


@query("diff_matches", _WORDS + " select k.c as conv_id, k.t as turn, a::integer as a, b::integer as b, size::integer as size from closed")
def _(t):
    return _turns(t).select("conv_id", "turn", F.explode(diff.matches(_words(F.col("before")), _words(F.col("after")))).alias("m")).select("conv_id", "turn", "m.*")


@query("diff_longest_match", _WORDS + f" select x.k.c as conv_id, x.k.t as turn, coalesce(flo, 0)::integer as a, coalesce(flo - d, 0)::integer as b, coalesce(fhi - flo, 0)::integer as size from x left join (select * from {BEST_OF_ALL} where nth = 1 and fhi > flo) m on m.k = x.k")
def _(t):
    m = diff.longest_match(_words(F.col("before")), _words(F.col("after")))
    return _turns(t).select("conv_id", "turn", m.alias("m")).select("conv_id", "turn", *[F.col("m")[i].alias(n) for i, n in enumerate(("a", "b", "size"))])


@query("diff_operations", _WORDS + " select k.c as conv_id, k.t as turn, kind as type, a1::integer as a1, a2::integer as a2, b1::integer as b1, b2::integer as b2 from oper")
def _(t):
    return _turns(t).select("conv_id", "turn", F.explode(diff.operations(_words(F.col("before")), _words(F.col("after")))).alias("o")).select("conv_id", "turn", "o.*")


@query("diff_grouped_operations", _WORDS + GROUPED + " select k.c as conv_id, k.t as turn, g::integer as g, kind as type, a1::integer as a1, a2::integer as a2, b1::integer as b1, b2::integer as b2 from piece")
def _(t):
    groups = _turns(t).select("conv_id", "turn", F.posexplode(diff.grouped_operations(_words(F.col("before")), _words(F.col("after")))).alias("g", "o"))
    return groups.select("conv_id", "turn", "g", F.explode("o").alias("o")).select("conv_id", "turn", "g", "o.*")


_SPAN = "case when {1} - {0} <= 1 then ({1})::varchar else ({0} + 1)::varchar || ',' || ({1})::varchar end"
_NORMAL = f""" select k.c as conv_id, k.t as turn, unnest([case when kind = 'insert' then a1::varchar else {_SPAN.format("a1", "a2")} end || case kind when 'replace' then 'c' when 'delete' then 'd' else 'a' end || case when kind = 'delete' then b1::varchar else {_SPAN.format("b1", "b2")} end]
 || ['< ' || v for v in x.a[a1 + 1:a2]] || case when kind = 'replace' then ['---'] else [] end || ['> ' || v for v in x.b[b1 + 1:b2]]) as line from oper join x using (k) where kind <> 'equal'"""
_RANGES = "ends as (select k, g, min(a1) as a1, max(a2) as a2, min(b1) as b1, max(b2) as b2, bool_or(kind in ('replace', 'delete')) as out, bool_or(kind in ('replace', 'insert')) as inn from piece group by k, g)"


def _unified(a: str, b: str) -> str:
    return f"case {b} - {a} when 1 then ({a} + 1)::varchar when 0 then {a}::varchar || ',0' else ({a} + 1)::varchar || ',' || ({b} - {a})::varchar end"


def _context(a: str, b: str) -> str:
    return f"case {b} - {a} when 0 then {a}::varchar when 1 then ({a} + 1)::varchar else ({a} + 1)::varchar || ',' || ({b})::varchar end"


_UNIFIED = GROUPED + f""", {_RANGES}, line as (select distinct k, unnest(['--- source', '+++ target']) as line, -1 as g, 0 as n from piece
 union all select k, '@@ -' || {_unified("a1", "a2")} || ' +' || {_unified("b1", "b2")} || ' @@', g, 0 from ends
 union all select k, unnest(case when kind = 'equal' then [' ' || v for v in x.a[a1 + 1:a2]] else ['-' || v for v in x.a[a1 + 1:a2]] || ['+' || v for v in x.b[b1 + 1:b2]] end), g, n from piece join x using (k)) select k.c as conv_id, k.t as turn, line from line"""
_SIGN = "case kind when 'replace' then '! ' when 'delete' then '- ' when 'insert' then '+ ' else '  ' end"
_CONTEXT = GROUPED + f""", {_RANGES}, line as (select distinct k, unnest(['*** source', '--- target']) as line, -1 as g, 0 as n from piece
 union all select k, unnest(['***************', '*** ' || {_context("a1", "a2")} || ' ****', '--- ' || {_context("b1", "b2")} || ' ----']), g, 0 from ends
 union all select k, unnest([{_SIGN} || v for v in x.a[piece.a1 + 1:piece.a2]]), g, n from piece join x using (k) join ends using (k, g) where ends.out and kind <> 'insert'
 union all select k, unnest([{_SIGN} || v for v in x.b[piece.b1 + 1:piece.b2]]), g, n from piece join x using (k) join ends using (k, g) where ends.inn and kind <> 'delete') select k.c as conv_id, k.t as turn, line from line"""

for _form, _sql in (("normal", _NORMAL), ("unified", _UNIFIED), ("context", _CONTEXT)):

    @query(f"diff_{_form}", _LINES + _sql)
    def _(t, form=_form):
        return _turns(t).select("conv_id", "turn", F.explode(diff.diff(F.col("before"), F.col("after"), form)).alias("line"))


@query("diff_readable", _TURNS + "select conv_id, turn, before, after, true as hinted from p")
def _(t):
    """Both texts, put together again from the lines; hints stand below changed lines only."""
    lines = _turns(t).select("conv_id", "turn", diff.diff(F.col("before"), F.col("after"), "readable").alias("l"))
    kept = lambda signs: F.array_join(F.transform(F.filter("l", lambda x: F.substring(x, 1, 2).isin(*signs)), lambda x: F.substring(x, F.lit(3), F.length(x))), "\n")
    hinted = F.forall(F.sequence(F.lit(1), F.size("l")), lambda i: ~F.get("l", i - 1).startswith("? ") | ((i > 1) & F.substring(F.get("l", i - 2), 1, 2).isin("- ", "+ ")))
    return lines.select("conv_id", "turn", kept(("  ", "- ")).alias("before"), kept(("  ", "+ ")).alias("after"), hinted.alias("hinted"))


@query("diff_identity", "select conv_id, turn, 1.0::double as ratio, 0 as lines, 1 as operations from conversations")
def _(t):
    c = F.col("text")
    return t.conversations.select("conv_id", "turn", diff.ratio(_words(c), _words(c)).alias("ratio"), F.size(diff.diff(c, c, "unified")).alias("lines"), F.size(diff.operations(_words(c), _words(c))).alias("operations"))


_NAMES = "word as (select distinct unnest(string_split(lower(p_name), ' ')) as word from part), asked as (select distinct unnest(string_split(lower(p_type), ' ')) as query from part), x as (select {'q': query, 'w': word} as k, string_split(word, '') as a, string_split(query, '') as b from asked, word)"


@query("diff_close_matches", matching(_NAMES, popular=False) + """, rated as (select k.q as query, k.w as word, 2.0::double * (select coalesce(sum(size), 0) from block where block.k = x.k) / (len(a) + len(b)) as ratio from x)
select query, word, ratio from (select *, row_number() over (partition by query order by ratio desc, word) as n from rated where ratio >= 0.4) where n <= 3""")
def _(t):
    words = t.part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    asked = t.part.select(F.explode(F.split(F.lower("p_type"), " ")).alias("asked"))
    return diff.close_matches(words, asked, "word", "asked", 3, 0.4)


# -- streams: bounded runs over the events' file, equal to a batch --------------------


def _stream(t):
    # One folder of one file: the reader takes a folder, so the file itself is named by a glob.
    return t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parque[t]")


def _ended(t, df, mode="append"):
    return stream.run_to_end(df, mode)


@query("stream_flat_map", "select event_id, unnest(string_split(event_type, 'i')) as item from events")
def _(t):
    return _ended(t, stream.flat_map(_stream(t), F.split("event_type", "i")).select("event_id", "item"))


@query("stream_filter_tap", "select event_id, value from events where event_type = 'click'")
def _(t):
    s = stream.tap(_stream(t), metrics={"rows": F.count(F.lit(1))})
    return _ended(t, s.where("event_type = 'click'").select("event_id", "value"))


@query("stream_window", """
with w as (select user_id, row_number() over u - 1 as start, list(event_id) over (u rows between current row and 2 following) as l
  from events window u as (partition by user_id order by event_id))
select user_id, start, array_to_string(l, ',') as items from w where start % 2 = 0 and len(l) = 3""")
def _(t):
    out = _ended(t, stream.window(_stream(t), "user_id", "event_id", "event_id", 3, 2))
    return out.withColumn("items", F.array_join(F.transform("items", lambda x: x.cast("string")), ","))


@query("stream_buffer", """
with w as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as i from events), c as (select user_id, i // 4 as k, list(event_id order by i) as l from w group by all)
select user_id, array_to_string(l, ',') as items from c where len(l) = 4""")
def _(t):
    out = _ended(t, stream.buffer(_stream(t), "user_id", "event_id", "event_id", 4))
    return out.withColumn("items", F.array_join(F.transform("items", lambda x: x.cast("string")), ","))


@query("stream_where_type", "select event_id, event_id as v from events where event_id % 2 = 0")
def _(t):
    v = F.when(F.col("event_id") % 2 == 0, F.expr("cast(event_id as variant)")).otherwise(F.expr("cast(event_type as variant)"))
    tagged = _stream(t).select("event_id", F.schema_of_variant(v).alias("kind"), v.alias("v"))
    return _ended(t, stream.where_type(tagged.where("kind = 'BIGINT'"), "v", "bigint").select("event_id", "v"))


@query("stream_session_windows", """
with w as (select user_id, ts, event_id, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)) < 7200000000 then 0 else 1 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as k from w)
select user_id, min(ts) as start, count(*) as n from s group by user_id, k""")
def _(t):
    w = F.session_window("ts", "2 hours")
    return t.events.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("stream_count_by_type", "select event_type, count(*) as n from events group by 1")
def _(t):
    return _ended(t, _stream(t).groupBy("event_type").agg(F.count("*").alias("n")), "complete")


# -- caches ------------------------------------------------------------------------


@query("cache_lru_lookup", "select r_regionkey, count(*) as n from region join nation on n_regionkey = r_regionkey group by 1")
def _(t):
    cache = caching.LruCache(lambda k: t.nation.where(F.col("n_regionkey") == k), maximum_size=2)
    keys = [r[0] for r in t.region.select("r_regionkey").orderBy("r_regionkey").collect()]  # five regions
    parts = [cache.get(k).groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("n")) for k in keys]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query("cache_policies", """select 'empty' as policy, count(*) as loads, cast(0 as bigint) as held from nation union all select 'stale', count(*), 0 from nation
 union all select unnest(['wide', 'delegate', 'fresh']), count(distinct n_regionkey), count(distinct n_regionkey) from nation""")
def _(t):
    """Loads of the regions of all nations, asked for in the nations' order, and what each policy holds in the end."""
    asked = [r[0] for r in t.nation.select("n_regionkey").orderBy("n_nationkey").collect()]  # 25 nations
    now, rows = iter(range(1000)), []

    def policy(name, make):
        loads = []
        cache = make(lambda k: loads.append(k) or k)
        for k in asked:
            cache.get(k)
        cache.reap()
        rows.append((name, len(loads), cache.size()))

    policy("empty", caching.EmptyCache)
    policy("wide", lambda load: caching.FifoCache(load, 10))
    policy("delegate", lambda load: caching.DelegateCache(caching.LruCache(load, 10)))
    clock = {"t": 0}

    def ticking():
        clock["t"] += 1
        return clock["t"]

    policy("stale", lambda load: caching.ExpiryCache(load, update_expiry=0.5, clock=lambda: next(now)))
    policy("fresh", lambda load: caching.ExpiryCache(load, access_expiry=1e6, clock=ticking))
    return t.spark.createDataFrame(rows, "policy string, loads long, held long")


# -- optional, either, rows ------------------------------------------------------------


@query("optional_values", "select event_id, case when value > 50 then value end as kept, coalesce(case when value > 50 then value end, -1) as filled, case when value > 50 then value * 2 end as doubled from events")
def _(t):
    x = opt.where_present(F.col("value"), lambda v: v > 50)
    return t.events.select("event_id", x.alias("kept"), opt.or_else(x, F.lit(-1.0)).alias("filled"), opt.map_present(x, lambda v: v * 2).alias("doubled"))


@query("either_values", "select event_id, case when value > 50 then 'R' || event_type else 'L' || cast(event_id as varchar) end as folded, not value > 50 as is_left, not not value > 50 as swapped from events")
def _(t):
    e = opt.iff(F.col("value") > 50, F.col("event_type"), F.col("event_id"))
    return t.events.select("event_id", opt.fold(e, lambda l: F.concat(F.lit("L"), l.cast("string")), lambda r: F.concat(F.lit("R"), r)).alias("folded"), e["is_left"].alias("is_left"), opt.swap(opt.map_either(e))["is_left"].alias("swapped"))


@query("map_default_computed", "select n_nationkey, case n_regionkey when 1 then 'one' when 2 then 'two' else 'other' end as named, case n_regionkey when 1 then 'one' when 2 then 'two' else 'no ' || n_regionkey end as computed from nation")
def _(t):
    m = F.create_map(F.lit(1), F.lit("one"), F.lit(2), F.lit("two"))
    return t.nation.select("n_nationkey", opt.map_default(m, F.col("n_regionkey"), F.lit("other")).alias("named"), opt.map_computed(m, F.col("n_regionkey"), lambda k: F.concat(F.lit("no "), k.cast("string"))).alias("computed"))


@query("tuple_operations", "select n_nationkey, n_name as second, cast(n_regionkey + 100 as integer) as changed, 'x' as added, n_name as first_left, concat(n_nationkey, ',', n_regionkey) as listed from nation")
def _(t):
    r = structs.row(F.col("n_nationkey"), F.col("n_name"), F.col("n_regionkey"))
    numbers = structs.remove_item(r, 3, 1)
    return t.nation.select(
        "n_nationkey", structs.item(r, 1).alias("second"), structs.item(structs.with_item(r, 3, 2, F.col("n_regionkey") + 100), 2).alias("changed"), structs.item(structs.add_item(r, 3, 0, F.lit("x")), 0).alias("added"), structs.item(structs.remove_item(r, 3, 0), 0).alias("first_left"),
        F.array_join(F.transform(structs.to_array(numbers, 2), lambda x: x.cast("string")), ",").alias("listed"),
    )


@query("udf_scalar_and_table", "select p_partkey, p_size * 2 as doubled, word from (select p_partkey, p_size, unnest(string_split(p_name, ' ')) as word from part)")
def _(t):
    @F.pandas_udf(T.IntegerType())
    def double(x):
        return x * 2

    @F.udtf(returnType="word string")
    class Words:
        def eval(self, text: str):
            for w in text.split(" "):
                yield (w,)

    t.spark.udtf.register("tessera_words", Words)
    t.part.createOrReplaceTempView("tessera_part")
    rows = t.spark.sql("select p_partkey, p_size, word from tessera_part, lateral tessera_words(p_name)")
    return rows.select("p_partkey", double("p_size").alias("doubled"), "word")


@query("udf_merge_counts", "select coalesce(a.event_type, b.event_type) as element, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) as n from (select event_type, count(*) as n from events where value > 50 group by 1) a full join (select event_type, count(*) as n from events where value <= 50 group by 1) b on a.event_type = b.event_type")
def _(t):
    from tessera.operators import bags

    a, b = bags.bag(t.events.where("value > 50"), "event_type"), bags.bag(t.events.where("value <= 50"), "event_type")
    return bags.combine(a, b, lambda e, x, y: F.greatest(x, y))
