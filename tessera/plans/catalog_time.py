"""Queries on dates, durations and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import formatting as fmt
from tessera.functions import temporal as tm
from tessera.functions.temporal import TimeUnit
from tessera.plans.registry import query

def _orders(t):
    return t.orders.select("o_orderkey", "o_orderdate")


@query("date_accessors", """select o_orderkey, (year(o_orderdate) % 4 = 0 and (year(o_orderdate) % 100 <> 0 or year(o_orderdate) % 400 = 0)) as leap, cast(dayofyear(make_date(year(o_orderdate), 12, 31)) as integer) as days_in_year, cast(day(last_day(o_orderdate)) as integer) as days_in_month,
 cast(weekofyear(make_date(year(o_orderdate), 12, 28)) as integer) as weeks, cast(quarter(o_orderdate) as integer) as quarter, cast(isoyear(o_orderdate) as integer) as week_year, cast(weekofyear(o_orderdate) as integer) as week, cast(dayofyear(o_orderdate) as integer) as day_of_year from orders""")
def _(t):
    return _orders(t).select("o_orderkey", tm.is_leap_year(F.col("o_orderdate")).alias("leap"), tm.days_in_year(F.col("o_orderdate")).alias("days_in_year"), tm.days_in_month(F.col("o_orderdate")).alias("days_in_month"), tm.weeks_in_year(F.col("o_orderdate")).alias("weeks"), F.quarter(F.col("o_orderdate")).alias("quarter"), tm.week_year(F.col("o_orderdate")).alias("week_year"), tm.week_number(F.col("o_orderdate")).alias("week"), F.dayofyear(F.col("o_orderdate")).alias("day_of_year"))


@query("date_hour12", "select event_id, cast((hour(ts) + 11) % 12 + 1 as integer) as h from events")
def _(t):
    return t.events.select("event_id", tm.hour12(F.col("ts")).alias("h"))


_UNITS = ["microsecond", "millisecond", "second", "minute", "hour", "day", "week", "month", "quarter", "year", "decade", "century", "millennium"]
_TRUNC = [f"cast(date_trunc('{u}', ts) as timestamp) as {u}_" for u in _UNITS[:10]] + [f"cast(make_date(year(ts) - year(ts) % {n}, 1, 1) as timestamp) as {u}_" for u, n in (("decade", 10), ("century", 100), ("millennium", 1000))]


@query("date_truncate", f"select event_id, {', '.join(_TRUNC)}, cast(date_trunc('week', ts + interval 1 day) - interval 1 day as timestamp) as sunday_ from events")
def _(t):
    ts = F.col("ts")
    return t.events.select("event_id", *[tm.truncate(ts, TimeUnit[u.upper()]).alias(u + "_") for u in _UNITS], tm.truncate(ts, TimeUnit.WEEK, 7).alias("sunday_"))


@query("date_periodical_days", "select range as place, timestamp '2024-01-30 06:00:00' + interval (range * 36) hour as at from range(40)")
def _(t):
    return tm.periodical(t.spark, "2024-01-30 06:00:00", TimeUnit.HOUR, 40, 36)


@query("date_periodical_months", """select range as place, case range when 0 then timestamp '2023-01-31 10:00:00' else timestamp '2023-03-03 10:00:00' + interval (range - 1) month end as at from range(30)""")
def _(t):
    return tm.periodical(t.spark, "2023-01-31 10:00:00", TimeUnit.MONTH, 30)


@query("duration_convert", """with v as (select event_id, (event_id * 1234567891) % 10000000000000 as us from events) select event_id, us / 3600000000.0::double as hours, us / 2592000000000.0::double as months, us / 2629746000000.0::double as accurate_months from v""")
def _(t):
    us = (F.col("event_id") * 1234567891) % 10000000000000
    return t.events.select("event_id", tm.convert_to(us, TimeUnit.HOUR).alias("hours"), tm.convert_to(us, TimeUnit.MONTH).alias("months"), tm.convert_to(us, TimeUnit.MONTH, tm.ACCURATE).alias("accurate_months"))


@query("duration_convert_all", """with v as (select event_id, (event_id * 1234567891) % 10000000000000 as us from events) select event_id, us // 86400000000 as day, us % 86400000000 // 3600000000 as hour, us % 3600000000 as microsecond from v""")
def _(t):
    us = (F.col("event_id") * 1234567891) % 10000000000000
    m = tm.convert_to_all(us, [TimeUnit.DAY, TimeUnit.HOUR])
    return t.events.select("event_id", m.alias("m")).select("event_id", *[F.col("m")[u].alias(u) for u in ("day", "hour", "microsecond")])


@query("interval_to_duration", "select user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 * 1000 as us from events group by 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select("user_id", tm.interval_duration(F.col("a"), F.col("b")).alias("us"))


@query("format_combinators", """select c_custkey, case when c_acctbal < 0 then 'debt ' || cast(cast(c_acctbal as bigint) as varchar) when c_acctbal > 5000 then 'rich' else '<' || c_name || '>' end as switched, case when c_custkey % 2 = 0 then c_name else '' end as filtered, case when c_custkey % 3 = 0 then '␀' else c_name end as shown, 'n=' || cast(length(c_name) as varchar) || '!' as derived from customer""")
def _(t):
    name = F.col("c_name")
    row = F.struct("c_acctbal", "c_name")
    whole = lambda c: F.rint(c["c_acctbal"]).cast("long").cast("string")  # noqa: E731 (ties to even, as the SQL's cast)
    switched = fmt.switcher([(lambda c: c["c_acctbal"] < 0, fmt.before(whole, "debt ")), (lambda c: c["c_acctbal"] > 5000, fmt.literal("rich"))], fmt.around(lambda c: c["c_name"], "<", ">"))
    return t.customer.select("c_custkey", switched(row).alias("switched"), fmt.where(fmt.standard(), lambda c: F.col("c_custkey") % 2 == 0)(name).alias("filtered"), fmt.if_null(fmt.standard())(F.when(F.col("c_custkey") % 3 != 0, name)).alias("shown"), fmt.sequence(fmt.literal("n="), fmt.after(fmt.on_result_of(fmt.standard(), F.length), "!"))(name).alias("derived"))


@query("format_iterable", """with w as (select p_partkey, string_split(p_name, '') as a from part) select p_partkey, case when len(a) > 1 then array_to_string(a[:-2], ', ') || ' and ' || a[-1] else array_to_string(a, ', ') end as last, case when len(a) > 5 then array_to_string(a[:3] || ['…'] || a[-2:], '-') else array_to_string(a, '-') end as cut, '∅' as nothing from w""")
def _(t):
    a = F.split("p_name", "")
    return t.part.select("p_partkey", fmt.iterable(last_separator=" and ")(a).alias("last"), fmt.iterable(separator="-", leading=3, trailing=2)(a).alias("cut"), fmt.if_empty(fmt.iterable())(F.array().cast("array<string>")).alias("nothing"))


@query("format_fixed", """select c_custkey, format('{:.2f}', c_acctbal) as two, format('{:,}', cast(round(abs(c_acctbal) * 1000) as bigint)) as grouped, lpad(cast(c_custkey as varchar), 8, '0') as padded, hex(c_custkey) as sixteen, case when c_acctbal < 0 and tenths > 0 then '-' else '+' end || tenths // 10 || '.' || tenths % 10 as signed from (select *, (abs(cast(round(c_acctbal * 100) as bigint)) + 5) // 10 as tenths from customer)""")
def _(t):
    b = F.col("c_acctbal")
    return t.customer.select("c_custkey", fmt.fixed(b, 2).alias("two"), fmt.fixed(F.round(F.abs(b) * 1000), separator=",").alias("grouped"), fmt.fixed(F.col("c_custkey"), padding=8).alias("padded"), F.upper(fmt.fixed(F.col("c_custkey"), base=16)).alias("sixteen"), fmt.fixed(F.round(b, 1), 1, positive="+").alias("signed"))


@query("format_special", "select 'NaN' as nan, '-Infinity' as low, 'inf' as high, '0.25' as quarter, '-3' as half")
def _(t):
    f = lambda x: F.lit(float(x))
    return t.spark.range(1).select(fmt.fixed(f("nan")).alias("nan"), fmt.fixed(f("-inf")).alias("low"), fmt.fixed(f("inf"), infinity="inf").alias("high"), fmt.fixed(f(0.26), accuracy=0.05, precision=2).alias("quarter"), fmt.fixed(f(-2.5)).alias("half"))


@query("format_scientific", """with v as (select o_orderkey, o_totalprice < 0 as below, cast(round(abs(o_totalprice) * 1000000) as hugeint) as u from orders), d as (select *, length(u::varchar) as l from v),
q as (select *, case when l > 4 then (u + 5 * cast(pow(10, l - 5) as hugeint)) // cast(pow(10, l - 4) as hugeint) else u * cast(pow(10, 4 - l) as hugeint) end as m from d)
select o_orderkey, case when below then '-' else '' end || case when u = 0 then '0.000e0' when m = 10000 then '1.000e' || (l - 6) else (m // 1000) || '.' || lpad((m % 1000)::varchar, 3, '0') || 'e' || (l - 7) end as text from q""")
def _(t):
    return t.orders.select("o_orderkey", fmt.scientific(F.col("o_totalprice")).alias("text"))


_IEC = "case when o_orderkey >= 1 << 30 then format('{:.1f} GiB', round(o_orderkey / 1073741824, 1)) when o_orderkey >= 1 << 20 then format('{:.1f} MiB', round(o_orderkey / 1048576, 1)) when o_orderkey >= 1024 then format('{:.1f} KiB', round(o_orderkey / 1024, 1)) else cast(o_orderkey as varchar) || ' B' end"


@query("format_human", f"""select o_orderkey, case when o_totalprice >= 1e9 then format('{{:.1f}} GB', round(o_totalprice / 1e9, 1)) when o_totalprice >= 1e6 then format('{{:.1f}} MB', round(o_totalprice / 1e6, 1)) when o_totalprice >= 1000 then format('{{:.1f}} kB', round(o_totalprice / 1000, 1))
 when o_totalprice >= 1 then format('{{:.0f}} B', round(o_totalprice)) when o_totalprice > 0 then format('{{:.1f}} mB', round(o_totalprice * 1000, 1)) else '0 B' end as si, {_IEC} as iec from orders""")
def _(t):
    return t.orders.select("o_orderkey", fmt.human(F.col("o_totalprice"), "B").alias("si"), fmt.human(F.col("o_orderkey"), "B", binary=True).alias("iec"))


@query("format_ordinal_sign", """select o_orderkey, cast(o_orderkey as varchar) || case when o_orderkey % 100 between 10 and 20 then 'th' when o_orderkey % 10 = 1 then 'st' when o_orderkey % 10 = 2 then 'nd' when o_orderkey % 10 = 3 then 'rd' else 'th' end as ordinal, case when o_orderkey % 3 = 0 then '-' else '+' end as sign, translate(cast(o_orderkey as varchar), '0123456789', '٠١٢٣٤٥٦٧٨٩') as arabic, 'U+' || lpad(hex(o_orderkey % 90 + 33), 4, '0') || ' "' || chr(cast(o_orderkey % 90 + 33 as integer)) || '"' as point from orders""")
def _(t):
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", fmt.ordinal(k).alias("ordinal"), fmt.sign(F.when(k % 3 == 0, -k - 1).otherwise(k), positive="+").alias("sign"), fmt.numerals(k.cast("string"), "arabic").alias("arabic"), fmt.code_point(k % 90 + 33).alias("point"))


@query("format_pad_truncate", """select p_partkey, case when length(p_name) < 30 then lpad(p_name, 30, '.') else p_name end as lefted, case when length(p_name) < 30 then rpad(p_name, 30, '.') else p_name end as righted, case when length(p_name) < 30 then rpad(lpad(p_name, cast(length(p_name) + floor((30 - length(p_name)) / 2) as integer), '.'), 30, '.') else p_name end as both, case when length(p_name) > 8 then left(p_name, 7) || '…' else p_name end as cut, case when length(p_name) > 8 then '…' || right(p_name, 7) else p_name end as cut_left, case when length(p_name) > 8 then left(p_name, 4) || '…' || right(p_name, 3) else p_name end as cut_center from part""")
def _(t):
    c = F.col("p_name")
    return t.part.select("p_partkey", fmt.pad_left(c, 30, ".").alias("lefted"), fmt.pad_right(c, 30, ".").alias("righted"), fmt.pad_both(c, 30, ".").alias("both"), fmt.truncate_right(c, 8).alias("cut"), fmt.truncate_left(c, 8).alias("cut_left"), fmt.truncate_center(c, 8).alias("cut_center"))


@query("format_separate_trim", r"""select o_orderkey, format('{:,}', o_orderkey * 1234) as from_right, rtrim(regexp_replace(cast(o_orderkey * 1234 as varchar), '(\d{3})', '\1_', 'g'), '_') as from_left, 'x' as trimmed, left('  x ', 3) as kept from orders""")
def _(t):
    s = (F.col("o_orderkey") * 1234).cast("string")
    x = F.lit("  x ")
    return t.orders.select("o_orderkey", fmt.separate_right(s, 3, 0, ",").alias("from_right"), fmt.separate_left(s, 3, 0, "_").alias("from_left"), fmt.trim(x).alias("trimmed"), fmt.trim(x, left=False).alias("kept"))


@query("format_date_time", """select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as iso, strftime(ts, '%d/%m/%Y') || ' Q' || quarter(ts) || ' W' || lpad(cast(weekofyear(ts) as varchar), 2, '0') || ' ' || lpad(cast(dayofyear(ts) as varchar), 3, '0') as custom, lpad(cast((hour(ts) + 11) % 12 + 1 as varchar), 2, '0') || case when hour(ts) < 12 then 'am' else 'pm' end as clock, strftime(ts, '%b %a') as names, 'AD' as era, strftime(ts, '%g') as ms, strftime(ts, '%Y-%m-%d') as date, strftime(ts, '%H:%M:%S') as time from events""")
def _(t):
    ts = F.col("ts")
    custom = fmt.date_time(fmt.day(), "/", fmt.month(), "/", fmt.year(), " Q", fmt.quarter(), " W", fmt.week(), " ", fmt.day_of_year())
    names = fmt.date_time(fmt.month(names="Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()), " ", fmt.weekday("Mon Tue Wed Thu Fri Sat Sun".split()))
    return t.events.select("event_id", fmt.iso8601(ts).alias("iso"), custom(ts).alias("custom"), fmt.date_time(fmt.hour12(), fmt.meridiem())(ts).alias("clock"), names(ts).alias("names"), fmt.era()(ts).alias("era"), fmt.millisecond()(ts).alias("ms"), fmt.date(ts).alias("date"), fmt.time(ts).alias("time"))


@query("format_duration", """with v as (select event_id, event_id * 123456789 as us from events) select event_id, cast(us // 3600000000 as varchar) || ':' || lpad(cast(us // 60000000 % 60 as varchar), 2, '0') || ':' || lpad(cast(us // 1000000 % 60 as varchar), 2, '0') || '.' || lpad(cast(us % 1000000 as varchar), 6, '0') as text, 'PT0S' as zero, '-P1DT2H3M4.5S' as iso from v""")
def _(t):
    us = F.col("event_id") * 123456789
    return t.events.select("event_id", fmt.duration(us).alias("text"), fmt.duration_iso8601(F.lit(0)).alias("zero"), fmt.duration_iso8601(F.lit(-(86400 + 7200 + 184) * 1000000 - 500000)).alias("iso"))


@query("format_record", "select c_custkey, 'Customer(name=' || c_name || ', segment=' || c_mktsegment || case when c_custkey % 2 = 0 then ', even=' || cast(c_custkey as varchar) else '' end || ')' as text from customer")
def _(t):
    return t.customer.select("c_custkey", fmt.record("Customer", {"name": F.col("c_name"), "segment": F.col("c_mktsegment"), "even": F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey"))}, omit_null=True).alias("text"))
