"""SQL that finds the matching blocks of two sequences, for the oracles of the difference queries.

From the longest block of a range on, the ranges before and after it are searched
in turn, by a recursive CTE.  Of equally long blocks the one that begins first
is taken.  Items that a long second sequence holds very often start no block but
lengthen one.
"""

_BEST = """(select q.*, greatest(f.lo, q.a1, q.b1 + q.d) as flo, least(f.hi, q.a2, q.b2 + q.d) as fhi, row_number() over (partition by q.k, q.a1, q.a2, q.b1, q.b2 order by q.size desc, q.lo, q.lo - q.d) as nth
  from (select r.k, r.a1, r.a2, r.b1, r.b2, c.d, greatest(c.lo, r.a1, r.b1 + c.d) as lo, least(c.hi, r.a2, r.b2 + c.d) - greatest(c.lo, r.a1, r.b1 + c.d) as size from {ranges} r join plain_run c on c.k = r.k where least(c.hi, r.a2, r.b2 + c.d) > greatest(c.lo, r.a1, r.b1 + c.d)
        union all select k, a1, a2, b1, b2, a1 - b1, a1, 0 from {ranges}) q
  join full_run f on f.k = q.k and f.d = q.d and f.lo <= q.lo and f.hi >= q.lo + greatest(q.size, 1))"""


def matching(source: str, popular: bool = True) -> str:
    """CTEs up to block(k, a, b, size) and oper(k, n, kind, a1, a2, b1, b2) from ``source``, CTEs that end with x(k, a, b).

    k is a column of any type, a and b are lists.  To be followed by a select.
    """
    rare = "having count(*) > len(any_value(x.b)) // 100 + 1 and len(any_value(x.b)) >= 200" if popular else "having false"
    runs = "select k, d, min(i) as lo, max(i) + 1 as hi from (select k, d, i, i - row_number() over (partition by k, d order by i) as g from eq{where}) group by k, d, g"
    return f"""with recursive {source},
ea as (select k, unnest(a) as w, generate_subscripts(a, 1) - 1 as i from x), eb as (select k, unnest(b) as w, generate_subscripts(b, 1) - 1 as j from x),
popular as (select eb.k, eb.w from eb join x on x.k = eb.k group by eb.k, eb.w {rare}),
eq as (select ea.k, ea.i, ea.i - eb.j as d, popular.w is null as plain from ea join eb on ea.k = eb.k and ea.w = eb.w left join popular on popular.k = ea.k and popular.w = ea.w),
full_run as ({runs.format(where="")}), plain_run as ({runs.format(where=" where plain")}),
ranges as (select k, 0::bigint as a1, len(a)::bigint as a2, 0::bigint as b1, len(b)::bigint as b2 from x
  union all select k, case side when 0 then a1 else fhi end, case side when 0 then flo else a2 end, case side when 0 then b1 else fhi - d end, case side when 0 then flo - d else b2 end
  from {_BEST.format(ranges="ranges")}, (values (0), (1)) s(side)
  where nth = 1 and fhi > flo and case side when 0 then a1 < flo and b1 < flo - d else fhi < a2 and fhi - d < b2 end),
found as (select k, flo as a, flo - d as b, fhi - flo as size from {_BEST.format(ranges="ranges")} where nth = 1 and fhi > flo),
block as (select k, min(a) as a, min(b) as b, sum(size)::bigint as size from (select *, sum(fresh) over (partition by k order by a) as g from (select *, case when lag(a + size) over w = a and lag(b + size) over w = b then 0 else 1 end as fresh from found window w as (partition by k order by a))) group by k, g),
closed as (select k, a, b, size from block union all select k, len(a), len(b), 0 from x),
stepped as (select *, coalesce(lag(a + size) over (partition by k order by a, b, size desc), 0) as pa, coalesce(lag(b + size) over (partition by k order by a, b, size desc), 0) as pb from closed),
oper as (select k, row_number() over (partition by k order by a1, b1, a2, b2) as n, kind, a1, a2, b1, b2 from (
  select k, case when pa < a and pb < b then 'replace' when pa < a then 'delete' else 'insert' end as kind, pa as a1, a as a2, pb as b1, b as b2 from stepped where pa < a or pb < b
  union all select k, 'equal', a, a + size, b, b + size from stepped where size > 0))"""


#: Rows of the longest block of whole sequences, in the range's columns; nth = 1 is it.
BEST_OF_ALL = _BEST.format(ranges="(select k, 0::bigint as a1, len(a)::bigint as a2, 0::bigint as b1, len(b)::bigint as b2 from x)")

#: CTE piece(k, g, n, kind, a1, a2, b1, b2): the operations in groups with three equal items around changes.
GROUPED = """, placed as (select o.*, n = 1 as head, n = count(*) over (partition by k) as tail, sum(case when kind <> 'equal' then 1 else 0 end) over (partition by k) as changes,
  sum(case when kind = 'equal' and a2 - a1 > 6 and n > 1 then 1 else 0 end) over (partition by k order by n rows between unbounded preceding and 1 preceding) as before from oper o),
piece as (select k, coalesce(before, 0) as g, n, kind, case when head and kind = 'equal' then greatest(a1, a2 - 3) else a1 end as a1, case when kind = 'equal' and tail then least(a2, a1 + 3) else a2 end as a2,
    case when head and kind = 'equal' then greatest(b1, b2 - 3) else b1 end as b1, case when kind = 'equal' and tail then least(b2, b1 + 3) else b2 end as b2 from placed where changes > 0 and not (kind = 'equal' and not head and not tail and a2 - a1 > 6)
  union all select k, coalesce(before, 0) + side, n, kind, case side when 0 then a1 else a2 - 3 end, case side when 0 then a1 + 3 else a2 end, case side when 0 then b1 else b2 - 3 end, case side when 0 then b1 + 3 else b2 end
    from placed, (values (0), (1)) s(side) where changes > 0 and kind = 'equal' and not head and not tail and a2 - a1 > 6)"""
