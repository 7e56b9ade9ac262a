"""All queries of the library's own operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import sequence as seq
from tessera.plans import catalog_bags, catalog_graph, catalog_math, catalog_misc, catalog_ordering, catalog_sequence, catalog_text, catalog_time  # noqa: F401
from tessera.plans.registry import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]


@query("flagship_window_top_users", """
with w as (select user_id, row_number() over u - 1 as start, list(event_id) over (u rows between current row and 2 following) as l
  from events window u as (partition by user_id order by ts, event_id))
select user_id, cast(sum(list_sum(l)) as bigint) as total from w where start % 2 = 0 and len(l) = 3 group by 1 order by total desc, user_id limit 10""")
def _(t):
    windows = seq.window(t.events, "event_id", 3, step=2, order_by=["ts", "event_id"], partition_by="user_id")
    per_window = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x)
    return windows.groupBy("user_id").agg(F.sum(per_window).alias("total")).orderBy(F.desc("total"), "user_id").limit(10)
