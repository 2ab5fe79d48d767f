"""Queries over how lists turned out."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitgrid.operators import audit, track as tk
from pitgrid.plans import panel as pl, press, prices as pr, upkeep as up
from pitgrid.plans.alternatives import membership
from pitgrid.plans.fixtures import TABLES, ctes, read
from pitgrid.plans.prices import rounded

HORIZONS = (4, 13)


def live(spark, sf):
    return rounded(tk.live_cohorts(pl.scores(spark, sf), pr.grid(spark, sf), pl.index_of(spark, sf), read(spark, sf, "as_of"), HORIZONS))


def report(spark, sf):
    return rounded(tk.cohort_report(live(spark, sf), read(spark, sf, "as_of"), (pl.VETO,)), 9)


LIVE = pl.SCORES + f""",
market as ({TABLES["market"][1]}), mk as (select session, close from market join sessions using (date)),
lc0 as (select s.as_of, s.strategy, s.ticker, composite, row_number() over (partition by s.as_of, s.strategy, h order by rank, s.ticker) as p, a.session + 1 as i, h as horizon, a.session + 1 + h as o from scores s join as_of a using (as_of), (select unnest({list(HORIZONS)}) as h) q where composite is not null),
lc1 as (select lc0.*, y.close_ff / nullif(x.close_ff, 0) - 1 as ret from lc0 join grid x on x.ticker = lc0.ticker and x.session = i join grid y on y.ticker = lc0.ticker and y.session = o),
lc2 as (select as_of, strategy, horizon, i, o, count(ret) as n, avg(ret) as mean from lc1 where p <= 10 group by all),
lc3 as (select as_of, strategy, horizon, rank() over (partition by as_of, strategy, horizon order by composite) + (count(*) over (partition by as_of, strategy, horizon, composite) - 1) / 2.0 as a, rank() over (partition by as_of, strategy, horizon order by ret) + (count(*) over (partition by as_of, strategy, horizon, ret) - 1) / 2.0 as b from lc1 where ret is not null),
lc4 as (select as_of, strategy, horizon, case when count(*) >= 8 then corr(a, b) end as ic from lc3 group by all),
lc as (select as_of, strategy, horizon, n, round(mean, 6) + 0.0 as mean, round(d.close / nullif(c.close, 0) - 1, 6) + 0.0 as bench, round(mean - (d.close / nullif(c.close, 0) - 1), 6) + 0.0 as excess, round(ic, 6) + 0.0 as ic
  from lc2 left join mk c on c.session = i left join mk d on d.session = o left join lc4 using (as_of, strategy, horizon))"""


def drifts(spark, sf):
    return rounded(tk.drift_summary(pl.scores(spark, sf)))


def floors(spark, sf):
    return rounded(tk.safe_from(audit.survivorship_gap(membership(spark, sf), read(spark, sf, "bars"))))


def sanity(spark, sf):
    bars = read(spark, sf, "bars").withColumn("close", F.when(F.dayofyear("date") % 61 == 0, 0.0).otherwise(F.col("close")))
    return tk.price_sanity(bars, "2001-09-30")


def ordered(spark, sf):
    t = press.told(spark, sf).withColumn("tone", (F.col("id") % 7 - 3).cast("double") / 3)
    return tk.news_order(t, ["ticker"], "tone").select("ticker", "id", "place")


QUERIES = {
    "live_cohorts": (live, LIVE + " select * from lc"),
    "cohort_report": (report, LIVE + f""" select strategy, horizon, count(*) as cohorts, round(avg(excess), 9) + 0.0 as mean_excess, round(avg((case when strategy = '{pl.VETO}' then excess < 0 else excess > 0 end)::int), 9) + 0.0 as hit, round(avg(ic), 9) + 0.0 as mean_ic,
  greatest(1, round((max(session) - min(session)) / horizon) + 1)::bigint as independent from lc join as_of using (as_of) where excess is not null group by strategy, horizon"""),
    "drift_summary": (drifts, pl.SCORES + """, d0 as (select strategy, as_of, lag(as_of) over (partition by strategy order by as_of) as before from (select distinct strategy, as_of from scores where rank is not null)),
d1 as (select s.strategy, s.as_of, s.ticker, s.composite, s.rank, t.composite as c, t.rank as r from scores s join d0 on d0.strategy = s.strategy and d0.as_of = s.as_of and before is not null left join scores t on t.strategy = s.strategy and t.as_of = before and t.ticker = s.ticker and t.rank is not null where s.rank is not null),
d2 as (select strategy, as_of, 1 - count(case when r <= 10 then 1 end) / count(*) as turnover from d1 where rank <= 10 group by all),
d3 as (select strategy, as_of, rank() over (partition by strategy, as_of order by composite) + (count(*) over (partition by strategy, as_of, composite) - 1) / 2.0 as x, rank() over (partition by strategy, as_of order by c) + (count(*) over (partition by strategy, as_of, c) - 1) / 2.0 as y from d1 where c is not null),
d4 as (select strategy, as_of, case when count(*) >= 8 then corr(x, y) end as correlation, count(*) as names from d3 group by all)
select strategy, as_of, round(turnover, 6) + 0.0 as turnover, round(correlation, 6) + 0.0 as correlation, names from d2 left join d4 using (strategy, as_of)"""),
    "survivorship_floor": (floors, f"with g as ({up.QUERIES['survivorship_gap'][1]}), y as (select year(as_of) as year, max(gap) as gap from g group by 1) select year, gap, max(gap) over (order by year desc rows unbounded preceding) <= 0.1 as safe from y"),
    "price_sanity": (sanity, ctes("bars") + """, b as (select ticker, date, case when dayofyear(date) % 61 = 0 then 0 else close end as close from bars)
select * from (select ticker, count(case when coalesce(close <= 0, true) then 1 end) as no_price, count(case when date > date '2001-09-30' then 1 end) as future, max(date) as newest from b group by 1) where no_price + future > 0"""),
    "news_order": (ordered, press.TOLD + """ select ticker, id, place from (select *, row_number() over (partition by ticker order by (len(events) > 0)::int desc, abs((id % 7 - 3) / 3.0) desc, published desc, id) as place from told) where place <= 8"""),
}
