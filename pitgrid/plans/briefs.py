"""Roll-up queries over rankings, trades, cohorts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitgrid.operators import asof, brief, evaluation as ev, signals as sg
from pitgrid.plans import panel as pl, prices as pr, records as rc
from pitgrid.plans.fixtures import ctes, read
from pitgrid.plans.prices import rounded


def lists(spark, sf):
    return rounded(brief.lists_of(pl.scores(spark, sf), 10))


def changes(spark, sf):
    return brief.list_changes(pl.scores(spark, sf), 10)


def stable(spark, sf):
    return brief.stability(pl.scores(spark, sf))


def sector_mix(spark, sf):
    return rounded(brief.spread_of_sectors(pl.screen(spark, sf)))


def trades(spark, sf):
    return rounded(brief.trade_summary(rc.trade_rows(spark, sf)))


def cohort_table(spark, sf):
    return rounded(brief.cohort_summary(rc.cohort_rows(spark, sf), 10), 9)


def years(spark, sf):
    return rounded(brief.by_year(rc.cohort_rows(spark, sf), "2001-01-01"), 9)


def returns(spark, sf):
    return rounded(brief.return_table(pr.grid(spark, sf), {"r1": 1, "r5": 5, "r21": 21}))


def rebalances(spark, sf):
    return brief.rebalance_sessions(read(spark, sf, "sessions"), "quarter")


def reports(spark, sf):
    results = read(spark, sf, "corporate_events").where("category = 'results'").select("ticker", "filed").distinct()
    return brief.next_report(results, F.lit(rc.last_date(spark, sf)))


def patterns(spark, sf):
    seen = asof.window_join(rc.dates(spark, sf), read(spark, sf, "corporate_events"), "filed", 90)
    return brief.event_pattern(seen, {"management": 2, "restructuring": 3, "strategy": 2, "results": 1})


def ic_table(spark, sf):
    return rounded(ev.ic_summary(pl.ic(spark, sf), ["strategy"], 3), 9)


def inverse_vol(spark, sf):
    """Weights of the ten best by the inverse of volatility."""
    vol = pr.panel(spark, sf).select("as_of", "ticker", F.col("VOL_1Y").alias("vol"))
    picks = ev.holdings(pl.scores(spark, sf), 10).drop("weight").join(vol, ["as_of", "ticker"], "left")
    return rounded(ev.weight_scheme(picks, "inverse_vol").select("as_of", "strategy", "ticker", "weight"))


def risk(spark, sf):
    plans = pl.plans(spark, sf)
    return rounded(sg.portfolio_risk(plans, ["as_of"]))


def related(spark, sf):
    """How alike two strategies rank, per date."""
    s = pl.scores(spark, sf)
    a = s.where("strategy = 'momentum_trend'").select("as_of", "ticker", F.col("composite").alias("a"))
    b = s.where("strategy = 'breakout'").select("as_of", "ticker", F.col("composite").alias("b"))
    out = ev.rank_ic(a.join(b, ["as_of", "ticker"]), "a", "b", ["as_of"], 3)
    return rounded(out.withColumn("relation", ev.relation(F.col("ic"))))


AGG_TOP = pl.SCORES + ", top as (select * from scores where rank <= 10)"
QUERIES = {
    "strategy_lists": (lists, AGG_TOP + " select as_of, ticker, count(distinct strategy) as lists, round(avg(rank), 6) + 0.0 as mean_rank, min(rank) as best_rank, array_to_string(list_sort(list(distinct strategy)), ',') as strategies from top group by all"),
    "strategy_list_changes": (changes, AGG_TOP + """, d as (select as_of, lag(as_of) over (order by as_of) as before from (select distinct as_of from scores)),
ran as (select distinct as_of, strategy from scores), pd as (select d.as_of, d.before, r.strategy from d join ran r using (as_of) where exists (select 1 from ran x where x.as_of = d.before and x.strategy = r.strategy)),
n as (select top.as_of, ticker, count(*) as now from top join pd on top.as_of = pd.as_of and top.strategy = pd.strategy group by all), o as (select pd.as_of, ticker, count(*) as then_ from top join pd on top.as_of = pd.before and top.strategy = pd.strategy group by all)
select coalesce(n.as_of, o.as_of) as as_of, coalesce(n.ticker, o.ticker) as ticker, coalesce(now, 0) as now, coalesce(then_, 0) as "then", case when coalesce(then_, 0) = 0 then 'new' when coalesce(now, 0) = 0 then 'lost' when now > then_ then 'up' when now < then_ then 'down' else 'same' end as change from n full join o on n.as_of = o.as_of and n.ticker = o.ticker"""),
    "top_stability": (stable, AGG_TOP + """, t as (select strategy, as_of, list_sort(list(distinct ticker)) as names from top group by all), e as (select strategy, arg_min(names, as_of) as a, arg_max(names, as_of) as b from t group by 1)
select strategy, len(list_filter(a, lambda x: list_contains(b, x)))::int as shared, array_to_string(list_filter(b, lambda x: not list_contains(a, x)), ',') as entered, array_to_string(list_filter(a, lambda x: not list_contains(b, x)), ',') as exited from e"""),
    "sector_mix": (sector_mix, "with s as (" + pl.QUERIES["screen_momentum"][1] + "), g as (select as_of, strategy, sector, count(*) as n from s group by all) select as_of, strategy, sector, n, round(n / sum(n) over (partition by as_of, strategy), 6) + 0.0 as share from g"),
    "trade_summary": (trades, "with t as (" + rc.TRADES + ") select count(*) as n, round(avg((net_return > 0)::int), 6) + 0.0 as win_rate, round(avg(case when net_return > 0 then net_return end), 6) + 0.0 as mean_win, round(avg(case when net_return <= 0 then net_return end), 6) + 0.0 as mean_loss, round(avg(r_multiple), 6) + 0.0 as mean_r, round(avg(held), 6) + 0.0 as mean_held, round(sum(case when net_return > 0 then net_return end) / abs(sum(case when net_return <= 0 then net_return end)), 6) + 0.0 as profit_factor, count(case when reason = 'stop' then 1 end) as by_stop, count(case when reason = 'target' then 1 end) as by_target, count(case when reason = 'time' then 1 end) as by_time from t"),
    "cohort_summary": (cohort_table, "with c as (" + rc.QUERIES["cohort_returns"][1] + ") select strategy, count(excess) as cohorts, round(avg(excess), 9) + 0.0 as mean_excess, round(avg((excess > 0)::int), 9) + 0.0 as hit from c group by 1"),
    "cohort_years": (years, "with c as (" + rc.QUERIES["cohort_returns"][1] + ") select strategy, year(as_of) as year, case when as_of < '2001-01-01' then 'in' else 'out' end as sample, round(avg(excess), 9) + 0.0 as mean_excess, count(excess) as n from c group by all"),
    "return_table": (returns, pr.GRID + ", x as (select *, " + ", ".join(f"close_ff / nullif(lag(close_ff, {n}) over w, 0) - 1 as r{n}" for n in (1, 5, 21)) + " from grid window w as (partition by ticker order by session)) select ticker, date, round(r1, 6) + 0.0 as r1, round(r5, 6) + 0.0 as r5, round(r21, 6) + 0.0 as r21 from x where session = (select max(session) from sessions)"),
    "rebalance_sessions": (rebalances, ctes("sessions") + " select session, date from sessions where session in (select max(session) from sessions group by date_trunc('quarter', date)) or session = (select min(session) from sessions)"),
    "next_reports": (reports, ctes("corporate_events", "sessions", "as_of") + """, f as (select distinct ticker, filed from corporate_events where category = 'results' and filed <= (select max(as_of) from as_of)), l as (select *, max(filed) over (partition by ticker) as last from f),
e as (select ticker, last, min(case when filed + 364 >= (select max(as_of) from as_of) and filed + 364 - last >= 45 then filed + 364 end) as ahead from l group by all)
select ticker, coalesce(ahead, last + greatest(1, ceil(((select max(as_of) from as_of) - last) / 91))::int * 91) as expected, last as last_filed, coalesce(ahead, last + greatest(1, ceil(((select max(as_of) from as_of) - last) / 91))::int * 91) - (select max(as_of) from as_of) as days_until from e"""),
    "event_patterns": (patterns, ctes("corporate_events", "as_of") + """, s as (select as_of, c.*, case category when 'management' then 2 when 'restructuring' then 3 when 'strategy' then 2 when 'results' then 1 else 0 end as w from corporate_events c join as_of on filed <= as_of and filed > as_of - 90),
g as (select as_of, ticker, count(*) as n, sum(w) as weight, count(case when category = 'management' then 1 end) as m, count(case when category = 'restructuring' then 1 end) as r from s group by all)
select as_of, ticker, n, weight, concat_ws('; ', case when m >= 3 then 'management turnover' end, case when r >= 2 and m >= 1 then 'restructuring under new management' end, case when weight = 0 then 'routine only' end) as notes from g"""),
    "ic_summary": (ic_table, "with c as (" + pl.QUERIES["strategy_rank_ic"][1] + ") select strategy, round(avg(ic), 9) + 0.0 as mean_ic, round(avg(ic) / nullif(stddev_samp(ic), 0), 9) + 0.0 as ir, round(avg((ic > 0)::int), 9) + 0.0 as hit_rate, round(avg(ic) / nullif(stddev_samp(ic) / sqrt(greatest(count(ic) / 3.0, 1)), 0), 9) + 0.0 as t, count(ic) as n from c group by 1"),
    "inverse_vol_weights": (inverse_vol, pl.SCORES + """, p as (select * from (select *, row_number() over (partition by as_of, strategy order by rank, ticker) as p from scores where rank is not null) where p <= 10),
v as (select p.*, case when w."VOL_1Y" > 0 then 1 / w."VOL_1Y" end as iv from p left join frame w using (as_of, ticker))
select as_of, strategy, ticker, round(case when count(iv) over c >= 2 then coalesce(iv / sum(iv) over c, 0) else 1.0 / count(*) over c end, 6) + 0.0 as weight from v window c as (partition by as_of, strategy)"""),
    "plan_risk": (risk, "with p as (" + pl.QUERIES["trade_plans"][1] + ") select as_of, count(*) as n, round(sum(weight), 6) + 0.0 as invested, round(sum(weight * stop_pct), 6) + 0.0 as at_risk, round(avg(stop_pct), 6) + 0.0 as mean_stop, round(greatest(0, 1 - sum(weight)), 6) + 0.0 as cash from p group by 1"),
    "strategy_relation": (related, pl.SCORES + """, j as (select a.as_of, a.composite as a, b.composite as b from scores a join scores b using (as_of, ticker) where a.strategy = 'momentum_trend' and b.strategy = 'breakout' and a.composite is not null and b.composite is not null),
k as (select as_of, rank() over (partition by as_of order by a) + (count(*) over (partition by as_of, a) - 1) / 2.0 as ra, rank() over (partition by as_of order by b) + (count(*) over (partition by as_of, b) - 1) / 2.0 as rb from j),
c as (select as_of, case when count(*) >= 3 then corr(ra, rb) end as ic, count(*) as n from k group by 1)
select as_of, round(ic, 6) + 0.0 as ic, n, case when ic > 0.7 then 'redundant' when ic > 0.3 then 'related' when ic > -0.1 then 'independent' when ic is not null then 'opposed' end as relation from c"""),
}
