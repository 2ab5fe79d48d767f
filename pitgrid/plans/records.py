"""Queries over membership, positions, macro series, walk-forward curves, votes and trades."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitgrid.operators import asof, evaluation as ev, signals as sg
from pitgrid.plans import panel as pl
from pitgrid.plans import prices as pr
from pitgrid.plans.alternatives import CATEGORIES, MEMBERS, dates, membership  # noqa: F401
from pitgrid.plans.fixtures import ctes, read
from pitgrid.plans.prices import rounded

def reconcile(spark, sf):
    """Agreement of two sources of membership at each date."""
    df = membership(spark, sf)
    side = lambda s: df.where(F.col("source") == s).select("as_of", "ticker", F.lit(1).alias(s))
    both = side("a").join(side("b"), ["as_of", "ticker"], "full")
    agree = F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1))
    only = lambda x, y: F.slice(F.array_sort(F.collect_list(F.when(F.col(y).isNull() & F.col(x).isNotNull(), F.col("ticker")))), 1, 25)
    return rounded(
        both.groupBy("as_of").agg(agree.alias("agree"), (agree / F.count(F.lit(1))).alias("jaccard"), F.array_join(only("a", "b"), ",").alias("only_a"), F.array_join(only("b", "a"), ",").alias("only_b"))
    )


def membership_changes(spark, sf):
    """Snapshots that differ from the one before, with who came and went."""
    snaps = read(spark, sf, "members").groupBy("index_symbol", "source", "as_of").agg(F.array_sort(F.collect_set("ticker")).alias("now"))
    df = snaps.withColumn("before", F.lag("now").over(Window.partitionBy("index_symbol", "source").orderBy("as_of")))
    df = df.where(F.col("before").isNull() | (F.col("now") != F.col("before")))
    none = F.array().cast("array<string>")
    return df.select("index_symbol", "source", "as_of", F.size(F.array_except("now", F.coalesce("before", none))).alias("came"), F.size(F.array_except(F.coalesce("before", none), "now")).alias("went"))


def events_in_index(spark, sf):
    """Events of the last 90 days of names that source a holds at that date."""
    held = membership(spark, sf).where("source = 'a'").select("as_of", "ticker")
    seen = asof.window_join(dates(spark, sf), read(spark, sf, "corporate_events"), "filed", 90)
    return seen.join(held, ["as_of", "ticker"], "left_semi").select("as_of", "ticker", "filed", "accession", "item_code")


def macro(spark, sf):
    """Level and changes over a week and a month of each series, as known at each date."""
    return rounded(asof.snapshot(dates(spark, sf), read(spark, sf, "macro"), {"chg_1w": 7, "chg_1m": 30}))


def _macro_at(days):
    return f"(select arg_max(value, date) from macro m where m.series_id = n.series_id and m.date <= a.as_of - {days})"


def last_date(spark, sf):
    """The last date of the panel."""
    return read(spark, sf, "as_of").agg(F.max("as_of")).first()[0]


def holdings(spark, sf):
    """Lots at the last as-of date as positions: split-adjusted shares, cost, value, gain, tightest stop and nearest target."""
    lots = read(spark, sf, "positions").where("ticker is not null")
    day = F.lit(last_date(spark, sf))
    hit = lots.join(read(spark, sf, "splits").withColumnRenamed("date", "sdate"), "ticker").where((F.col("sdate") > F.col("opened")) & (F.col("sdate") <= day))
    factor = hit.groupBy("lot_id").agg(F.product("ratio").alias("f"))
    lots = lots.join(factor, "lot_id", "left").withColumn("f", F.coalesce("f", F.lit(1.0)))
    df = lots.groupBy("ticker").agg(
        F.sum(F.col("shares") * F.col("f")).alias("shares"), F.sum(F.col("shares") * F.col("cost_basis")).alias("cost"), F.max(F.col("stop") / F.col("f")).alias("stop"),
        F.min(F.col("target") / F.col("f")).alias("target"), F.count(F.lit(1)).alias("lots"),
    )
    df = asof.asof_join(df.withColumn("as_of", day), read(spark, sf, "bars"), ["ticker"], "as_of", "date", ["close"])
    df = df.withColumn("value", F.col("shares") * F.col("close"))
    df = df.withColumns({"gain": F.col("value") / F.col("cost") - 1, "weight": F.col("value") / F.sum("value").over(Window.partitionBy("as_of"))})
    alert = F.concat_ws(",", F.when(F.col("close") <= F.col("stop"), "stop hit"), F.when((F.col("close") > F.col("stop")) & (F.col("close") <= 1.03 * F.col("stop")), "near stop"), F.when(F.col("close") >= F.col("target"), "target hit"))
    return rounded(df.select("ticker", "lots", "shares", "cost", "value", "gain", "weight", "stop", "target", alert.alias("alerts")))


HOLDINGS = ctes("positions", "splits", "bars", "sessions", "as_of") + """,
l as (select p.*, coalesce((select product(ratio) from splits s where s.ticker = p.ticker and s.date > p.opened and s.date <= (select max(as_of) from as_of)), 1) as f from positions p),
h as (select ticker, sum(shares * f) as shares, sum(shares * cost_basis) as cost, max(stop / f) as stop, min(target / f) as target, count(*) as lots from l group by 1),
v as (select h.*, (select arg_max(close, date) from bars b where b.ticker = h.ticker and b.date <= (select max(as_of) from as_of)) as close from h)
select ticker, lots, round(shares, 6) + 0.0 as shares, round(cost, 6) + 0.0 as cost, round(shares * close, 6) + 0.0 as value, round(shares * close / cost - 1, 6) + 0.0 as gain, round(shares * close / sum(shares * close) over (), 6) + 0.0 as weight,
round(stop, 6) + 0.0 as stop, round(target, 6) + 0.0 as target, concat_ws(',', case when close <= stop then 'stop hit' end, case when close > stop and close <= 1.03 * stop then 'near stop' end, case when close >= target then 'target hit' end) as alerts from v"""


def walk(spark, sf):
    """Walk-forward curve of each strategy's ten best, filled one session after the signal."""
    segs = ev.segments(read(spark, sf, "as_of"), 1)
    held = ev.segment_values(ev.holdings(pl.scores(spark, sf), 10), segs, pr.grid(spark, sf))
    return rounded(ev.walk_forward(held, segs))


WALK = pl.SCORES + """,
segs as (select as_of, s + 1 as start, e + 1 as stop_, row_number() over (order by s) as seg from (select as_of, session as s, lead(session) over (order by session) as e from as_of) where e is not null),
top as (select as_of, strategy, ticker, 1.0 / count(*) over (partition by as_of, strategy) as weight from (select *, row_number() over (partition by as_of, strategy order by rank, ticker) as p from scores where rank is not null) where p <= 10),
rel as (select t.*, seg, coalesce(b.close_ff / nullif(a.close_ff, 0), 1) as rel from top t join segs using (as_of) left join grid a on a.ticker = t.ticker and a.session = segs.start left join grid b on b.ticker = t.ticker and b.session = segs.stop_),
dr as (select *, weight * rel / sum(weight * rel) over (partition by strategy, seg) as drifted from rel),
mv as (select coalesce(n.strategy, o.strategy) as strategy, coalesce(n.seg, o.seg) as seg, abs(coalesce(n.weight, 0) - coalesce(o.drifted, 0)) as d
  from (select strategy, seg, ticker, weight from dr) n full join (select strategy, seg + 1 as seg, ticker, drifted from dr) o on n.strategy = o.strategy and n.seg = o.seg and n.ticker = o.ticker),
tn as (select strategy, seg, sum(d) as turnover from mv where seg in (select seg from segs) group by all),
gr as (select strategy, as_of, seg, sum(weight * rel) - 1 as gross from dr group by all),
nt as (select *, (1 + gross) * (1 - 0.001 * turnover) - 1 as net from gr join tn using (strategy, seg))
select strategy, seg, as_of, round(gross, 6) + 0.0 as gross, round(turnover, 6) + 0.0 as turnover, round(net, 6) + 0.0 as net, round(exp(sum(ln(1 + net)) over (partition by strategy order by seg)), 6) + 0.0 as curve from nt"""


def market_metrics(spark, sf):
    """Performance of the market series over a yearly risk-free rate of 3 %."""
    df = read(spark, sf, "market").withColumn("id", F.lit("market"))
    return rounded(ev.metrics(df, ["id"], "close", "date", 0.03))


def sector_metrics(spark, sf):
    """The mean adjusted close of each sector against the market's."""
    px = read(spark, sf, "bars").join(read(spark, sf, "securities").select("ticker", "sector"), "ticker")
    own = px.groupBy("sector", "date").agg(F.avg("adj_close").alias("value"))
    return rounded(ev.relative_metrics(own.join(read(spark, sf, "market").select("date", F.col("adj_close").alias("bench")), "date"), ["sector"], "date"))


def drift(spark, sf):
    """Rankings of the last two dates against each other."""
    order = Window.orderBy(F.desc("as_of"))
    back = read(spark, sf, "as_of").select("as_of", F.row_number().over(order).alias("back")).where("back <= 2")
    df = pl.scores(spark, sf).join(back, "as_of").where("rank <= 20")
    return rounded(ev.compare(df.where("back = 1"), df.where("back = 2"), ["strategy"]))


def crossed(spark, sf):
    return ev.crossover(pl.scores(spark, sf), "momentum_trend", "pullback", 20)


def forward(spark, sf):
    return ev.forward_returns(pr.grid(spark, sf), read(spark, sf, "as_of"), 13)


FWD = """,
fw as (select a.as_of, x.ticker, y.close_ff / nullif(x.close_ff, 0) - 1 as fwd from as_of a join grid x on x.session = a.session join grid y on y.ticker = x.ticker and y.session = a.session + 13)"""


def agreement(spark, sf):
    return rounded(ev.agreement(pl.voted(spark, sf), forward(spark, sf)))


def spread(spark, sf):
    return rounded(ev.agreement_spread(pl.voted(spark, sf), forward(spark, sf)))


def cohort_rows(spark, sf):
    return rounded(ev.cohorts(pl.scores(spark, sf), forward(spark, sf), 10))


def trade_rows(spark, sf):
    """Outcome of every plan on its own: limit orders of pullbacks, market orders of others."""
    df = pl.plan_rows(spark, sf).join(read(spark, sf, "as_of"), "as_of")
    wanted = df.select("ticker", "session", "entry", "stop", "target", (F.col("entry_type") == "pullback").alias("limit_order")).distinct()
    return rounded(ev.trades(wanted, read(spark, sf, "bars").join(read(spark, sf, "sessions"), "date")))


TRADES = pl.PLANS + """,
pd as (select distinct p3.ticker, a.session as sig, entry, stop, entry + 2 * (entry - stop) as target, entry_type = 'pullback' as lim from p3 join as_of a using (as_of)),
br as (select pd.*, s.session, b.open, b.high, b.low, b.close from pd join bars b on b.ticker = pd.ticker join sessions s using (date) where s.session between sig + 1 and sig + 18),
fl as (select ticker, sig, entry, stop, target, lim, min(session) as fs, arg_min(case when lim then least(open, entry) else open end, session) as fp from br where not lim or (low <= entry and session - sig <= 5) group by all),
hd as (select fl.*, br.session, open, high, low, close, case when low <= fl.stop then 'stop' when high >= fl.target and not (br.session = fs and fl.lim) then 'target' end as why,
  case when low <= fl.stop then case when br.session = fs then fl.stop else least(open, fl.stop) end when high >= fl.target and not (br.session = fs and fl.lim) then case when br.session = fs then fl.target else greatest(open, fl.target) end end as px
  from fl join br on br.ticker = fl.ticker and br.sig = fl.sig and br.entry = fl.entry and br.stop = fl.stop and br.lim = fl.lim and br.session between fs and fs + 13 where fp > fl.stop),
ex as (select ticker, sig, entry, stop, lim, fs, fp, coalesce(min(case when why is not null then session end), max(session)) as es, coalesce(arg_min(px, session) filter (where why is not null), arg_max(close, session)) as ep,
  coalesce(arg_min(why, session) filter (where why is not null), 'time') as reason from hd group by all)
select ticker, sig as signal_session, fs as fill_session, round(fp, 6) + 0.0 as fill_price, es as exit_session, round(ep, 6) + 0.0 as exit_price, reason, round(ep / fp - 1 - 0.002, 6) + 0.0 as net_return, round((ep - fp) / (fp - stop), 6) + 0.0 as r_multiple, es - fs as held from ex"""

QUERIES = {
    "members_reconciled": (reconcile, MEMBERS + """, a as (select as_of, ticker from mem where source = 'a'), b as (select as_of, ticker from mem where source = 'b'),
j as (select coalesce(a.as_of, b.as_of) as as_of, a.ticker as x, b.ticker as y from a full join b on a.as_of = b.as_of and a.ticker = b.ticker)
select as_of, count(case when x is not null and y is not null then 1 end) as agree, round(count(case when x is not null and y is not null then 1 end) / count(*), 6) + 0.0 as jaccard,
coalesce(array_to_string(list_sort(list(x) filter (where y is null))[1:25], ','), '') as only_a, coalesce(array_to_string(list_sort(list(y) filter (where x is null))[1:25], ','), '') as only_b from j group by 1"""),
    "membership_changes": (membership_changes, ctes("members") + """, s as (select index_symbol, source, as_of, list_sort(list(distinct ticker)) as now from members group by all), l as (select *, lag(now) over (partition by index_symbol, source order by as_of) as before from s)
select index_symbol, source, as_of, len(list_filter(now, lambda x: not list_contains(coalesce(before, []), x)))::int as came, len(list_filter(coalesce(before, []), lambda x: not list_contains(now, x)))::int as went from l where before is null or now <> before"""),
    "events_in_index": (events_in_index, MEMBERS.replace("with ", ctes("corporate_events") + ", ", 1) + """ select e_.as_of, e_.ticker, filed, accession, item_code from (select as_of, c.* from corporate_events c join as_of on filed <= as_of and filed > as_of - 90) e_ where exists (select 1 from mem m where m.source = 'a' and m.as_of = e_.as_of and m.ticker = e_.ticker)"""),
    "macro_snapshot": (macro, ctes("macro", "as_of") + f" select as_of, series_id, round({_macro_at(0)}, 6) + 0.0 as value, round({_macro_at(0)} - {_macro_at(7)}, 6) + 0.0 as chg_1w, round({_macro_at(0)} - {_macro_at(30)}, 6) + 0.0 as chg_1m from as_of a, (select distinct series_id from macro) n"),
    "holdings": (holdings, HOLDINGS), "walk_forward": (walk, WALK), "trade_outcomes": (trade_rows, TRADES),
    "market_metrics": (market_metrics, ctes("market") + """, y as (select (max(date) - min(date)) / 365.25 as years, count(*) - 1 as n, arg_max(close, date) / arg_min(close, date) - 1 as total from market),
r as (select close / lag(close) over (order by date) - 1 as r, close / max(close) over (order by date) - 1 as dd from market), x as (select r, dd, r - (pow(1.03, years / n) - 1) as e from r, y),
m as (select stddev_samp(r) as sd, avg(e) as mean, sqrt(avg(case when e is not null then pow(least(e, 0), 2) end)) as down, min(dd) as dd, max(r) as best, min(r) as worst, avg(case when r is not null then (r > 0)::int end) as hit from x)
select 'market' as id, round(total, 6) + 0.0 as total_return, round(pow(1 + total, 1 / years) - 1, 6) + 0.0 as cagr, round(sd * sqrt(n / years), 6) + 0.0 as volatility, round(mean / sd * sqrt(n / years), 6) + 0.0 as sharpe, round(mean / down * sqrt(n / years), 6) + 0.0 as sortino,
round(dd, 6) + 0.0 as max_drawdown, round((pow(1 + total, 1 / years) - 1) / abs(dd), 6) + 0.0 as calmar, round(best, 6) + 0.0 as best, round(worst, 6) + 0.0 as worst, round(hit, 6) + 0.0 as hit_rate, round(years, 6) + 0.0 as years from m, y"""),
    "sector_metrics": (sector_metrics, ctes("market", "securities", "bars") + """, v as (select sector, date, avg(b.adj_close) as v from bars b join securities using (ticker) group by all),
p as (select v.*, m.adj_close as m from v join market m using (date)), r as (select sector, date, v, m, v / lag(v) over w - 1 as r, m / lag(m) over w - 1 as b from p window w as (partition by sector order by date)),
g as (select sector, (max(date) - min(date)) / 365.25 as years, count(r) as n, arg_max(v, date) / arg_min(v, date) as gv, arg_max(m, date) / arg_min(m, date) as gm, stddev_samp(r - b) as te, avg(r - b) as d, covar_samp(r, b) / var_samp(b) as beta from r group by 1)
select sector, round(pow(gm, 1 / years) - 1, 6) + 0.0 as benchmark_cagr, round(pow(gv, 1 / years) - pow(gm, 1 / years), 6) + 0.0 as excess_cagr, round(te * sqrt(n / years), 6) + 0.0 as tracking_error, round(d * n / years / (te * sqrt(n / years)), 6) + 0.0 as information_ratio, round(beta, 6) + 0.0 as beta from g"""),
    "rank_drift": (drift, pl.SCORES + """, a as (select * from scores where as_of = (select max(as_of) from as_of) and rank <= 20), b as (select * from scores where as_of = (select max(as_of) from as_of where as_of < (select max(as_of) from as_of)) and rank <= 20)
select coalesce(a.strategy, b.strategy) as strategy, coalesce(a.ticker, b.ticker) as ticker, a.rank as rank_now, b.rank as rank_then, case when b.rank is null then 'entered' when a.rank is null then 'dropped' else 'held' end as status, b.rank - a.rank as rank_change, round(a.composite - b.composite, 6) + 0.0 as score_change from a full join b on a.strategy = b.strategy and a.ticker = b.ticker"""),
    "strategy_crossover": (crossed, pl.SCORES + """, j as (select a.as_of, a.ticker, a.rank as rank_a, b.rank as rank_b, a.percentile as pa, b.percentile as pb from scores a join scores b using (as_of, ticker) where a.strategy = 'momentum_trend' and b.strategy = 'pullback'),
k as (select *, case when (pa >= 0.8 and pb <= 0.2) or (pa <= 0.2 and pb >= 0.8) then 'conflict' when rank_a <= 20 and rank_b <= 20 then 'both' when rank_a <= 20 then 'only_a' when rank_b <= 20 then 'only_b' end as side from j) select as_of, ticker, rank_a, rank_b, side from k where side is not null"""),
    "vote_agreement": (agreement, pl.VOTES + FWD + """, j as (select as_of, greatest(-1, least(4, votes)) as bucket, fwd from vc join fw using (as_of, ticker) where composite is not null), d as (select as_of, bucket, avg(fwd) as m, count(*) as n, avg(case when fwd is not null then (fwd > 0)::int end) as h from j group by all)
select bucket, round(avg(m), 6) + 0.0 as mean_return, sum(n) as names, round(avg(h), 6) + 0.0 as hit, round(median(m), 6) + 0.0 as median_return, count(*) as dates from d group by 1"""),
    "vote_spread": (spread, pl.VOTES + FWD + """, d as (select as_of, avg(case when votes >= 2 then fwd end) - avg(case when votes = 0 then fwd end) as s from vc join fw using (as_of, ticker) where composite is not null group by 1) select round(avg(s), 6) + 0.0 as spread, sum((s > 0)::int) as wins, count(s) as dates from d"""),
    "cohort_returns": (cohort_rows, pl.SCORES + FWD + """ select as_of, strategy, round(avg(case when rank <= 10 then fwd end), 6) + 0.0 as picks, round(avg(fwd), 6) + 0.0 as universe, round(avg(case when rank <= 10 then fwd end) - avg(fwd), 6) + 0.0 as excess, count(case when rank <= 10 then 1 end) as n from scores join fw using (as_of, ticker) group by all"""),
}
