"""Queries over what is stored: runs, panels by version, fingerprints of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgrid.operators import fundamentals as fu
from pitgrid.operators import runs as ru
from pitgrid.operators import versions as ve
from pitgrid.operators.store import shared_folder
from pitgrid.plans import filings, panel as pl
from pitgrid.plans.fixtures import ctes, read
from pitgrid.plans.prices import rounded

ALL = '{"sectors": null}'
SOME = '{"sectors": ["ASIA"]}'


def runs_of(spark, sf, spec: str, sector: str | None = None) -> DataFrame:
    """The screens of two strategies over a universe, with their factor weights."""
    s = pl.scores(spark, sf).where("strategy in ('momentum_trend', 'pullback') and composite is not null").join(read(spark, sf, "securities").select("ticker", "sector"), "ticker")
    s = s if sector is None else s.where(F.col("sector") == sector)
    return s.select("strategy", "as_of", "ticker", "sector", "composite", "coverage", F.col("rank").cast("int").alias("rank"), ru.universe_key(F.lit(spec)).alias("universe"))


def runs_replaced(spark, sf):
    """Runs of two universes, then a rerun of one strategy's later dates over one of them: one version of each is read back."""
    path = shared_folder(spark)
    ru.save(runs_of(spark, sf, ALL).unionByName(runs_of(spark, sf, SOME, "ASIA")), path, "2001-11-01 08:00:00")
    later = read(spark, sf, "as_of").where("year(as_of) >= 2000").select("as_of")
    again = runs_of(spark, sf, ALL).where("strategy = 'pullback'").join(later, "as_of", "left_semi").where("rank > 2").withColumn("composite", F.col("composite") + 1)
    ru.save(again, path, "2001-11-02 08:00:00")
    runs = ru.stored(spark, path)
    sums = runs.groupBy(*ru.KEYS).agg(F.sum("composite").alias("composite"), F.min("rank").alias("best"))
    return rounded(ru.headers(runs).join(sums, list(ru.KEYS)).select("strategy", "as_of", "universe", F.date_format("created_at", "yyyy-MM-dd").alias("made"), "universe_n", "names", "composite", "best"))


RUNS = pl.SCORES + f""",
one as (select s.*, sector from scores s join securities using (ticker) where strategy in ('momentum_trend', 'pullback') and composite is not null),
twice as (select *, substring(sha1('{ALL}'), 1, 16) as universe from one union all select *, substring(sha1('{SOME}'), 1, 16) from one where sector = 'ASIA'),
fin as (select *, strategy = 'pullback' and year(as_of) >= 2000 and universe = substring(sha1('{ALL}'), 1, 16) as again from twice),
had as (select distinct strategy, as_of, universe from fin where again and rank > 2),
left_ as (select f.* from fin f left join had h using (strategy, as_of, universe) where h.strategy is null or rank > 2)
select strategy, as_of, universe, case when bool_or(h.strategy is not null) then '2001-11-02' else '2001-11-01' end as made, count(*)::int as universe_n, count(*) as names,
  round(sum(composite + case when h.strategy is not null then 1 else 0 end), 6) + 0.0 as composite, min(rank)::int as best from left_ left join had h using (strategy, as_of, universe) group by all"""

CONCEPTS = ("revenue", "net_income")


def trailing_panel(facts: DataFrame, cells: DataFrame) -> DataFrame:
    """Trailing sums of the cells asked for, from facts of their names only."""
    own = facts.where(F.col("concept").isin(*CONCEPTS)).join(cells.select("ticker").distinct(), "ticker", "left_semi")
    known = fu.known_at(own, cells.select("as_of").distinct()).join(cells, ["as_of", "ticker"], "left_semi")
    known = fu.single_tag(known)
    t = fu.trailing(fu.flow_periods(known))
    return t.groupBy("as_of", "ticker").agg(*[F.max(F.when(F.col("concept") == c, F.col("ttm"))).alias(c) for c in CONCEPTS])


def restated(facts: DataFrame) -> DataFrame:
    """Facts in which one name in five has other revenue in what it filed in the second half of 2000."""
    hit = (F.substring("ticker", 2, 10).cast("int") % 5 == 1) & (F.col("concept") == "revenue") & F.col("filed").between("2000-07-01", "2000-12-31")
    return facts.withColumn("val", F.when(hit, F.col("val") * 1.1).otherwise(F.col("val")))


def panel_refreshed(spark, sf):
    """A panel of trailing sums, built, then refreshed after a restatement and with one date more: what each refresh built."""
    dates = read(spark, sf, "as_of").select("as_of")
    first = filings.facts(spark, sf)
    now = restated(first)
    path = f"{shared_folder(spark)}/panel"
    newest = dates.agg(F.max("as_of").alias("_z"))
    names = read(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("ticker"))
    for number, (facts, asked) in enumerate(((first, dates.join(newest, F.col("as_of") < F.col("_z")).drop("_z")), (now, dates)), 1):
        cells = names.withColumn("_d", F.lit(1)).join(asked.withColumn("_d", F.lit(1)), "_d").drop("_d")  # the cells of the panel
        own = facts.where(F.col("concept").isin(*CONCEPTS))
        holds = ve.valid_until(cells, facts.where(F.col("concept").isin(*filings.SHARES)), read(spark, sf, "splits"))
        out = ve.refresh(spark, path, ve.cell_versions(cells, {"facts": (own, "filed")}), holds, lambda todo, facts=facts: trailing_panel(facts, todo), number)
    return rounded(out.select(F.col("as_of").cast("date").alias("as_of"), "ticker", "revenue", "net_income", "valid_until", "built_in"), 5)


SHARE = str(filings.SHARES)
REFRESHED = (
    "with original as (select * from (" + filings.FACTS + " select * from facts)),\n"
    + ctes("quarters", "as_of", "splits", "bars", "sessions").replace("with ", "", 1)
    + f""",
changed as (select * replace (case when substring(ticker, 2)::int % 5 = 1 and concept = 'revenue' and filed between '2000-07-01' and '2000-12-31' then val * 1.1 else val end as val) from original),
seen as (select a.as_of, f.* from changed f join as_of a on f.filed <= a.as_of where form in {fu.FORMS} and concept in {CONCEPTS}),
tags as (select as_of, ticker, concept, tag, max(filed) as last, median(abs(val)) as scale from seen group by all),
best as (select as_of, ticker, concept, tag from (select *, max(last) over (partition by as_of, ticker, concept) as newest from tags) where newest - last <= 365
  qualify row_number() over (partition by as_of, ticker, concept order by scale desc, tag desc) = 1),
vers as (select seen.* from seen join best using (as_of, ticker, concept, tag) qualify row_number() over (partition by as_of, ticker, concept, period_start, period_end order by filed desc, val desc) = 1),
spans as (select *, case when period_end - period_start between 60 and 115 then 'Q' when period_end - period_start between 150 and 220 then 'H' when period_end - period_start between 240 and 310 then '9M' when period_end - period_start between 330 and 400 then 'A' end as span from vers),
steps as (select *, lag(period_end) over w as pe, lag(val) over w as pv, lag(filed) over w as pf from spans where span is not null window w as (partition by as_of, ticker, concept, period_start order by period_end)),
qs as (select as_of, ticker, concept, period_end, filed, val from spans where span = 'Q' union all select as_of, ticker, concept, period_end, greatest(filed, pf), val - pv from steps where span in ('H', '9M', 'A') and period_end - pe between 60 and 115),
q1 as (select * from qs qualify row_number() over (partition by as_of, ticker, concept, period_end order by filed desc, val desc) = 1),
q2 as (select as_of, ticker, concept, period_end, case when ago <> 0 and abs(val / ago) > 10 and val * ago < 0 then null else val end as val, row_number() over (partition by as_of, ticker, concept order by period_end desc) as k
  from (select *, lag(val, 4) over (partition by as_of, ticker, concept order by period_end) as ago from q1)),
four as (select as_of, ticker, concept, case when count(*) = 4 then sum(val) end as s from q2 where k <= 4 group by all),
year as (select as_of, ticker, concept, arg_max(val, (period_end, filed)) as annual from spans where span = 'A' group by all),
ttm as (select as_of, ticker, concept, coalesce(s, annual) as v from four full join year using (as_of, ticker, concept)),
cells as (select as_of, concat('S', s_suppkey) as ticker, as_of = max(as_of) over () as added, lag(as_of) over (partition by s_suppkey order by as_of) as before from as_of, supplier),
flips as (select c.as_of, c.ticker, max(f.filed) + 501 as flip from cells c join original f on f.ticker = c.ticker and f.filed <= c.as_of where concept in {SHARE} group by c.as_of, c.ticker, concept
  union all select c.as_of, c.ticker, unnest([s.date, s.date + 401]) from cells c join splits s using (ticker)),
holds as (select as_of, ticker, min(flip) as valid from flips where flip > as_of group by all),
news as (select c.as_of, c.ticker, exists (select 1 from original f where f.ticker = c.ticker and concept in {CONCEPTS} and f.filed <= c.as_of and f.filed > c.before) as fresh,
  exists (select 1 from original f where f.ticker = c.ticker and substring(f.ticker, 2)::int % 5 = 1 and concept = 'revenue' and filed between '2000-07-01' and '2000-12-31' and f.filed <= c.as_of and val <> 0) as other from cells c),
last as (select c.as_of, c.ticker, h.valid from cells c left join holds h on h.ticker = c.ticker and h.as_of = c.before where added)
select c.as_of, c.ticker, round(max(case when concept = 'revenue' then v end), 5) + 0.0 as revenue, round(max(case when concept = 'net_income' then v end), 5) + 0.0 as net_income,
  coalesce(any_value(h.valid), date '9999-12-31') as valid_until, case when bool_or(other) or (bool_or(added) and (bool_or(fresh) or coalesce(any_value(l.valid) <= c.as_of, false))) then 2 else 1 end as built_in
from cells c join news using (as_of, ticker) left join holds h using (as_of, ticker) left join last l using (as_of, ticker) left join ttm using (as_of, ticker) group by c.as_of, c.ticker"""
)


def source_versions(spark, sf):
    """Each source's count and dates, and whether its version is another one after a restatement."""
    sources = lambda facts: {"facts": (facts, "filed"), "events": (read(spark, sf, "corporate_events"), "filed"), "insiders": (read(spark, sf, "insider_txns"), "filed"), "splits": (read(spark, sf, "splits"), "date"), "bars": (read(spark, sf, "bars"), "date")}
    old, new = ve.data_version(sources(filings.facts(spark, sf))), ve.data_version(sources(restated(filings.facts(spark, sf))))
    before = old.select("source", F.col("digest").alias("_d"), F.col("version").alias("_v"))
    return new.join(before, "source").select("source", "n", "first", "last", (F.col("digest") != F.col("_d")).alias("changed"), (F.col("version") != F.col("_v")).alias("stale"))


QUERIES = {
    "runs_replaced": (runs_replaced, RUNS),
    "panel_refreshed": (panel_refreshed, REFRESHED),
    "source_versions": (source_versions, "with original as (select * from (" + filings.FACTS + " select * from facts)),\n" + ctes("bars", "corporate_events", "insider_txns", "splits").replace("with ", "", 1) + """
select *, source = 'facts' as changed, true as stale from (
  select 'facts' as source, count(*) as n, min(filed)::date as first, max(filed)::date as last from original union all select 'events', count(*), min(filed), max(filed) from corporate_events union all select 'insiders', count(*), min(filed), max(filed) from insider_txns
  union all select 'splits', count(*), min(date), max(date) from splits union all select 'bars', count(*), min(date), max(date) from bars)"""),
}
