"""Queries over events, insiders, attention and membership."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitgrid.operators import alternative as al
from pitgrid.operators import asof
from pitgrid.plans.fixtures import ctes, read
from pitgrid.plans.prices import rounded

CATEGORIES = ("management", "restructuring", "results", "strategy")


def dates(spark, sf):
    return read(spark, sf, "as_of").select("as_of")


def event_factors(spark, sf):
    return al.event_counts(asof.window_join(dates(spark, sf), read(spark, sf, "corporate_events"), "filed", 90), CATEGORIES)


#: Trades to a part: they are dealt by ticker once, and all that follows by ticker and date stays there.
TRADES_A_PART = 100_000


def chosen(spark, sf):
    txns = read(spark, sf, "insider_txns")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), txns.count() // TRADES_A_PART + 1)
    own = al.with_routine(txns.repartition(parts, "ticker"))
    return al.without_savings_plans(asof.window_join(dates(spark, sf), al.discretionary(own.where("not routine")), "filed", 180)).drop("routine")


CHOSEN = ctes("insider_txns", "as_of") + """,
disc as (select * from insider_txns where txn_code in ('P', 'S') and flags not in ('10b5-1', 'plan', 'exercise') and role <> '10% Owner'),
seen as (select as_of, d.* from disc d join as_of on filed <= as_of and filed > as_of - 180),
months as (select distinct ticker, insider, year(txn_date) as y, month(txn_date) as m from insider_txns),
routine as (select a.ticker, a.insider, a.y, a.m from (select distinct ticker, insider, year(txn_date) as y, month(txn_date) as m from seen) a join months b
  on a.ticker = b.ticker and a.insider = b.insider and a.m = b.m and b.y between a.y - 3 and a.y - 1 group by all having count(*) = 3),
s1 as (select * from seen s where not exists (select 1 from routine r where r.ticker = s.ticker and r.insider = s.insider and r.y = year(s.txn_date) and r.m = month(s.txn_date))),
gaps as (select *, txn_date - lag(txn_date) over (partition by as_of, ticker, insider order by txn_date) as gap from s1 where txn_code = 'P'),
plans as (select as_of, ticker, insider from gaps group by all having count(*) >= 3 and max(value) <= 25000 and avg(case when gap is not null then (gap between 75 and 105)::int end) >= 0.5),
s2 as (select * from s1 s where not (txn_code = 'P' and exists (select 1 from plans p where p.as_of = s.as_of and p.ticker = s.ticker and p.insider = s.insider)))"""


def insiders(spark, sf):
    return rounded(al.insider_signal(chosen(spark, sf)))


def lots(spark, sf):
    return rounded(al.merge_lots(read(spark, sf, "insider_txns")).drop("post_txn_shares"))


def attention(spark, sf):
    return rounded(al.attention_z(read(spark, sf, "attention")))


def attention_at(spark, sf, dates_):
    """ATTENTION_Z as of each date, of the counts of the half year that ends the day before."""
    seen = asof.window_join(dates_, read(spark, sf, "attention"), "date", 180, closed_end=False)
    return al.attention_z(seen, ("as_of", "ticker")).drop("n")


def attention_asof(spark, sf):
    return attention_at(spark, sf, dates(spark, sf))


def attention_days(spark, sf):
    """The same as of every day that has counts."""
    days = read(spark, sf, "attention").select(F.col("date").cast("date").alias("as_of")).distinct()
    return rounded(attention_at(spark, sf, days))


def attention_sql(dates_: str) -> str:
    return ctes("attention", "as_of", "sessions") + f""", k as (select a.as_of, t.ticker, t.wiki_views, row_number() over (partition by a.as_of, t.ticker order by t.date desc) as k
  from attention t join ({dates_}) a on t.date::date < a.as_of and t.date::date > a.as_of - 180)
select as_of, ticker, round(case when count(*) >= 60 and stddev_samp(case when k > 14 then wiki_views end) > 0 then (avg(case when k <= 14 then wiki_views end) - avg(case when k > 14 then wiki_views end)) / stddev_samp(case when k > 14 then wiki_views end) end, 6) + 0.0 as "ATTENTION_Z" from k group by all"""


def membership(spark, sf):
    return asof.members_asof(read(spark, sf, "as_of"), read(spark, sf, "members"))


MEMBERS = ctes("members", "as_of") + """,
snap as (select a.as_of, index_symbol, source, max(m.as_of) as snapshot from as_of a join members m on m.as_of <= a.as_of group by all),
mem as (select s.*, m.ticker from snap s join members m on m.index_symbol = s.index_symbol and m.source = s.source and m.as_of = s.snapshot)"""



#: The same as of the panel's dates.
ATTENTION = attention_sql("select as_of from as_of")
QUERIES = {
    "event_factors": (event_factors, ctes("corporate_events", "as_of") + " select as_of, ticker, count(*) as \"EVENT_INTENSITY_90D\", " + ", ".join(f"count(case when category = '{c}' then 1 end) as \"EVENT_{c.upper()}\"" for c in CATEGORIES) + " from corporate_events join as_of on filed <= as_of and filed > as_of - 90 group by all"),
    "insider_factors": (insiders, CHOSEN + """
select as_of, ticker, round((coalesce(sum(case when txn_code = 'P' then abs(value) end), 0) - coalesce(sum(case when txn_code = 'S' then abs(value) * coalesce(greatest(0.15, least(1.0, (abs(shares) / nullif(abs(shares) + post_txn_shares, 0) - 0.05) / 0.15)), 1) end), 0))
 / nullif(sum(abs(value)), 0), 6) + 0.0 as "INSIDER_NET_BUY", count(distinct case when txn_code = 'P' and abs(value) >= 10000 then insider end) as "INSIDER_CLUSTER" from s2 group by all"""),
    "insider_lots": (lots, ctes("insider_txns") + """ select accession, ticker, insider, txn_date, txn_code, sum(shares) as shares, round(sum(value), 6) + 0.0 as value, max(flags) as flags, count(*) as lots, round(sum(value) / nullif(abs(sum(shares)), 0), 6) + 0.0 as price from insider_txns group by all"""),
    "attention_z": (attention, ctes("attention") + """, k as (select *, row_number() over (partition by ticker order by date desc) as k from attention)
select ticker, round(case when count(*) >= 60 and stddev_samp(case when k > 14 then wiki_views end) > 0 then (avg(case when k <= 14 then wiki_views end) - avg(case when k > 14 then wiki_views end)) / stddev_samp(case when k > 14 then wiki_views end) end, 6) + 0.0 as "ATTENTION_Z", count(*) as n from k group by 1"""),
    "members_asof": (lambda s, d: membership(s, d).select("as_of", "index_symbol", "source", "snapshot", "ticker"), MEMBERS + " select as_of, index_symbol, source, snapshot, ticker from mem"),
    "attention_asof": (attention_days, attention_sql("select distinct date::date as as_of from attention")),
}
