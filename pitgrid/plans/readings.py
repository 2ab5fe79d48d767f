"""Readings of a name: what insiders did, and what speaks for and against it."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitgrid.operators import asof, desk as dk
from pitgrid.plans import alternatives as al
from pitgrid.plans import press as ps
from pitgrid.plans import prices as pr
from pitgrid.plans import records as rc
from pitgrid.plans.fixtures import ctes, read
from pitgrid.plans.prices import rounded

ITEMS = {"restated": "4.02", "impaired": "2.06", "restructured": "2.05", "acquired": "2.01", "delisting": "3.01"}


def insiders(spark, sf):
    return rounded(dk.insider_reading(al.chosen(spark, sf), "officer"))


READING = al.CHOSEN + """, p as (select *, case when abs(shares) + post_txn_shares > 0 then abs(shares) / (abs(shares) + post_txn_shares) * 100 end as pct, txn_code = 'P' as b, txn_code = 'S' as s from s2),
g as (select as_of, ticker, coalesce(sum(case when b then abs(value) end), 0) as buys, coalesce(sum(case when s then abs(value) end), 0) as sells, count(distinct case when b then insider end) as buyers, count(distinct case when s then insider end) as sellers,
  count(case when s and pct > 20 then 1 end) as large, count(case when s and pct <= 5 then 1 end) as small, count(case when s and pct is not null then 1 end) as rated, count(distinct case when s and contains(lower(role), 'officer') then insider end) as chiefs,
  max(case when s then txn_date end) - min(case when s then txn_date end) as span from p group by all),
n as (select *, concat_ws('; ', case when large > 0 then 'large position reduction' when sellers > 0 and small = rated then 'all sales are small' end, case when sellers >= 2 and chiefs >= 2 and span <= 14 then 'officers sold together' end,
  case when buyers >= 2 and buys > 100000 then 'cluster buying' when buyers = 1 and buys > 500000 then 'one large purchase' end) as note_ from g)
select as_of, ticker, round(buys, 6) + 0.0 as buys, round(sells, 6) + 0.0 as sells, buyers, sellers, large, case when note_ <> '' then note_ when buyers = 0 and sellers > 0 then 'all transactions are sales' else 'no clear pattern' end as notes from n"""


def score(spark, sf):
    """The scorecard of every name at the last date."""
    last = rc.last_date(spark, sf)
    tone = ps.tones(spark, sf).join(read(spark, sf, "wire").select("id", "ticker"), "id").groupBy("ticker").agg(F.round(F.avg("polarity"), 6).alias("tone"))
    news = ps.directions(spark, sf).select("ticker", "raised", "lowered", "withdrawn", "beat", "missed", "upgrade", "downgrade").join(tone, "ticker", "full")
    own = insiders(spark, sf).where(F.col("as_of") == F.lit(last)).select("ticker", "buys", "sells", "buyers", "large")
    dates = al.dates(spark, sf).where(F.col("as_of") == F.lit(last))
    seen = asof.window_join(dates, read(spark, sf, "corporate_events"), "filed", 90)
    events = seen.groupBy("ticker").agg(*[F.count(F.when(F.col("item_code") == c, 1)).alias(k) for k, c in ITEMS.items()])
    px = pr.panel(spark, sf).where(F.col("as_of") == F.lit(last)).select("ticker", F.col("PCT_VS_MA200").alias("above"))
    return dk.scorecard(news, own, events, px)


SCORE = "with nd as (" + ps.QUERIES["news_directions"][1] + "), pt as (" + ps.TONES + "), ir as (" + READING + "), px as (" + pr.QUERIES["price_trailing_factors"][1] + "),\n" + ctes("wire", "corporate_events", "sessions", "as_of").replace("with ", "", 1) + """,
l as (select max(as_of) as d from as_of), tn as (select ticker, round(avg(polarity), 6) as tone from pt join wire using (id) group by 1),
i as (select * from ir, l where as_of = d), e as (select ticker, """ + ", ".join(f"count(case when item_code = '{c}' then 1 end) as {k}" for k, c in ITEMS.items()) + """ from corporate_events, l where filed <= d and filed > d - 90 group by 1), p as (select ticker, "PCT_VS_MA200" as above from px, l where as_of = d),
nm as (select ticker from nd union select ticker from tn union select ticker from i union select ticker from e union select ticker from p),
j as (select nm.ticker, coalesce(raised, 0) as raised, coalesce(lowered, 0) as lowered, coalesce(withdrawn, 0) as withdrawn, coalesce(beat, 0) as beat, coalesce(missed, 0) as missed, coalesce(upgrade, 0) as up, coalesce(downgrade, 0) as down, tone, coalesce(buys, 0) as buys, coalesce(sells, 0) as sells,
  coalesce(buyers, 0) as buyers, coalesce(large, 0) as large, restated, impaired, restructured, acquired, delisting, above from nm left join nd using (ticker) left join tn using (ticker) left join i using (ticker) left join e using (ticker) left join p using (ticker))
select ticker, concat_ws('; ', case when raised > 0 or beat > 0 then 'guidance raised or beaten' end, case when up > down then 'net upgrades' end, case when buys > 2 * sells and buyers >= 2 then 'cluster insider buying' when buys > sells then 'insiders net buyers' end, case when tone > 0.2 then 'positive coverage' end) as supports,
concat_ws('; ', case when lowered > 0 or missed > 0 then 'guidance cut or missed' end, case when withdrawn > 0 then 'guidance withdrawn' end, case when down > up then 'net downgrades' end, case when sells > buys and large > 0 then 'large insider sales' end, case when restated > 0 then 'restatement' end,
  case when impaired > 0 then 'impairment' end, case when delisting > 0 then 'listing problem' end, case when tone < -0.2 then 'negative coverage' end, case when above > 0.15 then 'extended' end) as concerns,
concat_ws('; ', case when up = down and up > 0 then 'analysts disagree' end, case when sells > buys and large = 0 then case when sells > 3 * buys then 'heavy insider selling' else 'insiders net sellers' end end, case when restructured > 0 then 'restructuring' end, case when acquired > 0 then 'acquisition completed' end,
  case when above > 0.10 and above <= 0.15 then 'price elevated' when above < -0.15 then 'deep below average' end) as checks from j"""
QUERIES = {"insider_readings": (insiders, READING), "scorecards": (score, SCORE)}
