"""Queries of a desk: identities, stored runs, positions, picks, calendars, findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitgrid.functions import scalars as sc
from pitgrid.operators import audit, brief, desk as dk, evaluation as ev, holds as ho, identity as idn
from pitgrid.plans import alternatives as al
from pitgrid.plans import briefs, filings, panel as pl, prices as pr, records as rc
from pitgrid.operators import fundamentals as fu
from pitgrid.plans.fixtures import ctes, read
from pitgrid.plans.prices import rounded

LAST = "(select max(as_of) from as_of)"
#: Renames in chains and in rings, of the given names.
RENAMES = "select concat('S', s_suppkey) as old, concat('S', s_suppkey + 1) as new from supplier where s_suppkey % 10 in (3, 4) union all select concat('S', s_suppkey), concat('S', s_suppkey + 1) from supplier where s_suppkey % 10 = 7 union all select concat('S', s_suppkey), concat('S', s_suppkey - 1) from supplier where s_suppkey % 10 = 8"


def symbols(spark, sf):
    supplier = read(spark, sf, "supplier")
    names = supplier.select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("ticker"))
    return idn.current_symbols(names, spark.sql(RENAMES.replace("from supplier", "from {supplier}"), supplier=supplier))


def sector_names(spark, sf):
    """Sectors of other vocabularies and of industry codes."""
    kinds = sorted(idn.SECTOR_ALIASES) + ["Basket Weaving", ""]
    s = read(spark, sf, "supplier").withColumn("raw", F.get(F.array(*[F.lit(f" {k.title()} ") for k in kinds]), (F.col("s_suppkey") % len(kinds)).cast("int")))
    code = (100 + (F.col("s_suppkey") * 37) % 8900).cast("string")
    return s.select("s_suppkey", idn.sector_name(F.col("raw")).alias("by_name"), idn.sector_of_code(code).alias("by_code"))


def _sector_sql() -> str:
    kinds = sorted(idn.SECTOR_ALIASES) + ["Basket Weaving", ""]
    by_name = " ".join(f"when {i} then '{idn.SECTOR_ALIASES.get(k, 'Unknown')}'" for i, k in enumerate(kinds))
    ranges = ", ".join(f"({i}, {a}, {b}, '{s}')" for i, (a, b, s) in enumerate(idn.CODE_RANGES))
    digits = ", ".join(f"({d}, '{s}')" for d, s in idn.BY_TWO_DIGITS.items())
    return f"""with rg(o, a, b, sector) as (values {ranges}), dg(d, sector) as (values {digits}), s as (select s_suppkey, 100 + (s_suppkey * 37) % 8900 as code from supplier)
select s_suppkey, case s_suppkey % {len(kinds)} {by_name} end as by_name, case when code in {idn.REAL_ESTATE_CODES} then 'Real Estate'
else coalesce((select arg_min(sector, o) from rg where code between a and b), (select sector from dg where d = code // 100), 'Unknown') end as by_code from s"""


def lineage(spark, sf):
    """Facts of a ticker over the ids under which it filed."""
    filer = F.concat(F.when((F.col("l_suppkey") % 5 == 0) & (F.col("period_start") < F.lit("1998-01-01").cast("date")), F.lit("D")).otherwise(F.lit("C")), F.col("l_suppkey"))
    facts = read(spark, sf, "quarters").select(filer.alias("filer"), "period_start", "revenue")
    key = F.col("s_suppkey")
    ids = read(spark, sf, "supplier").select(F.concat(F.lit("S"), key).alias("ticker"), F.explode(F.array(F.concat(F.lit("C"), key), F.concat(F.lit("D"), key))).alias("filer"))
    return rounded(idn.pooled(facts, ids).groupBy("ticker").agg(F.count_distinct("filer").alias("filers"), F.count(F.lit(1)).alias("facts"), F.min("period_start").alias("first"), F.sum("revenue").alias("revenue")), 4)


def runs(spark, sf) -> DataFrame:
    return pl.scores(spark, sf).where("composite is not null").groupBy("strategy", "as_of").agg(F.count(F.lit(1)).alias("names"))


def newest_runs(spark, sf):
    """The newest run of each strategy forty days after each date."""
    days = read(spark, sf, "as_of").select(F.date_add("as_of", 40).alias("as_of"))
    return dk.latest_runs(runs(spark, sf), days)


def held_names(spark, sf) -> DataFrame:
    return read(spark, sf, "positions").select("ticker")


def strategy_view(spark, sf):
    df = pl.scores(spark, sf).where("composite is not null").select("strategy", "as_of", "ticker", "rank", "percentile")
    return rounded(dk.latest_view(df, held_names(spark, sf)))


def detail(spark, sf):
    return rounded(dk.factor_detail(pr.scored(spark, sf), 3))


def portfolio_totals(spark, sf):
    return rounded(dk.totals(rc.holdings(spark, sf)), 4)


def ranks(spark, sf) -> DataFrame:
    """Rank and kind of signal of every strategy at its newest date."""
    s = pl.signal_rows(spark, sf).select("as_of", "strategy", "ticker", sc.signal_bucket(F.col("signal")).alias("bucket"), "signal")
    df = pl.scores(spark, sf).where("composite is not null").join(s, ["as_of", "strategy", "ticker"])
    return df.withColumn("_l", F.max("as_of").over(Window.partitionBy("strategy"))).where("as_of = _l").select("as_of", "strategy", "ticker", "rank", "bucket", "signal")


SIGNAL_ROWS = f"sr as ({pl.QUERIES['signals'][1]})"
BUCKET = "case when contains(lower(signal), 'buy') or contains(lower(signal), 'enter') then 'Buy' when contains(lower(signal), 'sell') or contains(lower(signal), 'trim') or contains(lower(signal), 'avoid') then 'Sell' when contains(lower(signal), 'hold') or contains(lower(signal), 'add') or contains(lower(signal), 'watch') then 'Hold' else 'Neutral' end"
RANKS = pl.SCORES + ",\n" + SIGNAL_ROWS + f""",
rk as (select * from (select s.as_of, s.strategy, s.ticker, s.rank, {BUCKET} as bucket, signal, max(s.as_of) over (partition by s.strategy) as l from scores s join sr using (as_of, strategy, ticker) where s.composite is not null) where as_of = l)"""


def signal_counts(spark, sf):
    """How many names each strategy rates how, on every date."""
    return ho.signal_counts(pl.signal_rows(spark, sf)).drop("share")


def watched(spark, sf):
    """Names held, and those with large orders, as every strategy ranks them."""
    names = held_names(spark, sf).where("ticker like '%1'").union(read(spark, sf, "securities").where("sector = 'ASIA'").select("ticker"))
    return dk.watch_summary(ranks(spark, sf), names)


def next_reports(spark, sf) -> DataFrame:
    results = read(spark, sf, "corporate_events").where("category = 'results'").select("ticker", "filed").distinct()
    return brief.next_report(results, F.lit(rc.last_date(spark, sf)))


def due(spark, sf):
    """Reports of the next fortnight: a calendar's for some names, estimates for the rest."""
    day = F.lit(rc.last_date(spark, sf))
    calendar = read(spark, sf, "supplier").where("s_suppkey % 4 = 1").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("ticker"), F.date_add(day, (F.col("s_suppkey") % 40).cast("int")).alias("report_date"))
    return dk.upcoming(calendar, next_reports(spark, sf), day, 14)


NEXT = briefs.QUERIES["next_reports"][1]
DUE = ctes("sessions", "as_of", "supplier") + f""", nx as ({NEXT}), cf as (select concat('S', s_suppkey) as ticker, ({LAST} + (s_suppkey % 40)::int)::date as report_date from supplier where s_suppkey % 4 = 1),
su as (select * from cf where report_date - {LAST} between 0 and 14),
du as (select ticker, report_date, true as confirmed, report_date - {LAST} as days_until from su union all select ticker, expected::date, false, expected::date - {LAST} from nx where expected::date - {LAST} between 0 and 14 and ticker not in (select ticker from su))"""


def alert_rows(spark, sf):
    """Alerts of the positions at the last date."""
    day = rc.last_date(spark, sf)
    bars = read(spark, sf, "bars").where(F.col("date") <= F.lit(day))
    w = Window.partitionBy("ticker").orderBy("date")
    last = F.max("date").over(Window.partitionBy("ticker"))
    spread = F.avg(F.col("high") - F.col("low")).over(w.rowsBetween(-13, 0)) / F.col("close")
    end = bars.withColumns({"move": F.col("close") / F.lag("close").over(w) - 1, "spread": spread, "_l": last}).where("date = _l")
    held = rc.holdings(spark, sf).select("ticker", "stop", "target").join(end.select("ticker", F.col("close").alias("last"), "low", "high"), "ticker", "left")
    r = ranks(spark, sf)
    kinds = r.where(F.col("strategy") != pl.VETO).groupBy("ticker").agg(F.count(F.when(F.col("bucket") == "Buy", 1)).alias("buys"), F.count(F.when(F.col("bucket") == "Sell", 1)).alias("sells"))
    flagged = r.where((F.col("strategy") == pl.VETO) & F.col("signal").contains("Avoid")).select("ticker", F.lit(True).alias("avoided"))
    return dk.alerts(held, end.select("ticker", "move", "spread"), due(spark, sf), kinds.join(flagged, "ticker", "full"))


ALERTS = RANKS + f""", hd as ({rc.QUERIES["holdings"][1]}), du0 as ({DUE} select ticker, days_until from du),
bm as (select ticker, date, close, low, high, close / lag(close) over w - 1 as move, avg(high - low) over (partition by ticker order by date rows 13 preceding) / close as spread from bars where date <= {LAST} window w as (partition by ticker order by date)),
be as (select * from bm qualify row_number() over (partition by ticker order by date desc) = 1),
vw as (select ticker, count(case when strategy <> '{pl.VETO}' and bucket = 'Buy' then 1 end) as buys, count(case when strategy <> '{pl.VETO}' and bucket = 'Sell' then 1 end) as sells, coalesce(bool_or(strategy = '{pl.VETO}' and contains(signal, 'Avoid')), false) as avoided from rk group by 1),
aj as (select hd.ticker, stop, target, close as last, low, high, move, greatest(0.05, coalesce(2.5 * spread, 0.05)) as lim, days_until, buys, sells, avoided from hd left join be using (ticker) left join du0 using (ticker) left join vw using (ticker))
select ticker, 'risk' as level, 'stop hit' as kind from aj where last <= stop or low <= stop union all select ticker, 'watch', 'near stop' from aj where not (last <= stop or coalesce(low <= stop, false)) and last / stop - 1 <= 0.03
union all select ticker, 'info', 'target reached' from aj where last >= target or high >= target union all select ticker, 'watch', 'large move' from aj where abs(move) >= lim
union all select ticker, 'watch', 'report due' from aj where days_until between 0 and 7 union all select ticker, 'watch', 'strategies negative' from aj where sells > buys and sells >= 2 union all select ticker, 'watch', 'on avoid list' from aj where avoided"""


def picks(spark, sf):
    own = pl.scores(spark, sf).where(F.col("composite").isNotNull() & (F.col("strategy") != pl.VETO)).select("as_of", "strategy", "ticker", "rank")
    return dk.current_picks(pl.voted(spark, sf), own)


def moved(spark, sf):
    return dk.movers(rc.drift(spark, sf), 5)


def traded(spark, sf):
    top = ev.holdings(pl.scores(spark, sf), 10)
    return dk.orders_of(top, read(spark, sf, "as_of"))


def ever_listed(spark, sf):
    """Names of any snapshot in force at any date."""
    return ho.ever_held(al.membership(spark, sf))


def yearly_turnover(spark, sf):
    return rounded(dk.annual_turnover(rc.walk(spark, sf), 4))


def benchmark(spark, sf):
    return rounded(dk.rebased(read(spark, sf, "market"), "adj_close", "date"))


def curve(spark, sf):
    """Value of every strategy at every session."""
    segs = ev.segments(read(spark, sf, "as_of"), 1)
    held = ev.holdings(pl.scores(spark, sf), 10)
    return rounded(dk.daily_curve(held, rc.walk(spark, sf), segs, pr.grid(spark, sf)))


CURVE = pl.SCORES + f""", wk as ({rc.QUERIES["walk_forward"][1]}), sg as (select as_of, s + 1 as a, e + 1 as b from (select as_of, session as s, lead(session) over (order by session) as e from as_of) where e is not null),
tp as (select as_of, strategy, ticker, 1.0 / count(*) over (partition by as_of, strategy) as weight from (select *, row_number() over (partition by as_of, strategy order by rank, ticker) as p from scores where rank is not null) where p <= 10),
vl as (select tp.as_of, strategy, g.session, sum(weight * coalesce(g2.close_ff / nullif(g1.close_ff, 0), 1)) as v from tp join sg using (as_of) join (select distinct session from sessions) g on g.session between a and b
  left join grid g1 on g1.ticker = tp.ticker and g1.session = a left join grid g2 on g2.ticker = tp.ticker and g2.session = g.session group by all),
bf as (select *, coalesce(lag(curve) over (partition by strategy order by seg), 1) as c from wk)
select strategy, session, round(c * (1 - 0.001 * turnover) * v, 6) + 0.0 as value from vl join bf using (strategy, as_of) qualify row_number() over (partition by strategy, session order by seg desc) = 1"""


def flags(spark, sf):
    """Regimes at every date; series of order values stand for curve, credit and fear."""
    px = read(spark, sf, "market").join(read(spark, sf, "sessions"), "date").withColumns({
        "n": F.count("adj_close").over(Window.orderBy("session").rowsBetween(-199, 0)), "ma": F.avg("adj_close").over(Window.orderBy("session").rowsBetween(-199, 0))
    })
    trend = px.where("n = 200").join(read(spark, sf, "as_of"), "session").select("as_of", (F.col("adj_close") / F.col("ma") - 1).alias("trend"))
    snap = rc.macro(spark, sf)
    one = lambda s, c: F.max(F.when(F.col("series_id") == s, F.col(c)))
    levels = snap.groupBy("as_of").agg(
        ((one("1-URGENT", "value") - 140) / 10).alias("curve"), (one("1-URGENT", "chg_1m") / 10).alias("curve_1m"), (one("2-HIGH", "value") / 25).alias("credit"), (one("2-HIGH", "chg_1m") / 25).alias("credit_1m"),
        (one("3-MEDIUM", "value") / 6).alias("fear"),
    )
    return dk.regime(trend, levels)


FLAGS = ctes("market", "sessions", "as_of") + f""", mc as ({rc.QUERIES["macro_snapshot"][1]}),
tr as (select a.as_of, case when count(*) over w = 200 then m.adj_close / avg(m.adj_close) over w - 1 end as trend from market m join sessions s using (date) left join as_of a on a.session = s.session window w as (order by s.session rows 199 preceding)),
lv as (select as_of, (max(case when series_id = '1-URGENT' then value end) - 140) / 10 as curve, max(case when series_id = '1-URGENT' then chg_1m end) / 10 as c1, max(case when series_id = '2-HIGH' then value end) / 25 as credit, max(case when series_id = '2-HIGH' then chg_1m end) / 25 as k1,
  max(case when series_id = '3-MEDIUM' then value end) / 6 as fear from mc group by 1), x as (select lv.*, trend from lv left join (select * from tr where as_of is not null) t using (as_of)),
f as (select as_of, 'trend' as topic, case when trend >= 0 then 'ok' when trend < 0 then 'risk' end as level from x union all select as_of, 'curve', case when curve < 0 then 'inverted' when c1 > 0.4 and curve < 0.75 then 'steepening' end from x
  union all select as_of, 'credit', case when credit >= 6 then 'risk' when k1 >= 0.5 then 'watch' when credit is not null then 'ok' end from x union all select as_of, 'fear', case when fear >= 30 then 'risk' when fear >= 20 then 'watch' when fear is not null then 'ok' end from x)
select * from f where level is not null"""


def share_filings(spark, sf) -> DataFrame:
    return filings.known(spark, sf).where(F.col("concept").isin(*filings.SHARES)).groupBy("as_of", "ticker", "concept").agg(F.max("filed").alias("filed"))


def validity(spark, sf):
    return dk.valid_until(share_filings(spark, sf), read(spark, sf, "splits"))


SHARE_FILINGS = filings.KNOWN + f", sh as (select as_of, ticker, concept, max(filed) as filed from known where concept in {filings.SHARES} group by all)"


def stale_shares(spark, sf):
    """Names at each date whose newest share count is over 500 days old."""
    return ho.stale(share_filings(spark, sf))


def share_gaps(spark, sf):
    """Names with any fact by a date, but no share count of the 500 days before."""
    return ho.lacking_fresh(filings.known(spark, sf), share_filings(spark, sf))


def cap_checks(spark, sf):
    """Values computed from shares against a provider's, where both are there: how far apart, and whether the share count stands."""
    w = ho.value_agreement(filings.wide(spark, sf), F.col("shares") * F.col("close"), F.col("snap_cap"))
    return rounded(w.select("as_of", "ticker", "ratio", "apart", "stands"))


CAP_CHECKS = filings.WIDE + ", ck as (select as_of, ticker, shares * px / snap_cap as ratio from w where snap_cap > 0)"


def all_findings(spark, sf):
    """Every check at once, the gravest first."""
    frame = pl.frame(spark, sf)
    one = lambda df, check, severity: df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), "count")
    raw = fu.ratios(filings.wide(spark, sf), fu.raw_div)
    endless = raw.select(F.explode(F.array(*[F.col(c).cast("double") for c in raw.columns[2:]])).alias("v")).where(F.abs("v") == float("inf"))
    bad = audit.out_of_bounds(frame.select("as_of", "ticker", *[F.col(f).cast("double").alias(f) for f in audit.BOUNDS]).unpivot(["as_of", "ticker"], list(audit.BOUNDS), "factor", "value"))
    thin = pl.available(spark, sf).where("coverage < 0.5").select("as_of", "factor").distinct()
    early = filings.facts(spark, sf).where("filed < period_end")
    parts = [
        one(endless, "infinite values", "error"), bad.select(F.concat("factor", F.lit(" out of range")).alias("check"), F.lit("error").alias("severity"), F.col("bad").alias("count")), one(thin, "thin factor coverage", "warning"),
        one(early, "filed before period end", "error"), one(stale_shares(spark, sf), "stale share counts", "warning"), one(cap_checks(spark, sf).where("apart"), "market cap disagreement", "error"),
        one(cap_checks(spark, sf).where("not apart"), "market cap agreement", "info"),
    ]
    return dk.findings(parts)


def _findings_sql() -> str:
    bad = " union all ".join(f"""select '{f} out of range' as "check", 'error' as severity, count(*) as count from frame where "{f}" is not null and ("{f}" < {a!r} or "{f}" > {b!r})""" for f, (a, b) in audit.BOUNDS.items())
    return "with " + pl.FRAME + f""", ad as ({pl.QUERIES["factor_availability"][1]}), st as ({QUERIES["stale_shares"][1]}), ck0 as ({QUERIES["cap_checks"][1]}), fc as ({filings.FACTS} select * from facts),
a as ({bad} union all select 'thin factor coverage', 'warning', count(*) from (select distinct as_of, factor from ad where coverage < 0.5) union all select 'filed before period end', 'error', count(*) from fc where filed < period_end
union all select 'stale share counts', 'warning', count(*) from st union all select 'market cap disagreement', 'error', count(*) from ck0 where apart union all select 'market cap agreement', 'info', count(*) from ck0 where not apart)
select *, row_number() over (order by case severity when 'error' then 0 when 'warning' then 1 else 2 end, count desc, "check") as place from a where count > 0"""


#: Where factors come from.
SOURCES = {
    **{f: "bars" for f in (*pr.TRAILING_COLUMNS, *pr.PATH_COLUMNS)}, **{f: "facts" for f in (*filings.RATIOS, "PIOTROSKI_F")}, "INSIDER_NET_BUY": "insiders", "INSIDER_CLUSTER": "insiders",
    **{f"EVENT_{c.upper()}": "events" for c in al.CATEGORIES}, "EARNINGS_REACTION": "events", "LLM_EARNINGS_VIEW": "reviews",
}


def firsts(spark, sf) -> DataFrame:
    parts = [("bars", "bars", "date"), ("facts", "quarters", "period_start"), ("insiders", "insider_txns", "filed"), ("events", "corporate_events", "filed"), ("reviews", "reviews", "filed")]
    out = None
    for name, table, column in parts:
        part = read(spark, sf, table).agg(F.min(column).alias("first")).select(F.lit(name).alias("source"), "first")
        out = part if out is None else out.unionByName(part)
    return out


def windows(spark, sf):
    sources = spark.createDataFrame([(f, s) for f, s in SOURCES.items()], "factor string, source string")
    return dk.source_windows(pl.plain_weights(spark), sources, firsts(spark, sf), "1996-01-01")


def families_open(spark, sf):
    """Families of which every strategy has a window that is open by each date."""
    fam = spark.createDataFrame([(s, f) for f, m in pl.FAMILIES.items() for s in m], "strategy string, family string")
    starts = windows(spark, sf).join(fam, "strategy").groupBy("family").agg(F.max("start").alias("start"), F.max(F.length("blockers")).alias("blocked"))
    rows = read(spark, sf, "as_of").select("as_of", F.explode(F.array(*map(F.lit, sorted(pl.FAMILIES)))).alias("family")).join(starts, "family")
    return rows.where("blocked = 0 and start <= as_of").groupBy("as_of").agg(F.count(F.lit(1)).alias("families"))


WINDOWS = ctes("bars", "quarters", "insider_txns", "corporate_events", "reviews", "sessions", "as_of") + f""",
weights(strategy, factor) as (values {", ".join(f"('{s}', '{f}')" for s, f, _ in pl.CELLS)}), src(factor, source) as (values {", ".join(f"('{f}', '{s}')" for f, s in SOURCES.items())}),
fi as (select 'bars' as source, min(date) as first from bars union all select 'facts', min(period_start) from quarters union all select 'insiders', min(filed) from insider_txns union all select 'events', min(filed) from corporate_events union all select 'reviews', min(filed) from reviews),
wi as (select strategy, greatest(max(first), date '1996-01-01') as start, arg_max(source, (first, source)) as last_source, coalesce(array_to_string(list_sort(list(distinct factor) filter (where first is null)), ','), '') as blockers from weights left join src using (factor) left join fi using (source) group by 1)"""


def riskless(spark, sf):
    """Mean of a rate series over each year, in hundredths; a fallback where it has fewer than five values."""
    rates = read(spark, sf, "macro").where("series_id = '5-LOW'").withColumn("year", F.year("date"))
    return rounded(ho.riskless(rates, ["year"], scale=5000.0))


def snapshots(spark, sf):
    return ho.snapshot_coverage(read(spark, sf, "members"))


def consistency(spark, sf):
    """Rows that repeat a key, per table."""
    news = read(spark, sf, "news").withColumn("key", sc.article_id(F.col("ticker"), F.col("title")))
    return ho.repeats({"news": (news, ("key",)), "events": (read(spark, sf, "corporate_events"), ("ticker", "filed", "item_code")), "trades": (read(spark, sf, "insider_txns"), ("accession", "ticker", "txn_date", "txn_code"))})


def unamended(spark, sf):
    """Events without those of filings that were amended later."""
    amended = read(spark, sf, "orders").where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("accession"))
    return ho.without_amended(read(spark, sf, "corporate_events"), amended).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def digest_events(spark, sf):
    """Events of the last thirty days that aren't routine, with names and sectors."""
    e = ho.digest_events(read(spark, sf, "corporate_events"), read(spark, sf, "securities"), F.lit(rc.last_date(spark, sf)))
    return e.select("ticker", "name", "sector", "filed", "item_code", "category")


def theme_names(spark, sf):
    """For each theme's sector at most forty names, in order."""
    themes = spark.createDataFrame([("trade", "ASIA"), ("trade", "EUROPE"), ("energy", "MIDDLE EAST"), ("aid", "AFRICA"), ("aid", "NOWHERE")], "theme string, sector string")
    w = Window.partitionBy("theme", "sector").orderBy("ticker")
    rows = themes.join(read(spark, sf, "securities"), "sector").withColumn("r", F.row_number().over(w)).where("r <= 40")
    return rows.groupBy("theme").agg(F.array_join(F.array_sort(F.collect_set("ticker")), ",").alias("tickers"))


def estimates_near(spark, sf):
    """For each results filing the newest estimate from four days before to two days after it."""
    e = read(spark, sf, "corporate_events").where("item_code = '2.02'").select("ticker", "filed", "accession")
    made = e.select("ticker", F.date_add("filed", (F.col("accession") % 9 - 5).cast("int")).alias("day"), (F.col("accession") % 100 / 10).alias("eps"))
    return rounded(ho.estimates_near(e, made))


def acquirers(spark, sf):
    """Names with an acquisition filed in the year before each date."""
    return ho.inorganic(al.dates(spark, sf), read(spark, sf, "corporate_events").where("item_code = '1.01' and accession % 8 = 0"))


def unscored(spark, sf):
    """Why a trade takes no part in the insider signal."""
    why = ho.why_unscored(F.col("txn_code"), F.col("flags"), F.col("role"))
    return read(spark, sf, "insider_txns").groupBy(why.alias("why")).agg(F.count(F.lit(1)).alias("n"))


def specs(spark, sf):
    """Weights of strategies as JSON, and read back."""
    used = pl.long_used(spark, sf).where("value is not null").groupBy("factor").agg(F.count(F.lit(1)).alias("values"))
    back, _ = ho.unpacked(ho.packed(pl.plain_weights(spark)), pl.plain_weights(spark))
    return rounded(back.join(used, "factor").groupBy("strategy").agg(F.count(F.lit(1)).alias("factors"), F.sum("weight").alias("weight"), F.sum("values").alias("values")))


def completed(spark, sf):
    """For each hour with events, the newest session that is complete in New York."""
    hours = read(spark, sf, "events").select(F.date_trunc("hour", "ts").alias("at")).distinct()
    local = F.from_utc_timestamp("at", "America/New_York")
    before = F.date_sub(F.to_date(local), F.when(F.dayofweek(local) == 2, 3).when(F.dayofweek(local) == 1, 2).otherwise(1))
    return hours.select("at", sc.last_completed(local, F.dayofweek(local).between(2, 6), before).alias("session"))


QUERIES = {
    "current_symbols": (symbols, f"""with recursive rn as ({RENAMES}), wk as (select concat('S', s_suppkey) as ticker, concat('S', s_suppkey) as now, []::varchar[] as seen from supplier
union all select ticker, new, list_append(seen, now) from wk join rn on old = now and not list_contains(seen, now))
select ticker, arg_max(now, len(seen)) as current from wk group by 1"""),
    "sector_names": (sector_names, _sector_sql()),
    "filer_lineage": (lineage, ctes("quarters") + " select concat('S', l_suppkey) as ticker, count(distinct (l_suppkey % 5 = 0 and period_start < date '1998-01-01')) as filers, count(*) as facts, min(period_start) as first, round(sum(revenue), 4) + 0.0 as revenue from quarters group by 1"),
    "latest_runs": (newest_runs, pl.SCORES + """, rn as (select strategy, as_of as run, count(*) as names from scores where composite is not null group by all)
select d.day, strategy, run, names, d.day - run as age from (select as_of + 40 as day from as_of) d join rn on run <= d.day and run > d.day - 400 qualify row_number() over (partition by d.day, strategy order by run desc) = 1"""),
    "strategy_view": (strategy_view, pl.SCORES + ", " + ctes("positions").replace("with ", "", 1) + """, v as (select strategy, as_of, ticker, rank, round(percentile, 6) + 0.0 as percentile, max(as_of) over (partition by strategy) as l from scores where composite is not null)
select strategy, as_of, ticker, rank, percentile from v where as_of = l and ticker in (select ticker from positions)"""),
    "factor_detail": (detail, pr.LONG + pr.SCORED + """, d as (select *, max(as_of) over (partition by factor) as l from scored)
select ticker, place, factor, round(score, 6) + 0.0 as score from (select *, row_number() over (partition by ticker order by round(abs(score), 9) desc, factor) as place from d where as_of = l and score is not null) where place <= 3"""),
    "portfolio_totals": (portfolio_totals, f"with h as ({rc.QUERIES['holdings'][1]}) select round(sum(case when value is not null then value end), 4) + 0.0 as market_value, round(sum(case when value is not null then cost end), 4) + 0.0 as cost, round(sum(case when value is not null then value - cost end), 4) + 0.0 as pnl, round(sum(case when value is not null then value end) / sum(case when value is not null then cost end) - 1, 4) + 0.0 as pnl_pct, count(*) as positions, count(case when value is null then 1 end) as unpriced from h"),
    "signal_counts": (signal_counts, f"with {SIGNAL_ROWS} select as_of, strategy, {BUCKET} as bucket, count(*) as n from sr group by all"),
    "watch_summary": (watched, RANKS + ", " + ctes("positions").replace("with ", "", 1) + """, nm as (select ticker from positions where ticker like '%1' union select ticker from securities where sector = 'ASIA')
select ticker, min(rank) as best_rank, arg_min(strategy, (rank, strategy)) as best_strategy, count(case when rank <= 20 then 1 end) as n_top, """ + "concat_ws(' · ', " + ", ".join(f"case when count(case when bucket = '{k}' then 1 end) > 0 then '{k} ' || count(case when bucket = '{k}' then 1 end) end" for k in ("Buy", "Hold", "Neutral", "Sell")) + ") as votes from rk where ticker in (select ticker from nm) group by 1"),
    "upcoming_reports": (due, DUE + " select ticker, report_date, confirmed, days_until from du"),
    "portfolio_alerts": (alert_rows, ALERTS),
    "current_picks": (picks, pl.VOTES + f""", bv as (select as_of, ticker, 'votes' as "by", votes::bigint as n, composite as s from vc where votes >= 2 and composite is not null),
ls as (select as_of, ticker, 'lists' as "by", count(distinct strategy) as n, round(-avg(rank), 9) as s from scores where composite is not null and strategy <> '{pl.VETO}' and rank <= 20 and as_of not in (select as_of from bv) group by all having count(distinct strategy) >= 2)
select * from (select as_of, ticker, "by", n, row_number() over (partition by as_of order by n desc, s desc, ticker) as place from (select * from bv union all select * from ls)) where place <= 25"""),
    "rank_movers": (moved, f"with d as ({rc.QUERIES['rank_drift'][1]})" + """, m as (select *, row_number() over (partition by strategy order by rank_change desc, ticker) as u, row_number() over (partition by strategy order by rank_change, ticker) as w from d where rank_change is not null and rank_change <> 0)
select strategy, ticker, case when rank_change > 0 then 'riser' else 'faller' end as side, rank_change from m where (rank_change > 0 and u <= 5) or (rank_change < 0 and w <= 5)"""),
    "buys_and_sells": (traded, pl.SCORES + """, k as (select as_of, row_number() over (order by as_of) as k from as_of), t as (select strategy, ticker, k from (select *, row_number() over (partition by as_of, strategy order by rank, ticker) as p from scores where rank is not null) join k using (as_of) where p <= 10),
b as (select *, 'buy' as side from t where not exists (select 1 from t o where o.strategy = t.strategy and o.ticker = t.ticker and o.k = t.k - 1) union all select strategy, ticker, k + 1, 'sell' from t where not exists (select 1 from t o where o.strategy = t.strategy and o.ticker = t.ticker and o.k = t.k + 1))
select as_of, strategy, ticker, side from b join k using (k)"""),
    "names_ever_listed": (ever_listed, al.MEMBERS + " select ticker, min(as_of) as first, max(as_of) as last, count(distinct as_of) as dates from mem group by 1"),
    "annual_turnover": (yearly_turnover, f"with w as ({rc.QUERIES['walk_forward'][1]}) select strategy, round(avg(turnover) / 2 * 4, 6) + 0.0 as turnover, count(*) as rebalances from w group by 1"),
    "benchmark_curve": (benchmark, ctes("market") + " select date, round(last_value(adj_close ignore nulls) over w / first_value(adj_close ignore nulls) over w, 6) + 0.0 as rebased from market window w as (order by date rows unbounded preceding)"),
    "strategy_curve": (curve, CURVE),
    "regime_flags": (flags, FLAGS),
    "row_validity": (validity, SHARE_FILINGS + """, fl as (select as_of, ticker, filed + 501 as day from sh union all select sh.as_of, sh.ticker, unnest([s.date, s.date + 401]) from (select distinct as_of, ticker from sh) sh join splits s on s.ticker = sh.ticker)
select as_of, ticker, min(day)::date as valid_until from fl where day > as_of group by all"""),
    "stale_shares": (stale_shares, SHARE_FILINGS + ", nw as (select as_of, ticker, max(filed) as newest from sh group by all) select as_of, ticker, newest, as_of - newest as age from nw where as_of - newest > 500"),
    "share_gaps": (share_gaps, SHARE_FILINGS + " select distinct as_of, ticker from known k where not exists (select 1 from sh where sh.as_of = k.as_of and sh.ticker = k.ticker and k.as_of - sh.filed <= 500)"),
    "cap_checks": (cap_checks, CAP_CHECKS + " select as_of, ticker, round(ratio, 6) + 0.0 as ratio, abs(ratio - 1) > 0.15 as apart, ratio between 0.8 and 1.25 as stands from ck where ratio is not null"),
    "backtest_windows": (windows, WINDOWS + " select strategy, start, last_source, blockers from wi"),
    "families_open": (families_open, WINDOWS + f""", fam(strategy, family) as (values {", ".join(f"('{s}', '{f}')" for f, m in pl.FAMILIES.items() for s in m)}), fs as (select family, max(start) as start, max(length(blockers)) as blocked from wi join fam using (strategy) group by 1)
select as_of, count(*) as families from as_of join fs on start <= as_of where blocked = 0 group by 1"""),
    "riskless_rate": (riskless, ctes("macro") + " select year(date) as year, round(case when count(value) >= 5 then avg(value) / 100 / 50 else 0.04 end, 6) + 0.0 as rate, count(value) as n from macro where series_id = '5-LOW' group by 1"),
    "snapshot_coverage": (snapshots, ctes("members") + " select source, count(distinct as_of) as snapshots, min(as_of) as first, max(as_of) as last, count(distinct ticker) as names from members group by 1"),
    "consistency": (consistency, ctes("news", "corporate_events", "insider_txns") + """ select 'news' as what, count(*) - count(distinct (coalesce(ticker, '') || '|' || trim(regexp_replace(lower(coalesce(title, '')), '\\s+', ' ', 'g')))) as extra from news
union all select 'events', (select count(*) from corporate_events) - (select count(*) from (select distinct ticker, filed, item_code from corporate_events)) union all select 'trades', (select count(*) from insider_txns) - (select count(*) from (select distinct accession, ticker, txn_date, txn_code from insider_txns))"""),
    "events_unamended": (unamended, ctes("corporate_events") + " select category, count(*) as n from corporate_events where accession not in (select o_orderkey from orders where o_orderkey % 50 = 0) group by 1"),
    "digest_events": (digest_events, ctes("corporate_events", "securities", "sessions", "as_of") + f" select e.ticker, name, sector, filed, item_code, category from corporate_events e left join securities using (ticker) where filed <= {LAST} and {LAST} - filed < 30 and category not in ('disclosure', 'results')"),
    "theme_names": (theme_names, ctes("securities") + """, th(theme, sector) as (values ('trade', 'ASIA'), ('trade', 'EUROPE'), ('energy', 'MIDDLE EAST'), ('aid', 'AFRICA'), ('aid', 'NOWHERE')),
r as (select theme, ticker, row_number() over (partition by theme, sector order by ticker) as r from th join securities using (sector)) select theme, array_to_string(list_sort(list(distinct ticker)), ',') as tickers from r where r <= 40 group by 1"""),
    "estimates_near": (estimates_near, ctes("corporate_events") + """, e as (select ticker, filed, accession from corporate_events where item_code = '2.02'), m as (select ticker, filed + (accession % 9 - 5)::int as day, accession % 100 / 10.0 as eps from e)
select e.ticker, filed, accession, max((day, eps))[1]::date as day, round(max((day, eps))[2], 6) + 0.0 as eps from e join m on m.ticker = e.ticker and m.day between e.filed - 4 and e.filed + 2 group by all"""),
    "acquirers": (acquirers, ctes("corporate_events", "sessions", "as_of") + " select as_of, ticker, count(*) as deals, max(filed) as last from corporate_events join as_of on filed <= as_of and filed > as_of - 365 where item_code = '1.01' and accession % 8 = 0 group by all"),
    "trades_unscored": (unscored, ctes("insider_txns") + """, w as (select concat_ws(', ', case when txn_code not in ('P', 'S') then 'not an open-market trade' end, case when contains(flags, '10b5-1') then 'under a plan' end, case when role = '10% Owner' then 'large holder only' end) as why from insider_txns)
select case when why <> '' then why else 'scored' end as why, count(*) as n from w group by 1"""),
    "strategy_specs": (specs, "with " + pl.FRAME + f""", weights(strategy, factor, weight) as (values {", ".join(f"('{s}', '{f}', {w}::double)" for s, f, w in pl.CELLS)}), u as ({" union all ".join(f'''select '{f}' as factor, count("{f}") as v from frame''' for f in pl.USED)})
select strategy, count(*) as factors, round(sum(weight), 6) + 0.0 as weight, sum(v)::bigint as "values" from weights join u using (factor) where v > 0 group by 1"""),
    "completed_sessions": (completed, """with h as (select distinct date_trunc('hour', ts) as "at" from events), l as (select "at", "at" - interval 5 hour as t from h)
select "at", case when isodow(t) <= 5 and hour(t) * 60 + minute(t) >= 1005 then t::date else t::date - (case isodow(t) when 1 then 3 when 7 then 2 else 1 end)::int end as session from l"""),
}
QUERIES["findings"] = (all_findings, _findings_sql())
