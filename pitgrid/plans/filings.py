"""Fundamental queries."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitgrid.operators import asof, fundamentals as fu
from pitgrid.plans.fixtures import _fill, ctes, read
from pitgrid.plans.kept import kept
from pitgrid.plans.prices import rounded

#: Filings derived from quarterly sums, in SQL that both engines read but for {d(n)} = period end + n days.
#: concept: (expression, kind).
FLOWS = {
    "revenue": "revenue", "net_income": "net_income", "operating_cash_flow": "ocf", "gross_profit": "0.4 * revenue", "operating_income": "0.2 * revenue", "capex": "-0.05 * revenue",
    "dividends_paid": "-0.1 * abs(net_income)", "buybacks": "-0.05 * abs(net_income)",
    "eps_diluted": "net_income / (100.0 * (1 + l_suppkey % 5)) * (case when l_suppkey % 13 = 0 then 3 else 1 end)",
}
STOCKS = {
    "assets": "6 * revenue", "equity": "2.5 * revenue", "cash": "0.4 * revenue", "long_term_debt": "1.5 * revenue", "current_assets": "1.2 * revenue", "current_liabilities": "0.8 * revenue",
    "shares_diluted": "100.0 * (1 + l_suppkey % 5)", "shares_outstanding": "100.0 * (1 + l_suppkey % 5) / (case when l_suppkey % 10 = 7 then 2 else 1 end)",
    "shares_basic": "95.0 * (1 + l_suppkey % 5)",
}
SHARES = ("shares_diluted", "shares_outstanding", "shares_basic")
PER_SHARE = ("eps_diluted",)


BASE = """q as (select l_suppkey, concat('S', l_suppkey) as ticker, period_start, {end} as period_end, month(period_start) as m, {yearstart} as y0,
  revenue, net_income, ocf, restated from quarters),
cum as (select *, """ + ", ".join(f"sum({c}) over (partition by l_suppkey, y0 order by period_start) as c_{c}" for c in ("revenue", "net_income", "ocf")) + """,
  count(*) over (partition by l_suppkey, y0 order by period_start) as k from q)"""
FIELDS = ("concept", "tag", "period_start", "period_end", "filed", "form", "val")


def fact_rows() -> list[tuple[tuple[str, ...], str]]:
    """Rows of filings, as SQL of ``FIELDS`` and of the condition: quarters (the last one of a year only
    within the year), half-years and nine months too, a restatement without returns 90 days later, and
    for some a second revenue tag of a tenth."""
    filed, form = "case when m = 10 then {d55} else {d35} end", "case when m = 10 then '10-K' else '10-Q' end"
    rows = []
    for c, e in FLOWS.items():
        ce = e.replace("net_income", "c_net_income").replace("revenue", "c_revenue").replace("ocf", "c_ocf")
        rows.append(((f"'{c}'", f"'{c}'", "period_start", "period_end", filed, "'10-Q'", f"cast({e} as double)"), "m <> 10"))
        rows.append(((f"'{c}'", f"'{c}'", "y0", "period_end", filed, form, f"cast({ce} as double)"), "m <> 1 and k = (m + 2) / 3"))
    for c, e in STOCKS.items():
        ok = {"shares_outstanding": "l_suppkey % 8 <> 3", "shares_diluted": "l_suppkey % 16 <> 3 or period_end < date'1998-01-01'"}.get(c, "true")
        rows.append(((f"'{c}'", f"'{c}'", "period_end", "period_end", filed, form, f"cast({e} as double)"), ok))
    rows.append((("'revenue'", "'revenue'", "period_start", "period_end", "{d125}", "'10-Q/A'", "restated"), "m <> 10"))
    rows.append((("'revenue'", "'sales'", "period_start", "period_end", filed, "'10-Q'", "revenue * 0.1"), "m <> 10 and l_suppkey % 9 = 0"))
    rows.append((("'revenue'", "'revenue'", "period_start", "period_end", filed, "'DEF 14A'", "revenue * 7"), "m = 4"))
    return rows


def facts_sql() -> str:
    parts = [f"select ticker, {', '.join(f'{v} as {n}' for n, v in zip(FIELDS, values))} from cum where {ok}" for values, ok in fact_rows()]
    return BASE + ",\nfacts as (" + "\nunion all ".join(parts) + ")"


SPARK = {"end": "date_sub(add_months(period_start, 3), 1)", "yearstart": "cast(date_trunc('year', period_start) as date)"} | {f"d{n}": f"date_add(period_end, {n})" for n in (35, 55, 125)}
DUCK = {"end": "cast(period_start + interval 3 month as date) - 1", "yearstart": "cast(date_trunc('year', period_start) as date)"} | {f"d{n}": f"(period_end + {n})" for n in (35, 55, 125)}


#: Quarters to a part of the facts: each gives some thirty facts.
QUARTERS_A_PART = 2500


def facts(spark: SparkSession, sf: str, concepts: Collection[str] = (*FLOWS, *STOCKS)) -> DataFrame:
    """All rows of ``concepts`` from one pass over the quarters, which are dealt by ticker into parts that grow in number, not in size."""
    wanted = [row for row in fact_rows() if row[0][0].strip("'") in concepts]
    # each expression once, as a column: as fields of some thirty structs they make a method that is too long to be compiled
    names = {v: f"x{i}" for i, v in enumerate(dict.fromkeys(v for values, ok in wanted for v in (*values, ok)))}
    columns = ", ".join(f"{v} as {x}" for v, x in names.items())
    structs = ", ".join(f"case when {names[ok]} then struct({', '.join(f'{names[v]} as {n}' for n, v in zip(FIELDS, values))}) end" for values, ok in wanted)
    base = BASE.replace("concat('S', l_suppkey) as ticker", "ticker").replace("partition by l_suppkey, y0", "partition by ticker, y0")
    sql = _fill(f"with {base} select ticker, x.* from (select ticker, explode(array({structs})) as x from (select ticker, {columns} from cum)) where x is not null", SPARK)
    rows = read(spark, sf, "quarters").withColumn("ticker", F.concat(F.lit("S"), "l_suppkey"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // QUARTERS_A_PART + 1)
    return spark.sql(sql.replace("from quarters", "from {quarters}"), quarters=rows.repartition(parts, "ticker"))


FACTS = ctes("quarters", "as_of", "splits", "bars", "sessions") + ",\n" + _fill(facts_sql(), DUCK)


def known(spark, sf) -> DataFrame:
    """Facts seen at each as-of date, split-restated, of one tag per concept; they aren't kept, since they are facts times dates."""
    rows = fu.known_at(facts(spark, sf), read(spark, sf, "as_of"))
    return fu.single_tag(fu.split_restated(rows, read(spark, sf, "splits"), SHARES, PER_SHARE))


KNOWN = FACTS + f""",
seen as (select a.as_of, f.ticker, concept, tag, period_start, period_end, filed, form, val * case when concept in {SHARES} then
  coalesce((select product(ratio) from splits s where s.ticker = f.ticker and f.filed < s.date and s.date <= a.as_of), 1) when concept = 'eps_diluted' then
  1 / coalesce((select product(ratio) from splits s where s.ticker = f.ticker and f.filed < s.date and s.date <= a.as_of), 1) else 1 end as val
  from facts f join as_of a on f.filed <= a.as_of where form in {fu.FORMS}),
tags as (select as_of, ticker, concept, tag, max(filed) as last, median(abs(val)) as scale from seen group by all),
best as (select as_of, ticker, concept, tag from (select *, row_number() over (partition by as_of, ticker, concept order by scale desc, tag desc) as r
  from (select *, max(last) over (partition by as_of, ticker, concept) as newest from tags) where newest - last <= 365) where r = 1),
known as (select seen.* from seen join best using (as_of, ticker, concept, tag)),
vers as (select * from known qualify row_number() over (partition by as_of, ticker, concept, period_start, period_end order by filed desc, val desc) = 1),
spans as (select *, case when period_end - period_start between 60 and 115 then 'Q' when period_end - period_start between 150 and 220 then 'H'
  when period_end - period_start between 240 and 310 then '9M' when period_end - period_start between 330 and 400 then 'A' end as span from vers),
steps as (select *, lag(period_end) over w as pe, lag(val) over w as pv, lag(filed) over w as pf from spans where span is not null window w as (partition by as_of, ticker, concept, period_start order by period_end)),
qs as (select as_of, ticker, concept, period_end, filed, val from spans where span = 'Q' union all
  select as_of, ticker, concept, period_end, greatest(filed, pf), val - pv from steps where span in ('H', '9M', 'A') and period_end - pe between 60 and 115),
q1 as (select * from qs qualify row_number() over (partition by as_of, ticker, concept, period_end order by filed desc, val desc) = 1),
q2 as (select as_of, ticker, concept, period_end, filed, case when ago <> 0 and abs(val / ago) > 10 and val * ago < 0 then null else val end as val
  from (select *, lag(val, 4) over (partition by as_of, ticker, concept order by period_end) as ago from q1))"""


def known_spans(spark, sf, concepts: Collection[str], *keys: str) -> DataFrame:
    """The same facts with the as-of dates they hold for, of one version by ``keys``: as many rows as facts, not facts times dates."""
    return fu.known_spans(facts(spark, sf, concepts), read(spark, sf, "as_of"), read(spark, sf, "splits"), SHARES, PER_SHARE, keys)


def flows(spark, sf, concepts: Collection[str] = tuple(FLOWS)) -> DataFrame:
    """The quarters and years of flows known at each as-of date, in lists."""
    return fu.flows_at(known_spans(spark, sf, concepts, "period_start", "period_end"), read(spark, sf, "as_of"))


def stocks(spark, sf) -> DataFrame:
    return fu.stocks_at(known_spans(spark, sf, STOCKS, "period_end"), read(spark, sf, "as_of"))


def finely(df: DataFrame, *columns: str) -> DataFrame:
    """Sums rounded to 7 digits, those per share to 9: quotients of amounts end in a five there."""
    return df.withColumns({c: F.when(F.col("concept").isin(*PER_SHARE), F.round(c, 9)).otherwise(F.round(c, 7)) + 0.0 for c in columns})


def quarter_rows(spark, sf):
    rows = flows(spark, sf).select("as_of", "ticker", "concept", F.explode("quarters").alias("x"))
    return finely(rows.select("as_of", "ticker", "concept", "x.period_end", "x.filed", "x.val"), "val")


def ttm(spark, sf):
    return finely(fu.with_trailing(flows(spark, sf)).select("as_of", "ticker", "concept", "ttm", "y1", "y2", "y3"), "ttm", "y1", "y2", "y3")


TTM = KNOWN + """,
qk as (select *, row_number() over (partition by as_of, ticker, concept order by period_end desc) as k from q2 where concept in """ + str(tuple(FLOWS)) + """),
sums as (select as_of, ticker, concept, """ + ", ".join(f"case when count(case when k between {4*n+1} and {4*n+4} then 1 end) = 4 then sum(case when k between {4*n+1} and {4*n+4} then val end) end as y{n}" for n in range(4)) + """ from qk group by all),
annual as (select as_of, ticker, concept, arg_max(val, (period_end, filed)) as annual from spans where span = 'A' group by all),
ttm as (select as_of, ticker, concept, coalesce(y0, annual) as ttm, y1, y2, y3 from sums full join annual using (as_of, ticker, concept) where concept in """ + str(tuple(FLOWS)) + """)"""
STOCK = """,
sv as (select *, max(period_end) over (partition by as_of, ticker, concept) as last from (select * from known where concept in """ + str(tuple(STOCKS)) + """
  qualify row_number() over (partition by as_of, ticker, concept, period_end order by filed desc, val desc) = 1)),
stock as (select as_of, ticker, concept, arg_max(val, period_end) as now, arg_max(filed, period_end) as filed, arg_max(val, period_end) filter (where period_end <= last - interval 12 month) as y1,
  arg_max(val, period_end) filter (where period_end <= last - interval 36 month) as y3 from sv group by all)"""


def stock_rows(spark, sf):
    return rounded(stocks(spark, sf), 4)


def surprises(spark, sf):
    return rounded(fu.with_surprise(flows(spark, sf, PER_SHARE)).where("sue_filed is not null").select("as_of", "ticker", "sue", "sue_filed"))


def wide(spark, sf) -> DataFrame:
    """One row of sums, stock values and the years before per name and date."""
    return kept(spark, sf, "fundamentals", lambda: widened(spark, sf))


def widened(spark, sf) -> DataFrame:
    by = ["as_of", "ticker"]
    pick = lambda c, v, name: F.max(F.when(F.col("concept") == c, F.col(v))).alias(name)
    f = fu.with_surprise(fu.with_trailing(flows(spark, sf))).groupBy(*by).agg(
        *[pick(c, v, c + s) for c in FLOWS for v, s in (("ttm", ""), ("y1", "_y1"), ("y3", "_y3"))], F.max("filed").alias("last_filed"), F.max("sue").alias("sue"), F.max("sue_filed").alias("sue_filed")
    )
    s = stocks(spark, sf).groupBy(*by).agg(*[pick(c, v, c + x) for c in STOCKS for v, x in (("now", ""), ("y1", "_y1"), ("y3", "_y3"))], *[pick(c, "filed", c + "_filed") for c in SHARES])
    out = f.join(s, by)
    split = fu.recent_splits(read(spark, sf, "splits"), read(spark, sf, "as_of")).withColumn("split_recent", F.lit(True))
    out = out.join(split, by, "left").fillna({"split_recent": False})
    out = out.withColumn("shares", fu.share_count(F.col("shares_outstanding"), F.col("shares_outstanding_filed"), F.col("shares_diluted"), F.col("shares_diluted_filed"), F.col("shares_basic"), F.col("shares_basic_filed"), F.col("as_of"), F.col("net_income"), F.col("eps_diluted"), F.col("split_recent")))
    out = out.withColumns({"shares_y1": F.col("shares_outstanding_y1"), "total_debt": F.lit(None).cast("double"), "short_term_debt": F.lit(None).cast("double")})
    px = read(spark, sf, "bars").select("ticker", "date", "close")
    out = asof.asof_join(out, px, ["ticker"], "as_of", "date", ["close"], max_age_days=30)
    snap = read(spark, sf, "profile_snapshots").withColumnRenamed("market_cap", "snap_cap")
    out = asof.asof_join(out, snap, ["ticker"], "as_of", "snapshot_date", ["snap_cap", "forward_pe", "trailing_pe"], max_age_days=7)
    return out.withColumns({"market_cap": F.coalesce("snap_cap", F.col("shares") * F.col("close")), "mcap_source": F.when(F.col("snap_cap").isNotNull(), "snapshot").when((F.col("shares") * F.col("close")).isNotNull(), "computed")})


def ratio_rows(spark, sf):
    return rounded(fu.ratios(wide(spark, sf)))


def market_caps(spark, sf):
    return rounded(wide(spark, sf).select("as_of", "ticker", "shares", "market_cap", "mcap_source", F.col("last_filed").alias("data_as_of")), 4)


def _wide_sql() -> str:
    f = ", ".join(f"max(case when concept = '{c}' then {v} end) as {c}{s}" for c in FLOWS for v, s in (("ttm", ""), ("y1", "_y1"), ("y3", "_y3")))
    s = ", ".join(f"max(case when concept = '{c}' then {v} end) as {c}{x}" for c in STOCKS for v, x in (("now", ""), ("y1", "_y1"), ("y3", "_y3")))
    sf_ = ", ".join(f"max(case when concept = '{c}' then filed end) as {c}_filed" for c in SHARES)
    return TTM + STOCK + f""",
chg as (select *, val - lag(val, 4) over (partition by as_of, ticker order by period_end) as c, row_number() over (partition by as_of, ticker order by period_end) as n from q2 where concept = 'eps_diluted'),
sd as (select *, stddev_samp(c) over w as sd, count(c) over w as k from chg window w as (partition by as_of, ticker order by period_end rows between 7 preceding and 1 preceding)),
sue as (select as_of, ticker, case when n >= 8 and k >= 4 then c / nullif(sd, 0) end as sue, filed as sue_filed from sd qualify row_number() over (partition by as_of, ticker order by period_end desc) = 1),
fl as (select as_of, ticker, {f} from ttm group by all), lf as (select as_of, ticker, max(filed) as last_filed from q2 where concept in {tuple(FLOWS)} group by all),
st as (select as_of, ticker, {s}, {sf_} from stock group by all),
snap as ({_snap()}),
wd as (select fl.*, lf.last_filed, st.* exclude (as_of, ticker), sue, sue_filed, exists (select 1 from splits x where x.ticker = fl.ticker and x.date <= fl.as_of and x.date > fl.as_of - 400) as split_recent,
  (select case when fl.as_of - max(date) <= 30 then arg_max(close, date) end from bars b where b.ticker = fl.ticker and b.date <= fl.as_of) as px,
  (select case when fl.as_of - max(snapshot_date) <= 7 then arg_max(market_cap, snapshot_date) end from snap b where b.ticker = fl.ticker and b.snapshot_date <= fl.as_of) as snap_cap,
  (select case when fl.as_of - max(snapshot_date) <= 7 then arg_max(forward_pe, snapshot_date) end from snap b where b.ticker = fl.ticker and b.snapshot_date <= fl.as_of) as forward_pe,
  (select case when fl.as_of - max(snapshot_date) <= 7 then arg_max(trailing_pe, snapshot_date) end from snap b where b.ticker = fl.ticker and b.snapshot_date <= fl.as_of) as trailing_pe
  from fl join lf using (as_of, ticker) join st using (as_of, ticker) left join sue using (as_of, ticker)),
w0 as (select *, case when shares_diluted > 0 and as_of - shares_diluted_filed <= 500 then shares_diluted end as fd, case when shares_basic > 0 and as_of - shares_basic_filed <= 500 then shares_basic end as fb,
  case when net_income / nullif(eps_diluted, 0) > 0 then net_income / nullif(eps_diluted, 0) end as implied from wd),
w1 as (select *, coalesce(case when shares_outstanding > 0 and as_of - shares_outstanding_filed <= 500 then shares_outstanding end, case when fd is not null and fb is not null and shares_basic_filed > shares_diluted_filed then fb else coalesce(fd, fb) end) as cnt from w0),
w2 as (select *, case when cnt / implied is null or cnt / implied between 0.70 and 1.45 or split_recent then cnt end as shares from w1),
w as (select *, coalesce(snap_cap, shares * px) as market_cap, case when snap_cap is not null then 'snapshot' when shares * px is not null then 'computed' end as mcap_source,
  case when equity > 0 and coalesce(equity >= 0.01 * assets, true) and coalesce(abs(net_income) <= 2 * equity, true) then equity end as eq, case when coalesce(long_term_debt, 0) > 0 then long_term_debt end as debt,
  operating_cash_flow - abs(capex) as fcf from w2)"""


def _snap() -> str:
    from pitgrid.plans.fixtures import TABLES

    return TABLES["profile_snapshots"][1]


WIDE = _wide_sql()
RATIOS = {
    "FCF": "fcf", "GROSS_MARGIN": "gross_profit / nullif(revenue, 0)", "OPERATING_MARGIN": "operating_income / nullif(revenue, 0)", "NET_MARGIN": "net_income / nullif(revenue, 0)", "ROE": "net_income / eq", "ROA": "net_income / nullif(assets, 0)",
    "ROIC": "operating_income / (eq + coalesce(debt, 0))", "GROSS_PROFITABILITY": "gross_profit / nullif(assets, 0)", "ASSET_TURNOVER": "revenue / nullif(assets, 0)", "DEBT_TO_EQUITY": "debt / eq",
    "NET_DEBT_TO_EQUITY": "(debt - coalesce(cash, 0)) / eq", "CURRENT_RATIO": "current_assets / nullif(current_liabilities, 0)",
    "FCF_CONVERSION": "fcf / nullif(case when coalesce(abs(net_income) >= 0.005 * abs(revenue), true) then net_income end, 0)", "EPS": "net_income / nullif(shares, 0)", "ACCRUALS": "(net_income - operating_cash_flow) / nullif(assets, 0)",
    "REVENUE_GROWTH_1Y": "case when revenue_y1 <> 0 and revenue * revenue_y1 >= 0 then (revenue - revenue_y1) / abs(revenue_y1) end",
    "EARNINGS_GROWTH_1Y": "case when net_income_y1 <> 0 and net_income * net_income_y1 >= 0 then (net_income - net_income_y1) / abs(net_income_y1) end",
    "REVENUE_CAGR_3Y": "case when revenue > 0 and revenue_y3 > 0 then pow(revenue / revenue_y3, 1 / 3.0) - 1 end", "EQUITY_CAGR_3Y": "case when equity > 0 and equity_y3 > 0 then pow(equity / equity_y3, 1 / 3.0) - 1 end",
    "EPS_CAGR_3Y": "case when eps_diluted > 0 and eps_diluted_y3 > 0 then pow(eps_diluted / eps_diluted_y3, 1 / 3.0) - 1 end", "FORWARD_PE": "forward_pe", "TRAILING_PE": "trailing_pe",
    "MARKET_CAP": "market_cap", "EV": "market_cap + coalesce(debt, 0) - coalesce(cash, 0)", "EARNINGS_YIELD": "net_income / nullif(market_cap, 0)", "FCF_YIELD": "fcf / nullif(market_cap, 0)", "SALES_YIELD": "revenue / nullif(market_cap, 0)",
    "BOOK_TO_MARKET": "eq / nullif(market_cap, 0)", "BUYBACK_YIELD": "abs(buybacks) / nullif(market_cap, 0)", "DIVIDEND_YIELD": "abs(dividends_paid) / nullif(market_cap, 0)", "PAYOUT_RATIO": "abs(dividends_paid) / nullif(net_income, 0)",
    "EBIT_TO_EV": "operating_income / nullif(market_cap + coalesce(debt, 0) - coalesce(cash, 0), 0)", "EARNINGS_SURPRISE": "case when as_of - sue_filed <= 100 then sue end",
}
TESTS = (
    "net_income / assets > 0", "operating_cash_flow > 0", "net_income / assets > net_income_y1 / assets_y1", "operating_cash_flow > net_income", "long_term_debt / assets < long_term_debt_y1 / assets_y1",
    "current_assets / current_liabilities > current_assets_y1 / current_liabilities_y1", "shares <= 1.02 * shares_outstanding_y1", "gross_profit / revenue > gross_profit_y1 / revenue_y1", "revenue / assets > revenue_y1 / assets_y1",
)
QUERIES = {
    "fact_quarters": (quarter_rows, KNOWN + f" select as_of, ticker, concept, period_end, filed, case when concept in ('eps_diluted') then round(val, 9) else round(val, 7) end + 0.0 as val from q2 where concept in {tuple(FLOWS)}"),
    "fact_ttm": (ttm, TTM + " select as_of, ticker, concept, " + ", ".join(f"case when concept in ('eps_diluted') then round({c}, 9) else round({c}, 7) end + 0.0 as {c}" for c in ("ttm", "y1", "y2", "y3")) + " from ttm"),
    "fact_stocks": (stock_rows, KNOWN + STOCK + " select as_of, ticker, concept, round(now, 4) + 0.0 as now, filed, round(y1, 4) + 0.0 as y1, round(y3, 4) + 0.0 as y3 from stock"),
    "earnings_surprise": (surprises, WIDE + " select as_of, ticker, round(sue, 6) + 0.0 as sue, sue_filed from sue"),
    "market_caps": (market_caps, WIDE + " select as_of, ticker, round(shares, 4) + 0.0 as shares, round(market_cap, 4) + 0.0 as market_cap, mcap_source, last_filed as data_as_of from w"),
    "fundamental_ratios": (ratio_rows, WIDE + " select as_of, ticker, " + ", ".join(f'round({e}, 6) + 0.0 as "{k}"' for k, e in RATIOS.items()) + ", " + " + ".join(f"coalesce(({t})::int, 0)" for t in TESTS) + ' as "PIOTROSKI_F" from w'),
}
