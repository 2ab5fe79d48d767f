"""The factor frame, the strategies on it, and what follows from their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitgrid.operators import panel as pn
from pitgrid.operators import signals as sg
from pitgrid.operators import transforms as tr
from pitgrid.plans import alternatives as al
from pitgrid.plans import filings, prices as pr
from pitgrid.plans.fixtures import ctes, read
from pitgrid.plans.kept import kept
from pitgrid.plans.prices import rounded

# Weights, gates and setups of the strategies. The least market value is a
# parameter: given tables have values of some 1e7, so 1e6 stands for 2e9.
LEAST_CAP = 1e6
STRATEGIES: dict[str, dict] = {
    "buffett": {"weights": {"BOOK_TO_MARKET": 1.2, "EARNINGS_YIELD": 1.4, "FCF_YIELD": 1.0, "FCF_CONVERSION": 1.0, "ACCRUALS": 0.8, "NET_DEBT_TO_EQUITY": 1.0, "PIOTROSKI_F": 0.6, "CURRENT_RATIO": 0.4, "ROIC": 1.2, "OPERATING_MARGIN": 0.6, "EQUITY_CAGR_3Y": 0.6}, "gates": {"min_market_cap": LEAST_CAP}, "horizon": "long"},
    "quality_momentum": {"weights": {"MOM_12_1": 1.5, "ROIC": 0.8, "ACCRUALS": 0.6, "NET_DEBT_TO_EQUITY": 0.4}, "gates": {"min_market_cap": LEAST_CAP}, "horizon": "long"},
    "style_factors": {"weights": {"EARNINGS_YIELD": 1.0, "REVENUE_GROWTH_1Y": 1.0, "MOM_12_1": 1.0}, "gates": {}, "horizon": "long"},
    "insider_conviction": {"weights": {"INSIDER_NET_BUY": 1.5, "ROIC": 1.0, "FCF_YIELD": 1.0, "EARNINGS_YIELD": 0.8, "NET_DEBT_TO_EQUITY": 0.5}, "gates": {}, "horizon": "long"},
    "ai_earnings": {"weights": {"LLM_EARNINGS_VIEW": 2.0, "EARNINGS_REACTION": 0.8, "ROIC": 0.5, "FCF_YIELD": 0.5}, "gates": {"min_market_cap": LEAST_CAP}, "horizon": "long"},
    "shareholder_yield": {"weights": {"DIVIDEND_YIELD": 1.0, "BUYBACK_YIELD": 1.0, "FCF_YIELD": 1.2, "PAYOUT_RATIO": 0.6, "ROIC": 0.6, "NET_DEBT_TO_EQUITY": 0.6}, "gates": {}, "horizon": "long"},
    "balanced": {"weights": {"EARNINGS_YIELD": 1.0, "FCF_YIELD": 1.0, "BUYBACK_YIELD": 1.0, "MOM_12_1": 1.5, "MOM_6_1": 0.75, "PCT_FROM_52W_HIGH": 0.75, "ROIC": 0.75, "ACCRUALS": 0.5, "EARNINGS_REACTION": 0.75}, "gates": {"above_ma200": True}, "horizon": "mid"},
    "momentum_trend": {"weights": {"MOM_12_1": 1.5, "MOM_VOL_ADJ": 1.2, "MOM_6_1": 0.8, "PCT_VS_MA200": 1.0, "PCT_FROM_52W_HIGH": 0.8, "VOL_1Y": 0.4}, "gates": {"above_ma200": True, "rsi_max": 80}, "horizon": "mid"},
    "breakout": {"weights": {"PCT_FROM_52W_HIGH": 2.0, "MOM_6_1": 1.2, "MOM_12_1": 0.8, "PCT_VS_MA50": 0.8, "ATTENTION_Z": 0.4}, "gates": {"above_ma200": True, "rsi_max": 85}, "horizon": "mid", "setup": "breakout"},
    "pullback": {"weights": {"PCT_VS_MA200": 1.2, "MOM_12_1": 1.0, "REVERSAL_1M": 1.2, "ROIC": 0.5}, "gates": {"above_ma200": True, "rsi_max": 45}, "horizon": "mid", "setup": "pullback"},
    "earnings_drift": {"weights": {"EARNINGS_REACTION": 2.0, "EARNINGS_SURPRISE": 1.0, "EARNINGS_GROWTH_1Y": 0.6, "MOM_6_1": 0.6, "PCT_VS_MA50": 0.4}, "gates": {"above_ma200": True, "earnings_reaction": True}, "horizon": "mid"},
    "insider_cluster": {"weights": {"INSIDER_NET_BUY": 2.0, "EARNINGS_YIELD": 1.0, "PCT_VS_MA200": 0.8, "FCF_YIELD": 0.8}, "gates": {"min_insider_buyers": 2}, "horizon": "mid", "setup": "pullback"},
    "mean_reversion": {"weights": {"REVERSAL_1M": 1.5, "ROIC": 1.0, "FCF_YIELD": 0.8, "DEBT_TO_EQUITY": 0.8, "PIOTROSKI_F": 0.6}, "gates": {"rsi_max": 35}, "horizon": "mid", "setup": "pullback"},
    "relative_strength": {"weights": {"MOM_VOL_ADJ": 1.5, "MOM_6_1": 1.0, "PCT_VS_MA200": 1.0, "VOL_1Y": 1.0, "MAX_DD_1Y": 0.6, "IDIO_VOL": 0.5}, "gates": {"above_ma200": True, "rsi_max": 75}, "horizon": "mid"},
    "quality_breakdown": {"weights": {"ACCRUALS": 1.2, "DEBT_TO_EQUITY": 1.0, "EVENT_MANAGEMENT": 0.8, "EVENT_RESTRUCTURING": 0.8, "PIOTROSKI_F": 1.2, "PCT_VS_MA200": 1.0, "INSIDER_NET_BUY": 0.6}, "gates": {}, "horizon": "mid", "invert": True},
}
FAMILIES = {
    "value": ("buffett", "shareholder_yield"), "momentum": ("quality_momentum", "momentum_trend", "relative_strength"),
    "insiders": ("insider_conviction", "insider_cluster"), "drift": ("earnings_drift",),
}
VETO = "quality_breakdown"
# Factors of which less is better.
LOW_IS_GOOD = (
    "ACCRUALS", "DEBT_TO_EQUITY", "NET_DEBT_TO_EQUITY", "VOL_1Y", "VOL_3M", "BETA", "IDIO_VOL", "PAYOUT_RATIO", "FORWARD_PE", "TRAILING_PE", "EVENT_INTENSITY_90D",
    "EVENT_MANAGEMENT", "EVENT_RESTRUCTURING",
)
CELLS = [(s, f, w) for s, c in STRATEGIES.items() for f, w in c["weights"].items()]
USED = tuple(dict.fromkeys(f for _, f, _ in CELLS))


def index_of(spark, sf) -> DataFrame:
    return read(spark, sf, "market").join(read(spark, sf, "sessions"), "date")


def reaction(spark, sf) -> DataFrame:
    dates = read(spark, sf, "as_of").select("as_of", "session")
    return rounded(pn.earnings_reaction(pr.grid(spark, sf), index_of(spark, sf), read(spark, sf, "corporate_events"), dates, read(spark, sf, "sessions")))


REACTION = pr.GRID.replace("with ", ctes("corporate_events") + ", ", 1) + """,
rl as (select a.as_of, a.session as now, e.ticker, max(e.filed) as day from corporate_events e join as_of a on e.filed <= a.as_of and e.filed >= a.as_of - 63 where item_code = '2.02' group by all),
rs as (select rl.*, (select min(session) from sessions s where s.date >= rl.day) as n from rl),
ra as (select *, n - 1 as s0, least(n + 1, now) as s1 from rs where n is not null)
select ra.as_of, ra.ticker, round((y.close_ff / x.close_ff - 1) - (m1.close / m0.close - 1), 6) + 0.0 as "EARNINGS_REACTION" from ra
join grid x on x.ticker = ra.ticker and x.session = s0 join grid y on y.ticker = ra.ticker and y.session = s1
join (select session, close from market join sessions using (date)) m0 on m0.session = s0 join (select session, close from market join sessions using (date)) m1 on m1.session = s1 where s1 > s0"""


def views(spark, sf) -> DataFrame:
    return rounded(pn.view_factor(read(spark, sf, "reviews"), read(spark, sf, "as_of").select("as_of")))


VIEWS = ctes("reviews", "as_of") + """, rv as (select a.as_of, r.* from reviews r join as_of a on r.filed <= a.as_of and r.filed >= a.as_of - 120 qualify row_number() over (partition by a.as_of, ticker order by filed desc, accession desc) = 1)
select as_of, ticker, round(score * case conviction when 'low' then 0.5 when 'medium' then 0.8 when 'high' then 1.0 else 0.5 end, 6) + 0.0 as "LLM_EARNINGS_VIEW" from rv"""


def attention_at(spark, sf) -> DataFrame:
    return rounded(al.attention_asof(spark, sf))


def frame(spark: SparkSession, sf: str) -> DataFrame:
    """All factors of every name at every date, with its sector."""

    def make() -> DataFrame:
        families = [pr.panel(spark, sf), filings.ratio_rows(spark, sf), al.insiders(spark, sf), al.event_factors(spark, sf), reaction(spark, sf), views(spark, sf), attention_at(spark, sf)]
        return pn.labelled(pn.joined(families), read(spark, sf, "securities"))

    return kept(spark, sf, "frame", make)


FRAME_COLUMNS = (
    *pr.TRAILING_COLUMNS, *pr.PATH_COLUMNS, *filings.RATIOS, "PIOTROSKI_F", "INSIDER_NET_BUY", "INSIDER_CLUSTER", "EVENT_INTENSITY_90D", *[f"EVENT_{c.upper()}" for c in al.CATEGORIES],
    "EARNINGS_REACTION", "LLM_EARNINGS_VIEW", "ATTENTION_Z",
)


def frame_sql() -> str:
    parts = {
        "fp1": pr.QUERIES["price_trailing_factors"][1], "fp2": pr.QUERIES["price_path_factors"][1], "ff1": filings.QUERIES["fundamental_ratios"][1], "fa1": al.QUERIES["insider_factors"][1],
        "fa2": al.QUERIES["event_factors"][1], "fa3": REACTION, "fa4": VIEWS, "fa5": al.ATTENTION,
    }
    made = ",\n".join(f"{n} as materialized ({sql})" for n, sql in parts.items())
    names = " union ".join(f"select as_of, ticker from {n}" for n in parts)
    joins = " ".join(f"left join {n} using (as_of, ticker)" for n in parts)
    columns = ", ".join(f'"{c}"' for c in FRAME_COLUMNS)
    return f"""{made},
frame as materialized (select as_of, ticker, coalesce(sec.sector, 'Unknown') as sector, {columns} from ({names}) n join (select ticker, r_name as sector from (select concat('S', s_suppkey) as ticker, s_nationkey from supplier) s
  join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey) sec using (ticker) {joins})"""


FRAME = frame_sql()


def panel_rows(spark, sf):
    return rounded(frame(spark, sf).select("as_of", "ticker", "sector", *FRAME_COLUMNS))


# Factors that may stand for a style, the first of each unless another is chosen.
PROXIES = {
    "value": ("EARNINGS_YIELD", "BOOK_TO_MARKET"),
    "growth": ("REVENUE_GROWTH_1Y", "EQUITY_CAGR_3Y", "EPS_CAGR_3Y"),
    "momentum": ("MOM_12_1", "MOM_6_1", "RETURN_6M", "RETURN_1M"),
}


def style_weights(**chosen: str) -> dict[str, float]:
    """Equal weights of one factor for each style: value, growth and momentum; a factor that can't stand for its style is refused."""
    if wrong := set(chosen) - set(PROXIES):
        raise ValueError(f"no such style: {', '.join(sorted(wrong))}")
    picked = {style: chosen.get(style) or names[0] for style, names in PROXIES.items()}
    for style, factor in picked.items():
        if factor not in PROXIES[style]:
            raise ValueError(f"{factor} can't stand for {style}; choose one of {', '.join(PROXIES[style])}")
    return dict.fromkeys(picked.values(), 1.0)


def gate_columns() -> dict:
    """Each strategy's gates as a condition on the frame."""
    return {s: sg.gate(**c["gates"]) for s, c in STRATEGIES.items()}


def gate_sql(gates: dict) -> str:
    made = {
        "above_ma200": 'coalesce("ABOVE_MA200", 0) = 1', "rsi_max": f'coalesce("RSI_14", 50) <= {gates.get("rsi_max")}', "min_market_cap": f'("MARKET_CAP" is null or "MARKET_CAP" >= {gates.get("min_market_cap")})',
        "earnings_reaction": '"EARNINGS_REACTION" is not null', "min_insider_buyers": f'coalesce("INSIDER_CLUSTER", 0) >= {gates.get("min_insider_buyers")}',
    }
    return " and ".join(made[k] for k in gates) or "true"


def scores(spark, sf) -> DataFrame:
    """composite, coverage, rank and percentile of the names that pass each strategy's gates."""

    def make() -> DataFrame:
        out = tr.composites(frame(spark, sf), gate_columns(), CELLS, LOW_IS_GOOD)
        flip = F.when(F.col("strategy").isin(*[s for s, c in STRATEGIES.items() if c.get("invert")]), -F.col("composite")).otherwise(F.col("composite"))
        return tr.ranked(rounded(out.withColumn("composite", flip), 9))

    return kept(spark, sf, "scores", make)


CELL = "as_of, strategy, factor"
def scores_sql(cells: list[tuple[str, str, float]], gates: dict[str, dict]) -> str:
    """Table expressions up to ``scores`` for strategies given by (strategy, factor, weight) and their gates."""
    return "with " + FRAME + ",\n" + ctes("bars", "sessions", "as_of").replace("with ", "", 1) + f""",
weights(strategy, factor, weight) as (values {", ".join(f"('{s}', '{f}', {w}::double)" for s, f, w in cells)}),
long as ({" union all ".join(f'''select as_of, '{s}' as strategy, '{f}' as factor, ticker, sector, "{f}"::double as value from frame where {gate_sql(gates.get(s, {}))}''' for s, f, _ in cells)}),
q as (select *, quantile_cont(value, 0.01) over c as lo, quantile_cont(value, 0.99) over c as hi, count(value) over c as n from long window c as (partition by {CELL})),
w as (select *, case when n >= 3 and lo < hi and value is not null then greatest(lo, least(hi, value)) else value end as winsorized from q),
z as (select *, {pr.z_sql("winsorized", CELL)} as z, {pr.z_sql("winsorized", CELL + ", sector")} as zs, count(winsorized) over (partition by {CELL}, sector) as ns from w),
scored as (select *, (case when ns >= 5 then zs else z end) * (case when factor in {LOW_IS_GOOD} then -1 else 1 end) as score from z),
agg as (select as_of, strategy, ticker, sum(score * weight) as s, sum(case when score is not null then weight end) as got from scored join weights using (strategy, factor) group by all),
comp as (select as_of, strategy, ticker, round(coalesce(got, 0) / whole, 9) + 0.0 as coverage, case when coalesce(got, 0) / whole >= 0.5 then round(s / got * (case when strategy = '{VETO}' then -1 else 1 end), 9) + 0.0 end as composite
  from agg join (select strategy, sum(weight) as whole from weights group by 1) using (strategy)),
scores as materialized (select *, case when composite is not null then rank() over (partition by as_of, strategy order by composite desc nulls last) end as rank,
  case when composite is not null then (rank() over (partition by as_of, strategy order by composite nulls last) + (count(composite) over (partition by as_of, strategy, composite) - 1) / 2.0)
    / count(composite) over (partition by as_of, strategy) end as percentile from comp),
grid as (select t.ticker, s.session, s.date, b.close, b.low, last_value(b.close ignore nulls) over (partition by t.ticker order by s.session rows unbounded preceding) as close_ff
  from (select ticker, min(session) as f from bars join sessions using (date) group by 1) t join sessions s on s.session >= t.f left join bars b on b.ticker = t.ticker and b.date = s.date),
securities as (select ticker, sector, any_value(as_of) as d from frame group by all)"""


SCORES = scores_sql(CELLS, {s: c["gates"] for s, c in STRATEGIES.items()})


def composites(spark, sf):
    return rounded(scores(spark, sf))


def screen(spark, sf):
    """The ten best of each strategy, no sector with more than three unless the list would stay short."""
    sectors = read(spark, sf, "securities").select("ticker", "sector")
    df = tr.shortlist(scores(spark, sf).join(sectors, "ticker"), 10)
    return rounded(df.select("as_of", "strategy", "ticker", "sector", "rank", "place", "composite", "coverage"))


def ic(spark, sf) -> DataFrame:
    """Rank correlation of each strategy's composite with the next quarter's return."""
    from pitgrid.operators.evaluation import forward_returns, rank_ic

    fwd = forward_returns(pr.grid(spark, sf), read(spark, sf, "as_of"), 13)
    return rounded(rank_ic(scores(spark, sf).join(fwd, ["as_of", "ticker"]), "composite", "fwd", ["as_of", "strategy"], 8))


def standing(spark, sf) -> DataFrame:
    return pn.standing(frame(spark, sf), gate_columns(), scores(spark, sf))


def voted(spark, sf) -> DataFrame:
    families = spark.createDataFrame([(s, f) for f, members in FAMILIES.items() for s in members], "strategy string, family string")
    return rounded(pn.family_votes(standing(spark, sf), families, views(spark, sf), VETO), 9)


VOTES = SCORES + f""",
gate as ({" union all ".join(f"select as_of, ticker, '{s}' as strategy, ({gate_sql(c['gates'])}) as ok from frame" for s, c in STRATEGIES.items())}),
stand as (select g.as_of, g.ticker, g.strategy, case when ok then percentile else 0.0 end as pct from gate g left join scores s using (as_of, ticker, strategy)),
fam as (select as_of, ticker, case {" ".join(f"when strategy in ({', '.join(repr(s) for s in m)}) then '{f}'" for f, m in FAMILIES.items())} end as family, avg(pct) as p from stand
  where strategy in ({", ".join(repr(s) for m in FAMILIES.values() for s in m)}) group by all),
fv as (select as_of, ticker, coalesce(sum((p >= 0.8)::int), 0) as votes, avg(p) as mean, count(p) as families from fam group by all),
vx as (select fv.*, f."LLM_EARNINGS_VIEW" as view, coalesce(x.pct >= 0.9, false) as vetoed from fv join frame f using (as_of, ticker) left join (select * from stand where strategy = '{VETO}') x using (as_of, ticker)),
v1 as (select as_of, ticker, votes + case when view >= 1 then 1 when view <= -1 then -1 else 0 end - vetoed::int as votes, round(mean, 9) + 0.0 as mean, families + (view is not null)::int as families, vetoed from vx),
vc as (select *, case when families >= 2 then round(votes + 0.5 * coalesce(mean, 0), 9) + 0.0 end as composite from v1)"""


def consensus(spark, sf):
    return rounded(pn.vote_labels(voted(spark, sf), len(FAMILIES) + 1))


def signal_rows(spark, sf):
    """Signals of every strategy: long-term, mid-term or avoid, by its horizon and whether it is inverted."""
    extra = ["PCT_VS_MA200", "INSIDER_NET_BUY", "RSI_14", "ATR_PCT", "PIOTROSKI_F", "EVENT_MANAGEMENT", "EVENT_RESTRUCTURING", "ACCRUALS"]
    df = scores(spark, sf).where("composite is not null").join(frame(spark, sf).select("as_of", "ticker", *extra), ["as_of", "ticker"])
    df = sg.avoid(sg.mid_term(sg.long_term(df)))
    kind = F.create_map(*[x for s, c in STRATEGIES.items() for x in (F.lit(s), F.lit("avoid" if c.get("invert") else c["horizon"]))])[F.col("strategy")]
    pick = lambda what: F.when(kind == "avoid", F.col(f"avoid_{what}")).when(kind == "long", F.col(f"long_{what}")).otherwise(F.col(f"mid_{what}")).alias(what)
    return df.select("as_of", "strategy", "ticker", pick("signal"), pick("score"), pick("reasons"))


LONG_SIGNAL = """(case when percentile >= 0.9 then 3 when percentile >= 0.75 then 2 when percentile >= 0.5 then 1 when percentile >= 0.25 then -1 else -2 end
  + case when "PCT_VS_MA200" > 0 then 1 when "PCT_VS_MA200" < -0.10 then -1 else 0 end + case when "INSIDER_NET_BUY" > 0.3 then 1 when "INSIDER_NET_BUY" < -0.3 then -0.5 else 0 end)"""
MID_SIGNAL = """(case when percentile >= 0.9 then 3 when percentile >= 0.75 then 2 when percentile >= 0.5 then 1 when percentile >= 0.3 then -0.5 else -2 end
  + case when "RSI_14" between 45 and 65 then 1 when "RSI_14" > 78 then -1.5 when "RSI_14" < 30 then 0.5 else 0 end + case when "ATR_PCT" > 0.06 then -1 when "ATR_PCT" < 0.015 then 0.5 else 0 end
  + case when "INSIDER_NET_BUY" > 0.3 then 1 else 0 end)"""
SIGNALS = SCORES + f""",
sj as (select s.*, f.* exclude (as_of, ticker, sector), case {" ".join(f"when s.strategy = '{s}' then '{'avoid' if c.get('invert') else c['horizon']}'" for s, c in STRATEGIES.items())} end as kind
  from scores s join frame f using (as_of, ticker) where composite is not null),
sg as (select *, {LONG_SIGNAL}::double as ls, {MID_SIGNAL}::double as ms from sj)
select as_of, strategy, ticker,
case kind when 'avoid' then case when percentile >= 0.9 then '🔴 Avoid — deteriorating' when percentile >= 0.75 then '🟠 Caution — weakening' else '⚪ No flag' end
  when 'long' then case when ls >= 5 then '🟢 Strong Buy — accumulate' when ls >= 3 then '🟢 Buy' when ls >= 1 then '🟡 Hold / add on weakness' when ls >= -1 then '⚪ Neutral' when ls >= -3 then '🟠 Trim' else '🔴 Avoid' end
  else case when ms >= 5 then '🟢 Enter — full size' when ms >= 3.5 then '🟢 Enter — half size' when ms >= 2 then '🟡 Watch for trigger' when ms >= 0 then '⚪ No setup' else '🔴 Avoid' end end as signal,
case kind when 'avoid' then case when percentile >= 0.9 then -3.0 when percentile >= 0.75 then -1.5 else 0.0 end when 'long' then ls else ms end as score,
case kind when 'avoid' then concat_ws('; ', case when "PIOTROSKI_F" <= 3 then printf('Piotroski %.0f/9', "PIOTROSKI_F"::double) end, case when "PCT_VS_MA200" < 0 then printf('%.0f%% below 200-day', "PCT_VS_MA200" * 100) end,
    case when "INSIDER_NET_BUY" < -0.3 then 'Insiders net sellers' end, case when "EVENT_MANAGEMENT" > 0 then 'Management change filed' end, case when "EVENT_RESTRUCTURING" > 0 then 'Restructuring filed' end,
    case when "ACCRUALS" > 0.05 then 'Earnings well ahead of cash flow' end)
  when 'long' then concat_ws('; ', case when percentile >= 0.9 then 'Top-decile composite' when percentile >= 0.75 then 'Top-quartile composite' when percentile >= 0.5 then 'Above-median composite' when percentile >= 0.25 then 'Below-median composite' else 'Bottom-quartile composite' end,
    case when "PCT_VS_MA200" > 0 then printf('Uptrend (+%.0f%% vs 200d)', "PCT_VS_MA200" * 100) when "PCT_VS_MA200" < -0.10 then 'Well below 200-day MA' end, case when "INSIDER_NET_BUY" > 0.3 then 'Insiders net buyers' when "INSIDER_NET_BUY" < -0.3 then 'Insider selling' end)
  else concat_ws('; ', case when percentile >= 0.9 then 'Top-decile setup' when percentile >= 0.75 then 'Strong setup' when percentile >= 0.5 then 'Positive setup' when percentile >= 0.3 then 'Marginal setup' else 'Weak setup' end,
    case when "RSI_14" between 45 and 65 then printf('Constructive RSI (%.0f)', "RSI_14") when "RSI_14" > 78 then printf('Extended (RSI %.0f)', "RSI_14") when "RSI_14" < 30 then printf('Oversold (RSI %.0f)', "RSI_14") end,
    case when "ATR_PCT" > 0.06 then printf('Very volatile (ATR %.1f%%/day)', "ATR_PCT" * 100) when "ATR_PCT" < 0.015 then 'Orderly volatility' end, case when "INSIDER_NET_BUY" > 0.3 then 'Insiders net buyers' end) end as reasons from sg"""


def plan_rows(spark, sf) -> DataFrame:
    """A plan for every shortlisted name of the strategies that take one, by the strategy's setup."""
    picks = screen(spark, sf).select("as_of", "strategy", "ticker")
    df = picks.join(frame(spark, sf).select("as_of", "ticker", "PRICE", "ATR_14", "SWING_LOW"), ["as_of", "ticker"])
    # a weekly bar's range is wide, so more is allowed than of daily bars
    made = None
    for setup in ("breakout", "pullback", "momentum"):
        own = [s for s, c in STRATEGIES.items() if c.get("setup", "momentum") == setup and c["horizon"] == "mid" and not c.get("invert")]
        part = sg.trade_plans(df.where(F.col("strategy").isin(*own)), setup, stop_ranges=0.5, max_stop=0.99)
        made = part if made is None else made.unionByName(part)
    return made


def plans(spark, sf):
    return rounded(plan_rows(spark, sf).select("as_of", "strategy", "ticker", "entry", "entry_type", "stop", "target", "basis", "stop_pct", "target_pct", "weight"))


SCREEN = f""",
pos as (select s.*, sector, row_number() over (partition by as_of, strategy, sector order by rank, ticker) as p from scores s join (select distinct ticker, sector from securities) using (ticker) where rank is not null),
kk as (select *, row_number() over (partition by as_of, strategy order by p, rank, ticker) as k from pos),
cap as (select *, greatest(3, coalesce(max(case when k = 10 then p end) over (partition by as_of, strategy), max(p) over (partition by as_of, strategy))) as c from kk),
placed as (select * from (select *, row_number() over (partition by as_of, strategy order by rank, ticker) as place from cap where p <= c) where place <= 10)"""
PLANS = SCORES + SCREEN + f""",
p0 as (select as_of, strategy, ticker, "PRICE" as px, "ATR_14" as atr, "SWING_LOW" as sw, strategy = 'breakout' as out_ from placed join frame using (as_of, ticker)
  where strategy in ({", ".join(repr(s) for s, c in STRATEGIES.items() if c["horizon"] == "mid" and not c.get("invert"))}) and "PRICE" > 0 and "ATR_14" > 0),
p1 as (select *, coalesce(sw < px and sw < px - 0.5 * atr, false) as far from p0),
p2 as (select *, case when far then sw * 0.995 else px - 0.5 * atr end as stop, case when far then 'swing_low' else 'atr' end as basis from p1),
p3 as (select *, case when not out_ and px - 0.5 * atr > stop then px - 0.5 * atr else px end as entry, case when not out_ and px - 0.5 * atr > stop then 'pullback' else 'market' end as entry_type
  from p2 where stop > 0 and stop < px and (px - stop) / px <= 0.99)"""


def dollar(spark, sf) -> DataFrame:
    return pn.dollar_volume(pr.grid(spark, sf), read(spark, sf, "as_of"))


ADV = """adv as (select ticker, session, avg(close * volume) over (partition by ticker order by session rows 19 preceding) as adv, close_ff as price from (
  select t.ticker, s.session, b.close, b.volume, last_value(b.close ignore nulls) over (partition by t.ticker order by s.session rows unbounded preceding) as close_ff
  from (select ticker, min(session) as f from bars join sessions using (date) group by 1) t join sessions s on s.session >= t.f left join bars b on b.ticker = t.ticker and b.date = s.date))"""


def universe_rows(spark, sf):
    """Names of three regions that trade enough and aren't too small, the largest half hundred of each date."""
    caps = frame(spark, sf).select("as_of", "ticker", F.col("MARKET_CAP").alias("market_cap"))
    names = read(spark, sf, "securities").select("ticker", "sector", "country")
    df = dollar(spark, sf).join(caps, ["as_of", "ticker"], "left").join(names, "ticker")
    return rounded(pn.universe(df, ["ASIA", "EUROPE", "AMERICA"], min_price=10_000, min_adv=500_000, min_cap=1e6, max_cap=1e9, most=50).select("as_of", "ticker", "sector", "country", "price", "adv", "market_cap"), 4)


def fwd_months(spark, sf) -> DataFrame:
    return pn.forward_months(read(spark, sf, "bars").select("ticker", "date", "close"), read(spark, sf, "as_of"))


def _fwd(m: int) -> str:
    at = lambda d: f"(select case when ({d})::date - max(date) <= 35 then arg_max(close, date) end from bars b where b.ticker = n.ticker and b.date <= ({d})::date)"
    end = f"a.as_of + interval {m} month"
    return f"round(case when ({end})::date <= (select max(date) from bars) + 7 then {at(end)} / nullif({at('a.as_of')}, 0) - 1 end, 6) + 0.0 as fwd_{m}m"


FWD_MONTHS = ctes("bars", "as_of", "sessions") + f" select a.as_of, n.ticker, {_fwd(1)}, {_fwd(3)}, {_fwd(6)} from as_of a join (select ticker, min(date) as f from bars group by 1) n on a.as_of >= n.f"
IC_FACTORS = ("MOM_12_1", "VOL_1Y", "EARNINGS_YIELD", "ROIC", "ACCRUALS", "INSIDER_NET_BUY", "EARNINGS_REACTION", "PCT_VS_MA200")


def factor_ics(spark, sf):
    """Sector-neutral rank correlation of factors with the next three months, for every date."""
    long = frame(spark, sf).select("as_of", "ticker", "sector", *[F.col(f).cast("double").alias(f) for f in IC_FACTORS]).unpivot(["as_of", "ticker", "sector"], list(IC_FACTORS), "factor", "value")
    return rounded(pn.factor_ic(long.join(rounded(fwd_months(spark, sf)), ["as_of", "ticker"]), "fwd_3m", True, 8))


def long_used(spark, sf) -> DataFrame:
    return frame(spark, sf).select("as_of", "ticker", *[F.col(f).cast("double").alias(f) for f in USED]).unpivot(["as_of", "ticker"], list(USED), "factor", "value")


def plain_weights(spark) -> DataFrame:
    return spark.createDataFrame(CELLS, "strategy string, factor string, weight double")


def available(spark, sf) -> DataFrame:
    return pn.availability(long_used(spark, sf), plain_weights(spark))


AVAILABLE = "with " + FRAME + f""",
weights(strategy, factor, weight) as (values {", ".join(f"('{s}', '{f}', {w}::double)" for s, f, w in CELLS)}),
cv as ({" union all ".join(f'''select as_of, '{f}' as factor, avg(("{f}" is not null)::int) as coverage from frame group by 1''' for f in USED)}),
av as (select as_of, strategy, factor, weight, coverage, case when coverage < 0.5 and factor in ('FORWARD_PE', 'TRAILING_PE', 'LLM_EARNINGS_VIEW') then 'live_only' when coverage < 0.1 then 'empty' when coverage < 0.5 then 'sparse' else 'ok' end as status from cv join weights using (factor))"""


def honest(spark, sf):
    return rounded(pn.degraded(available(spark, sf)))


def shares(spark, sf):
    """Weight shares of every strategy, and with momentum at two fifths."""
    return rounded(pn.rebalanced(plain_weights(spark).join(available(spark, sf).select("factor").distinct(), "factor", "left_semi"), "MOM_12_1", 0.4).select("strategy", "factor", "share"))


def pending(spark, sf):
    return pn.pending_reviews(read(spark, sf, "corporate_events"), read(spark, sf, "reviews"), read(spark, sf, "as_of").select("as_of"))


def members_only(spark, sf):
    """The frame's rows of names that a source's snapshot holds at that date."""
    held = al.membership(spark, sf).where("source = 'a'").select("as_of", "ticker")
    return rounded(pn.restricted(frame(spark, sf), held).select("as_of", "ticker", "sector", "MARKET_CAP", "MOM_12_1", "ROIC"))


def r(names, digits: int = 6) -> str:
    return pr.cols(names, digits)


QUERIES = {
    "earnings_reaction": (reaction, REACTION),
    "earnings_views": (views, VIEWS),
    "factor_panel": (panel_rows, "with " + FRAME + " select as_of, ticker, sector, " + ", ".join(f'"{c}"' if c in ("PIOTROSKI_F", "INSIDER_CLUSTER", "EVENT_INTENSITY_90D", *[f"EVENT_{x.upper()}" for x in al.CATEGORIES]) else f'round("{c}"::double, 6) + 0.0 as "{c}"' for c in FRAME_COLUMNS) + " from frame"),
    "factor_panel_members": (members_only, al.MEMBERS + ", " + FRAME + f" select f.as_of, f.ticker, f.sector, {r(('MARKET_CAP', 'MOM_12_1', 'ROIC'))} from frame f where exists (select 1 from mem m where m.source = 'a' and m.as_of = f.as_of and m.ticker = f.ticker)"),
    "composite_scores": (composites, SCORES + f" select as_of, strategy, ticker, {r(('coverage', 'composite'))}, rank, round(percentile, 6) + 0.0 as percentile from scores"),
    "screen_momentum": (screen, SCORES + SCREEN + f" select as_of, strategy, ticker, sector, rank, place, {r(('composite', 'coverage'))} from placed"),
    "strategy_rank_ic": (ic, SCORES + """,
fw as (select a.as_of, x.ticker, y.close_ff / nullif(x.close_ff, 0) - 1 as fwd from as_of a join grid x on x.session = a.session join grid y on y.ticker = x.ticker and y.session = a.session + 13),
j as (select as_of, strategy, composite as a, fwd as b from scores join fw using (as_of, ticker) where composite is not null and fwd is not null),
rk as (select as_of, strategy, rank() over (partition by as_of, strategy order by a) + (count(*) over (partition by as_of, strategy, a) - 1) / 2.0 as ra,
  rank() over (partition by as_of, strategy order by b) + (count(*) over (partition by as_of, strategy, b) - 1) / 2.0 as rb from j)
select as_of, strategy, case when count(*) >= 8 then round(corr(ra, rb), 6) + 0.0 end as ic, count(*) as n from rk group by all"""),
    "consensus_votes": (consensus, VOTES + f""" select as_of, ticker, votes, round(mean, 6) + 0.0 as mean, families, vetoed, round(composite, 6) + 0.0 as composite, case when vetoed and votes <= 1 then '🔴 Avoid — on the avoid list'
when votes >= 3 then '🟢 Strong Buy — ' || votes || ' of {len(FAMILIES) + 1} families agree' when votes = 2 then '🟢 Buy — 2 of {len(FAMILIES) + 1} families agree' when votes = 1 then '🟡 Hold / watch — 1 family' else '⚪ Neutral — no family agrees' end as signal from vc"""),
    "signals": (signal_rows, SIGNALS),
    "trade_plans": (plans, PLANS + """
select as_of, strategy, ticker, round(entry, 6) + 0.0 as entry, entry_type, round(stop, 6) + 0.0 as stop, round(entry + 2 * (entry - stop), 6) + 0.0 as target, basis, round((entry - stop) / entry, 6) + 0.0 as stop_pct,
round(2 * (entry - stop) / entry, 6) + 0.0 as target_pct, round(greatest(0.01, least(0.10, 0.01 / ((entry - stop) / entry))), 6) + 0.0 as weight from p3"""),
    "dollar_volume": (lambda s, d: rounded(dollar(s, d), 4), ctes("bars", "sessions", "as_of") + ", " + ADV + " select as_of, ticker, round(price, 4) + 0.0 as price, round(adv, 4) + 0.0 as adv from adv join as_of using (session)"),
    "universe": (universe_rows, "with " + FRAME + ",\n" + ctes("bars", "sessions", "as_of", "securities").replace("with ", "", 1) + ", " + ADV + """,
u as (select as_of, a.ticker, s.sector, s.country, a.price, a.adv, f."MARKET_CAP" as market_cap from adv a join as_of using (session) left join frame f using (as_of, ticker) join securities s on s.ticker = a.ticker
  where s.sector in ('ASIA', 'EUROPE', 'AMERICA') and a.price >= 10000 and a.adv >= 500000 and (f."MARKET_CAP" is null or f."MARKET_CAP" between 1e6 and 1e9))
select as_of, ticker, sector, country, round(price, 4) + 0.0 as price, round(adv, 4) + 0.0 as adv, round(market_cap, 4) + 0.0 as market_cap from u qualify row_number() over (partition by as_of order by market_cap desc nulls last, ticker) <= 50"""),
    "forward_months": (lambda s, d: rounded(fwd_months(s, d)), FWD_MONTHS),
    "factor_ic": (factor_ics, "with " + FRAME + f", fm as ({FWD_MONTHS})," + f"""
lg as ({" union all ".join(f'''select as_of, ticker, sector, '{f}' as factor, "{f}"::double as value from frame''' for f in IC_FACTORS)}),
dm as (select as_of, factor, round(value - avg(value) over (partition by as_of, factor, sector), 12) as x, round(fwd_3m - avg(fwd_3m) over (partition by as_of, factor, sector), 12) as y from lg join fm using (as_of, ticker) where value is not null and fwd_3m is not null),
rk as (select as_of, factor, rank() over (partition by as_of, factor order by x) + (count(*) over (partition by as_of, factor, x) - 1) / 2.0 as a, rank() over (partition by as_of, factor order by y) + (count(*) over (partition by as_of, factor, y) - 1) / 2.0 as b from dm)
select as_of, factor, case when count(*) >= 8 then round(corr(a, b), 6) + 0.0 end as ic, count(*) as n from rk group by all"""),
    "factor_availability": (lambda s, d: rounded(available(s, d)), AVAILABLE + " select as_of, strategy, factor, weight, round(coverage, 6) + 0.0 as coverage, status from av"),
    "degraded_dates": (honest, AVAILABLE + " select as_of, strategy, count(case when status <> 'ok' then 1 end) as bad, count(*) as factors, round(coalesce(sum(case when status <> 'ok' then weight end) / sum(weight), 0), 6) + 0.0 as lost, count(case when status <> 'ok' then 1 end) = 0 as honest from av group by all"),
    "weight_shares": (shares, AVAILABLE + """, sh as (select *, weight / sum(weight) over (partition by strategy) as share from (select distinct strategy, factor, weight from av)), ow as (select *, max(case when factor = 'MOM_12_1' then share end) over (partition by strategy) as own from sh)
select strategy, factor, round(case when own is null then share when factor = 'MOM_12_1' then 0.4 else share * 0.6 / nullif(1 - own, 0) end, 6) + 0.0 as share from ow"""),
    "reviews_pending": (pending, ctes("corporate_events", "reviews", "as_of") + """ select a.as_of, e.ticker, e.filed, e.accession from corporate_events e join as_of a on e.filed <= a.as_of and e.filed > a.as_of - 120
where item_code = '2.02' and not exists (select 1 from reviews r where r.ticker = e.ticker and r.accession = e.accession)"""),
}
