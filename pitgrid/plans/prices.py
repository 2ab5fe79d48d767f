"""Price queries: factors, transforms, screens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitgrid.functions.scalars import inverse_normal_sql
from pitgrid.operators import timeseries as ts
from pitgrid.operators import transforms as tr
from pitgrid.plans.fixtures import ctes, read
from pitgrid.plans.kept import kept


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum doesn't show; a negative zero is zero."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def grid(spark: SparkSession, sf: str) -> DataFrame:
    return kept(spark, sf, "grid", lambda: ts.filled(read(spark, sf, "bars"), read(spark, sf, "sessions")))


GRID = ctes("bars", "sessions", "market", "as_of", "securities") + """,
grid as (select t.ticker, s.session, s.date, b.open, b.high, b.low, b.close, b.volume,
  last_value(b.close ignore nulls) over (partition by t.ticker order by s.session rows unbounded preceding) as close_ff
  from (select ticker, min(session) as f from bars join sessions using (date) group by 1) t join sessions s on s.session >= t.f
  left join bars b on b.ticker = t.ticker and b.date = s.date),
r as (select *, close_ff / nullif(lag(close_ff) over w, 0) - 1 as ret, close_ff - lag(close_ff) over w as delta,
  case when lag(close_ff) over w is not null and high is not null and low is not null then
    greatest(high - low, abs(high - lag(close_ff) over w), abs(low - lag(close_ff) over w)) end as tr
  from grid window w as (partition by ticker order by session))"""
TRAILING = """,
t1 as (select *, lag(close_ff, 21) over w / nullif(lag(close_ff, 252) over w, 0) - 1 as "MOM_12_1", lag(close_ff, 21) over w / nullif(lag(close_ff, 126) over w, 0) - 1 as "MOM_6_1",
  close_ff / nullif(lag(close_ff, 21) over w, 0) - 1 as "RETURN_1M", close_ff / nullif(lag(close_ff, 63) over w, 0) - 1 as "RETURN_3M",
  close_ff / nullif(lag(close_ff, 126) over w, 0) - 1 as "RETURN_6M", close_ff / nullif(lag(close_ff, 252) over w, 0) - 1 as "RETURN_1Y",
  stddev_samp(ret) over w252 * sqrt(252) as "VOL_1Y", stddev_samp(ret) over w63 * sqrt(252) as "VOL_3M",
  case when count(close_ff) over w50 = 50 then avg(close_ff) over w50 end as "MA50", case when count(close_ff) over w200 = 200 then avg(close_ff) over w200 end as "MA200",
  close_ff / max(close_ff) over w252 - 1 as "PCT_FROM_52W_HIGH", close_ff / min(close_ff) over w252 - 1 as "PCT_FROM_52W_LOW", min(low) over w40 as "SWING_LOW"
  from r window w as (partition by ticker order by session), w252 as (partition by ticker order by session rows 251 preceding), w63 as (partition by ticker order by session rows 62 preceding),
  w50 as (partition by ticker order by session rows 49 preceding), w200 as (partition by ticker order by session rows 199 preceding), w40 as (partition by ticker order by session rows 39 preceding)),
t2 as (select *, -"RETURN_1M" as "REVERSAL_1M", "MOM_12_1" / nullif("VOL_1Y", 0) as "MOM_VOL_ADJ", close_ff / "MA50" - 1 as "PCT_VS_MA50", close_ff / "MA200" - 1 as "PCT_VS_MA200",
  case when "MA200" is not null then (close_ff > "MA200")::int end as "ABOVE_MA200", close_ff as "PRICE" from t1)"""
TRAILING_COLUMNS = ("MOM_12_1", "MOM_6_1", "RETURN_1M", "RETURN_3M", "RETURN_6M", "RETURN_1Y", "REVERSAL_1M", "VOL_1Y", "VOL_3M", "MOM_VOL_ADJ", "PCT_FROM_52W_HIGH",
                    "PCT_FROM_52W_LOW", "PCT_VS_MA50", "MA50", "PCT_VS_MA200", "MA200", "ABOVE_MA200", "SWING_LOW", "PRICE")
SEEN = """,
seen as (select a.as_of, r.*, a.session - r.session as age from r join as_of a on r.session <= a.session and r.session > a.session - 504),
ew as (select as_of, ticker, age, greatest(delta, 0) as g, greatest(-delta, 0) as l, delta, tr,
  max(case when delta is not null then age end) over (partition by as_of, ticker) as first_d, max(case when tr is not null then age end) over (partition by as_of, ticker) as first_t from seen),
momentum as (select as_of, ticker, count(*) as n,
  sum(case when delta is not null then g * pow(1 - 1/14.0, age) * (case when age = first_d then 1 else 1/14.0 end) end) as g,
  sum(case when delta is not null then l * pow(1 - 1/14.0, age) * (case when age = first_d then 1 else 1/14.0 end) end) as l,
  sum(case when tr is not null then tr * pow(1 - 1/14.0, age) * (case when age = first_t then 1 else 1/14.0 end) end) as "ATR_14" from ew group by 1, 2),
mret as (select session, m.close / nullif(lag(m.close) over (order by session), 0) - 1 as mret from market m join sessions using (date)),
paired as (select s.*, m.mret from seen s left join mret m using (session) where s.age < 252),
b as (select as_of, ticker, count(case when ret is not null and mret is not null then 1 end) as n, covar_samp(ret, mret) / nullif(var_samp(mret), 0) as beta from paired group by 1, 2),
ratio as (select p.as_of, p.ticker, any_value(case when b.n >= 60 then b.beta end) as "BETA",
  case when any_value(b.n) >= 60 then stddev_samp(p.ret - b.beta * p.mret) * sqrt(252) end as "IDIO_VOL" from paired p join b using (as_of, ticker) group by 1, 2),
dd as (select as_of, ticker, min(d) as "MAX_DD_1Y" from (select as_of, ticker, close_ff / max(close_ff) over (partition by as_of, ticker order by session rows unbounded preceding) - 1 as d
  from seen where age < 252) group by 1, 2)"""


def cols(names, digits: int = 6) -> str:
    return ", ".join(f'round("{c}", {digits}) + 0.0 as "{c}"' for c in names)


def trailing(spark, sf):
    return panel(spark, sf).select("as_of", "ticker", *TRAILING_COLUMNS)


PATH_COLUMNS = ("RSI_14", "ATR_14", "ATR_PCT", "BETA", "IDIO_VOL", "MAX_DD_1Y")


def panel(spark, sf) -> DataFrame:
    """All price factors at all dates."""

    def make() -> DataFrame:
        r = lambda n: read(spark, sf, n)
        full = ts.price_factors(r("bars"), r("sessions"), r("market"), r("as_of"))
        return rounded(full.select("as_of", "ticker", *[F.col(c).cast("double").alias(c) for c in (*TRAILING_COLUMNS, *PATH_COLUMNS)]))

    return kept(spark, sf, "price-factors", make)


def path_factors(spark, sf):
    return panel(spark, sf).select("as_of", "ticker", *PATH_COLUMNS)


PATH_SQL = GRID + SEEN + """
select as_of, ticker, round(case when m.n >= 15 then case when l > 0 then 100 - 100 / (1 + g / l) when g > 0 then 100 end end, 6) + 0.0 as "RSI_14",
round("ATR_14", 6) + 0.0 as "ATR_14", round("ATR_14" / r.close_ff, 6) + 0.0 as "ATR_PCT", round("BETA", 6) + 0.0 as "BETA", round("IDIO_VOL", 6) + 0.0 as "IDIO_VOL", round("MAX_DD_1Y", 6) + 0.0 as "MAX_DD_1Y"
from momentum m join ratio using (as_of, ticker) join dd using (as_of, ticker) join as_of a using (as_of) join r on r.ticker = m.ticker and r.session = a.session"""


def adjusted(spark, sf):
    return rounded(ts.adjusted_bars(read(spark, sf, "bars")))


FACTORS = ("MOM_12_1", "MOM_6_1", "VOL_1Y", "PCT_VS_MA200", "REVERSAL_1M", "PCT_FROM_52W_HIGH", "MOM_VOL_ADJ", "PCT_VS_MA50")
#: Factors whose low values are good.
LOW_IS_GOOD = ("VOL_1Y", "VOL_3M", "BETA", "IDIO_VOL", "ATR_PCT")


def long_factors(spark, sf) -> DataFrame:
    """(as_of, factor, ticker, value, sector, size) of the trailing price factors."""
    wide = panel(spark, sf).select("as_of", "ticker", "PRICE", *FACTORS)
    long = wide.unpivot(["as_of", "ticker", "PRICE"], list(FACTORS), "factor", "value")
    sectors = read(spark, sf, "securities").select("ticker", "sector")
    return long.join(sectors, "ticker", "left").select("as_of", "factor", "ticker", "value", F.coalesce("sector", F.lit("Unknown")).alias("sector"), F.col("PRICE").alias("size"))


LONG = GRID + TRAILING + """,
wide as (select a.as_of, ticker, round("PRICE", 6) + 0.0 as "PRICE", """ + ", ".join(f'round("{f}", 6) + 0.0 as "{f}"' for f in FACTORS) + """ from t2 join as_of a using (session)),
long0 as (""" + " union all ".join(f"""select as_of, '{f}' as factor, ticker, "{f}" as value, "PRICE" as size from wide""" for f in FACTORS) + """),
long as (select l.*, coalesce(s.sector, 'Unknown') as sector from long0 l left join securities s using (ticker))"""
WINSOR = """,
q as (select *, quantile_cont(value, 0.01) over c as lo, quantile_cont(value, 0.99) over c as hi, count(value) over c as n from long window c as (partition by as_of, factor)),
w as (select *, case when n >= 3 and lo < hi and value is not null then greatest(lo, least(hi, value)) else value end as winsorized from q)"""


def z_sql(x: str, part: str) -> str:
    sd = f"stddev_samp({x}) over (partition by {part})"
    return f"case when {x} is null or count({x}) over (partition by {part}) < 2 then null when {sd} > 1e-12 then ({x} - avg({x}) over (partition by {part})) / {sd} else 0.0 end"


CELL = "as_of, factor"
SCORED = WINSOR + f""",
z as (select *, {z_sql("winsorized", CELL)} as z, {z_sql("winsorized", CELL + ", sector")} as zs, count(winsorized) over (partition by {CELL}, sector) as ns,
  (rank() over (partition by {CELL} order by winsorized nulls last) + (count(winsorized) over (partition by {CELL}, winsorized) - 1) / 2.0) as ar,
  count(winsorized) over (partition by {CELL}) as nw from w),
scored as (select *, case when ns >= 5 then zs else z end as sector_z, case when winsorized is not null then ar / nw end as pct_rank,
  (case when ns >= 5 then zs else z end) * (case when factor in {LOW_IS_GOOD} then -1 else 1 end) as score from z)"""


def directions(spark) -> DataFrame:
    return spark.createDataFrame([(f, -1) for f in LOW_IS_GOOD], "factor string, direction int")


def scored(spark, sf) -> DataFrame:
    return tr.prepare(long_factors(spark, sf), directions(spark))


def prepared(spark, sf):
    return rounded(scored(spark, sf).select("as_of", "factor", "ticker", "winsorized", "z", "sector_z", "pct_rank", "score"))


def mad(spark, sf):
    df = tr.robust_zscore(tr.winsorize_mad(long_factors(spark, sf)), "winsorized", "robust_z")
    return rounded(df.select("as_of", "factor", "ticker", "winsorized", "robust_z"))


def neutral(spark, sf):
    df = tr.neutralize(tr.winsorize(long_factors(spark, sf)))
    return rounded(df.select("as_of", "factor", "ticker", "neutral"))


def normal_scores(spark, sf):
    df = tr.winsorize(long_factors(spark, sf)).withColumn("normal", tr.rank_to_normal("winsorized"))
    return rounded(df.select("as_of", "factor", "ticker", "normal"))


QUERIES = {
    "price_trailing_factors": (trailing, GRID + TRAILING + f" select a.as_of, ticker, {cols(TRAILING_COLUMNS)} from t2 join as_of a using (session)"),
    "price_path_factors": (path_factors, PATH_SQL),
    "adjusted_bars": (adjusted, ctes("bars") + """, f as (select *, adj_close / nullif(close, 0) as x from bars)
select ticker, date, round(open * k, 6) + 0.0 as open, round(high * k, 6) + 0.0 as high, round(low * k, 6) + 0.0 as low, round(close * k, 6) + 0.0 as close, volume from (select *,
coalesce(last_value(x ignore nulls) over (partition by ticker order by date rows unbounded preceding), first_value(x ignore nulls) over (partition by ticker order by date rows between current row and unbounded following), 1) as k from f)"""),
    "factor_transforms": (prepared, LONG + SCORED + f" select as_of, factor, ticker, {cols(('winsorized', 'z', 'sector_z', 'pct_rank', 'score'))} from scored"),
    "factor_winsorize_mad": (mad, LONG + WINSOR + f""",
m1 as (select *, median(value) over (partition by {CELL}) as med from w), m2 as (select *, median(abs(value - med)) over (partition by {CELL}) * 1.4826 as mad from m1),
m3 as (select *, case when value is null then null when mad > 0 then greatest(med - 5 * mad, least(med + 5 * mad, value)) else winsorized end as x from m2),
m4 as (select *, median(x) over (partition by {CELL}) as m from m3), m5 as (select *, median(abs(x - m)) over (partition by {CELL}) * 1.4826 as d from m4)
select as_of, factor, ticker, round(x, 6) + 0.0 as winsorized, round(case when d > 0 then (x - m) / d when x is not null then 0.0 end, 6) + 0.0 as robust_z from m5"""),
    "factor_neutralize": (neutral, LONG + WINSOR + f""",
l1 as (select *, case when winsorized is not null and size > 0 then ln(size) end as l from w),
l2 as (select *, count(winsorized) over (partition by {CELL}) as nv, count(l) over (partition by {CELL}) as nl, median(l) over (partition by {CELL}) as ml from l1),
l3 as (select *, case when winsorized is not null then coalesce(l, ml) end as ll from l2),
l4 as (select *, winsorized - avg(winsorized) over (partition by {CELL}, sector) as y, ll - avg(ll) over (partition by {CELL}, sector) as x from l3),
l5 as (select *, case when 2 * nl > nv then coalesce(sum(y * x) over (partition by {CELL}) / nullif(sum(x * x) over (partition by {CELL}), 0), 0) else 0 end as b from l4),
l6 as (select *, y - b * coalesce(x, 0) as e from l5)
select as_of, factor, ticker, round(case when nv >= 10 then {z_sql("e", CELL)} else {z_sql("winsorized", CELL)} end, 6) + 0.0 as neutral from l6"""),
    "factor_rank_normal": (normal_scores, LONG + SCORED + f"""
select as_of, factor, ticker, round(case when winsorized is not null then {inverse_normal_sql("(ar - 0.5) / nw")} end, 6) + 0.0 as normal from scored"""),
}
