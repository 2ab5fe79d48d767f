"""Price factors of every entity at every session, in one job over long bars."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitgrid.functions.scalars import safe_div

YEAR, HALF, QUARTER, MONTH = 252, 126, 63, 21


def filled(bars: DataFrame, sessions: DataFrame, fields: tuple[str, ...] = ("close",), parts: int | None = None) -> DataFrame:
    """Bars on every session from an entity's first on, ``fields`` carried forward.

    A bar gives the sessions up to the next one, as a sequence of its own, so bars are dealt by
    ticker once and nothing is joined to a product with the calendar.  With ``parts`` they are
    dealt to so many partitions.
    """
    numbered = bars.join(F.broadcast(sessions), "date").drop("date")  # as many rows as sessions
    if parts is not None:
        numbered = numbered.repartition(parts, "ticker")
    last = sessions.agg(F.max("session").alias("_last"))  # one row
    till = F.lead("session").over(Window.partitionBy("ticker").orderBy("session")) - 1
    spans = numbered.withColumn("_till", till).join(F.broadcast(last))
    spans = spans.withColumn("_s", F.explode(F.sequence("session", F.greatest("session", F.coalesce("_till", "_last")))))
    own = [F.when(F.col("_s") == F.col("session"), F.col(c)).alias(c) for c in numbered.columns if c not in ("ticker", "session")]
    grid = spans.select("ticker", F.col("_s").alias("session"), *own).join(F.broadcast(sessions), "session")
    order = Window.partitionBy("ticker").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    return grid.withColumns({f"{c}_ff": F.last(c, ignorenulls=True).over(order) for c in fields})


def by_session(start: int | None = None) -> Window:
    order = Window.partitionBy("ticker").orderBy("session")
    return order if start is None else order.rowsBetween(start, 0)


def session_return(px: Column, lookback: int, skip: int = 0) -> Column:
    w = by_session()
    return safe_div(F.lag(px, skip).over(w), F.lag(px, skip + lookback).over(w)) - 1


def lagged_factors(grid: DataFrame) -> DataFrame:
    """Returns over fixed numbers of sessions, from ``close_ff``."""
    px, w = F.col("close_ff"), by_session()
    df = grid.withColumn("ret", safe_div(px, F.lag(px).over(w)) - 1)
    returns = {
        "MOM_12_1": (231, 21), "MOM_6_1": (105, 21), "RETURN_1M": (MONTH, 0), "RETURN_3M": (QUARTER, 0), "RETURN_6M": (HALF, 0), "RETURN_1Y": (YEAR, 0),
    }
    return df.withColumns({k: session_return(px, *v) for k, v in returns.items()}).withColumn("PRICE", px)


def at_dates(rows: DataFrame, dates: DataFrame, lookback: int, columns: list[str]) -> DataFrame:
    """Per as-of date the rows of the last ``lookback`` sessions.

    ``age`` is 0 at the as-of session.  The dates are one row, which every row gets, so that rows
    dealt by ticker stay where they are.
    """
    asked = F.broadcast(dates.agg(F.collect_list(F.struct("as_of", F.col("session").alias("at"))).alias("_d")))  # one row
    seen = rows.select("ticker", "session", *columns).join(asked).select("ticker", "session", *columns, F.explode("_d").alias("_x"))
    seen = seen.where(f"session <= _x.at and session > _x.at - {lookback}")
    return seen.select("ticker", "session", *columns, F.col("_x.as_of").alias("as_of"), (F.col("_x.at") - F.col("session")).alias("age"))


def year_factors(grid: DataFrame, market: DataFrame, dates: DataFrame, least: int = 60) -> DataFrame:
    """Per (as_of, ticker) volatility, moving averages, distance from highs and lows, beta and what the
    market leaves, of the year before each date.

    Sums over the sessions that a date sees: a window that slides along all sessions would add up a
    year again for each of them.  A moving average needs all of its sessions.  Beta is the covariance
    of paired returns over the variance of all market returns seen.
    """
    px, ret, mret, age = F.col("close_ff"), F.col("ret"), F.col("mret"), F.col("age")
    seen = at_dates(grid.join(market.select("session", F.col("ret").alias("mret")), "session", "left"), dates, YEAR, ["close_ff", "low", "ret", "mret"])
    both = ret.isNotNull() & mret.isNotNull()
    last = lambda n, x: F.when(age < n, x)
    ma = lambda n: F.when(F.count(last(n, px)) == n, F.avg(last(n, px)))
    sums = seen.groupBy("ticker", "as_of").agg(
        (F.stddev_samp(ret) * math.sqrt(YEAR)).alias("VOL_1Y"), (F.stddev_samp(last(QUARTER, ret)) * math.sqrt(YEAR)).alias("VOL_3M"), ma(50).alias("MA50"), ma(200).alias("MA200"),
        F.max(px).alias("_high"), F.min(px).alias("_low"), F.min(last(40, F.col("low"))).alias("SWING_LOW"), F.max(last(1, px)).alias("_px"),
        F.covar_samp(F.when(both, ret), F.when(both, mret)).alias("_cov"), F.var_samp(mret).alias("_var"), F.var_samp(F.when(both, ret)).alias("_vr"), F.var_samp(F.when(both, mret)).alias("_vm"), F.count(F.when(both, 1)).alias("_k"),
    )
    now, b = F.col("_px"), safe_div(F.col("_cov"), F.col("_var"))
    rest = F.col("_vr") - 2 * b * F.col("_cov") + b * b * F.col("_vm")
    keep = lambda x: F.when(F.col("_k") >= least, x)
    made = {
        "PCT_FROM_52W_HIGH": safe_div(now, F.col("_high")) - 1, "PCT_FROM_52W_LOW": safe_div(now, F.col("_low")) - 1, "PCT_VS_MA50": safe_div(now, F.col("MA50")) - 1, "PCT_VS_MA200": safe_div(now, F.col("MA200")) - 1,
        "ABOVE_MA200": F.when(F.col("MA200").isNotNull(), (now > F.col("MA200")).cast("int")), "BETA": keep(b), "IDIO_VOL": keep(F.sqrt(F.greatest(rest, F.lit(0.0))) * math.sqrt(YEAR)),
    }
    return sums.withColumns(made).drop("_high", "_low", "_px", "_cov", "_var", "_vr", "_vm", "_k")


#: Sessions over which decayed sums share one scale; what is older than two such spans has no weight left.
SPAN = 504


def ewm(grid: DataFrame, columns: dict[str, str], alpha: float) -> DataFrame:
    """``grid`` with the unadjusted exponential mean of columns at every session, by names of the results.

    The first value has the weight of all that is missing before it.  Decayed values are
    summed along the entity's sessions, on a scale that starts anew every ``SPAN`` sessions so
    that it stays within the range of doubles; the sum of the span before is carried over.
    """
    keep = 1 - alpha
    pos = F.pmod(F.col("session"), F.lit(SPAN))
    span = Window.partitionBy("ticker", F.floor(F.col("session") / SPAN)).orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    so_far = by_session().rowsBetween(Window.unboundedPreceding, 0)
    scaled = {f"_sum_{n}": F.sum(F.coalesce(F.col(x) * F.pow(F.lit(keep), -pos), F.lit(0.0))).over(span) for n, x in columns.items()}
    # all columns' sums first, then all that looks along the entity: rows are put in order twice, not twice for each column
    out = grid.withColumns(scaled)
    ends = F.when(pos == SPAN - 1, F.struct("session", *scaled))
    firsts = {f"_first_{n}": F.first(F.when(F.col(x).isNotNull(), F.struct("session", F.col(x).alias("x"))), ignorenulls=True).over(so_far) for n, x in columns.items()}
    out = out.withColumns({"_before": F.last(ends, ignorenulls=True).over(by_session().rowsBetween(Window.unboundedPreceding, -1)), **firsts})
    made = {}
    for n in columns:
        carried = F.coalesce(F.col(f"_before._sum_{n}") * F.pow(F.lit(keep), F.lit(SPAN)), F.lit(0.0))
        decayed = alpha * F.pow(F.lit(keep), pos) * (F.col(f"_sum_{n}") + carried)
        made[n] = decayed + keep * F.col(f"_first_{n}.x") * F.pow(F.lit(keep), F.col("session") - F.col(f"_first_{n}.session"))
    return out.withColumns(made).drop("_before", *scaled, *firsts)


def rsi(grid: DataFrame, period: int = 14, beside: dict[str, str] | None = None) -> DataFrame:
    """``grid`` with RSI_14 of ``delta``, the change of the close; at least period + 1 sessions.

    All gains is 100, no move at all is NULL.  ``beside`` are exponential means of the same period
    that are made on the way, by names of the results.
    """
    some = F.col("delta").isNotNull()
    df = grid.withColumns({"_gain": F.when(some, F.greatest("delta", F.lit(0.0))), "_loss": F.when(some, F.greatest(-F.col("delta"), F.lit(0.0)))})
    df = ewm(df, {"_g": "_gain", "_l": "_loss", **(beside or {})}, 1 / period).withColumn("_k", F.row_number().over(by_session()))
    value = F.when(F.col("_l") > 0, 100 - 100 / (1 + F.col("_g") / F.col("_l"))).when(F.col("_g") > 0, F.lit(100.0))
    return df.withColumn("RSI_14", F.when(F.col("_k") >= period + 1, value)).drop("_gain", "_loss", "_g", "_l", "_k")


def true_range(grid: DataFrame) -> DataFrame:
    """``tr`` per bar: NULL on the first, and where high, low or the close before is missing."""
    before = F.lag("close_ff").over(by_session())
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return grid.withColumn("tr", F.when(before.isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull(), tr))


def max_drawdown(grid: DataFrame, dates: DataFrame, lookback: int = YEAR) -> DataFrame:
    """MAX_DD_1Y: the deepest fall below the highest close before, among the sessions that a date sees.

    An entity's closes are one array, of which each date looks at its own slice.
    """
    path = grid.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("session", F.col("close_ff").alias("x")))).alias("_p"))
    asked = F.broadcast(dates.agg(F.collect_list(F.struct("as_of", F.col("session").alias("at"))).alias("_d")))  # one row
    seen = path.join(asked).select("ticker", "_p", F.explode("_d").alias("_a")).where("_p[0].session <= _a.at")
    mine = F.filter("_p", lambda s: (s["session"] <= F.col("_a.at")) & (s["session"] > F.col("_a.at") - lookback))
    start = F.struct(F.lit(None).cast("double").alias("top"), F.lit(None).cast("double").alias("dd"))
    step = lambda a, s: F.struct(F.greatest(a["top"], s["x"]).alias("top"), F.least(a["dd"], s["x"] / F.greatest(a["top"], s["x"]) - 1).alias("dd"))
    return seen.select("ticker", F.col("_a.as_of").alias("as_of"), F.aggregate(mine, start, step, lambda a: a["dd"]).alias("MAX_DD_1Y"))


def adjusted_bars(bars: DataFrame) -> DataFrame:
    """Open, high, low and close times adj_close / close; a missing ratio is the one before, else the next, else 1."""
    order = Window.partitionBy("ticker").orderBy("date")
    ratio = safe_div(F.col("adj_close"), F.col("close"))
    df = bars.withColumn("_r", ratio)
    before = F.last("_r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_r", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("_f", F.coalesce(before, after, F.lit(1.0)))
    return df.select("ticker", "date", *[(F.col(c) * F.col("_f")).alias(c) for c in ("open", "high", "low", "close")], "volume")


PRICE_FACTORS = (
    "MOM_12_1", "MOM_6_1", "RETURN_1M", "RETURN_3M", "RETURN_6M", "RETURN_1Y", "REVERSAL_1M", "VOL_1Y", "VOL_3M", "MOM_VOL_ADJ", "PCT_FROM_52W_HIGH", "PCT_FROM_52W_LOW",
    "PCT_VS_MA50", "MA50", "PCT_VS_MA200", "MA200", "ABOVE_MA200", "SWING_LOW", "PRICE", "RSI_14", "ATR_14", "ATR_PCT", "BETA", "IDIO_VOL",
)


#: Bars to a part of the price grid.
BARS_A_PART = 50_000


def price_factors(bars: DataFrame, sessions: DataFrame, market: DataFrame, dates: DataFrame) -> DataFrame:
    """All price factors, one row per (as_of, ticker).

    Rows are dealt by ticker once, to parts that grow in number, not in size.  Lags and exponential
    means are windows along an entity's sessions, from which the as-of dates are picked; the others
    look at the year before each date.
    """
    parts = max(int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions")), bars.count() // BARS_A_PART + 1)
    grid = true_range(lagged_factors(filled(bars, sessions, parts=parts)))
    grid = grid.withColumn("delta", F.col("close_ff") - F.lag("close_ff").over(by_session()))
    index = market.join(sessions, "date").withColumn("ret", safe_div(F.col("close"), F.lag("close").over(Window.orderBy("session"))) - 1)
    full = rsi(grid, 14, {"ATR_14": "tr"}).withColumn("ATR_PCT", safe_div(F.col("ATR_14"), F.col("PRICE")))
    base = full.join(F.broadcast(dates.select("as_of", "session")), "session")
    year = year_factors(grid, index, dates)
    out = base.join(year, ["as_of", "ticker"], "left").withColumns({"REVERSAL_1M": -F.col("RETURN_1M"), "MOM_VOL_ADJ": safe_div(F.col("MOM_12_1"), F.col("VOL_1Y"))})
    return out.select("as_of", "ticker", *PRICE_FACTORS).join(max_drawdown(grid, dates), ["as_of", "ticker"], "left")
