"""Signal ladders, gates and trade plans: column arithmetic on a row of factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tiers(x: Column, steps: list[tuple[float, float, str]], rest: tuple[float, str]) -> tuple[Column, Column]:
    """Points and reason of the first step that ``x`` reaches; nothing where it is missing."""
    points, why = F.when(x.isNull(), F.lit(0.0)), F.when(x.isNull(), F.lit(None).cast("string"))
    for least, p, reason in steps:
        points, why = points.when(x >= least, F.lit(p)), why.when(x >= least, F.lit(reason))
    return points.otherwise(F.lit(rest[0])), why.otherwise(F.lit(rest[1]))


def rungs(steps: list[tuple[Column, float, Column]]) -> tuple[Column, Column]:
    """Points and reason of the first of some conditions that holds."""
    points, why = F.lit(0.0), F.lit(None).cast("string")
    for holds, p, reason in reversed(steps):
        points, why = F.when(holds, F.lit(p)).otherwise(points), F.when(holds, reason).otherwise(why)
    return points, why


def graded(df: DataFrame, parts: list[tuple[Column, Column]], labels: list[tuple[float, str]], last: str, name: str) -> DataFrame:
    """``df`` with ``name``_signal (the first label whose least points are reached), _score and _reasons."""
    total = sum((p for p, _ in parts), F.lit(0.0))
    label = F.when(F.lit(False), F.lit(""))
    for least, text in labels:
        label = label.when(total >= least, F.lit(text))
    return df.withColumns({f"{name}_signal": label.otherwise(F.lit(last)), f"{name}_score": total, f"{name}_reasons": F.concat_ws("; ", *[why for _, why in parts])})


def percent(x: Column, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f", x * 100)


# Thresholds, points, labels and texts of the ladders.
LONG_TIERS = [(0.90, 3.0, "Top-decile composite"), (0.75, 2.0, "Top-quartile composite"), (0.50, 1.0, "Above-median composite"), (0.25, -1.0, "Below-median composite")]
LONG_REST = (-2.0, "Bottom-quartile composite")
LONG_LABELS = [(5, "🟢 Strong Buy — accumulate"), (3, "🟢 Buy"), (1, "🟡 Hold / add on weakness"), (-1, "⚪ Neutral"), (-3, "🟠 Trim")]
MID_TIERS = [(0.90, 3.0, "Top-decile setup"), (0.75, 2.0, "Strong setup"), (0.50, 1.0, "Positive setup"), (0.30, -0.5, "Marginal setup")]
MID_REST = (-2.0, "Weak setup")
MID_LABELS = [(5, "🟢 Enter — full size"), (3.5, "🟢 Enter — half size"), (2, "🟡 Watch for trigger"), (0, "⚪ No setup")]
AVOID = "🔴 Avoid"
AVOID_LABELS = [(0.90, "🔴 Avoid — deteriorating", -3.0), (0.75, "🟠 Caution — weakening", -1.5)]
NO_FLAG = "⚪ No flag"


def long_term(df: DataFrame) -> DataFrame:
    """Grades a holding by its percentile, its distance from the long average and insiders' trades."""
    above, insiders = F.col("PCT_VS_MA200"), F.col("INSIDER_NET_BUY")
    trend = rungs([
        (above > 0, 1.0, F.concat(F.lit("Uptrend (+"), percent(above), F.lit("% vs 200d)"))),
        (above < -0.10, -1.0, F.lit("Well below 200-day MA")),
    ])
    buying = rungs([(insiders > 0.3, 1.0, F.lit("Insiders net buyers")), (insiders < -0.3, -0.5, F.lit("Insider selling"))])
    return graded(df, [tiers(F.col("percentile"), LONG_TIERS, LONG_REST), trend, buying], LONG_LABELS, AVOID, "long")


def mid_term(df: DataFrame) -> DataFrame:
    """Grades a setup by its percentile, RSI, range and insiders' purchases."""
    rsi, spread, insiders = F.col("RSI_14"), F.col("ATR_PCT"), F.col("INSIDER_NET_BUY")
    timing = rungs([
        (rsi.between(45, 65), 1.0, F.format_string("Constructive RSI (%.0f)", rsi)), (rsi > 78, -1.5, F.format_string("Extended (RSI %.0f)", rsi)),
        (rsi < 30, 0.5, F.format_string("Oversold (RSI %.0f)", rsi)),
    ])
    swings = rungs([(spread > 0.06, -1.0, F.concat(F.lit("Very volatile (ATR "), percent(spread, 1), F.lit("%/day)"))), (spread < 0.015, 0.5, F.lit("Orderly volatility"))])
    buying = rungs([(insiders > 0.3, 1.0, F.lit("Insiders net buyers"))])
    return graded(df, [tiers(F.col("percentile"), MID_TIERS, MID_REST), timing, swings, buying], MID_LABELS, AVOID, "mid")


def avoid(df: DataFrame) -> DataFrame:
    """Grades a name of an inverted strategy, whose first ranks are the worst; reasons come from its factors."""
    c = F.col
    reasons = F.concat_ws(
        "; ",
        F.when(c("PIOTROSKI_F") <= 3, F.format_string("Piotroski %.0f/9", c("PIOTROSKI_F").cast("double"))),
        F.when(c("PCT_VS_MA200") < 0, F.concat(percent(c("PCT_VS_MA200")), F.lit("% below 200-day"))),
        F.when(c("INSIDER_NET_BUY") < -0.3, F.lit("Insiders net sellers")),
        F.when(c("EVENT_MANAGEMENT") > 0, F.lit("Management change filed")),
        F.when(c("EVENT_RESTRUCTURING") > 0, F.lit("Restructuring filed")),
        F.when(c("ACCRUALS") > 0.05, F.lit("Earnings well ahead of cash flow")),
    )
    label, score = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(0.0))
    for least, text, points in AVOID_LABELS:
        label, score = label.when(c("percentile") >= least, F.lit(text)), score.when(c("percentile") >= least, F.lit(points))
    return df.withColumns({"avoid_signal": label.otherwise(F.lit(NO_FLAG)), "avoid_score": score.otherwise(F.lit(0.0)), "avoid_reasons": reasons})


def gate(
    above_ma200: bool = False, rsi_max: float | None = None, rsi_min: float | None = None, min_market_cap: float | None = None, earnings_reaction: bool = False,
    min_insider_buyers: int | None = None,
) -> Column:
    """Whether a row passes a strategy's hard gates.

    A missing RSI counts as 50, a missing market value passes, a missing trend or reaction
    fails, and no data of insiders is no buyer.
    """
    ok = F.lit(True)
    if above_ma200:
        ok &= F.coalesce(F.col("ABOVE_MA200") == 1, F.lit(False))
    if rsi_max is not None:
        ok &= F.coalesce("RSI_14", F.lit(50.0)) <= rsi_max
    if rsi_min is not None:
        ok &= F.coalesce("RSI_14", F.lit(50.0)) >= rsi_min
    if min_market_cap is not None:
        ok &= F.col("MARKET_CAP").isNull() | (F.col("MARKET_CAP") >= min_market_cap)
    if earnings_reaction:
        ok &= F.col("EARNINGS_REACTION").isNotNull()
    if min_insider_buyers is not None:
        ok &= F.coalesce("INSIDER_CLUSTER", F.lit(0)) >= min_insider_buyers
    return ok


def gates(df: DataFrame, **kinds) -> DataFrame:
    """The rows that pass ``gate``."""
    return df.where(gate(**kinds))


def trade_plans(
    df: DataFrame, setup: str = "momentum", stop_ranges: float = 3.0, reward: float = 2.0, risk: float = 0.01, bounds: tuple[float, float] = (0.01, 0.10),
    max_stop: float = 0.20, pullback_ranges: float = 0.5,
) -> DataFrame:
    """entry, entry_type, stop, target, basis, stop_pct, target_pct, weight per row of PRICE, ATR_14 and SWING_LOW.

    The stop is so many ranges below the price, or a little under the swing low where that is
    farther.  There is no plan without a price and a range above 0, with a stop that isn't
    between 0 and the price, or with one farther than ``max_stop`` from the price.  A breakout
    enters at the price; others wait half a range lower, unless that is at or under the stop.
    """
    price, spread, swing = F.col("PRICE"), F.col("ATR_14"), F.col("SWING_LOW")
    df = df.where((price > 0) & (spread > 0)).withColumn("_by_range", price - stop_ranges * spread)
    farther = F.coalesce((swing < price) & (swing < F.col("_by_range")), F.lit(False))
    df = df.withColumns({"stop": F.when(farther, swing * 0.995).otherwise(F.col("_by_range")), "basis": F.when(farther, "swing_low").otherwise("atr")})
    df = df.where((F.col("stop") > 0) & (F.col("stop") < price) & ((price - F.col("stop")) / price <= max_stop))
    lower = price - pullback_ranges * spread
    waits = F.lit(setup != "breakout") & (lower > F.col("stop"))
    df = df.withColumns({"entry": F.when(waits, lower).otherwise(price), "entry_type": F.when(waits, "pullback").otherwise("market")})
    gap = F.col("entry") - F.col("stop")
    weight = F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), risk / (gap / F.col("entry"))))
    return df.withColumns({"target": F.col("entry") + reward * gap, "stop_pct": gap / F.col("entry"), "target_pct": reward * gap / F.col("entry"), "weight": weight}).drop("_by_range")


def portfolio_risk(plans: DataFrame, by: list[str]) -> DataFrame:
    """Number, weight and risk of plans together, and the cash left."""
    return plans.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("invested"), F.sum(F.col("weight") * F.col("stop_pct")).alias("at_risk"), F.avg("stop_pct").alias("mean_stop"),
        F.greatest(F.lit(0.0), 1 - F.sum("weight")).alias("cash"),
    )
