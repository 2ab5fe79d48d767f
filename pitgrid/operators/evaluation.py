"""Evaluation of rankings: forward returns, rank correlation, walk-forward curves, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitgrid.functions.scalars import average_rank, correlation, safe_div


def forward_returns(grid: DataFrame, dates: DataFrame, sessions: int, name: str = "fwd") -> DataFrame:
    """Return from each as-of session to ``sessions`` later, NULL-free: dates without both are left out."""
    ends = dates.select("as_of", "session", (F.col("session") + sessions).alias("_end"))
    px = grid.select("ticker", "session", "close_ff")
    start = ends.join(px, "session").select("as_of", "ticker", "_end", F.col("close_ff").alias("_a"))
    end = px.select("ticker", F.col("session").alias("_end"), F.col("close_ff").alias("_b"))
    return start.join(end, ["ticker", "_end"]).select("as_of", "ticker", (safe_div(F.col("_b"), F.col("_a")) - 1).alias(name))


def rank_ic(df: DataFrame, x: str, y: str, by: list[str], least: int) -> DataFrame:
    """Spearman correlation of two columns per group; NULL under ``least`` pairs."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both.select(*by, average_rank(F.col(x), *by).alias("_x"), average_rank(F.col(y), *by).alias("_y"))
    n = F.count(F.lit(1))
    return ranked.groupBy(*by).agg(F.when(n >= least, correlation(F.col("_x"), F.col("_y"))).alias("ic"), n.alias("n"))


def ic_summary(ics: DataFrame, by: list[str], horizon: int = 1) -> DataFrame:
    """Mean, information ratio, hit rate, and t-value with overlapping horizons counted once."""
    n, mean, sd = F.count("ic"), F.avg("ic"), F.stddev_samp("ic")
    effective = F.greatest(n / horizon, F.lit(1.0))
    return ics.groupBy(*by).agg(
        mean.alias("mean_ic"), safe_div(mean, sd).alias("ir"), F.avg(F.when(F.col("ic").isNotNull(), (F.col("ic") > 0).cast("double"))).alias("hit_rate"),
        safe_div(mean, sd / F.sqrt(effective)).alias("t"), n.alias("n"),
    )


def holdings(scores: DataFrame, n: int) -> DataFrame:
    """The first n by rank of each date and strategy with equal weights."""
    by = Window.partitionBy("as_of", "strategy")
    top = scores.where("rank is not null").withColumn("_p", F.row_number().over(by.orderBy("rank", "ticker"))).where(F.col("_p") <= n)
    return top.withColumn("weight", 1 / F.count(F.lit(1)).over(by)).drop("_p")


def weight_scheme(picks: DataFrame, scheme: str) -> DataFrame:
    """Weights per (as_of, strategy): equal, inverse_vol (of ``vol``), or score (positive part of ``composite``).

    A scheme without two usable values falls back to equal weights.
    """
    by = Window.partitionBy("as_of", "strategy")
    raw = {"equal": F.lit(1.0), "inverse_vol": F.when(F.col("vol") > 0, 1 / F.col("vol")), "score": F.when(F.col("composite") > 0, F.col("composite"))}[scheme]
    df = picks.withColumn("_w", raw)
    usable = F.count("_w").over(by) >= 2
    return df.withColumn("weight", F.when(usable, F.coalesce(F.col("_w") / F.sum("_w").over(by), F.lit(0.0))).otherwise(1 / F.count(F.lit(1)).over(by))).drop("_w")


def segments(dates: DataFrame, lag: int) -> DataFrame:
    """as_of, start, end: the sessions between one rebalance's fill and the next's."""
    w = Window.orderBy("session")
    fill = F.col("session") + lag
    return dates.select("as_of", fill.alias("start"), (F.lead("session").over(w) + lag).alias("end")).where("end is not null")


def segment_values(picks: DataFrame, segs: DataFrame, grid: DataFrame) -> DataFrame:
    """Per (strategy, as_of, ticker): weight, price relative over the segment, drifted weight.

    A name without a price at the start of its segment is held as cash, relative 1.
    """
    px = grid.select("ticker", "session", "close_ff")
    at = lambda c, name: px.select("ticker", F.col("session").alias(c), F.col("close_ff").alias(name))
    df = picks.select("strategy", "as_of", "ticker", "weight").join(segs, "as_of")
    df = df.join(at("start", "_a"), ["ticker", "start"], "left").join(at("end", "_b"), ["ticker", "end"], "left")
    df = df.withColumn("rel", F.coalesce(safe_div(F.col("_b"), F.col("_a")), F.lit(1.0)))
    port = F.sum(F.col("weight") * F.col("rel")).over(Window.partitionBy("strategy", "as_of"))
    return df.withColumn("drifted", F.col("weight") * F.col("rel") / port).drop("_a", "_b")


def walk_forward(held: DataFrame, segs: DataFrame, cost: float = 0.001) -> DataFrame:
    """Per (strategy, as_of): gross return, turnover against the drifted weights before, cost and the curve."""
    order = segs.select("as_of", F.row_number().over(Window.orderBy("start")).alias("seg"))
    df = held.join(order, "as_of")
    now = df.select("strategy", "seg", "ticker", "weight")
    old = df.select("strategy", (F.col("seg") + 1).alias("seg"), "ticker", "drifted")
    live = df.select("strategy", "seg").distinct()
    moves = now.join(old, ["strategy", "seg", "ticker"], "full").join(live, ["strategy", "seg"])
    turnover = moves.groupBy("strategy", "seg").agg(F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("drifted", F.lit(0.0)))).alias("turnover"))
    gross = df.groupBy("strategy", "as_of", "seg").agg((F.sum(F.col("weight") * F.col("rel")) - 1).alias("gross"))
    out = gross.join(turnover, ["strategy", "seg"]).withColumn("net", (1 + F.col("gross")) * (1 - cost * F.col("turnover")) - 1)
    run = Window.partitionBy("strategy").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("curve", F.exp(F.sum(F.log1p("net")).over(run)))


def metrics(curve: DataFrame, by: list[str], value: str, time: str, rf: float = 0.0) -> DataFrame:
    """Performance of each curve: total_return, cagr, volatility, sharpe, sortino, max_drawdown, calmar, best, worst, hit_rate, years.

    Years come from the first and the last date.  The yearly risk-free rate is turned into
    one per period and taken off returns; Sortino divides by the deviation below it, over all
    periods.  A curve of fewer than two values has no row.
    """
    w = Window.partitionBy(*by).orderBy(time)
    df = curve.where(F.col(value).isNotNull()).withColumn("_r", F.col(value) / F.lag(value).over(w) - 1)
    df = df.withColumn("_dd", F.col(value) / F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    whole = Window.partitionBy(*by)
    df = df.withColumn("_years", F.greatest(F.datediff(F.max(time).over(whole), F.min(time).over(whole)) / 365.25, F.lit(1e-9)))
    df = df.withColumn("_n", F.count("_r").over(whole) / F.col("_years")).withColumn("_x", F.col("_r") - (F.pow(F.lit(1 + rf), 1 / F.col("_n")) - 1))
    out = df.groupBy(*by).agg(
        (F.max_by(value, time) / F.min_by(value, time) - 1).alias("total_return"), F.max("_years").alias("years"), F.max("_n").alias("n"), F.count("_r").alias("k"),
        F.coalesce(F.stddev_samp("_r"), F.lit(0.0)).alias("sd"), F.avg("_x").alias("x"), F.sqrt(F.avg(F.when(F.col("_x").isNotNull(), F.pow(F.least(F.col("_x"), F.lit(0.0)), F.lit(2))))).alias("down"),
        F.min("_dd").alias("max_drawdown"), F.max("_r").alias("best"), F.min("_r").alias("worst"), F.avg(F.when(F.col("_r").isNotNull(), (F.col("_r") > 0).cast("double"))).alias("hit_rate"),
    )
    year = F.sqrt("n")
    cagr = F.pow(1 + F.col("total_return"), 1 / F.col("years")) - 1
    over = lambda d: F.when(F.col(d) > 0, F.col("x") / F.col(d) * year).otherwise(F.lit(0.0))
    return out.where("k > 0").select(
        *by, "total_return", cagr.alias("cagr"), (F.col("sd") * year).alias("volatility"), over("sd").alias("sharpe"), over("down").alias("sortino"), "max_drawdown",
        F.when(F.col("max_drawdown") < 0, cagr / F.abs("max_drawdown")).otherwise(F.lit(0.0)).alias("calmar"), "best", "worst", "hit_rate", "years",
    )


def relative_metrics(pairs: DataFrame, by: list[str], time: str) -> DataFrame:
    """Of curves ``value`` against ``bench`` at the same dates: benchmark_cagr, excess_cagr, tracking_error, information_ratio, beta."""
    w, whole = Window.partitionBy(*by).orderBy(time), Window.partitionBy(*by)
    back = lambda c: F.col(c) / F.lag(c).over(w) - 1
    df = pairs.where("value is not null and bench is not null").withColumns({"_r": back("value"), "_b": back("bench")})
    years = F.greatest(F.datediff(F.max(time).over(whole), F.min(time).over(whole)) / 365.25, F.lit(1e-9))
    df = df.withColumns({"_years": years, "_d": F.col("_r") - F.col("_b")})
    grown = lambda c: F.pow(F.max_by(c, time) / F.min_by(c, time), 1 / F.max("_years")) - 1
    n, te = F.count("_r") / F.max("_years"), F.stddev_samp("_d")
    out = df.groupBy(*by).agg(
        grown("bench").alias("benchmark_cagr"), (grown("value") - grown("bench")).alias("excess_cagr"), (te * F.sqrt(n)).alias("tracking_error"),
        safe_div(F.avg("_d") * n, te * F.sqrt(n)).alias("information_ratio"), safe_div(F.covar_samp("_r", "_b"), F.var_samp("_b")).alias("beta"), F.count("_r").alias("k"),
    )
    return out.where("k > 0").drop("k")


def compare(now: DataFrame, then: DataFrame, keys: list[str]) -> DataFrame:
    """Full join of two rankings on keys + ticker: entered, dropped or held, and the changes of rank and score."""
    a = now.select(*keys, "ticker", F.col("rank").alias("rank_now"), F.col("composite").alias("score_now"))
    b = then.select(*keys, "ticker", F.col("rank").alias("rank_then"), F.col("composite").alias("score_then"))
    status = F.when(F.col("rank_then").isNull(), "entered").when(F.col("rank_now").isNull(), "dropped").otherwise("held")
    return a.join(b, [*keys, "ticker"], "full").select(
        *keys, "ticker", "rank_now", "rank_then", status.alias("status"), (F.col("rank_then") - F.col("rank_now")).alias("rank_change"),
        (F.col("score_now") - F.col("score_then")).alias("score_change"),
    )


def crossover(scores: DataFrame, one: str, two: str, n: int) -> DataFrame:
    """Names of two strategies on each date: in both lists, one only, or in conflict (top against bottom fifth)."""
    pick = lambda s, x: scores.where(F.col("strategy") == s).select("as_of", "ticker", F.col("rank").alias(f"rank_{x}"), F.col("percentile").alias(f"pct_{x}"))
    df = pick(one, "a").join(pick(two, "b"), ["as_of", "ticker"])
    in_a, in_b = F.coalesce(F.col("rank_a") <= n, F.lit(False)), F.coalesce(F.col("rank_b") <= n, F.lit(False))
    conflict = ((F.col("pct_a") >= 0.8) & (F.col("pct_b") <= 0.2)) | ((F.col("pct_a") <= 0.2) & (F.col("pct_b") >= 0.8))
    label = F.when(conflict, "conflict").when(in_a & in_b, "both").when(in_a, "only_a").when(in_b, "only_b")
    return df.withColumn("side", label).where("side is not null").select("as_of", "ticker", "rank_a", "rank_b", "side")


def relation(corr: Column) -> Column:
    return F.when(corr > 0.7, "redundant").when(corr > 0.3, "related").when(corr > -0.1, "independent").when(corr.isNotNull(), "opposed")


def honest_only(scores: DataFrame, degraded: DataFrame, strict: bool = False) -> DataFrame:
    """Scores of the dates on which all of a strategy's factors are fit to rank on (``honest`` of ``degraded``).

    Other dates are left out; with ``strict`` they are an error as soon as a row of theirs is read.
    """
    told = scores.join(degraded.select("as_of", "strategy", "honest"), ["as_of", "strategy"], "left").withColumn("honest", F.coalesce("honest", F.lit(False)))
    if not strict:
        return told.where("honest").drop("honest")
    message = F.concat(F.col("strategy"), F.lit(" can't be ranked honestly on "), F.col("as_of").cast("string"))
    return told.withColumn("strategy", F.when(F.col("honest"), F.col("strategy")).otherwise(F.raise_error(message).cast("string"))).drop("honest")


def agreement(voted: DataFrame, fwd: DataFrame) -> DataFrame:
    """Mean forward return by number of votes (clipped to -1..4): per date first, then over dates."""
    df = voted.where("composite is not null").join(fwd, ["as_of", "ticker"]).withColumn("bucket", F.greatest(F.lit(-1), F.least(F.lit(4), F.col("votes"))))
    by_date = df.groupBy("as_of", "bucket").agg(F.avg("fwd").alias("m"), F.count(F.lit(1)).alias("n"), F.avg((F.col("fwd") > 0).cast("double")).alias("h"))
    return by_date.groupBy("bucket").agg(F.avg("m").alias("mean_return"), F.sum("n").alias("names"), F.avg("h").alias("hit"), F.median("m").alias("median_return"), F.count(F.lit(1)).alias("dates"))


def agreement_spread(voted: DataFrame, fwd: DataFrame) -> DataFrame:
    """Mean over dates of what names with two votes or more return above those with none."""
    df = voted.where("composite is not null").join(fwd, ["as_of", "ticker"])
    by = df.groupBy("as_of").agg((F.avg(F.when(F.col("votes") >= 2, F.col("fwd"))) - F.avg(F.when(F.col("votes") == 0, F.col("fwd")))).alias("s"))
    return by.agg(F.avg("s").alias("spread"), F.sum((F.col("s") > 0).cast("int")).alias("wins"), F.count("s").alias("dates"))


def cohorts(scores: DataFrame, fwd: DataFrame, n: int) -> DataFrame:
    """Per (as_of, strategy): mean return of the first n, of all names, and the excess."""
    df = scores.join(fwd, ["as_of", "ticker"])
    picked = F.avg(F.when(F.col("rank") <= n, F.col("fwd")))
    return df.groupBy("as_of", "strategy").agg(picked.alias("picks"), F.avg("fwd").alias("universe"), (picked - F.avg("fwd")).alias("excess"), F.count(F.when(F.col("rank") <= n, 1)).alias("n"))


def trades(plans: DataFrame, bars: DataFrame, fill_window: int = 5, time_stop: int = 13, one_way: float = 0.001) -> DataFrame:
    """Outcome of each plan (ticker, session, entry, stop, target, limit_order) on its own.

    A market order fills at the next open; a limit order within ``fill_window`` sessions where
    the low reaches it, at the open on a gap below; a fill at or under the stop is skipped.
    The first bar that touches the stop (first) or the target ends it, at the open on a gap;
    else the close of the last session.  The bar of a limit fill can stop out but not reach
    the target.
    """
    reach = fill_window + time_stop
    plan = plans.withColumn("plan", F.struct("ticker", "session", "entry", "stop", "target", "limit_order"))
    dealt = plan.select("plan", "ticker", F.explode(F.sequence(F.col("session") + 1, F.col("session") + reach)).alias("session"))
    df = dealt.join(bars.select("ticker", "session", "open", "high", "low", "close").where("close is not null"), ["ticker", "session"])
    after = F.col("session") - F.col("plan.session")
    fills = F.when(F.col("plan.limit_order"), (F.col("low") <= F.col("plan.entry")) & (after <= fill_window)).otherwise(F.lit(True))
    price = F.when(F.col("plan.limit_order"), F.least("open", F.col("plan.entry"))).otherwise(F.col("open"))
    filled = df.where(fills).groupBy("plan").agg(F.min_by(F.struct("session", price.alias("price")), "session").alias("fill"))
    filled = filled.where(F.col("fill.price") > F.col("plan.stop"))
    held = filled.join(df, "plan").where("session >= fill.session and session <= fill.session + %d" % time_stop)
    same = F.col("session") == F.col("fill.session")
    stopped = F.col("low") <= F.col("plan.stop")
    reached = (F.col("high") >= F.col("plan.target")) & ~(same & F.col("plan.limit_order"))
    reason = F.when(stopped, "stop").when(reached, "target")
    out_at = F.when(stopped, F.when(same, F.col("plan.stop")).otherwise(F.least("open", F.col("plan.stop")))).when(reached, F.when(same, F.col("plan.target")).otherwise(F.greatest("open", F.col("plan.target"))))
    step = held.withColumn("exit", F.when(reason.isNotNull(), F.struct("session", reason.alias("reason"), out_at.alias("price"))))
    last = F.max_by(F.struct("session", F.lit("time").alias("reason"), F.col("close").alias("price")), "session")
    done = step.groupBy("plan", "fill").agg(F.coalesce(F.min_by("exit", F.when(F.col("exit").isNotNull(), F.col("session"))), last).alias("exit"))
    gross = F.col("exit.price") / F.col("fill.price") - 1
    return done.select(
        "plan.ticker", F.col("plan.session").alias("signal_session"), F.col("fill.session").alias("fill_session"), F.col("fill.price").alias("fill_price"),
        F.col("exit.session").alias("exit_session"), F.col("exit.price").alias("exit_price"), F.col("exit.reason").alias("reason"), (gross - 2 * one_way).alias("net_return"),
        ((F.col("exit.price") - F.col("fill.price")) / (F.col("fill.price") - F.col("plan.stop"))).alias("r_multiple"), (F.col("exit.session") - F.col("fill.session")).alias("held"),
    )
