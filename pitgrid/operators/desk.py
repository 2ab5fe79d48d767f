"""What a desk reads: stored runs, positions and their alerts, picks, calendars, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitgrid.functions.scalars import safe_div
from pitgrid.operators.asof import window_join


def latest_runs(runs: DataFrame, dates: DataFrame, days: int = 400) -> DataFrame:
    """Of each strategy the newest run (strategy, as_of, names) on or before each date, and its age."""
    seen = window_join(dates.withColumnRenamed("as_of", "day"), runs.withColumnRenamed("as_of", "run"), "run", days, as_of="day")
    last = seen.groupBy("day", "strategy").agg(F.max_by(F.struct("run", "names"), "run").alias("r"))
    return last.select("day", "strategy", F.col("r.run").alias("run"), F.col("r.names").alias("names"), F.datediff("day", F.col("r.run")).alias("age"))


def latest_view(scores: DataFrame, names: DataFrame) -> DataFrame:
    """Rank and percentile of some names in the newest run of every strategy."""
    last = F.max("as_of").over(Window.partitionBy("strategy"))
    return scores.withColumn("_last", last).where("as_of = _last").join(names.select("ticker").distinct(), "ticker", "left_semi").drop("_last")


def factor_detail(scored: DataFrame, n: int) -> DataFrame:
    """For each name its n most marked factors at the newest date."""
    last = F.max("as_of").over(Window.partitionBy(F.col("factor")))
    df = scored.withColumn("_last", last).where("as_of = _last and score is not null")
    order = Window.partitionBy("ticker").orderBy(F.desc(F.round(F.abs("score"), 9)), "factor")
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("ticker", "place", "factor", "score")


def totals(held: DataFrame) -> DataFrame:
    """Value, cost and gain of all positions that have a price; unpriced ones are out on both sides and counted."""
    priced = F.col("value").isNotNull()
    value, cost = F.sum(F.when(priced, F.col("value"))), F.sum(F.when(priced, F.col("cost")))
    return held.agg(
        value.alias("market_value"), cost.alias("cost"), (value - cost).alias("pnl"), (safe_div(value, cost) - 1).alias("pnl_pct"), F.count(F.lit(1)).alias("positions"), F.count(F.when(~priced, 1)).alias("unpriced")
    )


def alerts(held: DataFrame, moves: DataFrame, reports: DataFrame, views: DataFrame, near: float = 0.03, floor: float = 0.05, ranges: float = 2.5, days: int = 7) -> DataFrame:
    """ticker, level, kind: what a holder should look at.

    ``held`` (ticker, last, low, high, stop, target); ``moves`` (ticker, move, spread: the
    last session's move and the range over the price); ``reports`` (ticker, days_until);
    ``views`` (ticker, buys, sells, avoided).
    """
    c = F.col
    df = held.join(moves, "ticker", "left").join(reports.select("ticker", "days_until"), "ticker", "left").join(views, "ticker", "left")
    hit = c("stop").isNotNull() & ((c("last") <= c("stop")) | F.coalesce(c("low") <= c("stop"), F.lit(False)))
    limit = F.greatest(F.lit(floor), F.coalesce(ranges * c("spread"), F.lit(floor)))
    one = lambda ok, level, kind: F.when(F.coalesce(ok, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(kind).alias("kind")))
    priced = c("last").isNotNull()
    made = F.array_compact(F.array(
        one(priced & hit, "risk", "stop hit"), one(priced & ~hit & (c("last") / c("stop") - 1 <= near), "watch", "near stop"),
        one(priced & ((c("last") >= c("target")) | F.coalesce(c("high") >= c("target"), F.lit(False))), "info", "target reached"), one(F.abs("move") >= limit, "watch", "large move"),
        one(c("days_until").between(0, days), "watch", "report due"), one((c("sells") > c("buys")) & (c("sells") >= 2), "watch", "strategies negative"), one(c("avoided"), "watch", "on avoid list"),
    ))
    return df.select("ticker", F.explode(made).alias("a")).select("ticker", "a.level", "a.kind")


def watch_summary(ranks: DataFrame, names: DataFrame, top: int = 20) -> DataFrame:
    """Per watched name: best rank and strategy, number of lists, and the count of each kind of signal.

    ``ranks`` (ticker, strategy, rank, bucket).
    """
    own = ranks.join(names.select("ticker").distinct(), "ticker", "left_semi")
    kinds = [F.when(F.count(F.when(F.col("bucket") == k, 1)) > 0, F.concat(F.lit(f"{k} "), F.count(F.when(F.col("bucket") == k, 1)).cast("string"))) for k in ("Buy", "Hold", "Neutral", "Sell")]
    return own.groupBy("ticker").agg(
        F.min("rank").alias("best_rank"), F.min_by("strategy", F.struct("rank", "strategy")).alias("best_strategy"), F.count(F.when(F.col("rank") <= top, 1)).alias("n_top"), F.concat_ws(" · ", *kinds).alias("votes")
    )


def current_picks(voted: DataFrame, ranks: DataFrame, least: int = 2, top: int = 20, limit: int = 25) -> DataFrame:
    """Per date the names with enough votes, best first; where none has, those in enough lists."""
    order = Window.partitionBy("as_of").orderBy(F.desc("n"), F.desc("s"), "ticker")
    by_votes = voted.where((F.col("votes") >= least) & F.col("composite").isNotNull()).select("as_of", "ticker", F.lit("votes").alias("by"), F.col("votes").cast("long").alias("n"), F.round("composite", 9).alias("s"))
    lists = ranks.where(F.col("rank") <= top).groupBy("as_of", "ticker").agg(F.count_distinct("strategy").alias("n"), (-F.avg("rank")).alias("s")).where(F.col("n") >= least)
    other = lists.join(by_votes.select("as_of").distinct(), "as_of", "left_anti").select("as_of", "ticker", F.lit("lists").alias("by"), "n", F.round("s", 9).alias("s"))
    return by_votes.unionByName(other).withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("as_of", "ticker", "by", "n", "place")


def movers(compared: DataFrame, n: int) -> DataFrame:
    """The n largest rises and the n largest falls in rank of each strategy."""
    df = compared.where("rank_change is not null and rank_change != 0")
    up = Window.partitionBy("strategy").orderBy(F.desc("rank_change"), "ticker")
    down = Window.partitionBy("strategy").orderBy("rank_change", "ticker")
    df = df.withColumns({"_u": F.row_number().over(up), "_d": F.row_number().over(down)})
    side = F.when((F.col("rank_change") > 0) & (F.col("_u") <= n), "riser").when((F.col("rank_change") < 0) & (F.col("_d") <= n), "faller")
    return df.withColumn("side", side).where("side is not null").select("strategy", "ticker", "side", "rank_change")


def orders_of(picks: DataFrame, dates: DataFrame) -> DataFrame:
    """Buys and sells at each date: the differences of the lists of one date and the date before."""
    order = dates.select("as_of", F.row_number().over(Window.orderBy("as_of")).alias("k"))
    now = picks.select("as_of", "strategy", "ticker").join(order, "as_of")
    old = now.select("strategy", "ticker", (F.col("k") + 1).alias("k"))
    buys = now.select("strategy", "ticker", "k").join(old, ["strategy", "ticker", "k"], "left_anti").withColumn("side", F.lit("buy"))
    sells = old.join(now, ["strategy", "ticker", "k"], "left_anti").withColumn("side", F.lit("sell"))
    return buys.unionByName(sells).join(order, "k").select("as_of", "strategy", "ticker", "side")


def annual_turnover(walked: DataFrame, per_year: float) -> DataFrame:
    """Mean turnover of a rebalance times rebalances a year, half of it counted, and how many there were."""
    return walked.groupBy("strategy").agg((F.avg("turnover") / 2 * per_year).alias("turnover"), F.count(F.lit(1)).alias("rebalances"))


def rebased(curve: DataFrame, value: str, time: str) -> DataFrame:
    """A curve over its first value, missing values filled from before."""
    w = Window.orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    filled = curve.withColumn("_v", F.last(value, ignorenulls=True).over(w))
    return filled.withColumn("rebased", F.col("_v") / F.first("_v", ignorenulls=True).over(w)).select(time, "rebased")


def daily_curve(held: DataFrame, walked: DataFrame, segs: DataFrame, grid: DataFrame) -> DataFrame:
    """Value of each strategy at every session: the curve before the segment, less the cost at its start, times the segment's value so far.

    ``held`` (strategy, as_of, ticker, weight); a name without a price at the start is cash.
    """
    px = grid.select("ticker", "session", "close_ff")
    days = segs.select("as_of", "start", F.explode(F.sequence(F.col("start"), F.col("end"))).alias("session")).join(px.select("session").distinct(), "session", "left_semi")
    base = px.select("ticker", F.col("session").alias("start"), F.col("close_ff").alias("_a"))
    own = held.select("strategy", "as_of", "ticker", "weight").join(segs.select("as_of", "start"), "as_of").join(base, ["ticker", "start"], "left").drop("start")
    df = own.join(days, "as_of").join(px, ["ticker", "session"], "left")
    value = df.groupBy("strategy", "as_of", "session").agg(F.sum(F.col("weight") * F.coalesce(safe_div(F.col("close_ff"), F.col("_a")), F.lit(1.0))).alias("v"))
    w = Window.partitionBy("strategy").orderBy("seg")
    before = walked.select("strategy", "as_of", "seg", "turnover", F.coalesce(F.lag("curve").over(w), F.lit(1.0)).alias("_c"))
    out = value.join(before, ["strategy", "as_of"]).withColumn("value", F.col("_c") * (1 - 0.001 * F.col("turnover")) * F.col("v"))
    last = Window.partitionBy("strategy", "session").orderBy(F.desc("seg"))  # a boundary belongs to the later segment
    return out.withColumn("_r", F.row_number().over(last)).where("_r = 1").select("strategy", "session", "value")


def upcoming(confirmed: DataFrame, estimated: DataFrame, day: Column, days: int) -> DataFrame:
    """Reports due within ``days``: confirmed ones (ticker, report_date), and estimates (ticker, expected) for the other names."""
    within = lambda c: (F.col(c) >= day) & (F.datediff(F.col(c), day) <= days)
    sure = confirmed.where(within("report_date")).select("ticker", "report_date", F.lit(True).alias("confirmed"))
    rest = estimated.where(within("expected")).join(sure.select("ticker").distinct(), "ticker", "left_anti").select("ticker", F.col("expected").alias("report_date"), F.lit(False).alias("confirmed"))
    return sure.unionByName(rest).withColumn("days_until", F.datediff("report_date", day))


def regime(trend: DataFrame, levels: DataFrame) -> DataFrame:
    """Flags (as_of, topic, level) from the market's distance to its long average and from series (as_of, curve, curve_1m, credit, credit_1m, fear)."""
    df = levels.join(trend, "as_of", "left")
    c = F.col
    flag = lambda topic, level: F.when(level.isNotNull(), F.struct(F.lit(topic).alias("topic"), level.alias("level")))
    # The thresholds.
    made = F.array_compact(F.array(
        flag("trend", F.when(c("trend") >= 0, "ok").when(c("trend") < 0, "risk")),
        flag("curve", F.when(c("curve") < 0, "inverted").when((c("curve_1m") > 0.4) & (c("curve") < 0.75), "steepening")),
        flag("credit", F.when(c("credit") >= 6, "risk").when(c("credit_1m") >= 0.5, "watch").when(c("credit").isNotNull(), "ok")),
        flag("fear", F.when(c("fear") >= 30, "risk").when(c("fear") >= 20, "watch").when(c("fear").isNotNull(), "ok")),
    ))
    return df.select("as_of", F.explode(made).alias("f")).select("as_of", "f.topic", "f.level")


def valid_until(filed: DataFrame, splits: DataFrame, fresh: int = 500, window: int = 400) -> DataFrame:
    """First day after as_of on which a row (as_of, ticker, filed of a share count) may change without a new filing."""
    flips = filed.select("as_of", "ticker", F.date_add("filed", fresh + 1).alias("day"))
    names = filed.select("as_of", "ticker").distinct()
    near = names.join(splits.select("ticker", F.explode(F.array(F.col("date"), F.date_add("date", window + 1))).alias("day")), "ticker").select("as_of", "ticker", "day")
    return flips.unionByName(near).where("day > as_of").groupBy("as_of", "ticker").agg(F.min("day").alias("valid_until"))


def source_windows(weights: DataFrame, sources: DataFrame, firsts: DataFrame, floor: str | None = None) -> DataFrame:
    """Per strategy the first day on which all sources of its factors have data, and the source that is last.

    ``sources`` (factor, source), ``firsts`` (source, first); a factor whose source has no data blocks.
    """
    df = weights.join(sources, "factor", "left").join(firsts, "source", "left")
    start = F.max("first")
    if floor is not None:
        start = F.greatest(start, F.lit(floor).cast("date"))
    return df.groupBy("strategy").agg(
        start.alias("start"), F.max_by("source", F.struct("first", "source")).alias("last_source"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("first").isNull(), F.col("factor")))), ",").alias("blockers")
    )


def findings(parts: list[DataFrame]) -> DataFrame:
    """Findings (check, severity, count) with some to report, the gravest first."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return out.where("count > 0").withColumn("place", F.row_number().over(Window.orderBy(rank, F.desc("count"), "check")))


def insider_reading(trades: DataFrame, officers: str = "ceo|cfo|coo|cto|president|chief") -> DataFrame:
    """buys, sells, buyers, sellers and notes per (as_of, ticker) of chosen purchases (P) and sales (S)."""
    c = F.col
    buy, sell = c("txn_code") == "P", c("txn_code") == "S"
    part = F.abs("shares") / (F.abs("shares") + c("post_txn_shares")) * 100
    part = F.when(F.abs("shares") + c("post_txn_shares") > 0, part)
    chief = sell & c("role").rlike(f"(?i){officers}")
    g = trades.groupBy("as_of", "ticker").agg(
        F.coalesce(F.sum(F.when(buy, F.abs("value"))), F.lit(0.0)).alias("buys"), F.coalesce(F.sum(F.when(sell, F.abs("value"))), F.lit(0.0)).alias("sells"),
        F.count_distinct(F.when(buy, c("insider"))).alias("buyers"), F.count_distinct(F.when(sell, c("insider"))).alias("sellers"),
        F.count(F.when(sell & (part > 20), 1)).alias("large"), F.count(F.when(sell & (part <= 5), 1)).alias("small"), F.count(F.when(sell & part.isNotNull(), 1)).alias("rated"),
        F.count_distinct(F.when(chief, c("insider"))).alias("chiefs"), F.datediff(F.max(F.when(sell, c("txn_date"))), F.min(F.when(sell, c("txn_date")))).alias("span"),
    )
    first = [
        F.when(c("large") > 0, "large position reduction").when((c("sellers") > 0) & (c("small") == c("rated")), "all sales are small"),
        F.when((c("sellers") >= 2) & (c("chiefs") >= 2) & (c("span") <= 14), "officers sold together"),
        F.when((c("buyers") >= 2) & (c("buys") > 100_000), "cluster buying").when((c("buyers") == 1) & (c("buys") > 500_000), "one large purchase"),
    ]
    some = F.concat_ws("; ", *first)
    notes = F.when(some != "", some).when((c("buyers") == 0) & (c("sellers") > 0), "all transactions are sales").otherwise("no clear pattern")
    return g.select("as_of", "ticker", "buys", "sells", "buyers", "sellers", "large", notes.alias("notes"))


def scorecard(news: DataFrame, insiders: DataFrame, events: DataFrame, prices: DataFrame) -> DataFrame:
    """supports, concerns and checks of each name, as lists.

    ``news`` (ticker, counts of guidance and analysts, tone), ``insiders`` (ticker, buys,
    sells, buyers, large), ``events`` (ticker and flags by item), ``prices`` (ticker, above: the
    distance to the long average).
    """
    df = news.join(insiders, "ticker", "full").join(events, "ticker", "full").join(prices, "ticker", "full")
    n = lambda k: F.coalesce(F.col(k), F.lit(0))
    up, down, buys, sells = n("upgrade"), n("downgrade"), n("buys"), n("sells")
    any_ = lambda ok, text: F.when(F.coalesce(ok, F.lit(False)), F.lit(text))
    listed = lambda *parts: F.concat_ws("; ", *parts)
    buying = F.when((buys > 2 * sells) & (n("buyers") >= 2), "cluster insider buying").when(buys > sells, "insiders net buyers")
    selling, above = (sells > buys), F.col("above")
    return df.select(
        "ticker",
        listed(any_((n("raised") > 0) | (n("beat") > 0), "guidance raised or beaten"), any_(up > down, "net upgrades"), buying, any_(F.col("tone") > 0.2, "positive coverage")).alias("supports"),
        listed(
            any_((n("lowered") > 0) | (n("missed") > 0), "guidance cut or missed"), any_(n("withdrawn") > 0, "guidance withdrawn"), any_(down > up, "net downgrades"), any_(selling & (n("large") > 0), "large insider sales"),
            any_(n("restated") > 0, "restatement"), any_(n("impaired") > 0, "impairment"), any_(n("delisting") > 0, "listing problem"), any_(F.col("tone") < -0.2, "negative coverage"), any_(above > 0.15, "extended"),
        ).alias("concerns"),
        listed(
            any_((up == down) & (up > 0), "analysts disagree"), F.when(selling & (n("large") == 0), F.when(sells > 3 * buys, "heavy insider selling").otherwise("insiders net sellers")),
            any_(n("restructured") > 0, "restructuring"), any_(n("acquired") > 0, "acquisition completed"), F.when((above > 0.10) & (above <= 0.15), "price elevated").when(above < -0.15, "deep below average"),
        ).alias("checks"),
    )
