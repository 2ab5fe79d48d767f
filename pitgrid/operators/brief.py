"""Roll-ups over stored runs: agreement of strategies, stability, calendars of reports, regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitgrid.functions.scalars import safe_div


def lists_of(scores: DataFrame, n: int) -> DataFrame:
    """Names that strategies have among their first n: how many, mean and best rank, which."""
    return scores.where(F.col("rank") <= n).groupBy("as_of", "ticker").agg(
        F.count_distinct("strategy").alias("lists"), F.avg("rank").alias("mean_rank"), F.min("rank").alias("best_rank"), F.array_join(F.array_sort(F.collect_set("strategy")), ",").alias("strategies")
    )


def list_changes(scores: DataFrame, n: int) -> DataFrame:
    """Number of lists of each name against the date before, over strategies ranked on both."""
    dates = scores.select("as_of").distinct().withColumn("before", F.lag("as_of").over(Window.orderBy("as_of"))).where("before is not null")
    ran = scores.select("as_of", "strategy").distinct()
    paired = dates.join(ran, "as_of").join(ran.withColumnRenamed("as_of", "before"), ["before", "strategy"], "left_semi")
    top = scores.where(F.col("rank") <= n).select("as_of", "strategy", "ticker")
    now = paired.join(top, ["as_of", "strategy"]).groupBy("as_of", "ticker").agg(F.count(F.lit(1)).alias("now"))
    old = paired.join(top.withColumnRenamed("as_of", "before"), ["before", "strategy"]).groupBy("as_of", "ticker").agg(F.count(F.lit(1)).alias("then"))
    both = now.join(old, ["as_of", "ticker"], "full").fillna(0, ["now", "then"])
    what = F.when(F.col("then") == 0, "new").when(F.col("now") == 0, "lost").when(F.col("now") > F.col("then"), "up").when(F.col("now") < F.col("then"), "down").otherwise("same")
    return both.withColumn("change", what)


def stability(scores: DataFrame, n: int = 10) -> DataFrame:
    """Per strategy the first n of the first and of the last date: shared, entered, exited."""
    top = scores.where(F.col("rank") <= n).groupBy("strategy", "as_of").agg(F.array_sort(F.collect_set("ticker")).alias("names"))
    ends = top.groupBy("strategy").agg(F.min_by("names", "as_of").alias("a"), F.max_by("names", "as_of").alias("b"))
    return ends.select("strategy", F.size(F.array_intersect("a", "b")).alias("shared"), F.array_join(F.array_except("b", "a"), ",").alias("entered"), F.array_join(F.array_except("a", "b"), ",").alias("exited"))


def spread_of_sectors(picks: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return picks.groupBy("as_of", "strategy", "sector").agg(n.alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("as_of", "strategy")))


def trade_summary(trades: DataFrame) -> DataFrame:
    """Number, wins, mean gain and loss, mean multiple, days held, profit factor and exits of trades."""
    r = F.col("net_return")
    gain, loss = F.when(r > 0, r), F.when(r <= 0, r)
    exits = [F.count(F.when(F.col("reason") == k, 1)).alias(f"by_{k}") for k in ("stop", "target", "time")]
    return trades.agg(F.count(F.lit(1)).alias("n"), F.avg((r > 0).cast("double")).alias("win_rate"), F.avg(gain).alias("mean_win"), F.avg(loss).alias("mean_loss"), F.avg("r_multiple").alias("mean_r"), F.avg("held").alias("mean_held"), safe_div(F.sum(gain), F.abs(F.sum(loss))).alias("profit_factor"), *exits)


def cohort_summary(cohorts: DataFrame, per_date: int) -> DataFrame:
    """Per strategy: cohorts, mean excess and share of cohorts that did better than the universe."""
    return cohorts.groupBy("strategy").agg(F.count("excess").alias("cohorts"), F.avg("excess").alias("mean_excess"), F.avg((F.col("excess") > 0).cast("double")).alias("hit"))


def by_year(cohorts: DataFrame, split: str) -> DataFrame:
    """Mean excess per year, in sample before ``split`` and out of sample after."""
    part = F.when(F.col("as_of") < F.lit(split).cast("date"), "in").otherwise("out")
    return cohorts.groupBy("strategy", F.year("as_of").alias("year"), part.alias("sample")).agg(F.avg("excess").alias("mean_excess"), F.count("excess").alias("n"))


def return_table(grid: DataFrame, lags: dict[str, int]) -> DataFrame:
    """Returns over several numbers of sessions at each entity's last session."""
    w = Window.partitionBy("ticker").orderBy("session")
    df = grid.withColumns({k: safe_div(F.col("close_ff"), F.lag("close_ff", n).over(w)) - 1 for k, n in lags.items()})
    last = F.max("session").over(Window.partitionBy("ticker"))
    return df.withColumn("_l", last).where("session = _l").select("ticker", "date", *lags)


def rebalance_sessions(sessions: DataFrame, period: str) -> DataFrame:
    """The first session and the last session of every period: month, quarter or year."""
    key = F.date_trunc(period, "date")
    last = sessions.groupBy(key.alias("p")).agg(F.max("session").alias("session")).select("session")
    first = sessions.agg(F.min("session").alias("session"))
    return sessions.join(last.union(first).distinct(), "session", "left_semi")


def next_report(filed: DataFrame, as_of: Column) -> DataFrame:
    """Expected next filing per ticker: a past one plus 364 days if still ahead and 45 days after the last, else the last plus quarters of 91 days."""
    last = F.max("filed")
    df = filed.where(F.col("filed") <= as_of).withColumn("_last", F.max("filed").over(Window.partitionBy("ticker")))
    year = F.date_add("filed", 364)
    ahead = F.min(F.when((year >= as_of) & (F.datediff(year, "_last") >= 45), year))
    quarters = F.greatest(F.lit(1), F.ceil(F.datediff(as_of, last) / 91)).cast("int")
    return df.groupBy("ticker").agg(F.coalesce(ahead, F.date_add(last, quarters * 91)).alias("expected"), last.alias("last_filed")).withColumn("days_until", F.datediff("expected", as_of))



def event_pattern(events: DataFrame, weights: dict[str, int]) -> DataFrame:
    """Events per ticker by weight, with what their pattern says."""
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])
    df = events.withColumn("w", F.coalesce(F.try_element_at(w, F.col("category")), F.lit(0)))
    n = lambda k: F.count(F.when(F.col("category") == k, 1))
    note = F.concat_ws("; ", F.when(n("management") >= 3, "management turnover"), F.when((n("restructuring") >= 2) & (n("management") >= 1), "restructuring under new management"), F.when(F.sum("w") == 0, "routine only"))
    return df.groupBy("as_of", "ticker").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("weight"), note.alias("notes"))


# How much the item codes of current reports weigh; what isn't listed is routine.
SIGNIFICANCE = {
    "1.01": "notable", "1.02": "material", "2.01": "material", "2.02": "notable", "2.05": "material", "2.06": "material", "3.01": "material", "4.01": "notable", "4.02": "material",
    "5.02": "notable", "5.07": "routine", "7.01": "routine", "8.01": "routine",
}


def filing_pattern(events: DataFrame, by: list[str], turnover: int = 3) -> DataFrame:
    """Current reports (``by``, item_code) by weight, and what their pattern says, as a list in order of gravity.

    headline is the gravest weight that there is.  A window with nothing to say says "nothing unusual".
    """
    weigh = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SIGNIFICANCE.items() for x in kv]), F.trim("item_code")), F.lit("routine"))
    n = lambda *codes: F.count(F.when(F.trim("item_code").isin(*codes), 1))
    says = [
        (n("4.02") > 0, "earlier reports declared unreliable"), (n("2.06") > 0, "assets written down"), (n("5.02") >= turnover, "repeated change of management"), ((n("5.02") > 0) & (n("5.02") < turnover), "change of management"),
        (n("2.05") > 0, "restructuring under way"), (n("2.01", "1.02") > 0, "business changed shape"), (n("3.01") > 0, "listing rule not met"),
    ]
    df = events.withColumn("_w", weigh)
    count = lambda w: F.count(F.when(F.col("_w") == w, 1))
    found = F.array_compact(F.array(*[F.when(c, F.lit(text)) for c, text in says]))
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), count("material").alias("material"), count("notable").alias("notable"), count("routine").alias("routine"), found.alias("observations"))
    out = out.withColumn("observations", F.when(F.size("observations") == 0, F.array(F.lit("nothing unusual"))).otherwise(F.col("observations")))
    return out.withColumn("headline", F.when(F.col("material") > 0, "material").when(F.col("notable") > 0, "notable").otherwise("routine"))
