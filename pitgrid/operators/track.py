"""How stored lists turned out: live cohorts, their summary, drift between dates, and floors of honest history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitgrid.functions.scalars import average_rank, correlation, safe_div
from pitgrid.operators.evaluation import rank_ic


def live_cohorts(scores: DataFrame, grid: DataFrame, bench: DataFrame, dates: DataFrame, horizons: tuple[int, ...], n: int = 10) -> DataFrame:
    """Per (as_of, strategy, horizon): the mean return of the first n names, the benchmark's, the excess, and the rank IC of all names.

    Entry is at the first session strictly after the run's date, exit so many sessions later; a
    name or benchmark without a price at either has no return.
    """
    asked = scores.where("composite is not null").join(dates.select("as_of", "session"), "as_of")
    first = F.row_number().over(Window.partitionBy("as_of", "strategy").orderBy("rank", "ticker"))
    asked = asked.withColumn("_p", first).withColumn("_in", F.col("session") + 1).select("as_of", "strategy", "ticker", "composite", "_p", "_in", F.explode(F.array(*map(F.lit, horizons))).alias("horizon")).withColumn("_out", F.col("_in") + F.col("horizon"))
    px = lambda at, name: grid.select("ticker", F.col("session").alias(at), F.col("close_ff").alias(name))
    ret = asked.join(px("_in", "_a"), ["ticker", "_in"]).join(px("_out", "_b"), ["ticker", "_out"]).withColumn("ret", safe_div(F.col("_b"), F.col("_a")) - 1)
    by = ["as_of", "strategy", "horizon"]
    picks = ret.where(F.col("_p") <= n).groupBy(*by, "_in", "_out").agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"))
    level = lambda at, name: bench.select(F.col("session").alias(at), F.col("close").alias(name))
    picks = picks.join(level("_in", "_x"), "_in", "left").join(level("_out", "_y"), "_out", "left").withColumn("bench", safe_div(F.col("_y"), F.col("_x")) - 1)
    ic = rank_ic(ret, "composite", "ret", by, 8).select(*by, "ic")
    return picks.join(ic, by, "left").select(*by, "n", "mean", "bench", (F.col("mean") - F.col("bench")).alias("excess"), "ic")


def cohort_report(cohorts: DataFrame, dates: DataFrame, avoid: tuple[str, ...] = ()) -> DataFrame:
    """Per (strategy, horizon): cohorts, how many of them don't overlap, mean excess, share of cohorts that came out as meant, mean IC.

    A list of names to ``avoid`` comes out as meant where it does worse than the benchmark.
    """
    df = cohorts.join(dates.select("as_of", "session"), "as_of").where("excess is not null")
    won = F.when(F.col("strategy").isin(*avoid), F.col("excess") < 0).otherwise(F.col("excess") > 0)
    span = F.max("session") - F.min("session")
    out = df.groupBy("strategy", "horizon").agg(F.count(F.lit(1)).alias("cohorts"), span.alias("_s"), F.avg("excess").alias("mean_excess"), F.avg(won.cast("double")).alias("hit"), F.avg("ic").alias("mean_ic"))
    return out.withColumn("independent", F.greatest(F.lit(1), F.round(F.col("_s") / F.col("horizon")) + 1).cast("long")).drop("_s")


def drift_summary(scores: DataFrame, n: int = 10) -> DataFrame:
    """Per strategy and date against its date before: share of the first n that are new, and the rank correlation of the names that both have."""
    ranked = scores.where("rank is not null")
    when = ranked.select("strategy", "as_of").distinct().withColumn("before", F.lag("as_of").over(Window.partitionBy("strategy").orderBy("as_of"))).where("before is not null")
    now = ranked.select("strategy", "as_of", "ticker", "composite", "rank").join(when, ["strategy", "as_of"])
    then = ranked.select("strategy", F.col("as_of").alias("before"), "ticker", F.col("composite").alias("_c"), F.col("rank").alias("_r"))
    both = now.join(then, ["strategy", "before", "ticker"], "left")
    by = ["strategy", "as_of"]
    top = both.where(F.col("rank") <= n).groupBy(*by).agg((1 - F.count(F.when(F.col("_r") <= n, 1)) / F.count(F.lit(1))).alias("turnover"))
    held = both.where("_c is not null").select(*by, average_rank(F.col("composite"), *by).alias("_x"), average_rank(F.col("_c"), *by).alias("_y"))
    return top.join(held.groupBy(*by).agg(F.when(F.count(F.lit(1)) >= 8, correlation(F.col("_x"), F.col("_y"))).alias("correlation"), F.count(F.lit(1)).alias("names")), by, "left")


def safe_from(gaps: DataFrame, most: float = 0.10) -> DataFrame:
    """year, gap, safe: the worst survivorship gap of each year, and whether it and all later years stay within ``most``."""
    years = gaps.groupBy(F.year("as_of").alias("year")).agg(F.max("gap").alias("gap"))  # as many rows as years
    later = F.max("gap").over(Window.orderBy(F.desc("year")).rowsBetween(Window.unboundedPreceding, 0))
    return years.withColumn("safe", later <= most)


def price_sanity(bars: DataFrame, today: str) -> DataFrame:
    """Per ticker bars that can't be: without a positive close, and of days after ``today``; tickers without any are left out."""
    future = F.col("date") > F.lit(today).cast("date")
    n = lambda c: F.count(F.when(c, 1))
    out = bars.groupBy("ticker").agg(n(F.coalesce(F.col("close") <= 0, F.lit(True))).alias("no_price"), n(future).alias("future"), F.max("date").alias("newest"))
    return out.where("no_price + future > 0")


def news_order(news: DataFrame, by: list[str], tone: str, n: int = 8) -> DataFrame:
    """The first n articles of each group: those with an event, then those of the strongest tone, then the newest; ties by id."""
    order = Window.partitionBy(*by).orderBy(F.desc((F.size("events") > 0).cast("int")), F.desc_nulls_last(F.abs(tone)), F.desc("published"), "id")
    return news.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
