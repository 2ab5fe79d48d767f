"""Insider trades, corporate events and attention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitgrid.functions.scalars import safe_div

#: Flags of trades that weren't a decision of the day.
NOT_CHOSEN = ("10b5-1", "plan", "exercise")


def discretionary(trades: DataFrame) -> DataFrame:
    """Purchases and sales without flags of plans or exercises, by others than mere large holders."""
    flags = F.split(F.coalesce("flags", F.lit("")), r"\s*,\s*")
    holder = F.lower("role").contains("10% owner") & ~F.lower("role").rlike("director|officer")
    return trades.where(F.col("txn_code").isin("P", "S") & ~F.arrays_overlap(flags, F.array(*map(F.lit, NOT_CHOSEN))) & ~F.coalesce(holder, F.lit(False)))


def with_routine(trades: DataFrame, years: int = 3) -> DataFrame:
    """``trades`` with ``routine``: whether the person traded in the same month of each of the years before.

    The years of a person's month are read off the trades beside it, so trades dealt by ticker stay where they are.
    """
    own = Window.partitionBy("ticker", "insider", F.month("txn_date"))
    seen, known = F.collect_set(F.year("txn_date")).over(own), F.col("ticker").isNotNull() & F.col("insider").isNotNull()
    before = [F.array_contains("_years", F.year("txn_date") - n) for n in range(1, years + 1)]
    routine = reduce(lambda a, b: a & b, before, known)
    return trades.withColumn("_years", seen).withColumn("routine", F.coalesce(routine, F.lit(False))).drop("_years")


def without_savings_plans(trades: DataFrame, most: float = 25_000, least: int = 3) -> DataFrame:
    """Without the purchases of people who buy small amounts about every quarter."""
    own = Window.partitionBy("ticker", "insider", "as_of", "txn_code")
    gap = F.datediff("txn_date", F.lag("txn_date").over(own.orderBy("txn_date")))
    df = trades.withColumn("_gap", gap)
    regular = F.avg(F.when(F.col("_gap").isNotNull(), F.col("_gap").between(75, 105).cast("double"))).over(own)
    df = df.withColumns({"_n": F.count(F.lit(1)).over(own), "_top": F.max("value").over(own), "_regular": regular})
    plan = (F.col("txn_code") == "P") & (F.col("_n") >= least) & (F.col("_top") <= most) & (F.col("_regular") >= 0.5)
    someone = F.col("as_of").isNotNull() & F.col("ticker").isNotNull() & F.col("insider").isNotNull()
    return df.where(~F.coalesce(plan & someone, F.lit(False))).drop("_gap", "_n", "_top", "_regular")


def conviction(shares: Column, after: Column) -> Column:
    """Weight of a sale by the part of the holding sold: 5 % counts little, 20 % in full; 1 without a holding."""
    held = F.abs(shares) + after
    part = safe_div(F.abs(shares), held)
    return F.when(part.isNull(), F.lit(1.0)).otherwise(F.greatest(F.lit(0.15), F.least(F.lit(1.0), (part - 0.05) / 0.15)))


def insider_signal(trades: DataFrame) -> DataFrame:
    """INSIDER_NET_BUY and INSIDER_CLUSTER per (as_of, ticker)."""
    buy = F.when(F.col("txn_code") == "P", F.abs("value"))
    sell = F.when(F.col("txn_code") == "S", F.abs("value"))
    weighed = sell * conviction(F.col("shares"), F.col("post_txn_shares"))
    zero = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    return trades.groupBy("as_of", "ticker").agg(
        safe_div(zero(buy) - zero(weighed), zero(buy) + zero(sell)).alias("INSIDER_NET_BUY"),
        F.count_distinct(F.when((F.col("txn_code") == "P") & (F.abs("value") >= 10_000), F.col("insider"))).alias("INSIDER_CLUSTER"),
    )


def event_counts(events: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """Events per (as_of, ticker), in all and by category."""
    return events.groupBy("as_of", "ticker").agg(
        F.count(F.lit(1)).alias("EVENT_INTENSITY_90D"), *[F.count(F.when(F.col("category") == c, 1)).alias(f"EVENT_{c.upper()}") for c in categories]
    )


def attention_z(views: DataFrame, by: tuple[str, ...] = ("ticker",), recent: int = 14, least: int = 60) -> DataFrame:
    """Mean of the last ``recent`` counts against mean and deviation of those before; ``least`` counts at least."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("date")))
    df = views.withColumn("k", k)
    new, old = F.when(F.col("k") <= recent, F.col("wiki_views")), F.when(F.col("k") > recent, F.col("wiki_views"))
    out = df.groupBy(*by).agg(F.avg(new).alias("a"), F.avg(old).alias("b"), F.stddev_samp(old).alias("s"), F.count(F.lit(1)).alias("n"))
    return out.select(*by, F.when((F.col("n") >= least) & (F.col("s") > 0), (F.col("a") - F.col("b")) / F.col("s")).alias("ATTENTION_Z"), "n")


def merge_lots(trades: DataFrame) -> DataFrame:
    """Lots of one filing, person, day and code as one: sums, average price, last holding, all flags.

    A sale on a day with an option exercise is flagged ``exercise``.
    """
    day = Window.partitionBy("accession", "txn_date")
    exercised = (F.max((F.col("txn_code") == "M").cast("int")).over(day) == 1) & (F.col("txn_code") == "S")
    df = trades.withColumn("flag", F.array_compact(F.array(F.when(F.col("flags") != "", F.col("flags")), F.when(exercised, F.lit("exercise")))))
    out = df.groupBy("accession", "ticker", "insider", "txn_date", "txn_code").agg(
        F.sum("shares").alias("shares"), F.sum("value").alias("value"), F.max_by("post_txn_shares", F.struct("shares", "value", "post_txn_shares")).alias("post_txn_shares"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("flag")))), ",").alias("flags"), F.count(F.lit(1)).alias("lots"),
    )
    return out.withColumn("price", safe_div(F.col("value"), F.abs("shares")))
