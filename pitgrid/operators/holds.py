"""Checks and small joins over dated records that any table with these columns can be given to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitgrid.functions.scalars import safe_div, signal_bucket
from pitgrid.operators.asof import window_join

#: What a strategy's weights may be.
MOST_WEIGHT = 25.0


def stale(filed: DataFrame, days: int = 500) -> DataFrame:
    """(as_of, ticker) whose newest ``filed`` is more than ``days`` old, with it and its age."""
    last = filed.groupBy("as_of", "ticker").agg(F.max("filed").alias("newest"))
    return last.withColumn("age", F.datediff("as_of", "newest")).where(F.col("age") > days)


def lacking_fresh(names: DataFrame, filed: DataFrame, days: int = 500) -> DataFrame:
    """(as_of, ticker) of ``names`` for which nothing was filed in the ``days`` before."""
    fresh = filed.where(F.datediff("as_of", "filed") <= days).select("as_of", "ticker").distinct()
    return names.select("as_of", "ticker").distinct().join(fresh, ["as_of", "ticker"], "left_anti")


def value_agreement(df: DataFrame, computed: Column, quoted: Column, apart: float = 0.15, low: float = 0.8, high: float = 1.25) -> DataFrame:
    """``df`` with the ratio of a computed to a quoted value, whether they are apart, and whether the count behind it stands; rows without both go."""
    out = df.withColumn("ratio", safe_div(computed, F.when(quoted > 0, quoted))).where("ratio is not null")
    return out.withColumns({"apart": F.abs(F.col("ratio") - 1) > apart, "stands": F.col("ratio").between(low, high)})


def kept_counts(df: DataFrame, count: str, price: str, quoted: str, low: float = 0.8, high: float = 1.25) -> DataFrame:
    """``df`` with a sourced share count only where it agrees with a quoted value; where there is none, it stays."""
    ratio = safe_div(F.col(count) * F.col(price), F.when(F.col(quoted) > 0, F.col(quoted)))
    return df.withColumn(count, F.when(ratio.isNull() | ratio.between(low, high), F.col(count)))


def without_amended(events: DataFrame, amended: DataFrame, key: str = "accession") -> DataFrame:
    """Events without those of filings that were amended."""
    return events.join(amended.select(key), key, "left_anti")


def digest_events(events: DataFrame, securities: DataFrame, day: Column, days: int = 30, routine: tuple[str, ...] = ("disclosure", "results")) -> DataFrame:
    """Events of the ``days`` up to a day that aren't routine, with name and sector where they are known."""
    e = events.where((F.col("filed") <= day) & (F.datediff(day, "filed") < days) & ~F.col("category").isin(*routine))
    return e.join(securities.select("ticker", "name", "sector"), "ticker", "left")


def estimates_near(filings: DataFrame, estimates: DataFrame, before: int = 4, after: int = 2) -> DataFrame:
    """Filings (ticker, filed, accession) with the newest estimate (ticker, day, eps) from so many days before to so many after, the greatest of one day.

    Filings are dealt to the days of their interval, so that the join is on equal days.
    """
    days = filings.withColumn("day", F.explode(F.sequence(F.date_sub("filed", before), F.date_add("filed", after)))).join(estimates.select("ticker", "day", "eps"), ["ticker", "day"])
    return days.groupBy("ticker", "filed", "accession").agg(F.max(F.struct("day", "eps")).alias("x")).select("ticker", "filed", "accession", "x.day", "x.eps")


def inorganic(dates: DataFrame, deals: DataFrame, days: int = 365) -> DataFrame:
    """(as_of, ticker) with a completed deal in the ``days`` before: how many and the last."""
    return window_join(dates, deals, "filed", days).groupBy("as_of", "ticker").agg(F.count(F.lit(1)).alias("deals"), F.max("filed").alias("last"))


def repeats(tables: dict[str, tuple[DataFrame, tuple[str, ...]]]) -> DataFrame:
    """what, extra: rows of each table beyond the first of their key."""
    out = None
    for name, (df, keys) in sorted(tables.items()):
        one = df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("extra")).select(F.lit(name).alias("what"), "extra")
        out = one if out is None else out.unionByName(one)
    return out


def snapshot_coverage(members: DataFrame) -> DataFrame:
    """Snapshots, first, last and different names of each source of memberships."""
    return members.groupBy("source").agg(F.count_distinct("as_of").alias("snapshots"), F.min("as_of").alias("first"), F.max("as_of").alias("last"), F.count_distinct("ticker").alias("names"))


def riskless(rates: DataFrame, by: list[str], value: str = "value", scale: float = 100.0, least: int = 5, fallback: float = 0.04) -> DataFrame:
    """Mean of a rate per group, over ``scale``; ``fallback`` where there are fewer than ``least`` values."""
    return rates.groupBy(*by).agg(F.when(F.count(value) >= least, F.avg(value) / scale).otherwise(F.lit(fallback)).alias("rate"), F.count(value).alias("n"))


def signal_counts(signals: DataFrame) -> DataFrame:
    """How many names each strategy rates how on every date, and which share that is."""
    n = signals.groupBy("as_of", "strategy", signal_bucket(F.col("signal")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("as_of", "strategy")))


def why_unscored(code: Column, flags: Column, role: Column) -> Column:
    """Why a trade takes no part in the insider signal, or ``scored``."""
    role, flags = F.lower(F.coalesce(role, F.lit(""))), F.coalesce(flags, F.lit(""))
    why = F.concat_ws(
        ", ", F.when(~F.coalesce(code, F.lit("")).isin("P", "S"), "not an open-market trade"), F.when(flags.contains("10b5-1"), "under a plan"), F.when(flags.rlike("(^|,)\\s*plan"), "plan mechanics"),
        F.when(flags.contains("exercise"), "sale after an exercise"), F.when(role.contains("10% owner") & ~role.rlike("director|officer"), "large holder only"),
    )
    return F.when(why != "", why).otherwise("scored")


def packed(weights: DataFrame) -> DataFrame:
    """strategy and spec: its weights (strategy, factor, weight) as JSON, factors in order."""
    return weights.groupBy("strategy").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("factor", "weight"))))).alias("spec"))


def unpacked(specs: DataFrame, factors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weights read back from JSON, and rejects (strategy, reason).

    A strategy is rejected as a whole if its JSON can't be read, a factor isn't in ``factors``
    (factor), a weight is missing, negative or over ``MOST_WEIGHT``, or all weights are zero.
    """
    df = specs.withColumn("_m", F.from_json("spec", "map<string,double>"))
    rows = df.select("strategy", F.explode("_m").alias("factor", "weight")).join(factors.select("factor").distinct().withColumn("_known", F.lit(True)), "factor", "left")
    bad = rows.groupBy("strategy").agg(
        F.max(F.col("_known").isNull()).alias("unknown"), F.max(F.col("weight").isNull() | (F.col("weight") < 0) | (F.col("weight") > MOST_WEIGHT)).alias("range"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("sum")
    )
    reason = F.when(F.col("_m").isNull(), "not JSON").when(F.coalesce("unknown", F.lit(False)), "unknown factor").when(F.coalesce("range", F.lit(False)), "weight out of range").when(F.coalesce("sum", F.lit(0.0)) == 0, "no weight")
    judged = df.join(bad, "strategy", "left").withColumn("reason", reason)
    good = rows.join(judged.where("reason is null").select("strategy"), "strategy", "left_semi").select("strategy", "factor", "weight")
    return good, judged.where("reason is not null").select("strategy", "reason")


def ever_held(snapshots: DataFrame) -> DataFrame:
    """Names of any date's membership: first and last date and how many."""
    return snapshots.groupBy("ticker").agg(F.min("as_of").alias("first"), F.max("as_of").alias("last"), F.count_distinct("as_of").alias("dates"))
