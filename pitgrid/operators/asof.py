"""Point-in-time joins: what was knowable at a date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str], max_age_days: int | None = None, tie: str | None = None) -> DataFrame:
    """Every row of ``left`` with ``values`` of the latest row of ``right`` at or before it.

    Both sides are united and each left row takes the last right row before it within its
    key: one shuffle on the key, with no range join and no product of the sides.  Among right
    rows of one time, the one with the greatest ``tie`` counts.  A value older than
    ``max_age_days`` is NULL.  Left rows keep all their columns and may repeat.
    """
    mine = F.struct(*[F.col(c) for c in left.columns])
    found = F.struct(F.col(right_time).cast("timestamp").alias("t"), *[F.col(c) for c in values])
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(on)]
    lefts = left.select(*keys, F.col(left_time).cast("timestamp").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("string").alias("_tie"), mine.alias("_left"))
    rights = right.where(F.col(right_time).isNotNull()).select(
        *keys, F.col(right_time).cast("timestamp").alias("_t"), F.lit(0).alias("_side"), (F.col(tie).cast("string") if tie else F.lit("")).alias("_tie"), found.alias("_right")
    )
    both = lefts.unionByName(rights, allowMissingColumns=True)
    order = Window.partitionBy(*[f"_k{i}" for i in range(len(on))]).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn("_found", F.last("_right", ignorenulls=True).over(order)).where("_side = 1")
    fresh = F.lit(True) if max_age_days is None else F.datediff("_t", F.col("_found.t")) <= max_age_days
    return last.select("_left.*", *[F.when(fresh, F.col(f"_found.{c}")).alias(c) for c in values])


def window_join(dates: DataFrame, facts: DataFrame, time: str, days: int, as_of: str = "as_of", closed_end: bool = True, shift: int = 0) -> DataFrame:
    """``facts`` of the ``days`` before each as-of date: as_of - days < time <= as_of.

    Each fact is dealt to the month-long buckets of dates that can see it, so the join is on
    equal buckets and the interval is checked within.  ``shift`` days pass before a fact is
    known; without ``closed_end`` the as-of day itself is out.
    """
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / 31)
    known = F.date_add(F.col(time).cast("date"), shift)
    dealt = facts.withColumn("_known", known).withColumn("_b", F.explode(F.sequence(bucket(F.col("_known")), bucket(F.date_add("_known", days)))))
    joined = dates.withColumn("_b", bucket(F.col(as_of))).join(dealt, "_b")
    end = F.col("_known") <= F.col(as_of) if closed_end else F.col("_known") < F.col(as_of)
    return joined.where(end & (F.col("_known") > F.date_sub(F.col(as_of), days))).drop("_b", "_known")


def members_asof(dates: DataFrame, members: DataFrame) -> DataFrame:
    """as_of, index_symbol, source, ticker: the rows of each source's latest snapshot."""
    snaps = members.select("index_symbol", "source", F.col("as_of").alias("snapshot")).distinct()
    # a source is asked about the dates from its first snapshot on; they meet by year
    first = snaps.groupBy("index_symbol", "source").agg(F.year(F.min("snapshot")).alias("_a"), F.year(F.max("snapshot")).alias("_z"))
    last = dates.agg(F.max(F.year("as_of")).alias("_y")).select(F.col("_y").alias("_last"))
    years = dates.select("as_of", F.year("as_of").alias("_y"))
    spans = first.join(last, F.col("_a") <= F.col("_last")).select("index_symbol", "source", F.explode(F.sequence("_a", F.greatest("_z", "_last"))).alias("_y"))
    keyed = years.join(spans, "_y").drop("_y")
    latest = asof_join(keyed, snaps, ["index_symbol", "source"], "as_of", "snapshot", ["snapshot"]).where("snapshot is not null")
    rows = members.select("index_symbol", "source", F.col("as_of").alias("snapshot"), "ticker")
    return latest.join(rows, ["index_symbol", "source", "snapshot"])


def members_current(dates: DataFrame, members: DataFrame, closed: DataFrame) -> DataFrame:
    """``members_asof`` under today's symbols: names mapped by ``closed`` renames (old, current), each name once per source and date.

    ``named`` is the symbol of the snapshot, the smallest where two have become one.
    """
    found = members_asof(dates, members).join(closed.select(F.col("old").alias("ticker"), "current"), "ticker", "left")
    by = ["as_of", "index_symbol", "source", "snapshot"]
    return found.groupBy(*by, F.coalesce("current", "ticker").alias("symbol")).agg(F.min("ticker").alias("named"), F.count(F.lit(1)).alias("names")).withColumnRenamed("symbol", "ticker")


def snapshot(dates: DataFrame, series: DataFrame, spans: dict[str, int]) -> DataFrame:
    """as_of, series_id, value and, for each name of ``spans``, the change over so many days, all as known then.

    Every date is asked of every series; the dates are one row, which each series gets.
    """
    asked = series.select("series_id").distinct().join(dates.agg(F.sort_array(F.collect_set("as_of")).alias("_d"))).select("series_id", F.explode("_d").alias("as_of"))
    out = asof_join(asked, series, ["series_id"], "as_of", "date", ["value"])
    for name, days in spans.items():
        shifted = series.select("series_id", F.date_add("date", days).alias("date"), F.col("value").alias(f"_{name}"))
        out = asof_join(out, shifted, ["series_id"], "as_of", "date", [f"_{name}"])
    return out.select("as_of", "series_id", "value", *[(F.col("value") - F.col(f"_{n}")).alias(n) for n in spans])
