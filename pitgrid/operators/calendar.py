"""The exchange's calendar, computed from its rules as columns: holidays, early closes, sessions, and when a bar is final."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ZONE = "America/New_York"
# Hours of the bell in New York, minutes until a bar is final, and closures that no rule gives.
CLOSE, EARLY, DELAY = 16 * 60, 13 * 60, 45
SPECIAL = {
    "2001-09-11": "September 11 attacks", "2001-09-12": "September 11 attacks", "2001-09-13": "September 11 attacks", "2001-09-14": "September 11 attacks",
    "2004-06-11": "National Day of Mourning (Reagan)", "2007-01-02": "National Day of Mourning (Ford)", "2012-10-29": "Hurricane Sandy", "2012-10-30": "Hurricane Sandy",
    "2018-12-05": "National Day of Mourning (G.H.W. Bush)", "2025-01-09": "National Day of Mourning (Carter)",
}


def nth_weekday(year: Column, month: int, weekday: int, n: int) -> Column:
    """The n-th such weekday (Monday is 0) of a month, or the last one where n is -1."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    if n < 0:
        last = F.last_day(first)
        return F.date_sub(last, F.pmod(F.weekday(last) - weekday, F.lit(7)))
    return F.date_add(first, F.pmod(weekday - F.weekday(first), F.lit(7)) + 7 * (n - 1))


def easter(year: Column) -> Column:
    """Western Easter Sunday: the Sunday after the paschal moon, whose day comes from the year's place in the lunar cycle."""
    whole = lambda a, b: F.floor(a / b)
    golden, century = year % 19, whole(year, 100)
    moon = F.pmod(century - whole(century, 4) - whole(8 * century + 13, 25) + 19 * golden + 15, F.lit(30))
    # the moons of the last two days of the cycle come a day early
    moon = moon - F.when((moon == 29) | ((moon == 28) & (golden > 10)), 1).otherwise(0)
    full = F.date_add(F.make_date(year, F.lit(3), F.lit(21)), moon.cast("int"))
    return F.date_add(full, 7 - F.pmod(F.weekday(full) + 1, F.lit(7)))


def observed(day: Column) -> Column:
    """A holiday on Saturday is kept on Friday, one on Sunday on Monday."""
    w = F.weekday(day)
    return F.date_add(day, F.when(w == 5, -1).when(w == 6, 1).otherwise(0))


def holidays(years: DataFrame, year: str = "year") -> DataFrame:
    """date and holiday: full-day closures of each year, by rule, and the special ones of those years."""
    y = F.col(year)
    fixed = lambda m, d: F.make_date(y, F.lit(m), F.lit(d))
    new_year = fixed(1, 1)
    rules = {
        # on a Saturday it isn't kept: the Friday before ends the old year
        "New Year's Day": F.when(F.weekday(new_year) != 5, observed(new_year)),
        "Martin Luther King Jr. Day": F.when(y >= 1998, nth_weekday(y, 1, 0, 3)),
        "Washington's Birthday": nth_weekday(y, 2, 0, 3),
        "Good Friday": F.date_sub(easter(y), 2),
        "Memorial Day": nth_weekday(y, 5, 0, -1),
        "Juneteenth": F.when(y >= 2022, observed(fixed(6, 19))),
        "Independence Day": observed(fixed(7, 4)),
        "Labor Day": nth_weekday(y, 9, 0, 1),
        "Thanksgiving Day": nth_weekday(y, 11, 3, 4),
        "Christmas Day": observed(fixed(12, 25)),
    }
    special = [F.struct(F.when(y == int(d[:4]), F.lit(d).cast("date")).alias("date"), F.lit(name).alias("holiday")) for d, name in SPECIAL.items()]
    named = [F.struct(day.alias("date"), F.lit(name).alias("holiday")) for name, day in rules.items()]
    return years.select(F.explode(F.array(*named, *special)).alias("h")).select("h.*").where("date is not null")


def days(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Every day from ``first`` to ``last``: whether there is a session and why not, its number, the sessions before and after, early closes and when its bar is final.

    The days around the ends are looked at too, so that the first and last day have their
    neighbours; sessions are numbered from the first one asked for.
    """
    span = lambda a, b: F.sequence(F.date_sub(F.lit(a).cast("date"), 15), F.date_add(F.lit(b).cast("date"), 15))
    every = spark.range(1).select(F.explode(span(first, last)).alias("date"))
    closed = holidays(every.select(F.explode(F.array(F.year("date"), F.year("date") + 1)).alias("year")).distinct())
    df = every.join(closed, "date", "left").withColumn("reason", F.when(F.weekday("date") >= 5, "Weekend").otherwise(F.col("holiday")))
    open_ = F.col("reason").isNull()
    y, month, day = F.year("date"), F.month("date"), F.dayofmonth("date")
    eve = (((month == 7) & (day == 3)) | ((month == 12) & (day == 24))) & (F.weekday("date") <= 3)
    early = open_ & (eve | (F.col("date") == F.date_add(nth_weekday(y, 11, 3, 4), 1)))
    order = Window.orderBy("date")  # as many rows as days
    own = F.when(open_, F.col("date"))
    df = df.withColumns({
        "is_open": open_, "early_close": early,
        "previous": F.last(own, True).over(order.rowsBetween(Window.unboundedPreceding, -1)), "next": F.first(own, True).over(order.rowsBetween(1, Window.unboundedFollowing)),
    })
    bell = F.when(F.col("early_close"), EARLY).otherwise(CLOSE)
    at = lambda minutes: F.when(F.col("is_open"), F.to_utc_timestamp(F.timestamp_add("MINUTE", minutes, F.col("date").cast("timestamp_ntz")), F.lit(ZONE)))
    df = df.withColumns({"closes_at": at(bell), "final_at": at(bell + DELAY)})
    df = df.where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return df.select(
        "date", "is_open", "reason", "early_close", F.when(F.col("is_open"), F.sum(F.col("is_open").cast("int")).over(order)).cast("int").alias("session"), "previous", "next", "closes_at", "final_at",
        F.date_trunc("week", "date").cast("date").alias("week"), F.date_trunc("month", "date").cast("date").alias("month"), F.date_trunc("quarter", "date").cast("date").alias("quarter"),
    )


def completed(rows: DataFrame, calendar: DataFrame, time: str, name: str = "completed") -> DataFrame:
    """``rows`` with the newest session whose bar is final at the UTC ``time``: an equal join on the day in New York."""
    c = calendar.select(F.col("date").alias("_d"), "final_at", "previous")
    local = F.from_utc_timestamp(F.col(time).cast("timestamp"), ZONE).cast("date")
    df = rows.withColumn("_d", local).join(c, "_d", "left")
    done = F.col("final_at").isNotNull() & (F.col(time).cast("timestamp") >= F.col("final_at").cast("timestamp"))
    return df.withColumn(name, F.when(done, F.col("_d")).otherwise(F.col("previous"))).drop("_d", "final_at", "previous")


def finished(bars: DataFrame, calendar: DataFrame, now: str, date: str = "date") -> DataFrame:
    """Bars up to the last session whose bar is final at the UTC time ``now``; later and future bars go."""
    last = completed(bars.sparkSession.range(1).select(F.lit(now).cast("timestamp").alias("now")), calendar, "now", "_last").select("_last")
    return bars.join(last, F.col(date) <= F.col("_last")).drop("_last")  # against one row


def without_live_bar(bars: DataFrame, calendar: DataFrame, keys: list[str], traded_at: str, date: str = "date") -> DataFrame:
    """Bars without each key's last one if its session was still live at the payload's last trade: one minute before the bell or earlier.

    A key without a time of trade, and a last bar of a day without a session, stay whole.
    """
    last = F.max(date).over(Window.partitionBy(*keys))
    c = calendar.select(F.col("date").alias(date), F.col("closes_at").cast("timestamp").alias("_bell"))
    df = bars.withColumn("_last", last).join(c, date, "left")
    live = (F.col(date) == F.col("_last")) & (F.col(traded_at).cast("timestamp") < F.timestamp_add("MINUTE", F.lit(-1), F.col("_bell")))
    return df.where(~F.coalesce(live, F.lit(False))).drop("_last", "_bell")
