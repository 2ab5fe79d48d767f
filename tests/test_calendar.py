import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitgrid.operators import calendar as ca


@pytest.fixture(scope="module")
def almanac(spark):
    rows = ca.days(spark, "1997-12-20", "2028-01-10").collect()
    return {r.date: r for r in rows}


D = dt.date.fromisoformat
GOLDEN = {
    "2025-01-01": "New Year's Day", "2025-01-09": "National Day of Mourning (Carter)", "2025-04-18": "Good Friday", "2026-04-03": "Good Friday", "2024-03-29": "Good Friday", "2000-04-21": "Good Friday",
    "2019-04-19": "Good Friday", "2008-03-21": "Good Friday", "2011-04-22": "Good Friday", "2026-01-19": "Martin Luther King Jr. Day", "2026-02-16": "Washington's Birthday", "2026-05-25": "Memorial Day", "2026-06-19": "Juneteenth",
    "2026-07-03": "Independence Day", "2026-09-07": "Labor Day", "2026-11-26": "Thanksgiving Day", "2026-12-25": "Christmas Day", "2027-06-18": "Juneteenth", "2027-07-05": "Independence Day",
    "2027-12-24": "Christmas Day", "2023-01-02": "New Year's Day", "2012-10-29": "Hurricane Sandy", "2001-09-12": "September 11 attacks", "2026-11-07": "Weekend",
}


@pytest.mark.parametrize("day", GOLDEN)
def test_closed(almanac, day):
    assert not almanac[D(day)].is_open and almanac[D(day)].reason == GOLDEN[day]


@pytest.mark.parametrize("day", ["2021-12-31", "2027-12-31", "2021-06-18", "2026-11-09", "2026-07-02"])
def test_open(almanac, day):
    assert almanac[D(day)].is_open and almanac[D(day)].reason is None


def test_early_closes(almanac):
    for day in ("2025-07-03", "2025-11-28", "2025-12-24", "2026-11-27", "2026-12-24"):
        assert almanac[D(day)].early_close
    assert not almanac[D("2026-07-03")].early_close and not almanac[D("2026-07-02")].early_close


def test_neighbours(almanac):
    assert almanac[D("2026-11-27")].previous == D("2026-11-25") and almanac[D("2026-11-25")].next == D("2026-11-27")
    assert almanac[D("2026-07-02")].next == D("2026-07-06") and almanac[D("2026-01-20")].previous == D("2026-01-16")
    numbers = [almanac[d].session for d in sorted(almanac) if almanac[d].is_open]
    assert numbers == list(range(1, len(numbers) + 1))
    assert almanac[D("1997-12-20")].previous == D("1997-12-19")


def test_easter_by_another_rule(spark):
    years = {r.y: r.e for r in spark.range(1900, 2200).select(F.col("id").alias("y"), ca.easter(F.col("id").cast("int")).alias("e")).collect()}
    for y, e in years.items():
        # Gauss's rule with the constants of these centuries
        m, n = (24, 5) if y < 2100 else (24, 6)
        d = (19 * (y % 19) + m) % 30
        x = (2 * (y % 4) + 4 * (y % 7) + 6 * d + n) % 7
        day = dt.date(y, 3, 22) + dt.timedelta(d + x)
        if (day.month, day.day) == (4, 26):
            day -= dt.timedelta(7)
        if (day.month, day.day) == (4, 25) and d == 28 and x == 6 and y % 19 > 10:
            day -= dt.timedelta(7)
        assert e == day, y


def test_last_final_session(spark):
    cases = {
        "2026-08-11 20:50:00": "2026-08-11", "2026-11-10 20:50:00": "2026-11-09", "2026-11-10 22:00:00": "2026-11-10", "2026-11-26 23:00:00": "2026-11-25",
        "2026-11-27 19:00:00": "2026-11-27", "2026-11-27 18:30:00": "2026-11-25", "2026-11-09 23:00:00": "2026-11-09", "2026-11-10 02:00:00": "2026-11-09",
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r.t: r.completed for r in ca.completed(rows.withColumn("at", F.col("t").cast("timestamp")), ca.days(spark, "2026-01-01", "2026-12-31"), "at").collect()}
    assert {k: str(v) for k, v in got.items() if k} == cases and got[None] is None


def test_unfinished_bars(spark):
    calendar = ca.days(spark, "2026-11-01", "2026-11-30")
    rows = [("A", "2026-11-09", "2026-11-10 20:58:00"), ("A", "2026-11-10", "2026-11-10 20:58:00"), ("B", "2026-11-10", "2026-11-10 21:00:00"), ("C", "2026-11-08", "2026-11-08 10:00:00"), ("D", "2026-11-12", None)]
    bars = spark.createDataFrame(rows, "ticker string, date string, traded_at string").withColumn("date", F.col("date").cast("date"))
    left = sorted((r.ticker, str(r.date)) for r in ca.without_live_bar(bars, calendar, ["ticker"], "traded_at").collect())
    assert left == [("A", "2026-11-09"), ("B", "2026-11-10"), ("C", "2026-11-08"), ("D", "2026-11-12")]
    left = sorted((r.ticker, str(r.date)) for r in ca.finished(bars, calendar, "2026-11-11 20:00:00").collect())
    assert left == [("A", "2026-11-09"), ("A", "2026-11-10"), ("B", "2026-11-10"), ("C", "2026-11-08")]
    assert ca.without_live_bar(bars.limit(0), calendar, ["ticker"], "traded_at").count() == 0
