import pytest
from pyspark.sql import functions as F

from pitgrid.operators import panel as pn, track as tk


def test_entry_is_after_the_run(spark):
    scores = spark.createDataFrame([("d", "s", t, float(9 - i), i) for i, t in enumerate("ABC", 1)], "as_of string, strategy string, ticker string, composite double, rank int")
    dates = spark.createDataFrame([("d", 1)], "as_of string, session int")
    px = {"A": (100, 10, 11, 12), "B": (100, 10, 10, 10), "C": (100, 10, 9, None)}
    grid = spark.createDataFrame([(t, i + 1, None if p is None else float(p)) for t, row in px.items() for i, p in enumerate(row)], "ticker string, session int, close_ff double")
    bench = spark.createDataFrame([(2, 10.0), (3, 10.5), (4, 12.0)], "session int, close double")
    got = {r.horizon: r for r in tk.live_cohorts(scores, grid, bench, dates, (1, 2), 2).collect()}
    assert got[1].mean == pytest.approx(0.05) and got[1].excess == pytest.approx(0.0) and got[1].n == 2
    assert got[2].mean == pytest.approx(0.1) and got[2].bench == pytest.approx(0.2) and got[2].ic is None


def test_report_counts_independent_periods_and_turns_avoid_lists(spark):
    rows = [(f"d{i}", s, 4, e, 0.1) for i, e in enumerate((0.1, -0.2, -0.3), 1) for s in ("good", "bad")]
    cohorts = spark.createDataFrame(rows, "as_of string, strategy string, horizon int, excess double, ic double")
    dates = spark.createDataFrame([("d1", 1), ("d2", 3), ("d3", 9)], "as_of string, session int")
    got = {r.strategy: r for r in tk.cohort_report(cohorts, dates, ("bad",)).collect()}
    assert (got["good"].independent, got["good"].cohorts) == (3, 3) and got["good"].hit == pytest.approx(1 / 3) and got["bad"].hit == pytest.approx(2 / 3)


def test_drift_and_floor(spark):
    rows = [("d1", "s", c, float(20 - i), i) for i, c in enumerate("ABCDEFGHIJ", 1)] + [("d2", "s", c, float(20 - i), i) for i, c in enumerate("JABCDEFGHK", 1)]
    got = tk.drift_summary(spark.createDataFrame(rows, "as_of string, strategy string, ticker string, composite double, rank int"), 2).collect()
    assert len(got) == 1 and got[0].turnover == 0.5 and got[0].names == 9 and 0 < got[0].correlation < 1
    gaps = spark.createDataFrame([("2000-01-01", 0.05), ("2001-01-01", 0.2), ("2002-01-01", 0.1), ("2003-01-01", 0.0), ("2003-06-01", 0.02)], "as_of string, gap double").withColumn("as_of", F.col("as_of").cast("date"))
    assert {r.year: r.safe for r in tk.safe_from(gaps).collect()} == {2000: False, 2001: False, 2002: True, 2003: True}


def test_orders_and_sanity(spark):
    bars = spark.createDataFrame([("A", "2024-01-01", 1.0), ("A", "2024-01-09", 1.0), ("B", "2024-01-01", None), ("C", "2024-01-01", 2.0)], "ticker string, date string, close double").withColumn("date", F.col("date").cast("date"))
    assert sorted((r.ticker, r.no_price, r.future) for r in tk.price_sanity(bars, "2024-01-05").collect()) == [("A", 0, 1), ("B", 1, 0)]
    news = spark.createDataFrame([("A", 1, [], 0.9, 5), ("A", 2, ["ma"], None, 1), ("A", 3, ["ma"], -0.5, 2), ("A", 4, [], -0.9, 6)], "ticker string, id int, events array<string>, tone double, published int")
    assert [r.id for r in sorted(tk.news_order(news, ["ticker"], "tone", 3).collect(), key=lambda r: r.place)] == [3, 2, 4]


def test_named_universes(spark):
    rows = [("d", "A", "Health Care", 6e9, 1.0, 1.0), ("d", "B", "Health Care", None, None, None), ("d", "C", "Energy", 6e9, 1.0, 1.0), ("d", "D", "Health Care", 1e9, 0.0, -1.0)]
    names = spark.createDataFrame(rows, "as_of string, ticker string, sector string, market_cap double, dividend_yield double, eps double").withColumns({"country": F.lit("US"), "price": F.lit(20.0), "adv": F.lit(3e7), "is_adr": F.when(F.col("ticker") == "C", 1), "exchange": F.lit("NYSE")})
    members = spark.createDataFrame([("d", "SPY", t) for t in "ABCD"] + [("d", "QQQ", "A")], "as_of string, index_symbol string, ticker string")
    of = lambda name, **k: sorted(r.ticker for r in pn.preset(names, members, name, **k).collect())
    assert of("healthcare") == ["A", "B", "D"] and of("qqq") == ["A"] and of("dividend_quality") == ["A", "B", "C"] and of("dividend_quality", exclude_adr=True) == ["A", "B"]
    assert of("us_mid_cap") == ["A", "B", "C"] and of("us_large_cap") == ["B"] and of("spy", exchanges=["OTC"]) == [] and of("iwm") == []
