"""How plans grow: what is facts times dates, or names times dates, isn't shuffled or looked at more than once a row."""

import re

import pytest

from pitgrid.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["fact_quarters", "fact_stocks"])
def test_facts_times_dates_stay_where_they_are(spark, name):
    text = plan(catalogue.queries()[name](spark, SF))
    assert not re.search(r"Exchange hashpartitioning\([^)]*(concept|as_of)#", text)


@pytest.mark.parametrize("name", ["fact_quarters", "fact_ttm", "fact_stocks", "earnings_surprise", "fundamental_ratios"])
def test_facts_hold_for_spans_of_dates(spark, name):
    # a window by date would go over every fact again for each date
    assert not re.search(r"Window \[[^\n]*concept#[^\n]*as_of#", plan(catalogue.queries()[name](spark, SF)))


def test_facts_make_short_methods(spark):
    from pitgrid.plans import filings

    df = filings.facts(spark, SF, filings.FLOWS)
    text = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    assert all(int(x) < 8000 for x in re.findall(r"maxMethodCodeSize:(\d+)", text))


@pytest.mark.parametrize("name, times", [("landed_ownership", 1), ("landed_ownership_rejected", 2)])
def test_documents_are_parsed_once_for_each_use(spark, name, times):
    assert plan(catalogue.queries()[name](spark, SF)).count("from_xml(") == times


def test_exponential_means_of_several_columns_share_their_order(spark):
    from pitgrid.operators import timeseries as ts

    grid = spark.createDataFrame([("A", i, float(i % 5), float(i % 3)) for i in range(9)], "ticker string, session int, x double, y double").repartition("ticker")
    one, two = ts.ewm(grid, {"a": "x"}, 0.5), ts.ewm(grid, {"a": "x", "b": "y"}, 0.5)
    assert len(re.findall(r"\bSort \[", plan(two))) == len(re.findall(r"\bSort \[", plan(one)))
    assert two.select("session", "a").collect() == one.select("session", "a").collect()


@pytest.mark.parametrize("name", ["factor_transforms", "factor_winsorize_mad", "factor_neutralize"])
def test_quantiles_of_a_cell_are_not_made_anew_for_every_row(spark, name):
    assert not re.search(r"(percentile|median)\(", plan(catalogue.queries()[name](spark, SF)))


def test_mean_ranks_need_one_shuffle(spark):
    from pyspark.sql import functions as F

    from pitgrid.functions.scalars import average_rank

    df = spark.createDataFrame([("a", x) for x in (3.0, 1.0, 3.0, None)], "k string, x double").withColumn("r", average_rank(F.col("x"), "k"))
    assert plan(df).count("Exchange hashpartitioning") == 1
    assert sorted((r.x, r.r) for r in df.where("x is not null").collect()) == [(1.0, 1.0), (3.0, 2.5), (3.0, 2.5)]


def test_quantiles_lie_between_neighbours(spark):
    from pitgrid.operators import transforms as tr

    df = spark.createDataFrame([("d", "f", x) for x in (4.0, 1.0, None, 2.0, 8.0)], "as_of string, factor string, v double")
    got = tr.with_quantiles(df, "v", {"a": 0.5, "b": 0.1}).first()
    assert got.a == 3.0 and abs(got.b - 1.3) < 1e-12


@pytest.mark.parametrize("name, keys", [("bars", 1), ("corporate_events", 2), ("insider_txns", 2)])
def test_given_rows_are_dealt_once_to_parts_that_grow_in_number(spark, monkeypatch, name, keys):
    from pitgrid.plans import fixtures

    few = fixtures.derived(spark, SF, name).rdd.getNumPartitions()
    monkeypatch.setattr(fixtures, "ROWS_A_PART", 200)
    df = fixtures.derived(spark, SF, name)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == keys
    assert not re.search(r"Exchange hashpartitioning\([^)]*(ticker|_groupingexpression)#", plan(df))
    assert df.rdd.getNumPartitions() > few


def test_names_without_a_bar_around_a_date(spark):
    from pitgrid.operators import audit

    members = spark.createDataFrame([("2000-03-31", x) for x in "abcd"] + [("2000-03-31", "a")], "as_of string, ticker string").selectExpr("date(as_of) as as_of", "ticker")
    bars = spark.createDataFrame([("a", "2000-01-31"), ("b", "2000-01-30"), ("b", "2000-05-01"), ("c", "2000-04-30")], "ticker string, date string").selectExpr("ticker", "date(date) as date")
    df = audit.survivorship_gap(members, bars)
    assert (df.first().members, df.first().gap) == (4, 0.5)
    assert "Generate" not in plan(df)


def test_a_group_without_spread_has_no_correlation(spark):
    from pitgrid.operators import evaluation as ev

    df = spark.createDataFrame([("a", 1.0, float(i)) for i in range(8)] + [("b", float(i), float(i * i)) for i in range(8)], "k string, x double, y double")
    assert {r.k: (r.ic, r.n) for r in ev.rank_ic(df, "x", "y", ["k"], 8).collect()} == {"a": (None, 8), "b": (1.0, 8)}


def test_families_meet_in_one_shuffle(spark):
    from pitgrid.operators import panel as pn

    made = [spark.createDataFrame([("d", t, v)], f"as_of string, ticker string, {c} double") for c, t, v in (("x", "a", 1.0), ("y", "a", 2.0), ("z", "b", 3.0))]
    df = pn.joined(made)
    assert plan(df).count("Exchange hashpartitioning") == 1
    assert sorted((r.ticker, r.x, r.y, r.z) for r in df.collect()) == [("a", 1.0, 2.0, None), ("b", None, None, 3.0)]


def test_sessions_between_bars_are_filled_in_one_shuffle(spark):
    from pitgrid.operators import timeseries as ts

    sessions = spark.createDataFrame([(f"2000-01-0{i}", i) for i in range(1, 7)], "date string, session int")
    bars = spark.createDataFrame([("a", "2000-01-02", 1.0), ("a", "2000-01-05", 2.0), ("b", "2000-01-06", 3.0), ("b", "1999-01-01", 9.0)], "ticker string, date string, close double")
    df = ts.filled(bars, sessions, parts=3)
    assert plan(df).count("Exchange hashpartitioning") == 1
    got = sorted((r.ticker, r.session, r.date[-1], r.close, r.close_ff) for r in df.collect())
    assert got == [("a", 2, "2", 1.0, 1.0), ("a", 3, "3", None, 1.0), ("a", 4, "4", None, 1.0), ("a", 5, "5", 2.0, 2.0), ("a", 6, "6", None, 2.0), ("b", 6, "6", 3.0, 3.0)]


def test_trades_times_dates_stay_where_they_are(spark):
    from pitgrid.plans import alternatives as al

    assert not re.search(r"Exchange hashpartitioning\([^)]*(as_of|insider)#", plan(al.insiders(spark, SF)))


def test_facts_times_dates_are_made_once_for_sums_and_years(spark):
    text = plan(catalogue.queries()["fact_ttm"](spark, SF))
    assert len(re.findall(r"Generate explode\(_f#", text)) == 1


def test_dates_of_facts_need_no_bars(spark):
    from pitgrid.plans import fixtures

    df = fixtures.derived(spark, SF, "sessions")
    assert "derived-bars" not in "".join(df.inputFiles())
    assert {r.date for r in df.collect()} == {r.date for r in fixtures.read(spark, SF, "bars").collect()}
