import pytest
from pyspark.sql import functions as F

from pitgrid.functions.scalars import raw_div
from pitgrid.operators import audit, evaluation as ev, panel as pn
from pitgrid.plans import panel as pl


def test_styles():
    assert pl.style_weights() == {"EARNINGS_YIELD": 1.0, "REVENUE_GROWTH_1Y": 1.0, "MOM_12_1": 1.0}
    assert pl.style_weights(momentum="RETURN_1M", value="BOOK_TO_MARKET") == {"BOOK_TO_MARKET": 1.0, "REVENUE_GROWTH_1Y": 1.0, "RETURN_1M": 1.0}
    for wrong in ({"value": "MOM_12_1"}, {"size": "MARKET_CAP"}):
        with pytest.raises(ValueError):
            pl.style_weights(**wrong)


def test_targets_are_of_members_only(spark):
    frame = spark.createDataFrame([("d1", "A", 1.0), ("d1", "B", 2.0), ("d1", "C", 3.0), ("d2", "A", 4.0)], "as_of string, ticker string, X double")
    fwd = spark.createDataFrame([("d1", "A", 0.1), ("d1", "B", 0.3), ("d1", "C", 9.0)], "as_of string, ticker string, fwd double")
    members = spark.createDataFrame([("d1", "A"), ("d1", "B"), ("d2", "A"), ("d2", "C"), ("d1", "A")], "as_of string, ticker string")
    got = sorted((r.as_of, r.ticker, r.fwd, None if r.fwd_excess is None else round(r.fwd_excess, 9)) for r in pn.with_targets(frame, fwd, members, ["fwd"]).collect())
    assert got == [("d1", "A", 0.1, -0.1), ("d1", "B", 0.3, 0.1), ("d2", "A", None, None)]


def test_degraded_dates_are_left_out_or_refused(spark):
    scores = spark.createDataFrame([("d1", "s", "A"), ("d2", "s", "A"), ("d3", "s", "A")], "as_of string, strategy string, ticker string")
    told = spark.createDataFrame([("d1", "s", True), ("d2", "s", False)], "as_of string, strategy string, honest boolean")
    assert [r.as_of for r in ev.honest_only(scores, told).collect()] == ["d1"]
    with pytest.raises(Exception, match="ranked honestly"):
        ev.honest_only(scores, told, strict=True).collect()
    assert ev.honest_only(scores.where("as_of = 'd1'"), told, strict=True).count() == 1


def test_infinities_are_seen_before_they_are_nulled(spark):
    df = spark.createDataFrame([("A", 1.0, 0.0), ("B", -1.0, 0.0), ("C", 0.0, 0.0), ("D", 1.0, 2.0), ("E", None, 0.0), ("A", 5.0, 0.0)], "ticker string, a double, b double")
    wide = df.select("ticker", raw_div(F.col("a"), F.col("b")).alias("X"), (F.col("a") + 1).alias("Y"))
    assert [tuple(r) for r in audit.infinities(wide, ["X", "Y"]).collect()] == [("X", 3, "A,B")]
