from pyspark.sql import functions as F

from pitgrid.operators import holds as ho


def days(df, *columns):
    return df.withColumns({c: F.col(c).cast("date") for c in columns})


def test_stale_and_lacking(spark):
    filed = days(spark.createDataFrame([("2020-01-01", "A", "2018-01-01"), ("2020-01-01", "A", "2018-08-20"), ("2020-01-01", "B", "2018-08-18")], "as_of string, ticker string, filed string"), "as_of", "filed")
    assert [(r.ticker, r.age) for r in ho.stale(filed).collect()] == [("B", 501)]
    names = days(spark.createDataFrame([("2020-01-01", x) for x in "AABC"], "as_of string, ticker string"), "as_of")
    assert sorted(r.ticker for r in ho.lacking_fresh(names, filed).collect()) == ["B", "C"]


def test_values(spark):
    df = spark.createDataFrame([("A", 10.0, 10.0, 100.0), ("B", 10.0, 10.0, 70.0), ("C", 10.0, 10.0, None), ("D", 10.0, 10.0, 0.0), ("E", 10.0, 10.0, 85.0)], "ticker string, n double, px double, cap double")
    got = {r.ticker: (r.apart, r.stands) for r in ho.value_agreement(df, F.col("n") * F.col("px"), F.col("cap")).collect()}
    assert got == {"A": (False, True), "B": (True, False), "E": (True, True)}
    assert {r.ticker: r.n for r in ho.kept_counts(df, "n", "px", "cap").collect()} == {"A": 10.0, "B": None, "C": 10.0, "D": 10.0, "E": 10.0}


def test_estimates_and_reasons(spark):
    f = days(spark.createDataFrame([("A", "2020-01-10", 1)], "ticker string, filed string, accession int"), "filed")
    e = days(spark.createDataFrame([("A", "2020-01-05", 1.0), ("A", "2020-01-06", 2.0), ("A", "2020-01-12", 3.0), ("A", "2020-01-12", 4.0), ("A", "2020-01-13", 5.0)], "ticker string, day string, eps double"), "day")
    assert [(str(r.day), r.eps) for r in ho.estimates_near(f, e).collect()] == [("2020-01-12", 4.0)]
    rows = [("P", None, "Director"), ("A", "plan", None), ("S", "10b5-1,exercise", "10% Owner"), ("P", "", "Director, 10% Owner"), (None, None, None)]
    df = spark.createDataFrame(rows, "c string, f string, r string").select(ho.why_unscored(F.col("c"), F.col("f"), F.col("r")).alias("w"))
    assert [r.w for r in df.collect()] == ["scored", "not an open-market trade, plan mechanics", "under a plan, sale after an exercise, large holder only", "scored", "not an open-market trade"]


def test_specs_are_read_back_or_rejected(spark):
    weights = spark.createDataFrame([("s", "B", 1.0), ("s", "A", 2.0)], "strategy string, factor string, weight double")
    packed = ho.packed(weights)
    assert packed.first().spec == '{"A":2.0,"B":1.0}'
    bad = [("json", "no"), ("unknown", '{"Z":1}'), ("big", '{"A":26}'), ("low", '{"A":-1,"B":2}'), ("zero", '{"A":0,"B":0}'), ("none", "{}"), ("null", None), ("hole", '{"A":null,"B":1}')]
    good, rejects = ho.unpacked(packed.union(spark.createDataFrame(bad, packed.schema)), spark.createDataFrame([("A",), ("B",)], "factor string"))
    assert sorted(map(tuple, good.collect())) == [("s", "A", 2.0), ("s", "B", 1.0)]
    assert dict(map(tuple, rejects.collect())) == {"json": "not JSON", "unknown": "unknown factor", "big": "weight out of range", "low": "weight out of range", "zero": "no weight", "none": "no weight", "null": "not JSON", "hole": "weight out of range"}


def test_repeats_rates_and_signals(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, None), (None, None)], "k int, v string")
    assert sorted(map(tuple, ho.repeats({"x": (df, ("k", "v")), "y": (df.limit(0), ("k",))}).collect())) == [("x", 2), ("y", 0)]
    rates = spark.createDataFrame([("a", float(i)) for i in range(5)] + [("b", 9.0)], "g string, value double")
    assert {r.g: round(r.rate, 9) for r in ho.riskless(rates, ["g"]).collect()} == {"a": 0.02, "b": 0.04}
    signals = spark.createDataFrame([("d", "s", "Buy"), ("d", "s", "Strong Buy"), ("d", "s", "Trim"), ("d", "s", None)], "as_of string, strategy string, signal string")
    assert {r.bucket: (r.n, r.share) for r in ho.signal_counts(signals).collect()} == {"Buy": (2, 0.5), "Sell": (1, 0.25), "Neutral": (1, 0.25)}
