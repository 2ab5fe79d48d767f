import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitgrid.operators import runs as ru
from pitgrid.operators import store
from pitgrid.operators import versions as ve

D = dt.date.fromisoformat


def scores(spark, rows):
    return spark.createDataFrame(rows, "strategy string, as_of string, universe string, ticker string, composite double, coverage double, rank int").withColumn("as_of", F.col("as_of").cast("date"))


def test_a_rerun_replaces_its_run_only(spark):
    path = store.shared_folder(spark)
    first = [("a", "2020-01-31", "u", t, s, 1.0, i) for i, (t, s) in enumerate((("X", 2.0), ("Y", 1.0), ("Z", 0.5)), 1)]
    ru.save(scores(spark, first + [("b", "2020-01-31", "u", "X", 7.0, 1.0, 1), ("a", "2020-02-29", "u", "X", 8.0, 1.0, 1), ("a", "2020-01-31", "v", "X", 9.0, 1.0, 1)]), path, "2020-03-01 00:00:00")
    old = {(r.strategy, str(r.as_of), r.universe): r.run_id for r in ru.headers(ru.stored(spark, path)).collect()}
    ru.save(scores(spark, [("a", "2020-01-31", "u", "Y", 5.0, 0.9, 1)]), path, "2020-03-02 00:00:00")
    got = ru.stored(spark, path)
    assert sorted((r.strategy, str(r.as_of), r.universe, r.ticker, r.composite) for r in got.collect()) == [
        ("a", "2020-01-31", "u", "Y", 5.0), ("a", "2020-01-31", "v", "X", 9.0), ("a", "2020-02-29", "u", "X", 8.0), ("b", "2020-01-31", "u", "X", 7.0),
    ]
    new = {(r.strategy, str(r.as_of), r.universe): r.run_id for r in ru.headers(got).collect()}
    assert {k for k in old if old[k] != new[k]} == {("a", "2020-01-31", "u")}
    # the same rerun once more changes nothing
    ru.save(scores(spark, [("a", "2020-01-31", "u", "Y", 5.0, 0.9, 1)]), path, "2020-03-02 00:00:00")
    assert {r.run_id for r in ru.headers(ru.stored(spark, path)).collect()} == set(new.values())
    ru.drop(spark, path, ru.stored(spark, path).where("strategy = 'b'"))
    assert ru.stored(spark, path).where("strategy = 'b'").count() == 0 and ru.stored(spark, path).count() == 3


def test_runs_need_their_keys_and_carry_detail(spark):
    path = store.shared_folder(spark)
    with pytest.raises(Exception, match="a run needs"):
        ru.save(scores(spark, [(None, "2020-01-31", "u", "X", 1.0, 1.0, 1)]), path, "2020-03-01 00:00:00")
    factors = spark.createDataFrame([("a", "2020-01-31", "X", "F2", 1.0, 1.0, 0.1, 0.2, 0.3), ("a", "2020-01-31", "X", "F1", 2.0, 2.0, 0.1, None, 0.3)], "strategy string, as_of string, ticker string, factor string, raw double, winsorized double, z double, sector_z double, pct_rank double")
    rows = ru.detailed(scores(spark, [("a", "2020-01-31", "u", "X", 1.0, 1.0, 1), ("a", "2020-01-31", "u", "Y", 1.0, 1.0, 2)]), factors.withColumn("as_of", F.col("as_of").cast("date")))
    ru.save(rows, path, "2020-03-01 00:00:00")
    got = {r.ticker: r for r in ru.stored(spark, path).collect()}
    assert [d.factor for d in got["X"].detail] == ["F1", "F2"] and got["Y"].detail is None and got["X"].universe_n == 2


DATES = ("2020-03-31", "2020-06-30", "2020-09-30")
FACTS = [("A", "shares", "2020-02-01", 1.0), ("A", "shares", "2020-05-01", 2.0), ("A", "shares", "2020-08-01", 3.0), ("B", "shares", "2019-06-01", 4.0), ("B", "shares", "2020-05-05", 5.0)]


class Panel:
    """A panel whose value is the newest filed one, and the cells that each refresh asked to be built."""

    def __init__(self, spark):
        self.spark, self.path, self.asked, self.number = spark, store.shared_folder(spark) + "/panel", [], 0

    def refresh(self, facts, dates=DATES, names="AB", splits=()):
        spark, self.number = self.spark, self.number + 1
        facts = spark.createDataFrame(list(facts), "ticker string, concept string, filed string, val double").withColumn("filed", F.col("filed").cast("date"))
        splits = spark.createDataFrame(list(splits), "ticker string, date string").withColumn("date", F.col("date").cast("date"))
        cells = spark.createDataFrame([(d, n) for d in dates for n in names], "as_of string, ticker string").withColumn("as_of", F.col("as_of").cast("date"))

        def build(todo):
            self.asked.append(sorted((str(r.as_of), r.ticker) for r in todo.collect()))
            return todo.join(facts, "ticker").where("filed <= as_of").groupBy("as_of", "ticker").agg(F.max_by("val", "filed").alias("value"))

        out = ve.refresh(spark, self.path, ve.cell_versions(cells, {"facts": (facts, "filed"), "splits": (splits, "date")}), ve.valid_until(cells, facts, splits), build, self.number)
        return {(str(r.as_of), r.ticker): (r.value, r.built_in) for r in out.collect()}


def test_only_what_changed_is_built(spark):
    p = Panel(spark)
    got = p.refresh(FACTS)
    assert len(p.asked[0]) == 6 and got["2020-09-30", "A"] == (3.0, 1) and got["2020-03-31", "B"] == (4.0, 1)
    got = p.refresh(FACTS)
    assert p.asked[1] == [] and {b for _, b in got.values()} == {1}
    changed = [f if f[2] != "2020-08-01" else (*f[:3], 3.5) for f in FACTS]
    got = p.refresh(changed)
    assert p.asked[2] == [("2020-09-30", "A")] and got["2020-09-30", "A"] == (3.5, 3) and got["2020-09-30", "B"] == (5.0, 1)
    # a restatement filed in between changes all later dates of that name
    got = p.refresh([*changed, ("B", "shares", "2020-06-15", 6.0)])
    assert p.asked[3] == [("2020-06-30", "B"), ("2020-09-30", "B")] and got["2020-06-30", "B"] == (6.0, 4) and got["2020-03-31", "B"] == (4.0, 1)


def test_new_dates_take_over_rows_that_hold(spark):
    p = Panel(spark)
    p.refresh(FACTS)
    got = p.refresh(FACTS, (*DATES, "2020-12-31"))
    assert p.asked[1] == [] and got["2020-12-31", "A"] == (3.0, 1)
    # a split's date passes, and a share count of the fifth of May 2020 gets stale
    got = p.refresh(FACTS, (*DATES, "2020-12-31", "2021-10-15"), splits=[("A", "2021-01-15")])
    assert p.asked[2] == [("2021-10-15", "A"), ("2021-10-15", "B")]
    # a name that goes leaves the dates asked for; a new one is built and stored even without facts
    got = p.refresh(FACTS, names="AC")
    assert ("2020-09-30", "B") not in got and got["2020-09-30", "C"] == (None, 4) and ("2020-12-31", "B") in got
    assert p.refresh(FACTS, names="AC") and p.asked[-1] == []


def test_versions_tell_contents(spark):
    df = lambda rows: spark.createDataFrame(rows, "k int, v string, t string").withColumn("t", F.col("t").cast("date"))
    version = lambda rows: ve.data_version({"x": (df(rows), "t"), "y": (df([]), "t")}).orderBy("source").collect()
    a, same = version([(1, "p", "2020-01-01"), (2, None, "2020-01-02")]), version([(2, None, "2020-01-02"), (1, "p", "2020-01-01")])
    assert a == same and a[0].n == 2 and a[1].n == 0 and a[0]["last"] == D("2020-01-02")
    for other in ([(1, None, "2020-01-01"), (2, "p", "2020-01-02")], [(1, "p", "2020-01-01"), (2, "", "2020-01-02")], [(1, "p", "2020-01-01")]):
        assert version(other)[0].version != a[0].version


def test_the_shared_folder_is_named_or_an_error(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        store.shared_root(Session())
