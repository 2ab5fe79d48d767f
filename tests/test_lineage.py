import random

from pyspark.sql import functions as F

from pitgrid.operators import asof, audit, identity, store
from pitgrid.streaming import feeds


def end_of(name, renames):
    seen = set()
    while name in renames and name not in seen:
        seen.add(name)
        name = renames[name]
    return name


def test_renames_against_a_walk(spark):
    rng = random.Random(5)
    renames = {f"n{i}": f"n{i + 1}" for i in range(70)}  # one long chain
    renames |= {"a": "b", "b": "a", "self": "self", "x": "a", "y": "x", "p": "q", "q": "r", "r": "p", "t": "r"}
    renames |= {f"m{i}": f"m{rng.randrange(60)}" for i in range(40)}
    renames = {k: v for k, v in renames.items() if k != v}
    df = spark.createDataFrame([*renames.items(), ("n0", "zzz"), (None, "u"), ("u", None)], "old string, new string")
    got = {r.old: r.current for r in identity.closed_renames(df).collect()}
    assert got == {k: end_of(k, renames) for k in renames}
    names = spark.createDataFrame([("n3",), ("n3",), ("other",), ("t",)], "ticker string")
    assert sorted(map(tuple, identity.current_symbols(names, df).collect())) == [("n3", "n70"), ("other", "other"), ("t", "r")]
    assert identity.closed_renames(df.limit(0)).count() == 0


def test_members_under_current_symbols(spark):
    day = lambda df, *c: df.withColumns({x: F.col(x).cast("date") for x in c})
    members = day(spark.createDataFrame([("I", "OLD", "2020-01-01", "a"), ("I", "NEW", "2020-01-01", "a"), ("I", "Z", "2020-01-01", "a"), ("I", "OLD", "2020-06-01", "a")], "index_symbol string, ticker string, as_of string, source string"), "as_of")
    dates = day(spark.createDataFrame([("2020-03-01",), ("2020-07-01",), ("2019-01-01",)], "as_of string"), "as_of")
    closed = spark.createDataFrame([("OLD", "NEW")], "old string, current string")
    got = sorted((str(r.as_of), r.ticker, r.named, r.names) for r in asof.members_current(dates, members, closed).collect())
    assert got == [("2020-03-01", "NEW", "NEW", 2), ("2020-03-01", "Z", "Z", 1), ("2020-07-01", "NEW", "OLD", 1)]


def test_share_count_jumps(spark):
    rows = [("LRCX", "2024-03-31", "2024-04-20", 130.0), ("LRCX", "2024-06-30", "2024-07-20", 1284.0), ("LRCX", "2024-06-30", "2024-10-20", 131.0), ("BUY", "2024-03-31", "2024-04-20", 100.0), ("BUY", "2024-06-30", "2024-07-20", 96.0),
            ("REV", "2024-03-31", "2024-04-20", 100.0), ("REV", "2024-06-30", "2024-07-20", 10.2), ("ODD", "2024-03-31", "2024-04-20", 100.0), ("ODD", "2024-06-30", "2024-07-20", 150.0), ("OK", "2024-03-31", "2024-04-20", 1.0), ("OK", "2024-06-30", "2024-07-20", 2.0), ("NIL", "2024-03-31", "2024-04-20", 0.0), ("NIL", "2024-06-30", "2024-07-20", 2.0)]
    counts = spark.createDataFrame(rows, "ticker string, period_end string, filed string, val double").withColumns({c: F.col(c).cast("date") for c in ("period_end", "filed")})
    splits = spark.createDataFrame([("OK", "2023-12-20"), ("LRCX", "2023-06-01"), ("REV", "2025-06-01")], "ticker string, date string").withColumn("date", F.col("date").cast("date"))
    got = {r.ticker: (round(r.ratio, 3), r.declared) for r in audit.share_jumps(counts, splits).collect()}
    assert got == {"LRCX": (9.877, 10.0), "REV": (0.102, 0.1)}


def arrive(spark, folder, name, rows):
    spark.createDataFrame(rows, "k int, t string, v int").withColumn("t", F.col("t").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def stream(spark, folder, name):
    return spark.readStream.schema("k int, t timestamp, v int").option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")


def test_sightings_go_on_after_a_restart(spark):
    folder = store.shared_folder(spark)
    arrive(spark, folder, "in", [(1, "2024-01-01", 10), (1, "2024-01-02", 11), (2, "2024-01-02", 20)])
    first = feeds.sightings(stream(spark, folder, "in"), ["k"], "t", f"{folder}/out", "30 days")
    assert sorted(r.k for r in first.collect()) == [1, 2]
    arrive(spark, folder, "in", [(2, "2024-01-03", 21), (3, "2024-01-03", 30)])
    again = feeds.sightings(stream(spark, folder, "in"), ["k"], "t", f"{folder}/out", "30 days")
    assert sorted(r.k for r in again.collect()) == [1, 2, 3]
    assert sorted(r.k for r in feeds.sightings(stream(spark, folder, "in"), ["k"], "t", f"{folder}/out", "30 days").collect()) == [1, 2, 3]


def test_merges_are_idempotent_and_touch_their_folders_only(spark):
    path = f"{store.shared_folder(spark)}/table"
    df = lambda rows: spark.createDataFrame(rows, "k int, v int")
    table = feeds.Table(spark, path, df([]).schema, ["k"], folders=8)
    read = lambda: sorted(map(tuple, table.read().collect()))
    table.merge(df([(i, 0) for i in range(40)]), 0)
    before = {r.f for r in table.rows().select(F.input_file_name().alias("f")).distinct().collect()}
    table.merge(df([(7, 1)]), 1)
    assert read() == sorted([(i, 0) for i in range(40) if i != 7] + [(7, 1)])
    after = {r.f for r in table.rows().select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(before - after) == 1 and len(after - before) == 1
    table.merge(df([(7, 1)]), 1)  # a batch that is repeated after a failure
    table.merge(df([(7, 2), (99, 2)]), 2)
    table.merge(df([(7, 1)]), 1)  # and one that comes late
    assert read() == sorted([(i, 0) for i in range(40) if i != 7] + [(7, 2), (99, 2)])
    table.merge(df([]), 3)
    assert len(read()) == 41


def test_a_rolled_up_stream_goes_on(spark):
    folder = store.shared_folder(spark)
    arrive(spark, folder, "in", [(1, "2024-01-01", 10), (2, "2024-01-01", 5)])
    sums = lambda: stream(spark, folder, "in").groupBy("k").agg(F.sum("v").alias("total"))
    assert sorted(map(tuple, feeds.run_now(sums(), ["k"], f"{folder}/kept").collect())) == [(1, 10), (2, 5)]
    arrive(spark, folder, "in", [(1, "2024-01-02", 1), (3, "2024-01-02", 7)])
    assert sorted(map(tuple, feeds.run_now(sums(), ["k"], f"{folder}/kept").collect())) == [(1, 11), (2, 5), (3, 7)]
