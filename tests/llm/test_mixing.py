import pytest
from pyspark.sql import functions as F

from pitgrid.llm import mixing


def rows(spark):
    made = [(i, " ".join("w" for _ in range(1 + i * 7 % 90)) + (" | x" if i % 5 == 0 else ""), ("a", "b", None)[i % 3 if i % 2 else 0], ("en", "fr")[i % 7 == 0], "t") for i in range(3000)]
    return spark.createDataFrame(made + [(None, None, None, None, "t"), (1, "", "c", "en", "t")], "doc_id long, text string, source string, lang string, topic string")


def test_margins_hold(spark):
    targets = {"source": {"a": 0.5, "b": 0.3, "(none)": 0.1, "c": 0.1}, "lang": {"en": 0.4, "fr": 0.5, "(none)": 0.1}}
    cells = rows(spark).select(*mixing.placed(rows(spark), "doc_id", "text", "source", "lang", None)).groupBy(*mixing.DIMS).agg(F.sum("n_tokens").alias("tokens"))
    raked = mixing.rake(cells.where("source in ('a', 'b') and lang in ('en', 'fr')"), targets, 60)
    total = raked.agg(F.sum("raked")).first()[0]
    assert abs(raked.where("source = 'a'").agg(F.sum("raked")).first()[0] / total - 0.5 / 0.8) < 1e-6
    assert abs(raked.where("lang = 'fr'").agg(F.sum("raked")).first()[0] / total - 5 / 9) < 1e-6


def test_sample_follows_probabilities(spark):
    got = mixing.mix(rows(spark), rounds=3)
    assert got.count() == 3002 and got.where("prob is null or sampled is null or prob > 1").count() == 0
    r = got.agg(F.sum("prob"), F.sum(F.col("sampled").cast("int"))).first()
    assert abs(r[0] - r[1]) < 4 * r[0] ** 0.5
    out = mixing.sampled(rows(spark), rounds=3)
    assert out.columns == rows(spark).columns and out.count() == r[1]


def test_empty(spark):
    assert mixing.mix(rows(spark).limit(0), rounds=2).count() == 0
    assert mixing.sampled(rows(spark).limit(0), rounds=2).count() == 0


def test_a_rare_value_is_taken_whole(spark):
    common = rows(spark).where("doc_id is not null and source in ('a', 'b')")
    stray = spark.createDataFrame([(9999, "w " * 13, "a", None, "t")], common.schema)
    got = mixing.mix(common.union(stray)).groupBy("lang").agg(F.sum("n_tokens"), F.sum(F.col("n_tokens") * F.col("prob"))).collect()
    have = {r[0]: (r[1], r[2]) for r in got}
    assert abs(have["(none)"][1] - 13) < 1e-6
    total = sum(r[0] for r in have.values())
    assert abs(sum(r[1] for r in have.values()) / total - mixing.LEAST) < 1e-3
    want = (have["en"][0] / have["fr"][0]) ** 0.5  # the other languages keep their target proportion
    assert abs(have["en"][1] / have["fr"][1] / want - 1) < 1e-3
    told = {(r.dim, r.value): r for r in mixing.margins(common.union(stray)).collect()}
    assert not told["lang", "(none)"].met and told["lang", "(none)"].tokens == 13


def test_rakes_until_margins_hold(spark):
    made = [(i, "w " * (400 if s == l else 1), s, l) for i, (s, l) in enumerate([("a", "x"), ("b", "y"), ("a", "y"), ("b", "x")])]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string, lang string")
    targets = {"source": {"a": 0.7, "b": 0.3}, "lang": {"x": 0.4, "y": 0.6}}
    got = {(r.source, r.lang): r.n_tokens * r.prob for r in mixing.mix(docs, targets, least=0.0).collect()}
    total = sum(got.values())
    assert abs((got["a", "x"] + got["a", "y"]) / total - 0.7) < 1e-4 and abs((got["a", "x"] + got["b", "x"]) / total - 0.4) < 1e-4
    assert all(r.met for r in mixing.margins(docs, targets, least=0.0).collect())


def test_targets_that_exclude_each_other(spark):
    docs = spark.createDataFrame([(1, "w " * 50, "a", "x"), (2, "w " * 50, "b", "y")], "doc_id long, text string, source string, lang string")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.9, "y": 0.1, "z": 1.0}}
    with pytest.warns(UserWarning, match="met together"):
        told = {(r.dim, r.value): r.met for r in mixing.margins(docs, targets).collect()}
    assert not all(told.values()) and not told["lang", "z"]
