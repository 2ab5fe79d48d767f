import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from pitgrid.llm import jaccard, mixing, quality, secrets, spm  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start = docs
    for name, step in pipeline.STAGES:
        before = docs
        docs = step(spark, before, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "quality_rules":
            assert ids == {r.doc_id for r in quality.judge(before).where("kept").collect()}
        elif name == "near_duplicates":
            assert ids == {r.doc_id for r in jaccard.near_duplicates(before).where("doc_id = component_id").collect()}
        elif name == "secret_scan":
            assert ids == {r.doc_id for r in before.collect()}
            assert secrets.scan(docs).where("n_assign + n_access + n_hex > 0").count() == 0
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        elif name == "source_mixing":
            assert ids == {r.doc_id for r in mixing.mix(before).where("sampled").collect()}
        else:
            c = spm.codec(spm.default_path(), spm.ALPHA)
            texts = {r.doc_id: r.text for r in before.collect()}
            for r in docs.collect():
                assert r.round_trip and r.n_tokens == len(c.model.encode(texts[r.doc_id]))
        if name != "encoding":
            assert docs.columns == start.columns


def test_run_has_the_same_rows(spark):
    rows = pipeline.run(spark, SF)
    again = spark.read.parquet(f"{SF}/documents.parquet")
    for _, step in pipeline.STAGES:
        again = step(spark, again, SF)
    assert sorted(map(str, rows.collect())) == sorted(map(str, again.collect()))


def test_marks_are_no_secrets():
    assert not re.search(secrets.ASSIGN, "[secret] [secret]")


def test_odd_rows_pass_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    none = spark.createDataFrame([(None, None, None, None, None), (9_000_001, None, "en", "a", None), (9_000_002, "", None, None, 0)], docs.schema)
    from pyspark.sql import functions as F

    odd = docs.union(none).union(docs.limit(5)).withColumns({"label": F.lit(1), "block": F.lit("x"), "prob": F.lit(0.5)})
    for table in (odd, odd.limit(0)):
        now = table
        for name, step in pipeline.STAGES:
            now = step(spark, now, SF)
            if name != "encoding":
                assert now.columns == odd.columns
            now = spark.createDataFrame(now.collect(), now.schema)
        assert (now.count() > 0) == (table is odd)
