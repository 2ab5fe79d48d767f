"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitgrid.llm import alignment, collocations, htmltext, jaccard, katz, langid, mixing, packing, quality, secrets, spm, tokencount, topk
from pitgrid.llm.staging import table


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(table(spark, sf_dir, "pages"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.digest(table(spark, sf_dir, "documents"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"), least=1)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_topk_search": op1_topk_search,
        "op2_secret_scan": op2_secret_scan,
        "op3_source_mixing": op3_source_mixing,
        "op4_language_id": op4_language_id,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_token_counts": op6_token_counts,
        "op7_html_text": op7_html_text,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_lm_scores": op9_lm_scores,
        "op10_quality_rules": op10_quality_rules,
        "op11_token_alignment": op11_token_alignment,
        "op12_best_fit_packing": op12_best_fit_packing,
        "op13_collocations": op13_collocations,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk_search": topk.ORACLE_SQL,
        "op3_source_mixing": mixing.oracle_sql(),
        "op10_quality_rules": quality.oracle_sql(),
        "op13_collocations": collocations.ORACLE_SQL,
    }
