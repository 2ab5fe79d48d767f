"""A corpus pipeline over ``documents``: five stages, each one of the library's operators.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.
All but the last return the columns of ``documents``; the last returns the digest of each
text's encoding and of its sampled segmentations.

In every stage an empty table gives an empty one, and other columns pass through or, in the
last stage, aren't read.  What nulls, ties and repeated rows give is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitgrid.llm import jaccard, mixing, quality, secrets, spm
from pitgrid.llm.staging import stage, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    A null or empty text has no words and goes; repeated rows are judged alike and stay or go
    together; a posterior of exactly one half stays.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Rows repeated under that id all stay; rows with a null id stay; texts without words are
    linked with nothing and stay.
    """
    return jaccard.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark.

    A null text stays null, and so does its n_chars; overlapping secrets become one mark.
    """
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that expected tokens have the target margins.

    Null sources and languages are values of their own; rows repeated under one id are drawn
    together, and null ids too.
    """
    return mixing.sampled(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are encoded and decoded, and segmentations are sampled.

    A null text counts as empty: no tokens and one empty segmentation.  Repeated rows give
    repeated rows with the same draws; a null id has a seed of its own.
    """
    return spm.digest(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("encoding", encoding),
]

#: The posterior of the rules, the sets of shingles and the sampled segmentations can't all be SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
