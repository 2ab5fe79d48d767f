"""Stored runs: one version of each (strategy, date, universe), replaced as a whole by a rerun.

A run's rows carry its header and each name's factor detail as nested columns, so a run is one
partition of one table.  A write replaces the partitions that it has rows for and no others
(dynamic partition overwrite), in one commit: a reader sees the old run or the new one, and no
run without its scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DETAIL = "array<struct<factor:string,raw:double,winsorized:double,z:double,sector_z:double,pct_rank:double>>"
SCHEMA = f"run_id string, created_at timestamp, params map<string,double>, universe_n int, ticker string, sector string, composite double, coverage double, rank int, signal string, detail {DETAIL}, strategy string, as_of date, universe string"
KEYS = ("strategy", "as_of", "universe")


def universe_key(spec: Column) -> Column:
    """A short stable name of a universe's specification, fit for a folder."""
    return F.substring(F.sha1(spec), 1, 16)


def detailed(scores: DataFrame, factors: DataFrame) -> DataFrame:
    """``scores`` with the long ``factors`` (strategy, as_of, ticker, factor, raw ...) of each name as an array, by factor."""
    one = F.struct(*[F.col(c).cast("string" if c == "factor" else "double").alias(c) for c in ("factor", "raw", "winsorized", "z", "sector_z", "pct_rank")])
    per = factors.groupBy("strategy", "as_of", "ticker").agg(F.array_sort(F.collect_list(one)).alias("detail"))  # a strategy's factors: a dozen
    return scores.join(per, ["strategy", "as_of", "ticker"], "left")


def save(rows: DataFrame, path: str, created_at: str) -> None:
    """Writes runs: rows of KEYS, ticker, composite, coverage, rank and, where there are, sector, signal, params and detail.

    A run's id is a hash of what it is and when it was made.  Rows with a null key have no run
    and are refused.
    """
    known = {f.split(" ")[0] for f in SCHEMA.split(", ")}
    sized = F.count(F.lit(1)).over(Window.partitionBy(*KEYS)).cast("int")
    made = rows.withColumns({"created_at": F.lit(created_at).cast("timestamp"), "universe_n": sized})
    made = made.withColumn("run_id", F.sha1(F.concat_ws("|", *[F.col(k).cast("string") for k in KEYS], "created_at")))
    guard = F.when(F.greatest(*[F.col(k).isNull() for k in KEYS]), F.raise_error(F.lit("a run needs a strategy, a date and a universe"))).otherwise(F.col("strategy"))
    made = made.withColumn("strategy", guard)
    kinds = dict(f.split(" ", 1) for f in SCHEMA.split(", "))
    made = made.select(*[(F.col(c) if c in made.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in kinds if c in known])
    made.repartition(*KEYS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All stored runs; filters on KEYS prune folders."""
    return spark.read.schema(SCHEMA).parquet(path)


def headers(runs: DataFrame) -> DataFrame:
    """One row for each stored run."""
    return runs.groupBy(*KEYS, "run_id", "created_at").agg(F.max("universe_n").alias("universe_n"), F.count(F.lit(1)).alias("names"), F.count("composite").alias("scored"))


def drop(spark: SparkSession, path: str, runs: DataFrame) -> None:
    """Takes the runs with these KEYS out of the store: their folders are removed, nothing is rewritten.

    What is deleted is a list of runs that someone names, which is short.
    """
    from pyspark.sql.types import StringType

    files = spark._jvm.org.apache.hadoop.fs
    for r in runs.select(*[F.col(k).cast(StringType()) for k in KEYS]).distinct().toLocalIterator():
        place = files.Path(path + "".join(f"/{k}={r[k]}" for k in KEYS))
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
