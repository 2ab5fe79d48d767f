"""Upkeep of stored tables: upserts, window replacement, dedupe, retention, fingerprints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; in one local process, where it names none, the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.master.startswith("local["):
        named = spark.conf.get("spark.sql.warehouse.dir")
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new folder there."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as Parquet at ``path``, read again: later steps neither repeat its work nor hang on its lineage."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], on_conflict: str = "update") -> DataFrame:
    """``target`` with ``updates``: only supplied columns overwrite; with "ignore" the first write stays."""
    if on_conflict == "ignore":
        return target.unionByName(updates.join(target, keys, "left_anti"), allowMissingColumns=True)
    t, u = target.alias("t"), updates.withColumn("_hit", F.lit(True)).alias("u")
    joined = t.join(u, keys, "full")
    given = set(updates.columns)
    out = [F.when(F.col("u._hit"), F.col(f"u.`{c}`")).otherwise(F.col(f"t.`{c}`")).alias(c) if c in given else F.col(f"t.`{c}`") for c in target.columns if c not in keys]
    return joined.select(*keys, *out).select(*target.columns)


def record_ingest(log: DataFrame, attempts: DataFrame) -> DataFrame:
    """The ingest log (source, key, last_attempt, last_success, rows, error) after ``attempts`` (source, key, at, rows, error).

    The last attempt of each source and key counts, and of several at one time one that failed; a
    failure leaves time and rows of the last success as they were.
    """
    old = log.select("source", "key", F.col("last_attempt").alias("at"), F.col("last_success").alias("won"), "rows", "error")
    new = attempts.select("source", "key", "at", F.when(F.col("error").isNull(), F.col("at")).alias("won"), F.when(F.col("error").isNull(), F.col("rows")).alias("rows"), "error")
    both = old.unionByName(new)
    return both.groupBy("source", "key").agg(
        F.max("at").alias("last_attempt"), F.max("won").alias("last_success"), F.max_by("rows", F.when(F.col("won").isNotNull(), F.struct("won", "at", "rows"))).alias("rows"),
        F.max_by("error", F.struct("at", F.coalesce("error", F.lit("")))).alias("error"),
    )


def replace_window(stored: DataFrame, fresh: DataFrame, date: str, start: str, end: str, source: str, sources: list[str]) -> DataFrame:
    """Rows of the sources in the window go, the fresh ones come: a date that moved disappears."""
    old = F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.col(source).isin(*sources)
    return stored.where(~F.coalesce(old, F.lit(False))).unionByName(fresh)


def keep_newest(df: DataFrame, keys: list[str], by: str, tie: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(by), F.desc(tie))
    return df.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def retain(df: DataFrame, date: str, now: str, days: int) -> DataFrame:
    return df.where(F.col(date) >= F.date_sub(F.lit(now).cast("date"), days))


def thin_weekly(runs: DataFrame, keys: list[str], date: str, now: str, days: int) -> DataFrame:
    """Beyond so many days the last run of each ISO week."""
    recent = runs.where(F.col(date) >= F.date_sub(F.lit(now).cast("date"), days))
    week = Window.partitionBy(*keys, F.extract(F.lit("YEAROFWEEK"), date), F.weekofyear(date)).orderBy(F.desc(date))
    old = runs.where(F.col(date) < F.date_sub(F.lit(now).cast("date"), days)).withColumn("_r", F.row_number().over(week)).where("_r = 1").drop("_r")
    return recent.unionByName(old)


def fingerprint(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows, first and last date and span of each table, by name."""
    out = None
    for name, (df, date) in sorted(tables.items()):
        one = df.agg(F.count(F.lit(1)).alias("n"), F.min(F.col(date).cast("date")).alias("first"), F.max(F.col(date).cast("date")).alias("last")).select(F.lit(name).alias("source"), "*", F.datediff("last", "first").alias("span"))
        out = one if out is None else out.unionByName(one)
    return out


def orphans(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    return children.join(parents.select(*keys).distinct(), keys, "left_anti")


def open_days(spark, first: str, last: str, closed: DataFrame) -> DataFrame:
    """Days with a session: weekdays that aren't ``closed`` (date), numbered, with the days beside them."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))
    open_ = days.where(F.dayofweek("date").between(2, 6)).join(closed, "date", "left_anti")
    w = Window.orderBy("date")
    return open_.select("date", F.row_number().over(w).alias("session"), F.lag("date").over(w).alias("previous"), F.lead("date").over(w).alias("next"))
