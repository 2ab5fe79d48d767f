"""Panels that are kept by the version of their data, and rebuilt only where it changed.

The version of a cell (date, name) is a hash over what was knowable then: for every source the
number of rows, the newest date and a sum of row hashes, run up along the knowable date.  A panel
row also says until when it holds without new data.  A refresh compares versions: cells of the
same version stay, a new date takes over the row of the name's last date if the version is the
same and the row still holds, and only the rest is built.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitgrid.operators.asof import asof_join
from pitgrid.operators.store import shared_folder, written

#: Goes into every version; a change of the calculation makes all cells new.
CODE = 1
FOREVER = "9999-12-31"


def row_hash(name: str, columns: list[str]) -> Column:
    """64 bits of a row's contents, NULLs told from other values."""
    cells = [F.to_json(F.struct(F.col(c).alias("v"))) for c in sorted(columns)]
    return F.xxhash64(F.lit(name), *cells)


def data_version(sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """source, n, first, last, digest of each source (rows and its knowable date), and ``version``, one hash over all of them."""
    parts = None
    for name, (df, time) in sorted(sources.items()):
        day = F.col(time).cast("date")
        one = df.select(day.alias("_d"), row_hash(name, df.columns).cast("decimal(38,0)").alias("_h"))
        one = one.agg(F.count(F.lit(1)).alias("n"), F.min("_d").alias("first"), F.max("_d").alias("last"), F.coalesce(F.sum("_h"), F.lit(0)).cast("decimal(38,0)").alias("digest")).select(F.lit(name).alias("source"), "*")
        parts = one if parts is None else parts.unionByName(one)
    told = F.concat_ws(":", "source", "n", F.coalesce(F.col("last").cast("string"), F.lit("")), "digest")
    whole = F.sha1(F.concat(F.lit(f"{CODE}|"), F.array_join(F.array_sort(F.collect_list(told).over(Window.partitionBy())), "|")))  # a row for each source
    return parts.withColumn("version", whole)


def cell_versions(cells: DataFrame, sources: dict[str, tuple[DataFrame, str]], by: str = "ticker") -> DataFrame:
    """``cells`` (as_of and ``by``) with the version of what was knowable by then about each name."""
    days = None
    for name, (df, time) in sources.items():
        one = df.where(F.col(time).isNotNull()).select(by, F.col(time).cast("date").alias("_day"), row_hash(name, df.columns).cast("decimal(38,0)").alias("_h"))
        one = one.groupBy(by, "_day").agg(F.count(F.lit(1)).alias("_n"), F.sum("_h").cast("decimal(38,0)").alias("_h"))
        days = one if days is None else days.unionByName(one)
    days = days.groupBy(by, "_day").agg(F.sum("_n").alias("_n"), F.sum("_h").cast("decimal(38,0)").alias("_h"))
    upto = Window.partitionBy(by).orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    states = days.select(by, F.col("_day"), F.sum("_n").over(upto).alias("_n"), F.sum("_h").over(upto).cast("decimal(38,0)").alias("_h"), F.col("_day").alias("_newest"))
    seen = asof_join(cells.select("as_of", by), states, [by], "as_of", "_day", ["_n", "_h", "_newest"])
    told = F.concat_ws("|", F.lit(str(CODE)), F.coalesce("_n", F.lit(0)), F.coalesce(F.col("_newest").cast("string"), F.lit("")), F.coalesce(F.col("_h"), F.lit(0)))
    return seen.select("as_of", by, F.sha1(told).alias("version"))


def valid_until(cells: DataFrame, filings: DataFrame, splits: DataFrame, by: str = "ticker", fresh_days: int = 500, split_days: int = 400) -> DataFrame:
    """``cells`` with the first date on which a row may change without a new filing.

    ``filings`` (``by``, concept, filed) are those of share counts: the newest of each concept
    gets stale after ``fresh_days``.  A split matters from its date for ``split_days``.
    """
    concepts = filings.select(by, "concept").distinct()
    asked = cells.select("as_of", by).distinct()
    newest = asof_join(asked.join(concepts, by), filings.select(by, "concept", "filed").distinct(), [by, "concept"], "as_of", "filed", ["filed"])
    stale = newest.select("as_of", by, F.date_add("filed", fresh_days + 1).alias("flip"))
    turns = splits.select(by, F.explode(F.array(F.col("date"), F.date_add("date", split_days + 1))).alias("flip"))
    flips = stale.unionByName(asked.join(turns, by)).where("flip > as_of").groupBy("as_of", by).agg(F.min("flip").alias("valid_until"))
    return asked.join(flips, ["as_of", by], "left").withColumn("valid_until", F.coalesce("valid_until", F.lit(FOREVER).cast("date")))


def refresh(spark: SparkSession, path: str, cells: DataFrame, holds: DataFrame, build: Callable[[DataFrame], DataFrame], number: int, by: str = "ticker") -> DataFrame:
    """Brings the panel at ``path`` up to date and returns it.

    ``cells`` are (as_of, ``by``, version), ``holds`` (as_of, ``by``, valid_until), and
    ``build`` makes the rows of the cells that it is given.  ``number`` marks in ``built_in``
    the rows built now; rows kept or taken over keep the mark they have.  Only partitions (dates)
    in which a row changes are written, each as a whole; dates no longer among the cells stay.
    A cell for which ``build`` has no row is stored with nulls, so that it isn't asked for again.
    """
    want = cells.join(holds, ["as_of", by], "left").withColumn("valid_until", F.coalesce("valid_until", F.lit(FOREVER).cast("date")))
    folder = shared_folder(spark)
    if not exists(spark, path):
        todo = written(want, f"{folder}/todo")
        rows = todo.join(build(todo.select("as_of", by)), ["as_of", by], "left").withColumn("built_in", F.lit(number))
        save(rows, path)
        return spark.read.parquet(path)
    old = spark.read.parquet(path).withColumn("as_of", F.col("as_of").cast("date"))
    values = [c for c in old.columns if c not in ("as_of", by, "version", "valid_until", "built_in")]
    row = F.struct("version", "valid_until", "built_in", *values)
    # the stored row of the same date, and else that of the last date before it
    found = asof_join(want, old.select(F.col("as_of").alias("_at"), by, F.col("as_of").alias("_of"), row.alias("_row")), [by], "as_of", "_at", ["_of", "_row"])
    same = (F.col("_row.version") == F.col("version")) & ((F.col("_of") == F.col("as_of")) | (F.col("_row.valid_until") > F.col("as_of")))
    found = written(found.withColumn("_ok", F.coalesce(same, F.lit(False))).withColumn("_stays", F.col("_ok") & (F.col("_of") == F.col("as_of"))), f"{folder}/found")
    todo = found.where("not _ok").select("as_of", by)
    made = todo.join(found.select("as_of", by, "version", "valid_until"), ["as_of", by]).join(build(todo), ["as_of", by], "left").withColumn("built_in", F.lit(number))
    kept = found.where("_ok").select("as_of", by, "version", "valid_until", "_row.built_in", *[F.col(f"_row.{v}").alias(v) for v in values])
    gone = old.select("as_of", by).join(want.select("as_of").distinct(), "as_of", "left_semi").join(want, ["as_of", by], "left_anti").select("as_of")
    touched = found.where("not _stays").select("as_of").union(gone).distinct()
    rows = kept.unionByName(made.select(*kept.columns)).join(touched, "as_of", "left_semi")
    save(written(rows, f"{folder}/rows"), path)
    return spark.read.parquet(path)


def save(rows: DataFrame, path: str) -> None:
    rows.repartition("as_of").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
