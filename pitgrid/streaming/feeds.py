"""Streams: feeds that arrive in files, with state bounded by watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitgrid.operators.store import shared_folder, written


def arriving(spark: SparkSession, folder: str, name: str, files_per_batch: int = 8) -> DataFrame:
    """The files ``name`` under ``folder`` as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts and sums per hour and type of event."""
    w = F.window("ts", "1 hour")
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")


def first_sightings(news: DataFrame, keys: list[str], time: str, late: str = "7 days") -> DataFrame:
    """The first of each key; keys are forgotten once the watermark has passed."""
    return news.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def sightings(news: DataFrame, keys: list[str], time: str, path: str, late: str = "7 days") -> DataFrame:
    """Appends the first sightings that have arrived to the table at ``path`` and returns it.

    State and progress are kept beside the table, so a later call goes on where the last one
    ended, also after a failure: the file sink's log takes each batch once.
    """
    query = first_sightings(news, keys, time, late).writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return news.sparkSession.read.parquet(f"{path}/rows")


class Table:
    """A table at ``path`` that batches of a stream are merged into, by ``keys``.

    Rows lie in folders by a hash of their keys, and a batch rewrites only the folders that it
    has rows for.  Merging a batch twice gives the same table, since its rows replace those of
    their keys; a batch with a number not above the last one merged into a folder is skipped there, so
    that a late repeat doesn't undo what came after it.
    """

    def __init__(self, spark: SparkSession, path: str, schema, keys: list[str], folders: int = 64):
        self.spark, self.path, self.keys, self.folders = spark, path, keys, folders
        fields = T.StructType([*schema.fields, T.StructField("_merged", T.LongType()), T.StructField("_part", T.IntegerType())])
        self.schema, self.columns = fields, [f.name for f in schema.fields]

    def rows(self) -> DataFrame:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def read(self) -> DataFrame:
        return self.rows().select(*self.columns)

    def merge(self, batch: DataFrame, number: int) -> None:
        part = F.pmod(F.xxhash64(*self.keys), F.lit(self.folders)).cast("int")
        scratch = shared_folder(self.spark)
        fresh = written(batch.select(*self.columns).withColumns({"_merged": F.lit(number).cast("long"), "_part": part}), f"{scratch}/batch")
        old = self.rows().join(fresh.select("_part").distinct(), "_part", "left_semi")
        done = old.groupBy("_part").agg(F.max("_merged").alias("_last")).where(F.col("_last") >= number).select("_part")
        fresh = fresh.join(done, "_part", "left_anti")
        old = old.join(done, "_part", "left_anti")
        merged = written(old.join(fresh.select(*self.keys), self.keys, "left_anti").unionByName(fresh), f"{scratch}/merged")
        merged.repartition("_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(self.path)


def run_now(stream: DataFrame, keys: list[str], path: str | None = None) -> DataFrame:
    """All that has arrived so far, as a table: each batch's updates replace rows of the same keys.

    With a ``path`` a later call goes on where the last one ended.
    """
    spark = stream.sparkSession
    path = path or shared_folder(spark)
    table = Table(spark, f"{path}/table", stream.schema, keys)
    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).foreachBatch(table.merge).start()
    query.awaitTermination()
    return table.read()
