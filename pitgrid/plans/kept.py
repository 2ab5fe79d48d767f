"""Derived tables that many queries read: written once in a session, to the folder that all executors share.

What is kept belongs to a state of the given tables: their files, sizes and times.  Where those
change, the table is made anew.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pitgrid.operators.store import shared_root

_paths: dict[tuple[str, ...], str] = {}


def state(spark: SparkSession, sf_dir: str) -> str:
    """The files of the given tables with their sizes and times, as one hash."""
    top = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    told = []
    for table in files.listStatus(top):
        for f in files.listStatus(table.getPath()) if table.isDirectory() else [table]:
            told.append(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(told)).encode()).hexdigest()


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
    """The table ``name`` of ``sf_dir``, made and written on its first use; ``by`` is a column to cluster its rows by."""
    key = (spark.sparkContext.applicationId, sf_dir, state(spark, sf_dir), name)
    if key not in _paths:
        path = f"{shared_root(spark)}/derived-{name}-{uuid.uuid4().hex}"
        df = make()
        (df if by is None else df.repartition(by)).write.parquet(path)
        _paths[key] = path
    return spark.read.parquet(_paths[key])
