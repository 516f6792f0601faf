"""Folders that all executors share, for what streams, sinks and scans write."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, on one machine, below a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
    return f"{at.rstrip('/')}/attestra/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, to: DataFrame | None = None) -> DataFrame:
    """``df`` as a table of its own in a shared folder, or added to the stored table ``to``; lineage ends here."""
    at = to._folder if to is not None else shared_folder(df.sparkSession, "table")
    df.write.mode("append").parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._folder = at
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        if df is not None:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffles of the jobs that are set up in the block are deleted with the end of each job, not with a later collection of garbage."""
    before = spark.conf.get(FREE, "false")
    spark.conf.set(FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE, before)
