"""Streaming twins: event counts per window with a watermark, first-wins de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Event times with a zone, as watermarks need them; a watermark on streams."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late) if events.isStreaming else timed


def window_counts(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """start, kind, n: events per tumbling window and kind; what is later than ``late`` is left out of closed windows. Batch or stream."""
    marked = _timed(events, late)
    return marked.groupBy(F.window("ts", width)["start"].alias("start"), F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def first_of_key(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark (stream), of all (batch)."""
    timed = _timed(events, late)
    return timed.dropDuplicatesWithinWatermark(keys) if events.isStreaming else timed.dropDuplicates(keys)


def drained(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """All that a stream gives of the files there now, as a table in memory (for tests and small reports)."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def poured(stream: DataFrame, folder: str, schema: str) -> DataFrame:
    """All that an appending stream gives of the files there now, as Parquet below ``folder``; going on from its checkpoint."""
    stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(f"{folder}/rows")


def opened(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Parquet at ``path``, be it a file or a folder."""
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
