"""Board snapshots: one JSON text per board, repaired field by field when read; versions in partitioned folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLAIMS = "board_id string, schema_version int, claims array<struct<id:string,kind:string,content:string,confidence:string,source_span:struct<start:string,end:string>,support_refs:array<string>,superseded:string>>"
# The kinds of claims.
KINDS = ["observation", "analysis", "calculation", "strategy", "gap"]


def snapshots(claims: DataFrame) -> DataFrame:
    """board_id, json: the claims of each board (board_id, id, kind, content, confidence, start, end) in order of ``seq``."""
    item = F.struct("seq", F.struct("id", "kind", "content", "confidence", F.struct("start", "end").alias("source_span")).alias("c"))
    by = claims.groupBy("board_id").agg(F.sort_array(F.collect_list(item))["c"].alias("claims"))
    return by.select("board_id", F.to_json(F.struct(F.col("board_id").cast("string").alias("board_id"), F.lit(2).alias("schema_version"), "claims")).alias("json"))


def claims_of(texts: DataFrame) -> DataFrame:
    """Claims of snapshots (board_id, json): unknown kinds become observations, a bad confidence 0.6, a bad span null; absent lists are empty."""
    parsed = texts.select("board_id", F.posexplode(F.from_json("json", CLAIMS)["claims"]).alias("pos", "c")).select("board_id", "pos", "c.*")
    start, end = F.col("source_span.start").try_cast("int"), F.col("source_span.end").try_cast("int")
    good = start.isNotNull() & end.isNotNull() & (start >= 0) & (end > start)
    conf = F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.6))
    return parsed.select(
        "board_id", "pos", "id", F.when(F.col("kind").isin(KINDS), F.col("kind")).otherwise("observation").alias("kind"), F.coalesce("content", F.lit("")).alias("content"),
        F.greatest(F.lit(0.05), F.least(F.lit(0.98), conf)).alias("confidence"), F.when(good, start).alias("start"), F.when(good, end).alias("end"), F.coalesce("support_refs", F.array().cast("array<string>")).alias("support_refs"),
    )


def write_version(df: DataFrame, path: str) -> None:
    """Adds or replaces the (board_id, iteration, label) partitions that ``df`` holds; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("board_id", "iteration", "label").parquet(path)


def latest(versions: DataFrame) -> DataFrame:
    """The last version of each board, by iteration and label."""
    top = versions.groupBy("board_id").agg(F.max(F.struct("iteration", "label")).alias("v")).select("board_id", "v.*")
    return versions.join(top, ["board_id", "iteration", "label"])
