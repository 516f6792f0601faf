"""Ranking, paging, budgets and packing by order. All windows are partitioned; whole-table
rankings go through ``orderBy().limit()``, which keeps only the top rows of each task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

#: Rows of a measured table that one task of its shuffles takes.
TASK_ROWS = 500_000


def tasks_for(df: DataFrame) -> int:
    """How many tasks the shuffles of a table's rows take, so that a task's memory doesn't grow with the table: as many as the session says, or more."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS))


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, tasks: int) -> DataFrame:
    """``df`` with the place of each row in its group, from 0, for few groups of any size: rows are sorted over all tasks in ranges, and a
    row's place is its place in its range behind the group's rows in earlier ranges. A range and group are one row of a small table.
    The numbered rows are written once. Rows alike in ``by`` and ``order`` come in any order."""
    at = F.monotonically_increasing_id()
    rows = cut(df.repartitionByRange(tasks, *by, *order).sortWithinPartitions(*by, *order).withColumn("_at", at).withColumn("_range", F.shiftright("_at", 33)))
    parts = rows.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("_range", *[F.col(b).alias(f"_{b}") for b in by], (earlier - F.col("_first")).alias("_start"))
    same = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
    renamed = starts.withColumnRenamed("_range", "_of")
    found = rows.join(F.broadcast(renamed), [F.col("_range") == F.col("_of"), *same])
    return found.select(*df.columns, (F.col("_at") + F.col("_start")).cast("long").alias(name))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col(rank) <= k)


def round_robin(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows in turns over the groups: first of each, then second of each."""
    turn = df.withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    return turn.orderBy("turn", *by).limit(k)


def rotated(df: DataFrame, by: list[str], order: list[Column], offset: Column, take: int) -> DataFrame:
    """A page of ``take`` rows of each group from a place that moves on with the round, around the end."""
    w = Window.partitionBy(*by)
    placed = df.withColumns({"_n": F.row_number().over(w.orderBy(*order)) - 1, "_all": F.count(F.lit(1)).over(w)})
    return placed.where(F.pmod(F.col("_n") - offset, F.col("_all")) < take).drop("_n", "_all")


def within_budget(df: DataFrame, by: list[str], order: list[Column], cost: Column, budget: Column) -> DataFrame:
    """Rows in order with ``spent`` (cost of the rows up to here) and whether they still fit."""
    run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("spent", F.sum(cost).over(run)).withColumn("fits", F.col("spent") <= budget)


def packed(df: DataFrame, by: str, order: str, size: Column, most: int, items: int) -> DataFrame:
    """``by``, ``order``, chunk: items in order into chunks under a size cap and an item cap; an item above the cap alone.

    A fold over one group's ordered sizes, so a group is one row's array (a section, a document)."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), size.cast("long").alias("s"))))
    zero = F.struct(F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(a, x):
        new = (a["n"] > 0) & ((a["used"] + x["s"] > most) | (a["n"] >= items))
        chunk = F.when(new, a["chunk"] + 1).otherwise(a["chunk"])
        return F.struct(chunk.alias("chunk"), F.when(new, x["s"]).otherwise(a["used"] + x["s"]).alias("used"), F.when(new, F.lit(1)).otherwise(a["n"] + 1).alias("n"), F.concat(a["out"], F.array(chunk)).alias("out"))

    folded = df.groupBy(by).agg(rows.alias("rows")).select(by, "rows", F.aggregate("rows", zero, step, lambda a: a["out"]).alias("chunks"))
    return folded.select(by, F.inline(F.arrays_zip(F.col("rows")["o"].alias(order), F.col("chunks").alias("chunk"))))
