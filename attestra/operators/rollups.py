"""Roll-ups of boards and runs: grouped counts with map-side combining, at several levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_of(df: DataFrame, by: list[str], conditions: dict[str, Column]) -> DataFrame:
    """One count per condition and group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(name) for name, c in conditions.items()])


def count_map(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """A group's counts by ``key`` as text ``k=v`` in key order."""
    counted = df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("c"))
    pairs = F.sort_array(F.collect_list(F.concat_ws("=", F.col(key).cast("string"), F.col("c").cast("string"))))
    return counted.groupBy(*by).agg(F.array_join(pairs, ",").alias("counts"), F.sum("c").alias("n"))


def leveled(df: DataFrame, sets: list[list[str]], *aggregates: Column) -> DataFrame:
    """The aggregates at every level of ``sets``; a column that a level lacks is null."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names]).agg(*aggregates)


def convergence_score(critical: Column, high: Column, disputed: Column, unread: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), 100 - 22 * critical - 9 * high - 7 * disputed - 11 * unread))
