"""Connected components of link tables, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored

#: The rounds grow with the logarithm of the longest path; a table that needs more than this is not one that fits a cluster.
ROUNDS = 200


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of ``links`` (a, b).

    Alternates the two star operations: every node's larger neighbours, then its smaller
    ones, are linked to its smallest neighbour. Each is a grouped minimum (combined in
    the map tasks) and a join, so no neighbourhood is ever gathered in one place; the
    rounds grow with the logarithm of the links' paths. Self-links and repeats are harmless.
    """
    with scratch(links.sparkSession) as keep:
        edges, before = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links"), None
        for _ in range(ROUNDS):
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            down = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(down, "u")
            edges = stored(small.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v").distinct(), "links")
            now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == before:
                break
            before = now
        else:
            raise RuntimeError(f"components are not final after {ROUNDS} rounds")
        top = edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
        return keep(stored(top.unionByName(top.select(F.col("label").alias("node"), "label").distinct()), "components"))
