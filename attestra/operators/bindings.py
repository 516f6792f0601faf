"""Edges between claims, targets and units, what hangs on them, and references that lead nowhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import top_per_group

c = F.col
# Bounds of confidence after a verdict; claims of all units of an obligation, and of one unit at least and at most; claims of a card.
LOWEST, HIGHEST = 0.05, 0.98
UNIT_CLAIMS, FEWEST, MOST, CARD = 240, 3, 8, 8


def bound(binds: DataFrame, claims: DataFrame, others: DataFrame, id_: str) -> DataFrame:
    """board_id, claim_id, ``id_``: the edges of ``binds`` whose two ends are there, each once. Read from either side."""
    edges = binds.select("board_id", "claim_id", id_).distinct()
    return edges.join(claims.select("board_id", "claim_id").distinct(), ["board_id", "claim_id"], "left_semi").join(others.select("board_id", id_).distinct(), ["board_id", id_], "left_semi")


def evidenced(units: DataFrame, edges: DataFrame) -> DataFrame:
    """``units`` with ``claims`` (how many), discovered ones with a claim being evidenced."""
    n = edges.groupBy("board_id", "unit_id").agg(F.count(F.lit(1)).alias("claims"))
    status = F.when((c("status") == "discovered") & c("claims").isNotNull(), "evidenced").otherwise(c("status"))
    return units.join(n, ["board_id", "unit_id"], "left").withColumn("status", status).withColumn("claims", F.coalesce("claims", F.lit(0)))


def broken_references(*checks: tuple[str, DataFrame, DataFrame]) -> DataFrame:
    """board_id, kind, owner, reference: for each (kind, references, known) the references that lead nowhere, each once.

    ``references``: board_id, owner, refs (array of ids); ``known``: board_id, id."""
    def lost(kind: str, references: DataFrame, known: DataFrame) -> DataFrame:
        rows = references.select("board_id", "owner", F.explode(F.array_distinct("refs")).alias("reference"))
        return rows.join(known.select("board_id", c("id").alias("reference")).distinct(), ["board_id", "reference"], "left_anti").select("board_id", F.lit(kind).alias("kind"), "owner", "reference")

    return reduce(DataFrame.unionByName, (lost(*x) for x in checks))


def target_cards(edges: DataFrame, claims: DataFrame, k: int = CARD) -> DataFrame:
    """board_id, target_id, bound, raw, derived, kinds (sorted), best (the k claims with the highest confidence, ties by id).

    ``edges``: board_id, target_id, claim_id; ``claims``: board_id, claim_id, kind, derived, confidence. Only the k best are gathered."""
    rows = edges.join(claims, ["board_id", "claim_id"])
    key = ["board_id", "target_id"]
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("bound"), F.count_if(~c("derived")).alias("raw"), F.count_if("derived").alias("derived"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    best = top_per_group(rows, key, [F.desc("confidence"), c("claim_id")], k).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "claim_id"))), lambda x: x["claim_id"]).alias("best"))
    return counts.join(best, key)


def unit_rows(units: DataFrame, edges: DataFrame, claims: DataFrame) -> DataFrame:
    """board_id, obligation_id, unit_id, rank, claim_id: what a packet of an obligation holds of each of its units that isn't waived.

    A unit's share shrinks as units grow in number, from 8 to 3 claims; derived claims come first, then confidence, then id. A unit without
    claims has one row without a claim."""
    own = units.where("status <> 'waived'")
    n = own.groupBy("board_id", "obligation_id").agg(F.count(F.lit(1)).alias("n"))
    most = F.greatest(F.lit(FEWEST), F.least(F.lit(MOST), F.floor(F.lit(UNIT_CLAIMS) / c("n"))))
    held = edges.join(claims.select("board_id", "claim_id", "derived", "confidence"), ["board_id", "claim_id"])
    w = Window.partitionBy("board_id", "unit_id").orderBy(F.desc("derived"), F.desc("confidence"), "claim_id")
    ranked = held.withColumn("rank", F.row_number().over(w).cast("long")).where(c("rank") <= MOST).select("board_id", "unit_id", "rank", "claim_id")
    rows = own.join(n, ["board_id", "obligation_id"]).withColumn("most", most).join(ranked, ["board_id", "unit_id"], "left")
    return rows.where(c("rank").isNull() | (c("rank") <= c("most"))).select("board_id", "obligation_id", "unit_id", F.coalesce("rank", F.lit(1)).alias("rank"), "claim_id")


def judged(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``claims`` with verified and confidence as the last verdict (by seq) on each says, confidence held inside 0.05 to 0.98; what a verdict leaves out stays."""
    last = verdicts.groupBy("board_id", "claim_id").agg(F.max_by(F.struct(c("verified").alias("v"), c("confidence").alias("f")), "seq").alias("said"))
    level = F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), c("said.f")))
    rows = claims.join(last, ["board_id", "claim_id"], "left")
    return rows.withColumn("verified", F.coalesce("said.v", "verified")).withColumn("confidence", F.when(c("said.f").isNotNull(), level).otherwise(c("confidence"))).drop("said")
