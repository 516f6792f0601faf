"""Custody of sources: entries that rest on documents that don't exist are quarantined, with what depends on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

#: A board loses this share of its active entries at most by dependence, or LEAST entries if that is more.
SHARE, LEAST = 0.15, 20
ROUNDS = 3


def quarantined(entries: DataFrame, supports: DataFrame, mentions: DataFrame, rounds: int = ROUNDS, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """board_id, pos, round, reason of the entries that go.

    ``entries``: board_id, pos, invalid (names a source that doesn't exist), valid (names one that does), of active
    entries. ``supports``: board_id, pos, support (the entry it builds on). ``mentions``: board_id, pos of entries
    whose text holds the name of an invalid document of the board.

    Round 0 takes the entries with an invalid source. A later round goes once through the entries by position and
    takes those without a valid source of their own that mention an invalid document or build on an entry that is
    gone by then: in an earlier round, or in this one at an earlier position. So marks run forward without limit
    inside a round and backward by one round. After ``rounds`` the walk ends. Of what dependence took, in order of
    round and position, a board keeps the first max(``least``, ``share`` of its active entries) less the direct ones.
    A support that names no entry has no effect; an entry that supports itself isn't taken for that."""
    key = ["board_id", "pos"]
    direct = cut(entries.where("invalid").select(*key, F.lit(0).alias("round")).distinct())
    open_ = cut(entries.where("not invalid and not coalesce(valid, false)").select(*key).distinct())
    edges = cut(supports.select("board_id", "pos", "support").distinct().join(open_, key, "left_semi").where("pos <> support"))
    boards = direct.select("board_id").distinct()
    gone = direct
    for k in range(1, rounds + 1):
        on = lambda marks: marks.select("board_id", F.col("pos").alias("support"))
        new = edges.join(on(gone), ["board_id", "support"], "left_semi").select(*key)
        if k == 1:
            new = new.unionByName(mentions.join(boards, "board_id", "left_semi").select(*key).join(open_, key, "left_semi"))
        front = cut(new.distinct().join(gone, key, "left_anti"))
        if front.isEmpty():
            break
        while not front.isEmpty():
            gone = cut(gone.unionByName(front.withColumn("round", F.lit(k))))
            step = edges.where("pos > support").join(on(front), ["board_id", "support"], "left_semi").select(*key).distinct()
            front = cut(step.join(gone, key, "left_anti"))
    counts = entries.groupBy("board_id").agg(F.count_if(~F.col("invalid")).alias("active"), F.count_if("invalid").alias("direct"))
    most = F.greatest(F.lit(least), F.floor(F.col("active") * share)) - F.col("direct")
    rank = F.row_number().over(Window.partitionBy("board_id").orderBy("round", "pos"))
    derived = gone.where("round > 0").withColumn("rank", rank).join(counts, "board_id").where(F.col("rank") <= most)
    out = direct.select(*key, "round", F.lit("invalid_source_document").alias("reason"))
    return out.unionByName(derived.select(*key, "round", F.lit("depends_on_invalid_source_state").alias("reason")))
