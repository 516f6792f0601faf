"""Ledger operations on the targets of boards, replayed as tables.

Operations come in order (board_id, seq, op, target_id, others, value): ``merge`` (others are absorbed by the target; value: its
new wording), ``waive``, ``close``, ``block``, ``reopen``, ``reprioritize``, ``rephrase``; claims are bound at a place in the
same order. What an operation does depends on what stood before it: a merge needs both sides open, a reopening a closed
target. Nothing is replayed one by one: all operations that depend on a status are taken to hold, the statuses that follow are
worked out by windows, and what doesn't hold then is taken back, until nothing changes. As an operation depends on earlier
ones only, this ends after as many rounds as the longest chain of dependent ones, and gives what a replay gives.

Merged edges: a claim goes from an absorbed target to the one that absorbed it, and on from there, if it was bound before. The
merges make paths (into, out of, first place, last place), joined end to end by doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

c = F.col
# Levels of materiality; what operations make of a status.
LEVELS = ["critical", "high", "medium", "low"]
STATUS = {"waive": "waived", "close": "closed", "block": "blocked", "reopen": "open", "absorb": "waived"}
AT = ["seq", "pos"]


def status_events(targets: DataFrame, ops: DataFrame) -> DataFrame:
    """board_id, target_id, seq, pos, op, keep, holds: the status operations on known targets that hold, absorbing ones by the target absorbed."""
    known = targets.select("board_id", "target_id").distinct()
    plain = ops.where(c("op").isin("waive", "close", "block", "reopen")).select("board_id", "target_id", "seq", F.lit(0).alias("pos"), "op", F.lit(None).cast("string").alias("keep"))
    merged = ops.where("op = 'merge'").select("board_id", c("target_id").alias("keep"), "seq", F.posexplode("others").alias("pos", "target_id"))
    absorbed = merged.where("keep <> target_id").join(known.withColumnRenamed("target_id", "keep"), ["board_id", "keep"], "left_semi").select("board_id", "target_id", "seq", "pos", F.lit("absorb").alias("op"), "keep")
    events = cut(plain.unionByName(absorbed).join(known, ["board_id", "target_id"], "left_semi").withColumn("holds", F.lit(True)))
    start = _first(targets).select("*", F.lit(None).cast("string").alias("op"), F.lit(None).cast("string").alias("keep"), F.lit(None).cast("string").alias("of"), F.lit(True).alias("holds"))
    w = Window.partitionBy("board_id", "target_id").orderBy(c("seq").asc_nulls_first(), "pos", c("of").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    while True:
        # one pass in order: what a target was before an event, and before the questions of those that it absorbs (``of``)
        own = events.select("board_id", "target_id", *AT, F.when(c("holds"), _new()).alias("new"), "op", "keep", F.lit(None).cast("string").alias("of"), "holds")
        asked = events.where("keep is not null").select("board_id", c("keep").alias("target_id"), *AT, F.lit(None).cast("string").alias("new"), "op", "keep", c("target_id").alias("of"), "holds")
        seen = start.unionByName(own).unionByName(asked).withColumn("before", F.last("new", ignorenulls=True).over(w)).where("op is not null")
        # a question goes back to its event as a row of the same key
        mine = lambda status: F.max(F.when(c("of").isNull(), c("before") == status))
        seen = seen.groupBy("board_id", F.coalesce("of", "target_id").alias("target_id"), *AT, "op", "keep", "holds").agg(mine("open").alias("open"), mine("closed").alias("closed"), F.max(F.when(c("of").isNotNull(), c("before") == "open")).alias("keep_open"))
        holds = F.when(c("op") == "reopen", c("closed")).when(c("op") == "absorb", c("open") & c("keep_open")).otherwise(True)
        judged = cut(seen.select("board_id", "target_id", *AT, "op", "keep", holds.alias("holds"), (holds != c("holds")).alias("_changed")))
        changed, events = not judged.where("_changed").isEmpty(), judged.drop("_changed")
        if not changed:
            return events.where("holds")


def _new() -> Column:
    """What an event makes of its target's status."""
    new = F.lit(None).cast("string")
    for op, status in STATUS.items():
        new = F.when(c("op") == op, status).otherwise(new)
    return new


def _first(targets: DataFrame) -> DataFrame:
    return targets.select("board_id", "target_id", F.lit(None).cast("long").alias("seq"), F.lit(0).alias("pos"), c("status").alias("new"))


def status_before(targets: DataFrame, events: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (board_id, target_id, seq, pos; each once) with the status that the target has before that place."""
    start = _first(targets).withColumn("asks", F.lit(False))
    rows = start.unionByName(events.where("holds").select("board_id", "target_id", *AT, _new().alias("new"), F.lit(False).alias("asks")))
    rows = rows.unionByName(asked.select("board_id", "target_id", *AT, F.lit(None).cast("string").alias("new"), F.lit(True).alias("asks")))
    # a question comes before the events of its own place
    w = Window.partitionBy("board_id", "target_id").orderBy(c("seq").asc_nulls_first(), "pos", F.desc("asks")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("before", F.last("new", ignorenulls=True).over(w)).where("asks").select("board_id", "target_id", *AT, "before")


def merge_paths(merges: DataFrame) -> DataFrame:
    """board_id, target_id, to, first, last: where claims that a target has before ``first`` are from ``last`` on."""
    place = F.struct(*AT)
    paths = cut(merges.select("board_id", "target_id", c("keep").alias("to"), place.alias("first"), place.alias("last")).distinct())
    while True:
        on = paths.select("board_id", c("target_id").alias("to"), c("to").alias("beyond"), c("first").alias("_first"), c("last").alias("_last"))
        longer = paths.join(on, ["board_id", "to"]).where(c("last") < c("_first")).select("board_id", "target_id", c("beyond").alias("to"), "first", c("_last").alias("last"))
        grown = longer.join(paths, paths.columns, "left_anti").distinct()
        grown = cut(grown)
        if grown.isEmpty():
            return paths
        paths = cut(paths.unionByName(grown))


def replayed(targets: DataFrame, ops: DataFrame, binds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets after all operations, edges after all operations).

    ``targets``: board_id, target_id, status, materiality, need; ``binds``: board_id, claim_id, target_id, seq. The first table has
    board_id, target_id, status, materiality, need, absorbed_by, closure_basis (claims bound when it was closed, sorted; null unless
    it is closed); the second board_id, claim_id, target_id. Operations on unknown targets, of unknown levels and blank
    wordings do nothing."""
    known, key = targets.select("board_id", "target_id").distinct(), ["board_id", "target_id"]
    events = status_events(targets, ops)
    last = events.groupBy(*key).agg(F.max(F.struct(*AT, "op", "keep")).alias("s"))
    merges = events.where("op = 'absorb'")
    bound = binds.join(known, key, "left_semi").select("board_id", "claim_id", "target_id", F.struct("seq", F.lit(-1).alias("pos")).alias("since"))
    paths = merge_paths(merges)
    moved = bound.join(paths, key).where(c("since") < c("first")).select("board_id", "claim_id", c("to").alias("target_id"), c("last").alias("since"))
    edges = cut(bound.unionByName(moved).groupBy("board_id", "claim_id", "target_id").agg(F.min("since").alias("since")))
    # a merge gives its target a new wording if the target is open then, whether or not anything was absorbed
    wording = ops.where("op = 'merge' and length(trim(value)) > 0").select("board_id", "target_id", "seq", F.lit(1_000_000_000).alias("pos"), "value")
    open_then = status_before(targets, events, wording.select("board_id", "target_id", *AT).distinct()).where("before = 'open'")
    said = wording.join(open_then, [*key, *AT], "left_semi").unionByName(ops.where("op = 'rephrase' and length(trim(value)) > 0").select("board_id", "target_id", "seq", F.lit(0).alias("pos"), "value"))
    need = said.groupBy(*key).agg(F.max_by(F.trim("value"), F.struct(*AT)).alias("new_need"))
    level = ops.where((c("op") == "reprioritize") & c("value").isin(LEVELS)).groupBy(*key).agg(F.max_by("value", "seq").alias("new_level"))
    status = F.coalesce(F.when(c("s.op") == "reopen", "open").when(c("s.op") == "close", "closed").when(c("s.op") == "block", "blocked").when(c("s.op").isin("waive", "absorb"), "waived"), c("status"))
    rows = targets.join(last, key, "left").join(need, key, "left").join(level, key, "left")
    closed = rows.where("s.op = 'close'").select("board_id", "target_id", F.struct("s.seq", "s.pos").alias("closed_at"))
    basis = closed.join(edges, key, "left").groupBy(*key).agg(F.array_sort(F.collect_list(F.when(c("since") < c("closed_at"), c("claim_id")))).alias("closure_basis"))
    out = rows.join(basis, key, "left").select(*key, status.alias("status"), F.coalesce("new_level", "materiality").alias("materiality"), F.coalesce("new_need", "need").alias("need"), F.when(c("s.op") == "absorb", c("s.keep")).alias("absorbed_by"), "closure_basis")
    return out, edges.select("board_id", "claim_id", "target_id")
