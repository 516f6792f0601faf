"""State of boards: what new entries do to old ones, and whether a stored frontier still fits its board."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks of a candidate's priority, documents of a triage batch, candidates a target keeps of a batch.
PRIORITY_RANK = {"definite": 0, "maybe": 1}
BATCH, PER_TARGET = 150, 3

c = F.col


def met_edges(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` whose target is there when they take effect: in the batch of their own entry or an earlier one.

    ``entries``: board_id, pos, batch; ``edges``: board_id, pos, kind, place (in the entry's list), target (a pos).
    Edges of or to entries that don't exist have no effect."""
    own = entries.select("board_id", "pos", "batch")
    theirs = entries.select("board_id", c("pos").alias("target"), c("batch").alias("_batch"))
    return edges.join(own, ["board_id", "pos"]).join(theirs, ["board_id", "target"]).where("_batch <= batch").select("board_id", "pos", "kind", "place", "target")


def statuses(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """board_id, pos, status: a contradiction makes both entries disputed, a successor makes the old one superseded; the last to write wins.

    Entries take effect in order of pos, each one's contradictions before its successions. ``entries`` as for
    ``met_edges``, with status: what an entry keeps if nothing touches it."""
    met = met_edges(entries, edges)
    against, after = met.where("kind = 'contradicts'"), met.where("kind = 'supersedes'")
    at = lambda phase: F.struct("pos", F.lit(phase).alias("phase"), "place")
    wrote = lambda df, who, phase, status: df.select("board_id", c(who).alias("to"), at(phase).alias("at"), F.lit(status).alias("new"))
    writes = wrote(against, "target", 1, "disputed").unionByName(wrote(against, "pos", 1, "disputed")).unionByName(wrote(after, "target", 2, "superseded"))
    last = writes.groupBy("board_id", c("to").alias("pos")).agg(F.max_by("new", "at").alias("new"))
    return entries.join(last, ["board_id", "pos"], "left").select("board_id", "pos", F.coalesce("new", "status").alias("status"))


def conflicts(entries: DataFrame, edges: DataFrame, shown: int = 150) -> DataFrame:
    """board_id, pos, place, target, content, signal, priority: the entry and the critical signal that each contradiction brings in.

    ``entries``: board_id, pos, batch, content (null: empty), of which the first ``shown`` characters are cited."""
    met = met_edges(entries, edges).where("kind = 'contradicts'")
    cited = lambda who, name: entries.select("board_id", c("pos").alias(who), F.concat(F.lit("["), c("pos").cast("string"), F.lit("] "), F.substring(F.coalesce("content", F.lit("")), 1, shown), F.lit("...")).alias(name))
    both = met.join(cited("pos", "_new"), ["board_id", "pos"]).join(cited("target", "_old"), ["board_id", "target"])
    signal = F.concat(F.lit("Resolve conflict between "), c("pos").cast("string"), F.lit(" and "), c("target").cast("string"))
    return both.select("board_id", "pos", "place", "target", F.concat(F.lit("CONFLICT: "), "_new", F.lit(" vs "), "_old").alias("content"), signal.alias("signal"), F.lit("critical").alias("priority"))


def reopened(signals: DataFrame, entries: DataFrame, edges: DataFrame) -> DataFrame:
    """``signals`` (board_id, signal_id, status, addressed_by): those that a superseded entry had answered are open again."""
    gone = met_edges(entries, edges).where("kind = 'supersedes'").select("board_id", c("target").alias("addressed_by"), F.lit(True).alias("_gone")).distinct()
    back = F.coalesce("_gone", F.lit(False))
    out = signals.select("board_id", "signal_id", "status", "addressed_by").join(gone, ["board_id", "addressed_by"], "left")
    return out.select("board_id", "signal_id", F.when(back, "open").otherwise(c("status")).alias("status"), F.when(~back, c("addressed_by")).alias("addressed_by"))


def frontier_violations(targets: DataFrame, sources: DataFrame, candidates: DataFrame, fallback: DataFrame, batch: int = BATCH, cap: int = PER_TARGET) -> DataFrame:
    """board_id, kind, target_id, place, source_id: each way in which a stored frontier doesn't fit its board; none if it does.

    ``targets``: board_id, target_id; ``sources``: board_id, source_id, place (among the board's documents, from 0), is_document;
    ``candidates``: board_id, target_id, place (in the target's list, dense), source_id, priority, reason, batch_index,
    response_rank; ``fallback``: board_id, source_id. A document listed twice is in the batch of every place.
    Order is checked against the row at the place before by an equi join, so a long list needs no sort in one task."""
    rank = F.lit(None).cast("int")
    for name, value in PRIORITY_RANK.items():
        rank = F.when(c("priority") == name, value).otherwise(rank)
    rows = candidates.withColumn("_rank", rank)
    docs = sources.where("is_document").select("board_id", "source_id", F.floor(c("place") / batch).cast("long").alias("_batch"))
    known, mine, none = docs.select("board_id", "source_id").distinct(), ["board_id", "source_id"], F.lit(None)
    listed, spare = rows.select(*mine).distinct(), fallback.select(*mine)

    def bad(kind: str, df: DataFrame, *has: str):
        cells = [(c(n) if n in has else none).cast(t).alias(n) for n, t in (("target_id", "string"), ("place", "long"), ("source_id", "string"))]
        return df.select("board_id", F.lit(kind).alias("kind"), *cells)

    row = ("target_id", "place", "source_id")
    untyped = c("_rank").isNull() | c("reason").isNull() | c("batch_index").isNull() | c("response_rank").isNull() | c("source_id").isNull()
    first = rows.groupBy("board_id", "target_id", "source_id").agg(F.min("place").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    key = F.struct("_rank", "batch_index", "response_rank")
    before = rows.select("board_id", "target_id", (c("place") + 1).alias("place"), key.alias("_before"))
    batches = docs.select(*mine, c("_batch").alias("batch_index")).distinct()
    found = [
        bad("dead_target", rows.join(targets.select("board_id", "target_id").distinct(), ["board_id", "target_id"], "left_anti"), *row),
        bad("malformed", rows.where(untyped), *row),
        bad("unknown_source", rows.where("source_id is not null").join(known, mine, "left_anti"), *row),
        bad("wrong_batch", rows.where("batch_index is not null").join(known, mine, "left_semi").join(batches, [*mine, "batch_index"], "left_anti"), *row),
        bad("repeated", rows.join(first, ["board_id", "target_id", "source_id"]).where("place > _first"), *row),
        bad("out_of_order", rows.join(before, ["board_id", "target_id", "place"]).where(key < c("_before")), *row),
        bad("over_cap", rows.groupBy("board_id", "target_id", "batch_index").agg(F.count(F.lit(1)).alias("_n")).where(c("_n") > cap), "target_id"),
        bad("fallback_repeated", spare.groupBy(*mine).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "source_id"),
        bad("fallback_unknown", spare.distinct().join(known, mine, "left_anti"), "source_id"),
        bad("fallback_is_candidate", spare.distinct().join(listed, mine, "left_semi"), "source_id"),
        bad("uncovered", known.join(listed.unionByName(spare), mine, "left_anti"), "source_id"),
    ]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out
