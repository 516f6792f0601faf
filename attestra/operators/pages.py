"""Pages of sources that do justice to all targets, and the items of planned sections."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut
from .ranking import tasks_for

c = F.col
#: Sources of a page.
LIMIT = 60


def rotated_place(place: Column, size: Column, iteration: Column, stride: Column) -> Column:
    """Where the row at ``place`` (from 0) of a list of ``size`` stands once the list starts ``stride`` further on in each iteration."""
    return F.pmod(place - F.pmod((F.greatest(iteration, F.lit(1)) - 1) * stride, size), size)


def _dealt(limit: int):
    """Turns over a board's targets: each takes its next source that isn't on the page yet, until the page is full or all lists end.
    Rows come by board, turn and place; a board's rows are together in one partition, a task holds one board at a time."""

    def page_of(rows: Iterator[tuple]) -> list[str]:
        queues = [iter([x[3] for x in own]) for _, own in groupby(rows, key=lambda x: x[1])]
        page: dict[str, None] = {}
        while queues and len(page) < limit:
            left = []
            for queue in queues:
                if len(page) == limit:
                    break
                new = next((s for s in queue if s not in page), None)
                if new is not None:
                    page[new] = None
                    left.append(queue)
            queues = left
        return list(page)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (x for b in batches for x in zip(b["board_id"], b["turn"], b["place"], b["source_id"]))
        out: list[tuple] = []
        frame = lambda: pd.DataFrame(out, columns=["board_id", "slot", "source_id", "part"])
        for board, own in groupby(rows, key=lambda x: x[0]):
            out += [(board, slot, source, "target") for slot, source in enumerate(page_of(own))]
            if len(out) >= 10_000:
                yield frame()
                out.clear()
        yield frame()

    return deal


def balanced_page(boards: DataFrame, targets: DataFrame, candidates: DataFrame, sources: DataFrame, limit: int = LIMIT) -> DataFrame:
    """board_id, slot (from 0), source_id, part (target, unread, read): one page per board.

    ``boards``: board_id, iteration; ``targets``: board_id, target_id, pos, open, material; ``candidates``: board_id, target_id, pos,
    source_id; ``sources``: board_id, pos, source_id, read. Open targets take turns, the material ones first, another one
    leading in each iteration; each target's unread candidates start further on in each iteration, and no source comes
    twice. What is left of the page is filled with the other unread sources, then with read ones, rotated too. A
    repeated source counts as its first row.

    A target's list gives up to ``limit`` sources, of which others may have taken ``limit``: so 2 * limit of each list are
    enough, and of these lists a board's turns are worked out together."""
    first = sources.groupBy("board_id", "source_id").agg(F.min(F.struct("pos", "read")).alias("s")).select("board_id", "source_id", "s.pos", "s.read")
    listed = candidates.select("board_id", "target_id").distinct()
    open_ = targets.where("open").join(listed, ["board_id", "target_id"], "left_semi").join(boards, "board_id")
    board, order = Window.partitionBy("board_id"), Window.partitionBy("board_id").orderBy(F.desc("material"), "pos")
    ranked = open_.withColumn("n", F.count(F.lit(1)).over(board)).withColumn("k", F.row_number().over(order) - 1)
    turn = rotated_place(c("k"), c("n"), c("iteration"), F.lit(1))
    stride = F.greatest(F.lit(1), F.floor(F.lit(limit) / c("n")))
    turns = ranked.select("board_id", "target_id", "iteration", turn.alias("turn"), stride.alias("stride"))
    unread = candidates.join(first.where("not read").select("board_id", "source_id"), ["board_id", "source_id"]).join(turns, ["board_id", "target_id"])
    own = Window.partitionBy("board_id", "target_id")
    numbered = unread.withColumn("size", F.count(F.lit(1)).over(own)).withColumn("i", F.row_number().over(own.orderBy("pos")) - 1)
    placed = numbered.withColumn("place", rotated_place(c("i"), c("size"), c("iteration"), c("stride")))
    # a source that a target lists twice stands at its first place after the rotation
    near = placed.groupBy("board_id", "turn", "source_id").agg(F.min("place").alias("place"))
    near = near.withColumn("near", F.row_number().over(Window.partitionBy("board_id", "turn").orderBy("place"))).where(c("near") <= 2 * limit).drop("near")
    lists = near.select("board_id", "turn", "place", "source_id").repartition("board_id").sortWithinPartitions("board_id", "turn", "place")
    # dealt once: what is left over and the page itself both need it
    page = cut(lists.mapInPandas(_dealt(limit), "board_id string, slot long, source_id string, part string"))
    taken = page.groupBy("board_id").agg(F.count(F.lit(1)).alias("taken"))
    rest = first.where("read is not null").join(page.select("board_id", "source_id"), ["board_id", "source_id"], "left_anti").join(boards, "board_id").join(taken, "board_id", "left")
    same = Window.partitionBy("board_id", "read")
    numbered = rest.withColumn("unread", F.count_if(~c("read")).over(board)).withColumn("size", F.count(F.lit(1)).over(same)).withColumn("i", F.row_number().over(same.orderBy("pos")) - 1)
    place = rotated_place(c("i"), c("size"), c("iteration"), F.lit(limit)).cast("long")
    slot = F.coalesce("taken", F.lit(0).cast("long")) + F.when(c("read"), c("unread")).otherwise(0) + place
    part = F.when(c("read"), "read").otherwise("unread")
    return page.unionByName(numbered.select("board_id", slot.alias("slot"), "source_id", part.alias("part")).where(c("slot") < limit))


def section_items(sections: DataFrame, claims: DataFrame, coverage: DataFrame, units: DataFrame, requirements: DataFrame) -> DataFrame:
    """board_id, section_no, kind (claim, unit), target_id, obligation_id, unit_id, canonical, context, requirements: what a section renders.

    ``sections``: board_id, section_no, key, target_pos, target_id; ``claims``: board_id, target_id, pos, claim_id; ``coverage``:
    board_id, pos, key, obligation_id; ``units``: board_id, obligation_id, pos, unit_id, claim_ids (array); ``requirements``:
    board_id, claim_id. A claim is rendered once in a section: in the first of the section's targets that has it, else in the first
    unit; further units hold it as context. Units of an obligation are rendered once in all, in the first section that covers
    it; an obligation routed to no planned section goes to an appendix behind the last section. Requirements stand above every
    section and are only named in units. A section gives its items without being gathered: all of it is first occurrences in order."""
    keyed = sections.groupBy("board_id", "section_no").agg(F.first("key").alias("key"))
    appendix = keyed.groupBy("board_id").agg((F.max("section_no") + 1).alias("appendix"))
    of_key = keyed.groupBy("board_id", "key").agg(F.min("section_no").alias("section_no"))
    first = F.struct("section_no", "pos")
    routed = coverage.join(of_key, ["board_id", "key"], "left").join(appendix, "board_id", "left").withColumn("section_no", F.coalesce("section_no", "appendix", F.lit(0)))
    once = routed.groupBy("board_id", "obligation_id").agg(F.min(first).alias("f")).select("board_id", "obligation_id", "f.section_no", c("f.pos").alias("cover_pos"))
    binding = requirements.select("board_id", "claim_id", F.lit(True).alias("binding")).distinct()

    tasks = tasks_for(claims)
    target = sections.groupBy("board_id", "section_no", "target_id").agg(F.min("target_pos").alias("target_pos"))
    # of a claim that a target holds several times, the first place counts
    held = claims.repartition(tasks, "board_id", "target_id").groupBy("board_id", "target_id", "claim_id").agg(F.min("pos").alias("pos"))
    in_targets = held.join(target.repartition(tasks, "board_id", "target_id"), ["board_id", "target_id"])
    in_targets = in_targets.select("board_id", "section_no", "claim_id", F.struct(F.lit(0).alias("phase"), c("target_pos").cast("long").alias("a"), c("pos").cast("long").alias("b"), F.lit(0).cast("long").alias("d")).alias("at"), "target_id", F.lit(None).cast("string").alias("unit_id"), F.lit(None).cast("string").alias("obligation_id"))
    placed = once.join(units, ["board_id", "obligation_id"])
    in_units = placed.select("board_id", "section_no", "obligation_id", "unit_id", "cover_pos", "pos", F.posexplode_outer(F.array_distinct("claim_ids")).alias("i", "claim_id"))
    at = F.struct(F.lit(1).alias("phase"), c("cover_pos").cast("long").alias("a"), c("pos").cast("long").alias("b"), F.coalesce("i", F.lit(0)).cast("long").alias("d")).alias("at")
    rows = in_targets.unionByName(in_units.select("board_id", "section_no", "claim_id", at, F.lit(None).cast("string").alias("target_id"), "unit_id", "obligation_id"))
    # one shuffle by claim serves what is binding and what comes first
    rows = rows.repartition(tasks, "board_id", "claim_id").join(binding.repartition(tasks, "board_id", "claim_id"), ["board_id", "claim_id"], "left")
    unit = c("at.phase") == 1
    rows = rows.where(unit | c("binding").isNull())
    seen = rows.withColumn("nth", F.row_number().over(Window.partitionBy("board_id", "section_no", "claim_id").orderBy("at")))
    shown = cut(seen.where(unit | (c("nth") == 1)))
    # a claim shown is a row already; only units are gathered, each of them the claims that it lists
    none = F.array().cast("array<string>")
    of_claims = shown.where(~unit).select("board_id", "section_no", F.lit("claim").alias("kind"), "target_id", "obligation_id", "unit_id", F.array_compact(F.array("claim_id")).alias("canonical"), none.alias("context"), none.alias("requirements"), "at")
    chosen = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test & c("claim_id").isNotNull(), F.struct("at", "claim_id")))), lambda x: x["claim_id"])
    bound = F.coalesce("binding", F.lit(False))
    by = ["board_id", "section_no", F.lit("unit").alias("kind"), "target_id", "obligation_id", "unit_id"]
    of_units = shown.where(unit).groupBy(*by).agg(chosen(~bound & (c("nth") == 1)).alias("canonical"), chosen(~bound & (c("nth") > 1)).alias("context"), chosen(bound).alias("requirements"), F.min("at").alias("at"))
    return of_claims.unionByName(of_units)
