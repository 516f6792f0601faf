"""Confidence of entries under support and contradiction, in the order in which entries come.

An entry raises what it supports (less, once more than ``FEW`` supporters of the target are of the target's own document), up to
``TOP``; it lowers what it contradicts, itself once, and all that support the contradicted entry by then, down to ``FLOOR``. The
effects are rows: how many supporters there were by then is a running count, who supported it by then a join on order.
Then each entry's effects are applied in order. A raise or a lowering is a shift held between two bounds, and so are
several one after the other: so runs of ``BLOCK`` effects become one, level by level, and no entry's effects are ever gathered whole.
All figures are whole millionths, so no order of additions shows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut
from .ranking import tasks_for

c = F.col
# Fixed values, in millionths: raise, raise beyond FEW supporters of one document, contradiction, weakened support; bounds.
RAISE, SMALL_RAISE, LOWER, WEAKEN, TOP, FLOOR, FEW = 50_000, 20_000, 120_000, 50_000, 980_000, 100_000, 2
BLOCK = 1000
FAR = 10**15


def effects(entries: DataFrame) -> DataFrame:
    """board_id, entry_id, at, shift, low, high: what happens to each entry's confidence, ``at`` giving the order.

    ``entries``: board_id, entry_id, seq, document, supports, contradicts (arrays of entry ids). An entry acts on those that came
    before, and on itself."""
    tasks = tasks_for(entries)
    to = [tasks, "board_id", "to"]
    known = entries.select("board_id", c("entry_id").alias("to"), c("seq").alias("to_seq"), c("document").alias("to_document")).repartition(*to)

    def edges(name: str) -> DataFrame:
        rows = entries.select("board_id", "entry_id", "seq", "document", F.posexplode(name).alias("pos", "to"))
        return rows.repartition(*to).join(known, ["board_id", "to"])

    # a reference counts from its entry on, even to an entry that comes later; it has effects only on one that is there.
    # All that is asked of a target stays in the tasks that its references were dealt to, as many as the entries need
    supports, contradicts = edges("supports"), edges("contradicts").where("to_seq <= seq")
    target = Window.partitionBy("board_id", "to").orderBy("seq", "pos")
    mine = Window.partitionBy("board_id", "to", "entry_id").orderBy("pos")
    alike = (c("document") == c("to_document")) & (F.row_number().over(mine) == 1)
    counted = supports.withColumn("alike", alike.cast("int")).withColumn("n", F.sum(F.coalesce("alike", F.lit(0))).over(target.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    at = lambda phase, step: F.struct("seq", F.lit(phase).alias("phase"), "pos", F.lit(step).alias("step")).alias("at")
    up = lambda shift: [shift.cast("long").alias("shift"), F.lit(-FAR).alias("low"), F.lit(TOP).cast("long").alias("high")]
    down = lambda shift: [F.lit(-shift).cast("long").alias("shift"), F.lit(FLOOR).cast("long").alias("low"), F.lit(FAR).alias("high")]
    raised = counted.where("to_seq <= seq").select("board_id", c("to").alias("entry_id"), at(0, 0), *up(F.when(c("n") > FEW, SMALL_RAISE).otherwise(RAISE)))
    hit = contradicts.select("board_id", c("to").alias("entry_id"), at(1, 0), *down(LOWER))
    first = contradicts.repartition(tasks, "board_id", "entry_id").groupBy("board_id", "entry_id", "seq").agg(F.min("pos").alias("pos"))
    own = first.select("board_id", "entry_id", at(1, 1), *down(LOWER))
    backers = supports.select("board_id", "to", c("entry_id").alias("backer"), c("seq").alias("backer_seq")).distinct()
    weakened = contradicts.join(backers, ["board_id", "to"]).where("backer_seq <= seq").select("board_id", c("backer").alias("entry_id"), at(1, 2), *down(WEAKEN))
    return raised.unionByName(hit).unionByName(own).unionByName(weakened)


def applied(rows: DataFrame, key: list[str], block: int = BLOCK) -> DataFrame:
    """key, shift, low, high: the effects of each key one after the other, as one effect."""
    # the effects are worked out once: their number says how many tasks they take
    rows = cut(rows)
    order = Window.partitionBy(*key).orderBy("at")
    numbered = rows.repartition(tasks_for(rows), *key).select(*key, F.row_number().over(order).cast("long").alias("n"), "shift", "low", "high")
    most = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0

    def one(effects):
        # v -> min(high, max(low, v + shift)), then the next one, is again of that form
        start = F.struct(F.lit(0).cast("long").alias("shift"), F.lit(-FAR).alias("low"), F.lit(FAR).alias("high"))
        held = lambda x, e: F.least(e["high"], F.greatest(e["low"], x + e["shift"]))
        return F.aggregate(effects, start, lambda a, e: F.struct((a["shift"] + e["shift"]).alias("shift"), held(a["low"], e).alias("low"), held(a["high"], e).alias("high")))

    while True:
        part = F.floor((c("n") - 1) / block).cast("long")
        folded = numbered.groupBy(*key, part.alias("p")).agg(one(F.sort_array(F.collect_list(F.struct("n", "shift", "low", "high")))).alias("e"))
        numbered, most = folded.select(*key, (c("p") + 1).alias("n"), "e.shift", "e.low", "e.high"), -(-most // block)
        if most <= 1:
            return numbered.drop("n")


def confidences(entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """board_id, entry_id, confidence (double): after all entries have come. ``entries`` as above, with confidence."""
    key = ["board_id", "entry_id"]
    start = entries.select(*key, F.round(c("confidence") * 1_000_000).cast("long").alias("v"))
    folded = applied(effects(entries), key, block)
    tasks = tasks_for(entries)
    rows = start.repartition(tasks, *key).join(folded.repartition(tasks, *key), key, "left")
    after = F.when(c("shift").isNull(), c("v")).otherwise(F.least(c("high"), F.greatest(c("low"), c("v") + c("shift"))))
    return rows.select(*key, (after / 1_000_000).alias("confidence"))
