"""Edges, influence, reachability and ordered folds over support graphs.

Walks are rounds of joins with a visited set, until nothing new is met; each round is written to the
checkpoint folder where one is set, so lineage stays short and a lost executor costs one
round. Folds take one target's ordered effects as an array, so targets run in parallel.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the checkpoint folder, so that lineage ends here.

    The folder is the one that the session names in ``spark.checkpoint.dir``. Where none is named, a local
    session takes a temporary one; on a cluster that is an error, as rounds without a cut are worked out again and again."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-cut-"))
    return df.checkpoint()


def influence(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, score: twice the supporters, once what it supports. ``edges``: src supports dst."""
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("into"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out"))
    return nodes.select("id").join(into, "id", "left").join(out, "id", "left").select("id", (2 * F.coalesce("into", F.lit(0)) + F.coalesce("out", F.lit(0))).alias("score"))


def reachable(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, id) of all nodes that a walk along src -> dst reaches, itself included; it ends when a round meets nothing new."""
    seen = front = starts.select("start", "id").distinct()
    while True:
        step = front.join(edges, front["id"] == edges["src"]).select("start", F.col("dst").alias("id")).distinct()
        front = cut(step.join(seen, ["start", "id"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))


def depths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """id, depth: the longest chain down to a root along src -> dst, for all nodes above a root.

    A round takes the nodes whose supports are all taken; where nodes are left and none can be taken,
    supports go in a circle, which is an error."""
    above = reachable(roots.select(F.lit(0).alias("start"), "id"), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    left = cut(above.select("id").distinct())
    open_ = cut(edges.select("src", "dst").distinct().join(left.select(F.col("id").alias("dst")), "dst", "left_semi"))
    best, k = None, 0
    while not left.isEmpty():
        front = cut(left.join(open_.select(F.col("src").alias("id")).distinct(), "id", "left_anti"))
        if front.isEmpty():
            raise ValueError("supports form a cycle")
        layer = front.withColumn("depth", F.lit(k))
        best = layer if best is None else best.unionByName(layer)
        left = cut(left.join(front, "id", "left_anti"))
        open_ = cut(open_.join(front.select(F.col("id").alias("dst")), "dst", "left_anti"))
        k += 1
        if k % 32 == 0:
            best = cut(best)
    return best if best is not None else left.withColumn("depth", F.lit(0))


def folded(effects: DataFrame, by: str, order: list[str], start: Column, step) -> DataFrame:
    """``by`` and ``value``: the effects of each target applied in order; ``step(value, effect)`` gives the next value."""
    rows = F.sort_array(F.collect_list(F.struct(*order, "delta")))
    return effects.groupBy(by).agg(F.aggregate(rows, start, step).alias("value"))


# What a removed document costs for each conclusion broken or weakened and each contradiction hidden; conclusions.
BROKEN, WEAKENED, HIDDEN = 10, 3, 2
CONCLUSIONS = ["analysis", "strategy", "calculation"]


def removal(entries: DataFrame, supports: DataFrame, contradicts: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per document broken, weakened, robust, hidden, impact, most_load_bearing; conclusions that rest on one document alone).

    ``entries``: board_id, entry_id, type, status, document; the edges: board_id, src, dst; ``documents``: board_id, pos, document. An
    entry rests on its own document and on those of all that supports it, over any number of steps and in circles too. A
    conclusion is broken if the removed document is all it rests on, weakened if it is one of several, else robust;
    those that rest on nothing don't count. A contradiction is hidden if one of its ends comes from the document. Of several
    documents with the highest impact of a board the first one bears most."""
    node = lambda x: F.struct("board_id", F.col(x).alias("entry_id"))
    own = entries.where("document is not null").select(F.struct("board_id", "document").alias("start"), node("entry_id").alias("id")).distinct()
    rests = reachable(own, supports.select(node("src").alias("src"), node("dst").alias("dst")).distinct()).select("start.board_id", "start.document", "id.entry_id")
    ends = entries.where((F.col("status") == "active") & F.col("type").isin(CONCLUSIONS)).select("board_id", "entry_id")
    held = rests.join(ends, ["board_id", "entry_id"])
    n = held.groupBy("board_id", "entry_id").agg(F.count(F.lit(1)).alias("n"), F.min("document").alias("document"))
    total = n.groupBy("board_id").agg(F.count(F.lit(1)).alias("all"))
    per = held.join(n.select("board_id", "entry_id", "n"), ["board_id", "entry_id"]).groupBy("board_id", "document").agg(F.count_if(F.col("n") == 1).alias("broken"), F.count_if(F.col("n") > 1).alias("weakened"))
    known = entries.select("board_id", "entry_id", "document")
    sides = contradicts.join(known.select("board_id", F.col("entry_id").alias("src"), F.col("document").alias("a")), ["board_id", "src"]).join(known.select("board_id", F.col("entry_id").alias("dst"), F.col("document").alias("b")), ["board_id", "dst"])
    hidden = sides.select("board_id", F.explode(F.array_distinct(F.array_compact(F.array("a", "b")))).alias("document")).groupBy("board_id", "document").agg(F.count(F.lit(1)).alias("hidden"))
    zero = ["broken", "weakened", "hidden", "all"]
    rows = documents.join(per, ["board_id", "document"], "left").join(hidden, ["board_id", "document"], "left").join(total, "board_id", "left").fillna(0, zero)
    rows = rows.withColumn("robust", F.col("all") - F.col("broken") - F.col("weakened")).withColumn("impact", BROKEN * F.col("broken") + WEAKENED * F.col("weakened") + HIDDEN * F.col("hidden"))
    top = rows.groupBy("board_id").agg(F.max(F.struct("impact", (-F.col("pos")).alias("low"))).alias("top"))
    out = rows.join(top, "board_id").withColumn("most_load_bearing", (F.col("impact") == F.col("top.impact")) & (-F.col("pos") == F.col("top.low")))
    return out.select("board_id", "document", "broken", "weakened", "robust", "hidden", "impact", "most_load_bearing"), n.where("n = 1").select("board_id", "entry_id", "document")
