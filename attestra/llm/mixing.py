"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Targets. Sources by code point, null last, weigh 1, 2, 3, repeating. A source's target
is ``min(3 * size, theta * weight)``; theta is found by one sorted pass over the sources
so that the targets share all sizes (the fixed point of resharing each excess by weight).
Places in an order, and sums up to them, come from ranges that tasks sum up each for
themselves and that are then offset by the ranges before (``running``): neither the
sources nor the sizes of one source are sorted in one task.

Rates. Per source, the document rates nearest to 1 in relative entropy whose words meet
the target, none above 3, are ``min(3, exp(lambda * z))`` with z the document's size over
the source's mean size. lambda solves the convex dual; all sources take one Newton step
per pass, kept inside a bracket. A pass sums over the histogram (source, size, how many),
which is made with map-side combining, so a source with a third of all rows costs no
more than its distinct sizes.

Copies. Along the sizes of a source the rates are summed up, and a document gets as many
copies as whole numbers are passed at its place: rounding then shifts words only between
neighbours in size. Ranks among equal sizes come from salted sub-cells with offsets. Two
passes then move single copies of single documents where that brings a source nearer to
its target.

Defined results: null and empty texts have size 0 and take 0 words. Null sources are one
source. A source without words has target 0. Rows that repeat a doc_id are rounded each
(a repair moves a copy of only one of them). An empty table gives an empty result. Ties
are broken by a hash of doc_id (of the text where doc_id is null), then doc_id: reruns
agree. Further columns are ignored by the report and kept by ``mixed``, whatever their
names. A solve that doesn't meet its targets within ``PASSES`` is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns_of, deleted, fresh, scratch, session, stored, table, whole_row

CAP = 3
SALTS = 64
PASSES = 200
#: What a document gets is broadcast up to this measured number of documents, else joined by shuffle.
BROADCAST_IDS = 500_000
#: A source's words may miss its target by this share before rounding.
NEAR = 1e-7
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def tie(doc_id: Column, text: Column) -> Column:
    """What tells rows without doc_id apart."""
    return F.when(doc_id.isNull(), F.xxhash64(text))


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"), tie(F.col("doc_id"), F.col("text")).alias("tie"))


def running(rows: DataFrame, group: list[str], order: list[Column], values: list[str]) -> DataFrame:
    """``rows`` with before_<value>: the sum over the rows of the group that come before in the order.

    Rows are dealt out in ranges of the order. A range is summed up by its task; a group's
    offsets are one row for each range it reaches into."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(ranges, *[F.col(g).asc_nulls_last() for g in group], *order).withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy(*[f"_{g}" for g in group]).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*group, "_range").agg(*[F.sum(v).alias(f"_{v}") for v in values]).select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_range").alias("_at"), *[f"_{v}" for v in values])
    offsets = sums.select(*[f"_{g}" for g in group], "_at", *[F.coalesce(F.sum(f"_{v}").over(earlier), F.lit(0)).alias(f"_off_{v}") for v in values])
    within = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    hit = F.col("_range") == F.col("_at")
    for g in group:
        hit = hit & F.col(g).eqNullSafe(F.col(f"_{g}"))
    out = dealt.withColumns({f"before_{v}": F.coalesce(F.sum(v).over(within), F.lit(0)) for v in values}).join(offsets, hit)
    return out.select(*rows.columns, *[(F.col(f"before_{v}") + F.col(f"_off_{v}")).alias(f"before_{v}") for v in values])


def targets(cells: DataFrame) -> DataFrame:
    """source, source_size, n, target from the histogram; one row per source."""
    by = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n")).withColumn("one", F.lit(1))
    name = F.col("source").asc_nulls_last()
    weighed = running(by, [], [name], ["one"]).withColumn("weight", F.col("before_one") % 3 + 1).withColumn("cap", CAP * F.col("source_size")).drop("one", "before_one")
    weighed = stored(weighed, "weights")
    total, weights = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    swept = running(weighed, [], [F.col("cap") / F.col("weight"), name], ["cap", "weight"])
    swept = swept.withColumn("theta", (F.lit(total) - F.col("before_cap")) / (F.lit(weights) - F.col("before_weight")))
    # the first source, by ratio, that its share at theta doesn't fill sets theta for all
    level = swept.where(F.col("theta") * F.col("weight") <= F.col("cap")).agg(F.min(F.struct(F.col("cap") / F.col("weight"), "theta")).alias("level")).first().level
    return swept.select("source", "source_size", "n", F.least(F.col("cap").cast("double"), F.lit(level.theta if level else float("inf")) * F.col("weight")).alias("target"))


def rate(step: Column, size: Column, mean: Column) -> Column:
    return F.least(F.lit(float(CAP)), F.exp(F.least(F.lit(700.0), step * size / mean)))


def solve(cells: DataFrame, aims: DataFrame) -> DataFrame:
    """``aims`` with the multiplier ``step`` of each source; infinite where the target is the cap."""
    now = aims.withColumn("mean", F.greatest(F.lit(1.0), F.col("source_size") / F.col("n"))).withColumn("done", (F.col("source_size") == 0) | (F.col("target") >= F.col("source_size") * CAP * (1 - NEAR)))
    now = now.withColumn("step", F.when(F.col("done"), F.lit(float("inf"))).otherwise(0.0)).withColumn("low", F.lit(float("-inf"))).withColumn("high", F.lit(float("inf")))
    now = stored(now, "step-0")
    for i in range(PASSES):
        open_ = now.where("not done")
        if open_.isEmpty():
            return now
        z = F.col("size") / F.col("mean")
        r = rate(F.col("step"), F.col("size"), F.col("mean"))
        sums = cells.join(open_.select(F.col("source").alias("s"), "step", "mean"), cells["source"].eqNullSafe(F.col("s")))
        sums = sums.groupBy("s").agg(F.sum(r * F.col("size") * F.col("n")).alias("words"), F.sum(F.when(r < CAP, r * F.col("size") * z * F.col("n")).otherwise(0.0)).alias("slope"))
        x = now.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        gap = F.col("words") - F.col("target")
        x = x.withColumn("low", F.when(~F.col("done") & (gap < 0), F.col("step")).otherwise(F.col("low"))).withColumn("high", F.when(~F.col("done") & (gap > 0), F.col("step")).otherwise(F.col("high")))
        newton = F.col("step") - F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.try_divide(gap, F.col("slope"))))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        middle = F.when(F.col("low") == float("-inf"), F.col("high") - 2).when(F.col("high") == float("inf"), F.col("low") + 2).otherwise((F.col("low") + F.col("high")) / 2)
        met = F.abs(gap) <= NEAR * F.col("target")
        x = x.withColumn("done", F.col("done") | met | (F.col("high") - F.col("low") < 1e-13)).withColumn("step", F.when(F.col("done"), F.col("step")).when(inside, newton).otherwise(middle))
        before, now = now, stored(x.drop("words", "slope"), f"step-{i + 1}")
        deleted(now.sparkSession, [before._folder])
    raise RuntimeError(f"rates don't meet their targets after {PASSES} passes")


def _hash() -> Column:
    return F.xxhash64("doc_id", "size", "tie")


def balanced(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, tie, source_size, target, copies of every row."""
    with scratch(docs.sparkSession) as keep:
        rows = stored(sizes(docs), "sizes")
        cells = stored(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
        solved = solve(cells, targets(cells))
        # the sum of rates over all smaller documents of the source, per sub-cell of equal sizes
        salted = rows.withColumn("salt", F.pmod(_hash(), F.lit(SALTS)).cast("int"))
        aims = solved.select(F.col("source").alias("s"), "source_size", "target", "step", "mean")
        sub = salted.groupBy("source", "size", "salt").agg(F.count(F.lit(1)).alias("n")).join(aims, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        sub = sub.withColumn("rate", F.when(F.col("step") == float("inf"), F.lit(float(CAP))).otherwise(rate(F.col("step"), F.col("size"), F.col("mean")))).withColumn("mass", F.col("n") * F.col("rate"))
        sub = running(sub, ["source"], [F.col("size"), F.col("salt")], ["mass"])
        sub = sub.select(F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("salt").alias("_salt"), "source_size", "target", "rate", F.col("before_mass").alias("before"))
        order = Window.partitionBy("source", "size", "salt").orderBy(_hash(), "doc_id", "tie")
        ranked = salted.withColumn("rank", F.row_number().over(order))
        joined = ranked.join(sub, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("salt") == F.col("_salt")))
        end = F.floor(F.round(F.col("before") + F.col("rank") * F.col("rate"), 6) + 0.5)
        start = F.floor(F.round(F.col("before") + (F.col("rank") - 1) * F.col("rate"), 6) + 0.5)
        copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.least(F.lit(CAP), end - start)).cast("long")
        out = joined.select("doc_id", "source", "size", "tie", "source_size", "target", copies.alias("copies"), "rank", "salt")
        for k in range(2):
            out = repaired(stored(out, f"copies-{k}"))
        return keep(stored(out.drop("rank", "salt"), "mix"))


def repaired(out: DataFrame) -> DataFrame:
    """One copy of one document more or less in each source, where that comes nearer to the target."""
    taken = out.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("words"), F.first("target").alias("aim")).select(F.col("source").alias("s"), (F.col("aim") - F.col("words")).alias("lack"))
    sized = out.groupBy("source", "size", "copies").agg(F.min(F.struct("salt", "rank", "doc_id")).alias("at"))  # one row per size and number of copies
    off = F.when(F.col("lack") > 0, F.abs(F.col("lack") - F.col("size"))).otherwise(F.abs(F.col("lack") + F.col("size")))
    may = F.when(F.col("lack") > 0, F.col("copies") < CAP).otherwise(F.col("copies") > 0) & (F.col("size") > 0) & (off < F.abs(F.col("lack")))
    best = sized.join(taken, F.col("source").eqNullSafe(F.col("s"))).where(may).groupBy("source").agg(F.min(F.struct(off.alias("off"), "size", "copies", "at", "lack")).alias("b"))
    best = best.select(F.col("source").alias("s"), F.col("b.size").alias("size_"), F.col("b.copies").alias("copies_"), F.col("b.at.salt").alias("salt_"), F.col("b.at.rank").alias("rank_"), F.when(F.col("b.lack") > 0, 1).otherwise(-1).alias("move"))
    hit = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("size_")) & (F.col("copies") == F.col("copies_")) & (F.col("salt") == F.col("salt_")) & (F.col("rank") == F.col("rank_"))
    return out.join(best, hit, "left").withColumn("copies", F.col("copies") + F.coalesce("move", F.lit(0))).select(out.columns)


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; all columns as they were.

    Documents with an id of their own get their copies by it. Rows without doc_id, or with one
    that several rows have, are matched by source and size as well, equal ones in any order."""
    report = balanced(docs)
    odd = report.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("o"))
    with scratch(docs.sparkSession) as keep:
        odd = keep(stored(odd, "odd-ids"))
    mine, copies, own = F.col("doc_id").cast("long"), fresh(docs, "copies"), fresh(docs, "own")
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_IDS else df
    place = report.where("copies > 0 and doc_id is not null").join(small(odd), F.col("doc_id") == F.col("o"), "left_anti").select(F.col("doc_id").alias(own), F.col("copies").alias(copies))
    repeated = lambda df: df.withColumn(own, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    plain = repeated(docs.join(small(place), mine == F.col(own))).select(columns_of(docs))
    if odd.isEmpty():
        return plain
    key = ["d", "s", "n", "t"]
    rows = docs.select(whole_row(docs).alias("row"), mine.alias("d"), F.col("source").cast("string").alias("s"), "text")
    rows = rows.join(small(odd), F.col("d").eqNullSafe(F.col("o")), "left_semi").select("row", "d", "s", words_in(F.col("text")).alias("n"), tie(F.col("d"), F.col("text")).alias("t"), F.xxhash64("text").alias("h"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("h")))
    given = report.join(small(odd), F.col("doc_id").eqNullSafe(F.col("o")), "left_semi").withColumn("pk", F.row_number().over(Window.partitionBy("doc_id", "source", "size", "tie").orderBy("copies"))).where("copies > 0")
    given = given.select(F.col("doc_id").alias("pd"), F.col("source").alias("ps"), F.col("size").alias("pn"), F.col("tie").alias("pt"), "pk", "copies")
    hit = F.col("k") == F.col("pk")
    for c in key:
        hit = hit & F.col(c).eqNullSafe(F.col(f"p{c}"))
    return plain.unionByName(rows.join(given, hit).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*"))


def mix(docs: DataFrame) -> DataFrame:
    return balanced(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(session(spark), sf_dir, "documents"))
