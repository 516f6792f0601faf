"""Hard-negative mining by threshold joins over an inverted index with suffix-norm bounds.

An anchor has windows: first one for its positives (rows of its label, any score), then one for
each positive p (rows of other labels with ``LOW`` % of p's score <= score <= ``HIGH`` % of it). Each
window wants the first k rows in it, by score. Windows are filled by threshold joins:

1. Every window starts at a threshold that a sample of at most about ``SAMPLE`` rows expects
   ``FILL`` times k rows above. The anchors, in blocks that go to all tasks, are joined with
   all rows whose score reaches it.
2. The join: dimensions are ordered, those with few entries and small sums of squares first. In
   each batch of rows an inverted index holds, for each run of ``RUN`` dimensions, the rows and
   values there; it omits the first dimensions of a row as long as their norm times the anchors'
   largest is below the lowest threshold. Partial scores are accumulated from the last
   dimensions down. A pair is dropped once its partial score plus the product of the norms of
   what remains on both sides can't reach the anchor's threshold. Rounding is allowed for.
3. What is left is scored in whole numbers and offered to the anchor's windows. In a task a
   window's threshold rises with its own k-th best row, so that a task gives k rows a window.
4. Windows that didn't fill go on with a threshold that lets ``LOWER`` times as many rows of the
   sample through, down to the window's own lower end. Full windows are done: whatever
   wasn't seen scores less.

Thresholds only decide when a row is found, not whether; the sample has no say in the result.

Defined results: rows with a null label, a null vector, or null or non-finite components take no
part. Empty vectors score 0; of different lengths the shorter one ends in zeros. Each row is itself,
so repeated rows are each other's positives, and anchors of their own. Rows without vec_id are
no anchors and come behind equal scores. Scores beyond a long are held at its ends. Further
columns are ignored; an empty table gives an empty result. Anchors without positives, and
windows without rows, give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, session, stored, table
from .vectors import BLOCK_BYTES, FOUND, WIDEST, Batch, Best, block, blocks, exact, moments, named, ranged, ranked, read, whole

POSITIVES, NEGATIVES, LOW, HIGH, EVERY, SCALE = 5, 10, 30, 90, 100, 256.0
SAMPLE, FILL, LOWER = 4096, 4, 8
#: Dimensions of a list of the index; anchors that meet a batch at once.
RUN, GROUP = 8, 512
#: Relative error allowed for in bounds.
ROUNDING = 1e-9
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Windows:
    """What anchors look for: per window the anchor's place in the block, the whole scores low..high, the threshold so far, whether it is done."""

    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    least: np.ndarray
    done: np.ndarray
    same: bool
    k: int


def index_of(x: np.ndarray, length: float, least: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, np.ndarray]]]:
    """The rows' order by how many first dimensions are omitted, that number, and for each run of dimensions
    (from, to, rows that have entries there: so many of the first, their values)."""
    dims = x.shape[1]
    if least > 0:
        reach = np.sqrt(np.cumsum(np.square(x), axis=1)) * length * (1 + ROUNDING) < least
        omitted = reach.sum(axis=1)  # prefix norms ascend
    else:
        omitted = np.zeros(len(x), np.int64)
    order = np.argsort(omitted, kind="stable")
    omitted = omitted[order]
    lists = []
    for first in range(0, dims, RUN):
        last = min(first + RUN, dims)
        n = int(np.searchsorted(omitted, last, "left"))
        lists.append((first, last, n, np.where(np.arange(first, last) >= omitted[:n, None], x[order[:n], first:last], 0.0)))
    return order, omitted, lists


def joined(q: np.ndarray, norm: np.ndarray, least: np.ndarray, x: np.ndarray, x_norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in q, place in x) that may reach the anchor's threshold; dimensions in index order."""
    order, omitted, lists = index_of(x, float(norm.max()), float(least.min()))
    dims = x.shape[1]
    zero = np.zeros((len(x), 1))
    q_norms = np.sqrt(np.concatenate([np.zeros((len(q), 1)), np.cumsum(np.square(q), axis=1)], axis=1))
    x_norms = np.sqrt(np.concatenate([zero, np.cumsum(np.square(x[order]), axis=1)], axis=1))
    sums, error = np.zeros((len(q), len(x))), ROUNDING * np.outer(norm, x_norm[order])
    rows, columns = np.arange(len(q)), np.arange(len(x))
    checks = {lists[len(lists) // 4][0], 0} if lists else set()
    for first, last, n, values in reversed(lists):
        here = int(np.searchsorted(columns, n))
        sums[:, :here] += q[rows, first:last] @ values[columns[:here]].T
        if first in checks:
            rest = np.maximum(first, omitted[columns])  # a row's omitted dimensions remain as well
            bound = sums + q_norms[rows][:, rest] * x_norms[columns, rest] + error
            alive = ~(bound < least[rows][:, None])
            if first == 0:
                i, j = np.nonzero(alive)
                return rows[i], order[columns[j]]
            keep_rows, keep_columns = alive.any(axis=1), alive.any(axis=0)
            rows, columns = rows[keep_rows], columns[keep_columns]
            sums, error = sums[np.ix_(keep_rows, keep_columns)], error[np.ix_(keep_rows, keep_columns)]
    i, j = np.nonzero(np.zeros((len(q), len(x))) >= least[:, None]) if not dims else (rows[:0], rows[:0])
    return i, order[j]


def _miner(given):
    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Batch
        windows: Windows
        anchors, windows, axes = given.value
        dims = anchors.whole.shape[1]
        q, best = anchors.whole[:, axes], Best(windows.least, windows.k)
        open_ = np.flatnonzero(~windows.done)
        open_ = open_[np.argsort(windows.anchor[open_], kind="stable")]
        who, first = np.unique(windows.anchor[open_], return_index=True)
        many = np.diff(np.append(first, len(open_)))
        by_threshold = np.argsort(np.minimum.reduceat(windows.least[open_], first)) if len(who) else who
        with np.errstate(over="ignore", invalid="ignore"):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = read(batch, dims)
                turned = x.whole[:, axes]
                for at in range(0, len(who), GROUP):
                    group = by_threshold[at : at + GROUP]
                    group = group[np.isin(anchors.label[who[group]], x.label)] if windows.same else group
                    for label in np.unique(anchors.label[who[group]]) if windows.same else [None]:
                        some = group if label is None else group[anchors.label[who[group]] == label]
                        columns = np.flatnonzero(x.label == label) if windows.same else np.arange(len(x.row))
                        if not len(some):
                            continue
                        least = np.minimum.reduceat(best.reach[open_], first)[some]
                        i, j = joined(q[who[some]], anchors.norm[who[some]], least, turned[columns], x.norm[columns])
                        place, j = some[i], columns[j]
                        fit = (anchors.row[who[place]] != x.row[j]) if windows.same else anchors.label[who[place]] != x.label[j]
                        place, j = place[fit], j[fit]
                        score = exact(anchors.whole, x.whole, anchors.norm, x.norm, who[place], j)
                        for nth in range(int(many[place].max()) if len(place) else 0):
                            has = np.flatnonzero(many[place] > nth)
                            window = open_[first[place[has]] + nth]
                            inside = (score[has] >= windows.low[window]) & (score[has] <= windows.high[window])
                            best.offer(window[inside], score[has][inside], x, j[has][inside])
        yield from best.batches()

    return mine


def first_thresholds(windows: Windows, anchors: Batch, sample: Batch, share: float, times: float) -> np.ndarray:
    """Per window the sample's score above which the whole table should hold ``times`` * k rows of the window; its lower end where the sample has too few."""
    nth = max(1, int(np.ceil(times * windows.k * share)))
    out = windows.low.astype(np.float64)
    for at in range(0, len(windows.anchor), GROUP):
        part = slice(at, at + GROUP)
        of = windows.anchor[part]
        with np.errstate(over="ignore", invalid="ignore"):
            score = anchors.whole[of] @ sample.whole.T
        fit = (anchors.label[of][:, None] == sample.label) == windows.same
        fit &= (anchors.row[of][:, None] != sample.row) & (score >= windows.low[part][:, None]) & (score <= windows.high[part][:, None])
        if score.shape[1] >= nth:
            at_nth = -np.partition(-np.where(fit, score, -np.inf), nth - 1, axis=1)[:, nth - 1]
            out[part] = np.where(np.isfinite(at_nth), np.maximum(out[part], np.floor(at_nth)), out[part])
    return out


def filled(vectors: DataFrame, anchors: Batch, windows: Windows, sample: Batch, share: float, axes: np.ndarray) -> DataFrame | None:
    """key (the window), score, id, row, rank: the first k of each window, round by round with lower thresholds."""
    spark, times, found = vectors.sparkSession, float(FILL), None
    while not windows.done.all():
        windows.least = np.where(windows.done, windows.least, first_thresholds(windows, anchors, sample, share, times))
        given = spark.sparkContext.broadcast((anchors, windows, axes))
        new = vectors.mapInArrow(_miner(given), FOUND)
        if found is not None:  # a window that goes on finds its rows of earlier rounds again
            new = new.unionByName(found.drop("rank")).dropDuplicates(["key", "row"])
        found = stored(ranked(new, windows.k), "windows")
        windows.done |= windows.least <= windows.low
        full = [r.key for r in found.where(F.col("rank") == windows.k).select("key").collect()]
        windows.done[full] = True
        times *= LOWER
    return found


def hard_negatives(
    rows: DataFrame, asks: Callable[[Column], Column], id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: float = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows whose id ``asks``."""
    spark = rows.sparkSession
    own = rows.select(named(rows, id_column).alias("id"), named(rows, label_column).alias("label"), named(rows, vector_column).alias("vector"))
    with scratch(spark) as keep:
        plain = stored(whole(own.where(F.col("label").isNotNull()), scale), "whole")
        n, width = plain.agg(F.count("*"), F.coalesce(F.max(F.length("vector")), F.lit(0))).first()
        dims = width // 8
        vectors = stored(ranged(plain, n), "ranges")
        axes = index_order(vectors, dims)
        sample_rows = vectors.where(F.pmod(F.xxhash64("row", F.lit("sample")), F.lit(max(1, -(-n // sample_rows_of(dims))))) == 0)
        sample = block(sample_rows, dims)
        share = len(sample.row) / n if n else 1.0
        asking = vectors.where(asks(F.col("id")))
        done = []
        for rows_asking in blocks(asking, asking.count(), dims):
            anchors = block(rows_asking, dims)
            many = len(anchors.row)
            if not many:
                continue
            limits = np.full(many, -(2**63) + 1), np.full(many, 2**63 - 1)
            wanted = Windows(np.arange(many), *limits, np.full(many, -np.inf), np.zeros(many, bool), True, positives)
            found = filled(vectors, anchors, wanted, sample, share, axes).orderBy("key", "rank").collect()  # positives of a block: bounded
            if not found:
                continue
            ends = [(-(-low * p.score // 100), high * p.score // 100) for p in found]
            key = np.array([p.key for p in found])
            wanted = Windows(key, np.array([a for a, _ in ends]), np.array([b for _, b in ends]), np.full(len(key), -np.inf), np.array([a > b for a, b in ends]), False, negatives)
            mined = filled(vectors, anchors, wanted, sample, share, axes)
            if mined is None:
                continue
            of = spark.createDataFrame([(i, int(anchors.id[p.key]), p.id, p.score) for i, p in enumerate(found)], "key long, anchor_id long, positive_id long, positive_score long")
            out = mined.join(F.broadcast(of), "key").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            done.append(keep(stored(out, "negatives")))
    if not done:
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(done[0].schema).parquet(*(x._folder for x in done))


def sample_rows_of(dims: int) -> int:
    """``SAMPLE`` rows, or as many as a block of queries may hold bytes."""
    return max(1, min(SAMPLE, BLOCK_BYTES // (8 * max(dims, 1))))


def index_order(vectors: DataFrame, dims: int) -> np.ndarray:
    """Dimensions with small sums of squares first, so that the index omits as many as it can; wider vectors than ``WIDEST`` keep their order."""
    return np.argsort(np.diag(moments(vectors, dims)), kind="stable") if 0 < dims <= WIDEST else np.arange(dims)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(session(spark), sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), lambda id_: id_ % EVERY == 0)


SQL = f"""
WITH given AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding, row_number() OVER () AS r FROM embeddings
               WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
own AS (SELECT vec_id, label, r, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM given),
scored AS (SELECT a.r AS a, a.vec_id AS anchor_id, o.vec_id, o.r, a.label = o.label AS same, CAST(list_inner_product(a.v, o.v) AS BIGINT) AS score
           FROM own a JOIN own o ON a.vec_id % {EVERY} = 0 AND a.r <> o.r),
positives AS (SELECT a, anchor_id, vec_id AS positive_id, r, score AS positive_score FROM scored WHERE same
              QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, r) <= {POSITIVES}),
ranks AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
                 row_number() OVER (PARTITION BY p.a, p.r ORDER BY s.score DESC, s.vec_id NULLS LAST, s.r) AS rank
          FROM positives p JOIN scored s ON s.a = p.a AND NOT s.same AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranks WHERE rank <= {NEGATIVES}
"""
