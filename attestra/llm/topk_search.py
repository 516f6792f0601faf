"""Exact top-k search by inner product over norm-sorted vectors.

1. Vectors become whole numbers and are stored in ranges of descending norm.
2. The right singular vectors of all vectors (from the distributed sum of x xT) rotate them,
   so that the first rotated components hold most of what they have.
3. The queries, in blocks that go to all tasks, meet the ranges in rounds: first the longest
   vectors, each further round ``GROW`` times as many. The k-th best score so far is a query's
   threshold. By Cauchy-Schwarz, ranges whose largest norm times the query's is below all
   thresholds are not read, so that a round may be the last; inside a range the partial sum
   over the first rotated components plus the product of the residual norms bounds a score.
   Pairs whose bound stays below the threshold are dropped after half and after three
   quarters of the components. Rounding is allowed for in all bounds.
4. Scores of what is left are whole inner products. Each task gives k per query at most.

As rounds grow by a factor and thresholds with them, a query's rows between tasks stay near
GROW * k a round. The work is the queries times the vectors that the bounds let through.

Defined results: vectors that are null or hold null or non-finite components take no part;
empty vectors score 0; of different lengths the shorter one ends in zeros. Each row is itself
and never its own neighbour, so a repeated row is the other's neighbour and a query of its own.
Rows without vec_id are no queries; as neighbours they come behind equal scores. Scores beyond a
long are held at its ends. Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, session, stored, table
from .vectors import FOUND, RANGE, WIDEST, Batch, Best, block, blocks, exact, moments, named, ranged, ranked, read, whole

K, EVERY, SCALE = 10, 100, 1024.0
#: A round scans so many times the vectors of all rounds before it.
GROW = 8
#: Queries that meet a batch at once.
GROUP = 1024
#: Relative error allowed for in bounds.
ROUNDING = 1e-9


def rotation(vectors: DataFrame, dims: int) -> np.ndarray:
    """Right singular vectors, the largest singular value first; wider vectors than ``WIDEST`` keep their axes."""
    if not dims or dims > WIDEST:
        return np.eye(dims)
    sums = moments(vectors, dims)
    if not np.isfinite(sums).all():
        return np.eye(dims)
    return np.linalg.eigh(sums)[1][:, ::-1]


def _searcher(given, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Batch
        queries, least, axes = given.value
        dims = queries.whole.shape[1]
        steps = sorted({dims // 2, dims * 3 // 4, dims} - {0})
        best = Best(least, k)
        with np.errstate(over="ignore", invalid="ignore"):
            turned = queries.whole @ axes
            for batch in batches:
                if batch.num_rows:
                    x = read(batch, dims)
                    for at in range(0, len(queries.row), GROUP):
                        met(queries, turned, slice(at, at + GROUP), x, x.whole @ axes, steps, best)
        yield from best.batches()

    return search


def met(queries: Batch, turned: np.ndarray, part: slice, x: Batch, x_turned: np.ndarray, steps: list[int], best: Best) -> None:
    """Offers what the bounds leave of a group of queries and a batch of vectors."""
    least, norm = best.reach[part], queries.norm[part]
    some = np.flatnonzero(~(norm * x.norm.max() * (1 + ROUNDING) < least))  # the others' Cauchy-Schwarz bound is too low
    if not len(some):
        return
    who = some + part.start
    q, norm, least = turned[who], norm[some], least[some]
    error = ROUNDING * np.outer(norm, x.norm)
    sums, before, mask = np.zeros((len(who), len(x.row))), 0, np.ones((len(who), len(x.row)), bool)
    for step in steps:
        sums += q[:, before:step] @ x_turned[:, before:step].T
        before = step
        if step < q.shape[1] and not np.isfinite(least).all():
            continue  # no threshold yet: this batch's own k-th best will be one
        if step == q.shape[1] and len(x.row) > best.k + 1:
            # the batch itself has k others of at least this score
            least = np.maximum(least, np.minimum(2.0**62, np.partition(sums, len(x.row) - best.k - 1, axis=1)[:, -best.k - 1] - error.max(axis=1)))
        rest = np.outer(np.linalg.norm(q[:, step:], axis=1), np.linalg.norm(x_turned[:, step:], axis=1))
        mask = ~(sums + rest + error < least[:, None])
        if not mask.any():
            return
    i, j = np.nonzero(mask & (queries.row[who][:, None] != x.row))
    best.offer(who[i], exact(queries.whole, x.whole, queries.norm, x.norm, who[i], j), x, j)


def searched(vectors: DataFrame, parts: list[tuple[int, int, float]], queries: Batch, axes: np.ndarray, k: int) -> DataFrame:
    """key (the query's place in the block), score, id, row, rank: round by round from the longest vectors down."""
    spark = vectors.sparkSession
    least, found, first, seen = np.full(len(queries.row), -np.inf), None, 0, 0
    while first < len(parts):
        last, size = first, 0
        while last < len(parts) and (last == first or size + parts[last][1] <= max(RANGE, (GROW - 1) * seen)):
            size += parts[last][1]
            last += 1
        if (queries.norm * parts[first][2] * (1 + ROUNDING) < np.minimum(least, 2.0**62)).all():
            break  # no shorter vector can reach any threshold
        given = spark.sparkContext.broadcast((queries, least, axes))
        new = vectors.where(F.col("part").between(parts[first][0], parts[last - 1][0])).mapInArrow(_searcher(given, k), FOUND)
        found = stored(ranked(new if found is None else new.unionByName(found.drop("rank")), k), "round")
        for key, score in found.where(F.col("rank") == k).select("key", "score").collect():
            least[key] = score
        first, seen = last, seen + size
    return found


def top_k(rows: DataFrame, asks: Callable[[Column], Column], id_column: str = "vec_id", vector_column: str = "embedding", k: int = K, scale: float = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows, by whole inner product, of each row whose id ``asks``."""
    spark = rows.sparkSession
    own = rows.select(named(rows, id_column).alias("id"), F.lit(None).alias("label"), named(rows, vector_column).alias("vector"))
    with scratch(spark) as keep:
        plain = stored(whole(own, scale), "whole")
        n, width = plain.agg(F.count("*"), F.coalesce(F.max(F.length("vector")), F.lit(0))).first()
        dims = width // 8
        vectors = stored(ranged(plain, n), "ranges")
        parts = sorted(tuple(r) for r in vectors.groupBy("part").agg(F.count("*"), F.max("norm")).collect())
        axes = rotation(vectors, dims)
        asking = vectors.where(asks(F.col("id")))
        done = []
        for rows_asking in blocks(asking, asking.count(), dims):
            queries = block(rows_asking, dims)
            if len(queries.row):
                found = searched(vectors, parts, queries, axes, k)
                ids = F.broadcast(spark.createDataFrame(list(enumerate(queries.id.tolist())), "key long, query_id long"))
                done.append(keep(stored(found.join(ids, "key").select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score"), "nearest")))
    if not done:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return spark.read.schema(done[0].schema).parquet(*(x._folder for x in done))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(session(spark), sf_dir, "embeddings"), lambda id_: id_ % EVERY == 0)


SQL = f"""
WITH given AS (SELECT vec_id, embedding, row_number() OVER () AS r FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
own AS (SELECT vec_id, r, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM given),
scored AS (SELECT q.r AS q, q.vec_id AS query_id, o.vec_id, o.r, CAST(list_inner_product(q.v, o.v) AS BIGINT) AS score
           FROM own q JOIN own o ON q.vec_id % {EVERY} = 0 AND q.r <> o.r),
ranks AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id NULLS LAST, r) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranks WHERE rank <= {K}
"""
