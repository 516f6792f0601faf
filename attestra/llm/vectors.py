"""What the searches over vectors share: whole-number vectors in ranges of norm, blocks of queries, exact scores, first k.

Vectors are stored once: scaled and floored as doubles that hold whole numbers, with their norm, sorted by descending
norm in ranges (``part``; 0 holds the longest). Queries are dealt by hash into blocks of bounded bytes; a block goes to
all tasks, which scan the ranges and give the first k for each query. Vectors of different lengths are compared as if
the shorter one ended in zeros.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a range at least, and ranges at most.
RANGE, RANGES = 8192, 10_000
#: Rows and bytes of a block of queries at most.
BLOCK, BLOCK_BYTES = 8192, 1 << 25
#: Wider vectors are neither rotated nor reordered by statistics, whose table has a row for each pair of dimensions.
WIDEST = 1024
#: Components beyond it count as it.
LARGEST = 1e300
#: Pairs scored at once.
PAIRS = 20_000
VECTOR = "row long, id long, label long, vector binary, norm double"
FOUND = "key long, score long, id long, row long"
ENTRY = np.dtype([("key", "i8"), ("score", "i8"), ("absent", "?"), ("id", "i8"), ("row", "i8")])


def _whole(scale: float):
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component is NaN
            size = np.zeros(len(lists) + 1, np.int64)
            np.cumsum(lists.value_lengths().fill_null(0).to_numpy(), out=size[1:])
            bad = np.zeros(len(flat) + 1, np.int64)
            np.cumsum(~np.isfinite(flat), out=bad[1:])
            fit = (bad[size[1:]] == bad[size[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.clip(np.floor(flat * scale), -LARGEST, LARGEST)
                norms = [float(np.sqrt(np.square(flat[i:j]).sum())) for i, j in zip(size[:-1], size[1:])]
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(size * 8), pa.py_buffer(flat.tobytes())]).cast(pa.binary())
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), data, pa.array(norms, pa.float64())], ["row", "id", "label", "vector", "norm"])
            yield out.filter(pa.array(fit))

    return whole


def named(rows: DataFrame, name: str) -> Column:
    """The column of that very name, dots and all."""
    return rows["`" + name.replace("`", "``") + "`"]


def whole(rows: DataFrame, scale: float) -> DataFrame:
    """``rows`` (id, label, vector) with whole-number vectors; those that hold null or non-finite components are left out."""
    own = rows.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    return own.mapInArrow(_whole(scale), VECTOR)


def ranged(vectors: DataFrame, n: int) -> DataFrame:
    """In ranges of descending norm; equal norms are dealt by row, so no range is hot."""
    ranges = min(RANGES, max(1, -(-n // RANGE)))
    tie = F.xxhash64("row")
    return vectors.repartitionByRange(ranges, F.desc("norm"), tie).sortWithinPartitions(F.desc("norm"), tie).withColumn("part", F.spark_partition_id())


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of doubles, ended with zeros."""
    data, at = column.buffers()[2], np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.float64, count=at[-1] // 8) if data is not None and at[-1] else np.zeros(0)
    at = at // 8
    out = np.zeros((len(column), dims))
    out[np.arange(dims) < np.diff(at)[:, None]] = flat[at[0] : at[-1]]
    return out


@dataclass
class Batch:
    """Some vectors: rows, ids (absent: null ones), labels, whole numbers, norms."""

    row: np.ndarray
    id: np.ndarray
    absent: np.ndarray
    label: np.ndarray
    whole: np.ndarray
    norm: np.ndarray


def read(batch: pa.RecordBatch, dims: int) -> Batch:
    row, id_, label, vector, norm = (batch.column(c) for c in ("row", "id", "label", "vector", "norm"))
    return Batch(row.to_numpy(), id_.fill_null(0).to_numpy(), id_.is_null().to_numpy(zero_copy_only=False), label.fill_null(-1).to_numpy(), matrix(vector, dims), norm.to_numpy())


def block(rows: DataFrame, dims: int) -> Batch:
    """A block of queries on the driver; its size is bounded by ``blocks``."""
    found = rows.select("row", "id", "label", "vector", "norm").orderBy("row").toArrow().combine_chunks()
    whole_batch = found.to_batches()[0] if found.num_rows else pa.RecordBatch.from_arrays([pa.array([], f.type) for f in found.schema], schema=found.schema)
    return read(whole_batch, dims)


def blocks(queries: DataFrame, n: int, dims: int) -> list[DataFrame]:
    """The queries in blocks of about ``BLOCK`` rows and ``BLOCK_BYTES``, dealt by a hash of the row."""
    many = -(-n // max(1, min(BLOCK, BLOCK_BYTES // (8 * max(dims, 1)))))
    return [queries.where(F.pmod(F.xxhash64("row"), F.lit(many)) == i) for i in range(many)]


def exact(one: np.ndarray, two: np.ndarray, norm_one: np.ndarray, norm_two: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whole inner products of the pairs (i, j), held inside a long. No sum of doubles below 2**53 is rounded; larger ones are summed as Python's whole numbers."""
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), PAIRS):
        a, b = i[at : at + PAIRS], j[at : at + PAIRS]
        with np.errstate(over="ignore", invalid="ignore"):
            large = ~(norm_one[a] * norm_two[b] < 2.0**52)
            sums = np.einsum("ij,ij->i", one[a], two[b])
        out[at : at + PAIRS] = np.where(large, 0, sums).astype(np.int64)
        for k in np.flatnonzero(large):
            total = sum(int(x) * int(y) for x, y in zip(one[a[k]], two[b[k]]))
            out[at + k] = max(min(total, 2**63 - 1), 1 - 2**63)
    return out


def first_k(found: np.ndarray, k: int) -> np.ndarray:
    """Of each key the first k: highest score, then smallest id (null last), then row."""
    found = found[np.lexsort((found["row"], found["id"], found["absent"], -found["score"], found["key"]))]
    starts = np.flatnonzero(np.diff(found["key"], prepend=-1))
    rank = np.arange(len(found)) - np.repeat(starts, np.diff(np.append(starts, len(found))))
    return found[rank < k]


class Best:
    """The first k per key so far, and the score that each key's next ones must reach."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k, self.found, self.waiting, self.n = least.astype(np.float64), k, np.zeros(0, ENTRY), [], 0

    @property
    def reach(self) -> np.ndarray:
        """What a key's next scores must reach, as a bound on scores before they are held inside a long: none where ``least`` is near an end."""
        return np.where(self.least <= -(2.0**62), -np.inf, np.minimum(self.least, 2.0**62))

    def offer(self, key: np.ndarray, score: np.ndarray, of: Batch, at: np.ndarray) -> None:
        good = score >= self.least[key]
        new = np.zeros(int(good.sum()), ENTRY)
        at = at[good]
        new["key"], new["score"], new["absent"], new["id"], new["row"] = key[good], score[good], of.absent[at], of.id[at], of.row[at]
        self.waiting.append(new)
        self.n += len(new)
        if self.n > max(len(self.found), 4 * PAIRS):
            self.settle()

    def settle(self) -> np.ndarray:
        self.found = first_k(np.concatenate([self.found, *self.waiting]), self.k)
        self.waiting, self.n = [], 0
        starts = np.flatnonzero(np.diff(self.found["key"], prepend=-1))
        full = np.diff(np.append(starts, len(self.found))) == self.k
        last = self.found[starts[full] + self.k - 1]
        self.least[last["key"]] = np.maximum(self.least[last["key"]], last["score"])
        return self.found

    def batches(self) -> Iterator[pa.RecordBatch]:
        found = self.settle()
        yield pa.RecordBatch.from_arrays([pa.array(found["key"]), pa.array(found["score"]), pa.array(found["id"], mask=found["absent"]), pa.array(found["row"])], ["key", "score", "id", "row"])


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The first k per key of what the tasks gave (at most k each), with their rank."""
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _products(dims: int):
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            x = matrix(batch.column(0), dims)
            with np.errstate(over="ignore", invalid="ignore"):
                total += x.T @ x
        i, j = np.triu_indices(dims)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "x"])

    return products


def moments(vectors: DataFrame, dims: int) -> np.ndarray:
    """The sums of x_i * x_j over all vectors, as a matrix; dims are at most ``WIDEST``."""
    sums = vectors.select("vector").mapInArrow(_products(dims), "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros((dims, dims))
    out[sums.i, sums.j] = out[sums.j, sums.i] = sums.x
    return out
