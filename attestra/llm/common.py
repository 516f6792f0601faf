"""Helpers shared by the training-data operators.

Tables that cut lineage are written to the folder named by ``spark.checkpoint.dir``
(shared by all executors), so a lost executor costs a re-read and no recomputation.
Text work in tasks is done on Arrow buffers with numpy: one pass over the bytes of
a slice of whole documents, never a Python loop per character.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a longer document is a step of its own.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch; whole texts travel in it, so it is small.
BATCH_ROWS = 1000
#: Sides of joins are broadcast only below this many measured rows, else shuffled.
BROADCAST_ROWS = 50_000

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Keys that hold over this share of all rows are attached by broadcast: there are fewer than 1 / HOT_SHARE of them.
HOT_SHARE = 1e-3
_FACTORS = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93], np.uint64)
#: Folders of the tables written in the innermost open block of this thread; none is open at first.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def session(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, as rows hold whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset (tests on one machine) a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = spark.sparkContext._attestra_dir = getattr(spark.sparkContext, "_attestra_dir", None) or tempfile.mkdtemp(prefix="spark-")
    return at.rstrip("/")


def stored(df: DataFrame, name: str, listed: bool = True) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends here. listed: whether an open ``scratch`` or ``left_by`` of this thread knows of it."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/attestra/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    open_block = _written.get()
    if listed and open_block is not None:
        open_block.append(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._folder = at
    return out


def deleted(spark: SparkSession, folders: list[str]) -> None:
    """Removes tables that nothing reads any more."""
    for at in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def left_by() -> Iterator[list[str]]:
    """A list that holds, after the block, the folders of the tables that were stored in it and are still there.

    Blocks belong to the thread that opened them, so queries in several threads never see each other's tables."""
    out: list[str] = []
    mark = _written.set(out)
    try:
        yield out
    finally:
        _written.reset(mark)
        outer = _written.get()
        if outer is not None:
            outer.extend(out)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored inside the block are deleted at its end, but for those that are passed to what it yields."""
    kept = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._folder)
        return df

    with left_by() as folders:
        try:
            yield keep
        finally:
            gone = [x for x in folders if x not in kept]
            deleted(spark, gone)
            folders[:] = [x for x in folders if x in kept]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column's name as one name, whatever dots and marks it holds."""
    return "`" + name.replace("`", "``") + "`"


def columns_of(df: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c in df.columns]


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct."""
    return F.struct(*columns_of(df))


def attached(rows: DataFrame, unique: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """``rows`` joined to the one row of ``unique`` per key, keys without such a row left out.

    ``weight``: column of ``unique`` with the number of rows that have the key, of ``total``. Hot
    keys are fewer than 1 / HOT_SHARE, so they go to all tasks; no shuffle partition gets a hot group."""
    limit = total * HOT_SHARE
    hot, cold = unique.where(F.col(weight) > limit).drop(weight), unique.where(F.col(weight) <= limit).drop(weight)
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of at most ``most`` bytes together, or one longer document."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; scrambles all bits, one to one."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def digest(data: bytes) -> bytes:
    """128 bits of BLAKE2."""
    return hashlib.blake2b(data, digest_size=16).digest()


def pieces_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.DictionaryArray:
    """The byte ranges start..end (ascending, apart, not empty), equal ones (byte by byte) with one code."""
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    flat = data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).dictionary_encode()


def codes_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A whole number per byte range; equal for equal ranges only."""
    return pieces_of(data, start, end).indices.to_numpy(zero_copy_only=False).astype(np.int64)


def digests_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit digests of byte ranges as (n, 2) of 64 bits; each distinct range is hashed once."""
    coded = pieces_of(data, start, end)
    table = np.frombuffer(b"".join(digest(x) for x in coded.dictionary.to_pylist()), np.uint64).reshape(-1, 2)
    return table[coded.indices.to_numpy(zero_copy_only=False)]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: start, end, document of each, and the mask of word bytes."""
    inside = ~SPACE[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    before[edges] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[edges[1:] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1, inside


def per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (one per byte) for each document."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def chained(words: np.ndarray) -> np.ndarray:
    """(m, 2): one 128-bit digest for each row of (m, n, 2) digests, in order of the n."""
    h = words[:, 0]
    for k in range(1, words.shape[1]):
        h = mix(h * _FACTORS + words[:, k])
    return h


def ngrams(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Digest, (m, 2), and first word's index of each run of n words within a document."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros((0, 2), np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(doc[:m] == doc[n - 1 :])
    h = words[first]
    for k in range(1, n):
        h = mix(h * _FACTORS + words[first + k])
    return h, first
