"""Best-fit packing in bulk-synchronous rounds.

Documents become token ids plus a closing id 0; longer ones are cut into pieces of
the capacity, the first piece being the shorter one. Lengths and gaps are whole
numbers up to the capacity, so range-sorted documents and gaps are runs of equal
values: a run is (length, how many), and a document is (length, rank in its run).
The ranks are dealt out in parallel (salted sub-runs, then offsets), so a length that
a third of all pieces share isn't one task's work.

The state of the rounds is one table of runs in the shared folder: documents that have no
place yet (length, first rank, how many) and gaps (what is left of a sequence, first
sequence, how many). A round range-sorts both by size and sweeps each range in a task of
its own: documents from the longest down, each run to the successor of its length among
the gaps, which is the best fit. Where a run of documents meets fewer gaps, the lower
ranks win them and the rest go on to the next larger gap. Gaps that took a document go
back to what is left of them. What a range couldn't match is swept again in ranges
``WIDEN`` times as wide, up to all sizes. Documents that no gap took then open as many
sequences as their tokens fill at least, and the next round starts, until none are left.
A round's table has a row for each length and gap, and for each split of them: it grows with
the capacity and not with the documents, so that the widest sweep is one small task. The
placements (length, ranks from..to -> sequences from.., offset) of all rounds are bounded
alike and go to all tasks, which place their own pieces by binary search.

Defined results: null and empty texts are one piece of length 1 (the closing id).
Repeated rows are packed each. Further columns are ignored; an empty table gives an
empty result. Ids equal those of the tokenizer library: the same vocabulary's ranks are
used for speed where the text has common characters and no special mark, the library
itself elsewhere (tests compare the two).
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, session, stored, table
from .tokens import _here, _texts, library, rules, vocabulary_path

CAPACITY = 2048
#: Sub-runs of a run of equal lengths.
SALTS = 64
#: A round starts with this many ranges of sizes; each further sweep takes ranges so many times as wide.
RANGES = 16
WIDEN = 16
#: Runs: documents without a place, gaps, and documents that got one.
DOC, GAP, PUT = 0, 1, 2
RUNS = "kind int, size long, first long, n long, sequence long, offset long"
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _ranks(path: str):
    """An encoder over the rank file of the same vocabulary, once per process."""
    if ("ranks", path) not in _here:
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        _here["ranks", path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _here["ranks", path]


def encoder(path: str):
    """text -> its ids as the library gives them, as an array of 32-bit numbers."""
    ranks_path = path.removesuffix(".json") + ".tiktoken"
    fast, (_, mark, odd) = _ranks(ranks_path), rules()

    def ids(text: str) -> np.ndarray:
        if mark in text or odd.search(text):
            return np.array(library(path).encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=())

    return ids


def _pieces(path: str, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(path)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            rows = []
            for first, texts in _texts(batch, 1):
                for doc_id, text in zip(doc_ids[first : first + len(texts)], texts):
                    own = np.append(ids(text), np.uint32(0)).astype("<u4")
                    n, start = len(own), 0
                    for k in range(-(-n // capacity)):
                        end = start + (n % capacity or capacity if k == 0 else capacity)
                        rows.append((doc_id, k, start, end - start, zlib.crc32(own[start:end])))
                        start = end
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_pieces(path or vocabulary_path(), capacity), PIECE)


def swept(runs: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """One successor sweep: runs of documents and gaps (and what was placed before, unchanged) to placements, documents and gaps."""
    gaps: dict[int, list[tuple[int, int]]] = {}
    for size, first, n in runs.loc[runs["kind"] == GAP, ["size", "first", "n"]].sort_values(["size", "first"]).itertuples(index=False):
        gaps.setdefault(size, []).append((first, n))
    sizes, out = sorted(gaps), []
    for length, rank, n in runs.loc[runs["kind"] == DOC, ["size", "first", "n"]].sort_values(["size", "first"], ascending=[False, True]).itertuples(index=False):
        while n and (k := bisect_left(sizes, length)) < len(sizes):
            gap = sizes[k]
            first, free = gaps[gap].pop()
            m = min(n, free)
            out.append((PUT, length, rank, m, first, capacity - gap))
            rank, n = rank + m, n - m
            if m < free:
                gaps[gap].append((first + m, free - m))
            elif not gaps[gap]:
                del gaps[gap], sizes[k]
            if gap > length:
                if gap - length not in gaps:
                    insort(sizes, gap - length)
                gaps.setdefault(gap - length, []).append((first, m))
        if n:
            out.append((DOC, length, rank, n, 0, 0))
    out += [(GAP, size, first, n, 0, 0) for size, own in gaps.items() for first, n in own]
    return pd.concat([runs[runs["kind"] == PUT], pd.DataFrame(out, columns=runs.columns)])


def matched(runs: DataFrame, capacity: int) -> DataFrame:
    """A round: sweeps over ranges of sizes, each wider than the one before."""
    width = -(-capacity // RANGES)
    while True:
        span = F.floor((F.col("size") - 1) / width)
        runs = runs.groupBy(span).applyInPandas(lambda x: swept(x, capacity), RUNS)
        if width >= capacity:
            return runs
        width *= WIDEN


def rounds(counts: DataFrame, capacity: int) -> np.ndarray:
    """The placements (length, first rank, rank after the last, first sequence, offset) of ``counts`` (length, count), in their order."""
    spark, zero = counts.sparkSession, F.lit(0).cast("long")
    waiting = counts.select(F.lit(DOC).alias("kind"), F.col("length").alias("size"), zero.alias("first"), F.col("count").alias("n"), zero.alias("sequence"), zero.alias("offset"))
    sequences, placed = 0, []
    with scratch(spark):
        runs = stored(waiting, "round-0")
        while tokens := runs.where(F.col("kind") == DOC).agg(F.sum(F.col("size") * F.col("n"))).first()[0]:
            opened = -(-tokens // capacity)
            new = spark.createDataFrame([(GAP, capacity, sequences, opened, 0, 0)], RUNS)
            sequences += opened
            runs = stored(matched(runs.where(F.col("kind") != PUT).unionByName(new), capacity), f"round-{sequences}")
            placed.append(runs.where(F.col("kind") == PUT).select("size", "first", F.col("first") + F.col("n"), "sequence", "offset").toPandas().to_numpy(np.int64))
    plan = np.concatenate(placed) if placed else np.zeros((0, 5), np.int64)
    return plan[np.lexsort(plan.T[1::-1])]


def ranked(items: DataFrame) -> DataFrame:
    """``items`` with their rank among those of equal length, from 0."""
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    counts = salted.groupBy("length", "salt").count()
    before = counts.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return salted.withColumn("within", within).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within")).drop("salt", "within", "before")


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    plan = rounds(items.groupBy("length").count(), capacity)
    sent = items.sparkSession.sparkContext.broadcast(plan)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        length, first, _, sequence, offset = sent.value.T
        keys = length * (1 << 40) + first
        for x in frames:
            k = np.searchsorted(keys, x["length"].to_numpy() * (1 << 40) + x["rank"].to_numpy(), "right") - 1
            yield x.assign(sequence_id=sequence[k] + x["rank"].to_numpy() - first[k], offset=offset[k])[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return ranked(items).mapInPandas(place, PIECE + ", sequence_id long, offset long")


def best_fit(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(stored(pieces(docs, path, capacity), "pieces"), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(table(session(spark), sf_dir, "documents"))
