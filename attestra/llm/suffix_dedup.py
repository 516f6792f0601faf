"""Removal of long repeated byte strings by a distributed, common-prefix-aware suffix sort.

A byte goes if some 200-byte string that covers it also starts elsewhere. Sorting the
suffixes at every byte of the corpus isn't needed for that:

1. Every 200-byte window has an anchor: the 64-byte string in it with the least hash (the
   leftmost of equals). Equal windows have equal anchors at equal distance, so only
   suffixes that start at anchors are sorted (about one byte in seventy), and of these
   only such as start with a 64-byte string that occurs twice. Consecutive windows with
   one anchor form a run of 200 to 336 bytes.
2. Runs are counted by anchor with map-side combining. Of the anchors that occur twice each
   distinct run (128-bit digest of its bytes) is sorted once, from one place where it
   stands, however often it occurs. Hot anchors are attached to their places by broadcast.
3. Each task sorts its anchored suffixes, front-codes them (common prefix with the one
   before, rest) and sends them to the range of their anchor. There the sorted pieces are
   merged by a loser tree that keeps for each piece the common prefix with the last
   winner: longer prefix wins unread, and only bytes beyond equal prefixes are compared.
   The merge yields the suffixes in order with the common prefixes of neighbours.
4. A window that starts d bytes before its anchor repeats if another suffix shares
   200 - d bytes (a stretch of the order whose common prefixes are that long) and has the
   same d bytes on the left (a stretch of the order of what stands before the anchor, read
   backwards). Both are found by comparing bytes; no hash decides.
5. An anchor with over ``GROUP`` distinct runs (one passage in very many surroundings) would
   be one task's work. Its windows are counted by a grouping over all tasks, keyed by the
   128-bit digest of the window.

Defined results: null and empty texts have no bytes, nothing is removed, and the digest is
that of no bytes. Texts under 200 bytes stay whole. Rows that repeat doc_id and text are
documents of their own (each starts the string elsewhere). Further columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, attached, deleted, digest, mix, scratch, session, slices, stored, table, utf8

WINDOW, ANCHOR = 200, 64
#: Distinct runs of an anchor that one task takes; runs that a range of anchors gets on average.
GROUP, RANGE = 20_000, 4_000
#: Runs of an anchor that are compared pair by pair; of more, the left sides are sorted first.
FEW = 40
#: Runs in a row of the table of runs; a text with more has several rows. Bytes of a text whose spans are united together.
ROW_RUNS, ROW_BYTES = 65_536, 65_536
_EMPTY = hashlib.sha256(b"").hexdigest()
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def gram_keys(data: np.ndarray) -> np.ndarray:
    """Hashes of the ANCHOR-byte strings at every place. They only choose anchors: that strings are equal never rests on them."""
    if not _powers or len(_powers[0]) <= len(data):
        for base in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
            p = np.full(max(len(data), SLICE_BYTES) + 1, base, np.uint64)
            p[0] = 1
            _powers.insert(0, np.multiply.accumulate(p))
        del _powers[2:]
    down, up = _powers
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    n = len(data) - ANCHOR + 1
    return mix((sums[ANCHOR:] - sums[:n]) * down[:n])


def runs(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor, in order: document, start in it, length, anchor's place in the run, hash of the anchor, digest of the run."""
    w = WINDOW - ANCHOR + 1
    if len(data) < WINDOW:
        return {k: np.zeros(0, np.int64) for k in ("doc", "start", "length", "at", "anchor")} | {"content": []}
    grams = gram_keys(data)
    # the upper half of the hash, then the place: the choice doesn't depend on what else is in the slice (texts under 4 GB)
    low = np.uint64((1 << 32) - 1)
    keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    rows = np.concatenate([keys, np.full(-len(keys) % w, np.uint64((1 << 64) - 1))]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    s = np.arange(len(keys) - w + 1)
    anchor = (np.minimum(behind[s], ahead[s + w - 1]) & low).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[s]
    inside = s + WINDOW <= offsets[doc + 1]
    s, anchor, doc = s[inside], anchor[inside], doc[inside]
    new = np.ones(len(s), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    last = last[: len(first)]
    start, end, text = s[first], s[last] + WINDOW, data.tobytes()
    content = [digest(text[x:y]) for x, y in zip(start.tolist(), end.tolist())]
    return {"doc": doc[first], "start": start - offsets[doc[first]], "length": end - start, "at": anchor[first] - start, "anchor": grams[anchor[first]].view(np.int64), "content": content}


FIELDS = {"anchor": pa.int64(), "content": pa.binary(), "start": pa.int32(), "length": pa.int16(), "at": pa.int16()}


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text with its first runs; further rows, without ``sha``, with the others."""
    np.seterr(over="ignore")
    for batch in batches:
        data, at = utf8(batch.column(2))
        for a, b in slices(at):
            own, off = data[at[a] : at[b]], at[a : b + 1] - at[a]
            r, text = runs(own, off), own.tobytes()
            cuts = np.searchsorted(r["doc"], np.arange(b - a + 1))
            first = [c for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()) for c in range(x, max(y, x + 1), ROW_RUNS)]
            doc = np.repeat(np.arange(b - a), np.maximum(1, -(-np.diff(cuts) // ROW_RUNS)))
            heads = np.append(True, doc[1:] != doc[:-1])
            bounds = pa.array(np.append(np.array(first, np.int64), cuts[-1]), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, pa.array(r[k] if k == "content" else r[k].astype(t.to_pandas_dtype()), t)) for k, t in FIELDS.items()]
            shas = [hashlib.sha256(text[off[d] : off[d + 1]]).hexdigest() if head else None for d, head in zip(doc.tolist(), heads.tolist())]
            places = pa.array(doc + a)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(places), batch.column(1).take(places), pa.array(np.diff(off)[doc], pa.int64()), pa.array(shas, pa.string()), *lists], ["doc_id", "key", "n_bytes", "sha", *FIELDS])


def common_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix, known to be ``at`` at least."""
    end = min(len(a), len(b))
    step = 16
    while at < end:
        stop = min(end, at + step)
        if a[at:stop] == b[at:stop]:
            at, step = stop, step * 2
        elif stop - at == 1:
            return at
        else:
            step = max(1, (stop - at) // 2)
    return end


def front_code(strings: list[bytes]) -> bytes:
    """Sorted strings as (common prefix with the one before, rest)."""
    out, before = [], b""
    for s in strings:
        n = common_prefix(before, s, 0)
        out.append(struct.pack("<HH", n, len(s) - n))
        out.append(s[n:])
        before = s
    return b"".join(out)


def front_decode(piece: bytes) -> Iterator[tuple[bytes, int]]:
    """The strings with their common prefixes with the one before."""
    at, before = 0, b""
    while at < len(piece):
        n, rest = struct.unpack_from("<HH", piece, at)
        before = before[:n] + piece[at + 4 : at + 4 + rest]
        at += 4 + rest
        yield before, n


def merge(pieces: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[bytes, int, int, int]]:
    """(string, common prefix with the string before, piece, place in it) in order, by a loser tree over common prefixes.

    Every contender's prefix is that with the last winner; the inner nodes hold losers. A
    contender with the longer prefix is the smaller one. Equal prefixes are compared from
    there on, and the loser's prefix becomes that with its winner."""
    size = 1
    while size < max(1, len(pieces)):
        size *= 2
    string: list[bytes | None] = [None] * size
    prefix, place = [0] * size, [-1] * size

    def advance(k: int) -> None:
        got = next(pieces[k], None) if k < len(pieces) else None
        string[k], prefix[k] = got if got else (None, 0)
        place[k] += 1

    def smaller(i: int, j: int) -> tuple[int, int]:
        """(winner, loser)."""
        a, b = string[i], string[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        if prefix[i] != prefix[j]:
            return (i, j) if prefix[i] > prefix[j] else (j, i)
        n = common_prefix(a, b, prefix[i])
        if n == len(a) or n < len(b) and a[n] < b[n]:
            prefix[j] = n
            return i, j
        prefix[i] = n
        return j, i

    for k in range(size):
        advance(k)
    losers = [0] * size
    up = [0] * (2 * size)
    up[size:] = range(size)
    for node in range(size - 1, 0, -1):
        up[node], losers[node] = smaller(up[2 * node], up[2 * node + 1])
    best = up[1] if size > 1 else 0
    while string[best] is not None:
        yield string[best], prefix[best], best, place[best]
        advance(best)
        node = (best + size) // 2
        while node:
            best, losers[node] = smaller(best, losers[node])
            node //= 2


def repeated(shared: list[int], left: list[bytes], at: list[int], length: list[int], copies: list[int]) -> list[np.ndarray]:
    """Which windows of each run repeat; for the runs of one anchor in suffix order.

    shared: common prefix of each suffix with the one before; left: what stands before the anchor, read backwards."""
    out = [np.full(m - WINDOW + 1, k > 1) for m, k in zip(length, copies)]
    n = len(left)
    if n <= FEW:
        for i in range(n):
            r = 1 << 30
            for j in range(i + 1, n):
                r = min(r, shared[j])
                if r + at[i] < WINDOW:  # no window of this run reaches beyond, nor with any later suffix
                    break
                high = min(common_prefix(left[i], left[j], 0), at[i], at[j])
                low = max(WINDOW - r, at[i] - length[i] + WINDOW, at[j] - length[j] + WINDOW)
                if low <= high:
                    out[i][at[i] - high : at[i] - low + 1] = True
                    out[j][at[j] - high : at[j] - low + 1] = True
        return out
    order = sorted(range(n), key=left.__getitem__)
    near = np.array([0] + [common_prefix(left[i], left[j], 0) for i, j in zip(order, order[1:])])
    order = np.array(order)
    at_, low, cut = np.array(at), np.array(at) - np.array(length) + WINDOW, np.array(shared)
    side = np.zeros(n, np.int64)
    for d in range(int(low.min()), max(at) + 1):
        rows = np.flatnonzero((low <= d) & (d <= at_))
        if len(rows) > 1:
            side[order] = np.cumsum(near < d)
            key = side[rows] * (n + 1) + np.cumsum(cut < WINDOW - d)[rows]
            by = np.argsort(key, kind="stable")
            same = key[by][1:] == key[by][:-1]
            for i in rows[np.union1d(by[1:][same], by[:-1][same])].tolist():
                out[i][at[i] - d] = True
    return out


def stretches(flags: np.ndarray) -> tuple[list[int], list[int]]:
    """First and one after the last of each stretch of True."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()


PIECE = "range int, piece binary, left binary, anchors binary, contents binary, copies binary"


def _pieces(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def sent():
            rows.sort()
            by: dict[int, list[tuple]] = {}
            for r in rows:
                by.setdefault(struct.unpack(">Q", r[0][:8])[0] * ranges >> 64, []).append(r)
            for k, own in by.items():
                lefts = [r[1] for r in own]
                columns = [front_code([r[0] for r in own]), b"".join(struct.pack("<H", len(x)) + x for x in lefts), np.array([r[2] for r in own], np.int64).tobytes(), b"".join(r[3] for r in own), np.array([r[4] for r in own], np.int64).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *[pa.array([c], pa.binary()) for c in columns]], ["range", "piece", "left", "anchors", "contents", "copies"])
            rows.clear()

        for batch in batches:
            data, at = utf8(batch.column(0))
            text = data.tobytes()
            for x, own in zip(at[:-1].tolist(), batch.column(1).to_pylist()):
                for r in own:
                    s = x + r["start"]
                    a = s + r["at"]
                    rows.append((struct.pack(">Q", (r["anchor"] + (1 << 63)) & ((1 << 64) - 1)) + text[a : s + r["length"]], text[s:a], r["anchor"], r["content"], r["copies"]))
            if len(rows) > 200_000:
                yield from sent()
        if rows:
            yield from sent()

    return run


FOUND = "anchor long, content binary, froms array<int>, tos array<int>"


def _merged(key, pieces: pd.DataFrame) -> pd.DataFrame:
    np.seterr(over="ignore")
    side = []
    for p in pieces.itertuples():
        lefts, at = [], 0
        while at < len(p.left):
            n = struct.unpack_from("<H", p.left, at)[0]
            lefts.append(p.left[at + 2 : at + 2 + n])
            at += 2 + n
        side.append((lefts, np.frombuffer(p.anchors, np.int64), p.contents, np.frombuffer(p.copies, np.int64)))
    out, group = [], []

    def close():
        if len(group) > 1 or group and group[0][5] > 1:
            at = [len(g[2]) for g in group]
            flags = repeated([0] + [g[1] - 8 for g in group[1:]], [g[2][::-1] for g in group], at, [a + len(g[0]) - 8 for a, g in zip(at, group)], [g[5] for g in group])
            for g, f in zip(group, flags):
                if f.any():
                    froms, tos = stretches(f)
                    out.append((g[3], g[4], froms, [t + WINDOW - 1 for t in tos]))
        group.clear()

    for s, n, k, place in merge([front_decode(p) for p in pieces["piece"]]):
        lefts, anchors, contents, copies = side[k]
        if group and anchors[place] != group[-1][3]:
            close()
        group.append((s, n, lefts[place], int(anchors[place]), contents[16 * place : 16 * place + 16], int(copies[place])))
    close()
    return pd.DataFrame(out, columns=["anchor", "content", "froms", "tos"])


WINDOWS = "anchor long, content binary, copies long, j int, bytes binary"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of every run of the anchors with very many runs: the run, the distance, the digest of the window."""
    for batch in batches:
        data, at = utf8(batch.column(0))
        text = data.tobytes()
        for x, own in zip(at[:-1].tolist(), batch.column(1).to_pylist()):
            for r in own:
                s = x + r["start"]
                n = r["length"] - WINDOW + 1
                yield pa.RecordBatch.from_arrays([pa.array([r["anchor"]] * n, pa.int64()), pa.array([r["content"]] * n, pa.binary()), pa.array([r["copies"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([digest(text[s + j : s + j + WINDOW]) for j in range(n)], pa.binary())], ["anchor", "content", "copies", "j", "bytes"])


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The union of each row's stretches."""
    for x in frames:
        rows = []
        for key, froms, tos in zip(x["key"], x["froms"], x["tos"]):
            order = np.argsort(froms, kind="stable")
            a, b = np.asarray(froms)[order], np.maximum.accumulate(np.asarray(tos)[order])
            new = np.ones(len(a), bool)
            new[1:] = a[1:] > b[:-1]
            first = np.flatnonzero(new)
            end = b[np.append(first[1:], len(a)) - 1]
            rows.append((key, int((end - a[first]).sum()), len(first), a[first].tolist(), end.tolist()))
        yield pd.DataFrame(rows, columns=["key", "n_removed", "n_spans", "froms", "tos"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8(batch.column(0))
        out = []
        for x, y, froms, tos in zip(at[:-1].tolist(), at[1:].tolist(), batch.column(5).to_pylist(), batch.column(6).to_pylist()):
            h, last = hashlib.sha256(), x
            for a, b in zip(froms, tos):
                h.update(data[last : x + a])
                last = x + b
            h.update(data[last:y])
            out.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(1, 5)], pa.array(out)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def spans(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows``: doc_id, key, text. The per-row table (doc_id, key, n_bytes, sha) and what to remove (key, n_removed, n_spans, froms, tos)."""
    spark = rows.sparkSession
    with scratch(spark) as keep:
        fields = "anchor array<long>, content array<binary>, start array<int>, length array<smallint>, at array<smallint>"
        anchored = stored(rows.mapInArrow(_anchored, f"doc_id long, key binary, n_bytes long, sha string, {fields}"), "anchored")
        places = anchored.select("key", F.inline(F.arrays_zip(*FIELDS)))
        total = int(anchored.agg(F.sum(F.size("anchor"))).first()[0] or 0)
        twice = stored(places.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "anchors")
        dups = stored(attached(places, twice, ["anchor"], "n", total), "repeats")
        report = keep(stored(anchored.where("sha is not null").select("doc_id", "key", "n_bytes", "sha"), "texts"))
        deleted(spark, [anchored._folder])
        distinct = dups.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("key", "start", "length", "at")).alias("r"))
        distinct = stored(distinct.select("anchor", "content", "copies", "r.*"), "distinct-runs")
        big = stored(distinct.groupBy("anchor").count().where(F.col("count") > GROUP).select("anchor"), "big-anchors")
        ranges = max(1, -(-distinct.count() // RANGE))
        at = lambda d: rows.join(d.groupBy("key").agg(F.collect_list(F.struct("start", "length", "at", "anchor", "content", "copies")).alias("own")), "key").select(F.coalesce("text", F.lit("")).alias("text"), "own")
        pieces = at(distinct.join(big, "anchor", "left_anti")).mapInArrow(_pieces(ranges), PIECE)
        found = stored(pieces.groupBy("range").applyInPandas(_merged, FOUND), "found")
        if not big.isEmpty():
            windows = stored(at(distinct.join(big, "anchor", "left_semi")).mapInArrow(_windows, WINDOWS), "windows")
            often = windows.groupBy("bytes").agg(F.sum("copies").alias("n")).where("n > 1").select("bytes")
            more = windows.join(often, "bytes").groupBy("anchor", "content").agg(F.collect_set("j").alias("froms"))
            found = found.unionByName(more.select("anchor", "content", "froms", F.transform("froms", lambda j: j + WINDOW).alias("tos")))
        # what repeats of a run goes wherever the run stands
        held = attached(dups.select("key", "start", "anchor", "content"), found.join(distinct.select("anchor", "content", "copies"), ["anchor", "content"]), ["anchor", "content"], "copies", total)
        gone = held.select("key", "start", F.inline(F.arrays_zip("froms", "tos"))).select("key", (F.col("start") + F.col("froms")).alias("a"), (F.col("start") + F.col("tos")).alias("b"))
        united = "key binary, n_removed long, n_spans long, froms array<int>, tos array<int>"
        lists = lambda df, *by: df.groupBy("key", *by).agg(F.collect_list(F.struct("a", "b")).alias("own")).select("key", F.col("own.a").alias("froms"), F.col("own.b").alias("tos")).mapInPandas(_joined, united)
        parts = lists(gone, F.floor(F.col("a") / ROW_BYTES)).select("key", F.inline(F.arrays_zip(F.col("froms").alias("a"), F.col("tos").alias("b"))))
        return report, keep(stored(lists(parts), "gone"))


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(" "), F.coalesce("text", F.lit("")))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), "text")
    texts, gone = spans(rows)
    short = texts.join(gone.select("key", "n_removed", "n_spans"), "key", "left")
    done = short.where("n_removed is null or n_removed = n_bytes").select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.when(F.col("n_removed").isNull(), F.col("sha")).otherwise(_EMPTY).alias("kept_sha256"))
    # only texts of which a part stays are read again
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    part = rows.join(gone, "key").withColumn("n_bytes", size).where("n_removed < n_bytes")
    cut = part.select(F.coalesce("text", F.lit("")).alias("text"), "doc_id", "n_bytes", "n_removed", "n_spans", "froms", "tos").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return done.unionByName(cut)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(session(spark), sf_dir, "documents"))
