"""Exact dedup by a minimal perfect hash over historical distinct digests.

1. Each row's text (null: empty) is lower-cased A-Z and hashed in the task that
   reads it; from here on only (doc_id, sha256) travels.
2. ``history`` is a table of digests with the winner's locator. Without one from
   earlier batches, the table's own repeated digests are its history: counted with
   map-side combining, so a digest that holds a third of all rows is one row per task.
3. The history is cut into blocks by digest prefix. Each block gets a minimal perfect
   hash (hash-and-displace: one pilot per small group of keys, found so that all keys
   land in distinct slots 0..n-1). Its slots hold the full 32-byte digest, the winner's
   doc_id and the number of copies.
4. Rows meet the block of their prefix. The slot's digest is compared byte by byte:
   members take the slot's winner; nonmembers are grouped separately by digest.
   Blocks with many rows are dealt in parts by the rows' place in the stored table, with
   one copy of the block per part, so that no task gets a whole hot group, with or
   without ids.

Defined results: null or empty texts are one group (the digest of no bytes). Rows
without doc_id can win only where no row of the group has one (keep_id is null
then). Rows that repeat doc_id and text count as copies; all rows of the winning
doc_id are ``kept`` in the report, and ``deduplicated`` returns one of them. An
empty table gives an empty result. Further columns are ignored by the report and
kept by ``deduplicated``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, LOWER, fresh, scratch, session, stored, table, utf8, whole_row

#: Keys of a block aimed at, and keys a pilot places together.
BLOCK_KEYS, GROUP_KEYS = 4096, 4
#: Rows of one salted part of a block.
PART_ROWS = 50_000


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8(batch.column(1))
        low = LOWER[data].tobytes()
        out = [hashlib.sha256(low[a:b]).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "digest"])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and sha256 of the normalised text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_digests, "doc_id long, digest binary")


def repeated(keys: DataFrame) -> DataFrame:
    """History of one table: digest, winner, copies, winner_rows of each digest that occurs twice or more."""
    best = keys.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return best.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.sum("n").alias("copies"), F.max_by("n", F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("winner_rows")).where("copies > 1")


def _slot(keys: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    """keys: (n, 2) uint64 words of digests."""
    group = (keys[:, 0] >> np.uint64(20)) % np.uint64(len(pilots))
    x = keys[:, 1] + pilots[group] * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return ((x >> np.uint64(24)) % np.uint64(n)).astype(np.int64)


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 4)[:, 1:3]


def build_block(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pilots of a minimal perfect hash over distinct digests, and each digest's slot."""
    n, keys = len(digests), _words(digests)
    pilots = np.zeros(max(1, -(-n // GROUP_KEYS)), np.uint64)
    group = ((keys[:, 0] >> np.uint64(20)) % np.uint64(len(pilots))).astype(np.int64)
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(len(pilots) + 1))
    taken = np.zeros(n, bool)
    for g in np.argsort(-np.diff(bounds), kind="stable"):
        mine = order[bounds[g] : bounds[g + 1]]
        if not len(mine):
            break
        tries, first = 256, 0
        while True:
            pilot = np.arange(first, first + tries, dtype=np.uint64)
            x = keys[mine, 1][None, :] + (pilot * np.uint64(0x9E3779B97F4A7C15))[:, None]
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
            slots = ((x >> np.uint64(24)) % np.uint64(n)).astype(np.int64)
            ok = ~taken[slots].any(axis=1)
            if len(mine) > 1:
                ok &= (np.diff(np.sort(slots, axis=1), axis=1) > 0).all(axis=1)
            if ok.any():
                k = int(ok.argmax())
                pilots[g] = pilot[k]
                taken[slots[k]] = True
                break
            first, tries = first + tries, min(tries * 4, 1 << 14)
    return pilots, _slot(keys, pilots, n)


def _blocks(key, group: pd.DataFrame) -> pd.DataFrame:
    pilots, slot = build_block(group["digest"].tolist())
    order = np.argsort(slot)
    winner = group["winner"]
    return pd.DataFrame({
        "block": [key[0]], "n": [len(group)], "pilots": [pilots.tobytes()], "digests": [b"".join(group["digest"].iloc[order])],
        "winners": [winner.fillna(0).astype("int64").to_numpy()[order].tobytes()], "known": [winner.notna().to_numpy()[order].tobytes()],
        "copies": [group["copies"].astype("int64").to_numpy()[order].tobytes()],
    })


BLOCK = "block long, n long, pilots binary, digests binary, winners binary, known binary, copies binary"


def _prefix(blocks: int):
    return (F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long") % F.lit(blocks)).alias("block")


def index(history: DataFrame, blocks: int) -> DataFrame:
    """One row per block: the pilots and the slots of its minimal perfect hash."""
    return history.select("digest", "winner", "copies", _prefix(blocks)).groupBy("block").applyInPandas(_blocks, BLOCK)


def _look_up(key, rows: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "digest": rows["digest"], "keep_id": pd.array([pd.NA] * len(rows), "Int64"), "group_size": pd.array([pd.NA] * len(rows), "Int64"), "member": False})
    if len(rows) and len(block):
        b, digests = block.iloc[0], rows["digest"].tolist()
        slot = _slot(_words(digests), np.frombuffer(b["pilots"], np.uint64), int(b["n"]))
        held = np.frombuffer(b["digests"], np.uint64).reshape(-1, 4)[slot]
        found = (held == np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 4)).all(axis=1)
        winner = pd.Series(np.frombuffer(b["winners"], np.int64)[slot], dtype="Int64").mask(~np.frombuffer(b["known"], bool)[slot])
        out["keep_id"] = winner.where(found).array
        out["group_size"] = pd.Series(np.frombuffer(b["copies"], np.int64)[slot], dtype="Int64").where(found).array
        out["member"] = found
    return out


def look_up(keys: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """Rows of ``keys`` (a stored table: its rows have fixed places) with the winner and copies of their digest; both null, and member false, where the history lacks it."""
    rows = keys.select("doc_id", "digest", _prefix(n_blocks))
    hot = rows.groupBy("block").count().select("block", F.ceil(F.col("count") / PART_ROWS).cast("int").alias("parts")).where("parts > 1")
    salted = rows.withColumn("place", F.monotonically_increasing_id()).join(hot, "block", "left").withColumn("part", F.pmod(F.xxhash64("place"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts", "place")
    copies = blocks.join(hot, "block", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return salted.groupBy("block", "part").cogroup(copies.groupBy("block", "part")).applyInPandas(_look_up, "doc_id long, digest binary, keep_id long, group_size long, member boolean")


def exact_dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Report of every row. ``history``: (digest, winner, copies) of earlier batches; its winners stay and their new copies go."""
    with scratch(docs.sparkSession) as keep:
        keys = stored(digests(docs), "digests")
        past = stored(history if history is not None else repeated(keys), "history")
        n_blocks = max(1, -(-past.count() // BLOCK_KEYS))
        found = keep(stored(look_up(keys, stored(index(past, n_blocks), "blocks"), n_blocks), "found"))
    alone = found.where("not member").groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("copies"))
    rest = found.where("not member").drop("keep_id", "group_size").join(alone, "digest").select("doc_id", "digest", F.col("winner").alias("keep_id"), F.col("copies").alias("group_size"))
    return found.where("member").select("doc_id", "digest", "keep_id", "group_size").unionByName(rest).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of equal texts, all columns as they were.

    Rows with an id of their own stay or go by it. Only rows without doc_id, or with one that
    several rows have, are told apart by the digest of their text as well."""
    with scratch(docs.sparkSession) as keep:
        report = stored(exact_dedup(docs), "exact")
        odd = keep(stored(report.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"), "odd-ids"))
        gone = keep(stored(report.where("not kept and doc_id is not null").select("doc_id").distinct(), "gone"))
        stay = keep(stored(report.join(odd, report["doc_id"].eqNullSafe(odd["doc_id"]), "left_semi").where("kept").select("doc_id", "text_sha256").distinct(), "odd-winners"))
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    mine, own = docs["doc_id"].cast("long"), fresh(docs, "own")
    without = lambda df, ids, kind: df.join(small(ids.select(F.col("doc_id").alias(own))), mine.eqNullSafe(F.col(own)), kind)
    if odd.isEmpty():
        return without(docs, gone, "left_anti")
    plain = without(without(docs, odd, "left_anti"), gone, "left_anti")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = without(docs, odd, "left_semi").select(whole_row(docs).alias("row"), mine.alias("id"), F.sha2(F.translate(F.coalesce("text", F.lit("")), upper, lower), 256).alias("text_sha256"))
    won = rows.join(small(stay.select(F.col("doc_id").alias("won"), F.col("text_sha256").alias("sha"))), F.col("id").eqNullSafe(F.col("won")) & (F.col("text_sha256") == F.col("sha")), "left_semi")
    return plain.unionByName(won.groupBy("id", "text_sha256").agg(F.first("row").alias("row")).select("row.*"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(session(spark), sf_dir, "documents"))


SQL = """
with d as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents
), g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from d join g using (text_sha256)
"""
