"""Alignment of the tokens of two tokenizers by interval coalescing.

1. Each text becomes tokens of A (byte-level, of space+text) and of B (sentence pieces,
   which adds the space itself), each token a byte range. Both sides tile the same bytes,
   or the text has no tokens. Texts over ``SECTION`` characters are encoded in sections,
   cut where neither tokenizer can join across (a space between two characters that are no
   white space, or behind a line feed between two such), so a section's end is a group's end as well.
2. The tokens of many texts are laid end to end and lexsorted by start; the running maximum
   of the ends (``maximum.accumulate``) gives the groups: one ends where the next start
   reaches the maximum. Within groups the overlapping pairs of tokens are expanded: the B
   tokens that an A token overlaps are neighbours, so these are ranges found by binary search.
3. The pairs of each text (distinct, with how often) are stored with its counts. Pairs are
   summed over the corpus after map-side combining. The ``FREQUENT`` most frequent pairs go
   to all tasks as a sorted table, which settles nearly all links; only the links of other
   pairs are shuffled, by pair. None of those is hot, as a pair beyond the table holds less
   than one link in ``FREQUENT``. B's highest counts are at most as many as B's vocabulary.

Defined results: texts that are null or empty, or that one of the two tokenizers doesn't give
back byte by byte (B loses U+2581), have no tokens: zeros and ''. They add nothing to the
counts. Repeated rows and rows without doc_id are documents of their own, each counted.
Further columns are ignored; an empty table gives an empty result. Very long texts take
memory in proportion for their ids (about 4 bytes a byte) and for one section; a stretch
without any place to cut is one section.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, scratch, session, stored, table
from .packing import _ranks
from .tokens import _here, _texts, rules, vocabulary_path

PIECES = "piece_bpe_32k.model"
#: Characters from which on a text is encoded in sections.
SECTION = 1_000_000
#: Pairs of ids that go to all tasks: 17 bytes each.
FREQUENT = 300_000
#: Neither tokenizer joins across these places: before a lone space, behind a lone line feed.
CUT = re.compile(r"(?<=\S) (?=\S)|(?<=\S\n)(?=\S)")
SEPARATORS = pa.array([",", "|", ";", ""])
PART = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


class Side:
    """One tokenizer: what its ids stand for, and how it encodes a section."""

    def __init__(self, entries: list[bytes]):
        self.entries = entries
        self.sizes = np.array([len(x) for x in entries], np.int64)

    def covers(self, ids: np.ndarray, data: bytes) -> bool:
        return b"".join(map(self.entries.__getitem__, ids.tolist())) == data


class ByteLevel(Side):
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # the same vocabulary's ranks are quicker; the library itself takes texts with unusual characters
        ranks_path = path.removesuffix(".json") + ".tiktoken"
        with open(ranks_path, "rb") as lines:
            found = {int(n): base64.b64decode(x) for x, n in map(bytes.split, lines)}
        super().__init__([found.get(i, b"") for i in range(max(found) + 1)])
        self.fast, self.odd, self.library = _ranks(ranks_path), rules()[2], Tokenizer.from_file(path)
        self.library.encode_special_tokens = True

    def ids(self, section: str, at: int) -> np.ndarray:
        text = section if at else " " + section
        if self.odd.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


class SentencePieces(Side):
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = known = SentencePieceProcessor(model_file=path)
        super().__init__([bytes([int(p[1:-1], 16)]) if known.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, known.id_to_piece(i)) for i in range(known.get_piece_size()))])
        self.lead = len(self._own("\n"))

    def _own(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, num_threads=1), np.uint32)

    def ids(self, section: str, at: int) -> np.ndarray:
        """The library puts a space before each text: a section's own first space is left out for it."""
        if not at:
            return self._own(section)
        return self._own(section[1:]) if section[0] == " " else self._own("\n" + section)[self.lead :]


def _side(kind, path: str) -> Side:
    """Once per process."""
    if (kind, path) not in _here:
        _here[kind, path] = kind(path)
    return _here[kind, path]


def sections(text: str, most: int = SECTION) -> Iterator[tuple[int, str]]:
    """(place, section) of a text, cut where no token of either side can lie across."""
    first = 0
    while len(text) - first > most and (found := CUT.search(text, first + most)):
        yield first, text[first : found.start()]
        first = found.start()
    yield first, text[first:]


def encoded(text: str, a: Side, b: Side, most: int = SECTION) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids of both sides per section; none where a side doesn't give the text back."""
    out = []
    for at, section in sections(text, most) if text else ():
        data = (section if at else " " + section).encode()
        one, two = a.ids(section, at), b.ids(section, at)
        if not (a.covers(one, data) and b.covers(two, data)):
            return []
        out.append((one, two))
    return out


def coalesced(parts: list[tuple[np.ndarray, np.ndarray]], a: Side, b: Side) -> tuple:
    """Groups and links of many parts at once, laid end to end.

    Per part: groups, links, the offsets of its distinct pairs; all pairs (A id times B's
    vocabulary, plus B id) and how often; the parts' group texts as bytes with offsets."""
    ones, twos = np.concatenate([p[0] for p in parts]).astype(np.int64), np.concatenate([p[1] for p in parts]).astype(np.int64)
    end_a, end_b = np.cumsum(a.sizes[ones]), np.cumsum(b.sizes[twos])
    start_a, start_b = end_a - a.sizes[ones], end_b - b.sizes[twos]
    part_a = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    part_b = np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])

    start, end, part = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b]), np.concatenate([part_a, part_b])
    side = np.repeat([0, 1], [len(ones), len(twos)])
    order = np.lexsort((side, start))
    reached = np.maximum.accumulate(end[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = start[order][1:] >= reached[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1

    # the group texts: each id with what stands behind it
    key = 2 * group + side
    order = np.argsort(key, kind="stable")
    key, own = key[order], part[order]
    behind = np.full(len(key), 3)
    behind[:-1] = np.where(own[1:] != own[:-1], 3, np.where(key[1:] == key[:-1], 0, np.where(key[1:] >> 1 == key[:-1] >> 1, 1, 2)))
    said = pc.binary_join_element_wise(pa.array(np.concatenate([ones, twos])[order]).cast(pa.string()), SEPARATORS.take(pa.array(behind)), "")
    at = np.frombuffer(said.buffers()[1], np.int32)[: len(said) + 1]
    text_at = at[np.searchsorted(own, np.arange(len(parts) + 1))]

    low, high = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
    n = high - low
    first = np.cumsum(n) - n
    partner = np.arange(n.sum()) + np.repeat(low - first, n)
    vocabulary = len(a.entries) * len(b.entries)
    pair = np.repeat(part_a * vocabulary + ones * len(b.entries), n) + twos[partner]
    pair, times = np.unique(pair, return_counts=True)
    pairs_at = np.searchsorted(pair, np.arange(len(parts) + 1) * vocabulary)
    groups = np.bincount(own[np.flatnonzero(np.diff(key >> 1, prepend=-1))], minlength=len(parts))
    return groups, np.bincount(part_a, n, len(parts)).astype(np.int64), pairs_at, pair % vocabulary, times, said.buffers()[2], text_at


def _parts(path_a: str, path_b: str, most: int):
    """One row per text; a text of several packs of sections has a row for each, the last one with the digest."""

    def packs(known: list) -> Iterator[list]:
        """(text's place, its section, whether the last) in packs of bounded bytes together."""
        pack, size = [], 0
        for i, parts in known:
            for k, part in enumerate(parts):
                if pack and size + len(part[0]) > SLICE_BYTES // 2:
                    yield pack
                    pack, size = [], 0
                pack.append((i, part, k == len(parts) - 1))
                size += len(part[0])
        if pack:
            yield pack

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _side(ByteLevel, path_a), _side(SentencePieces, path_b)
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
        for batch in batches:
            rows, doc_ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, texts in _texts(batch, 2):
                known = [(first + i, encoded(text, a, b, most)) for i, text in enumerate(texts)]
                none = [i for i, parts in known if not parts]
                if none:
                    empty, zeros = pa.array([[]] * len(none), pa.list_(pa.int64())), pa.array([0] * len(none), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([rows[i] for i in none], pa.int64()), pa.array([doc_ids[i] for i in none], pa.int64()), zeros, zeros, zeros, zeros, pa.array([""] * len(none)), empty, empty], schema=schema)
                digests: dict = {}
                for pack in packs(known):
                    groups, links, pairs_at, pair, times, said, text_at = coalesced([p for _, p, _ in pack], a, b)
                    view, shown = memoryview(said), []
                    for k, (i, _, last) in enumerate(pack):
                        if i in digests:
                            digests[i].update(b";")
                        else:
                            digests[i] = hashlib.sha256()
                        digests[i].update(view[text_at[k] : text_at[k + 1]])
                        shown.append(digests.pop(i).hexdigest() if last else None)
                    offsets = pa.array(pairs_at, pa.int32())
                    columns = [pa.array([rows[i] for i, _, _ in pack], pa.int64()), pa.array([doc_ids[i] for i, _, _ in pack], pa.int64())]
                    columns += [pa.array([len(p[side]) for _, p, _ in pack], pa.int64()) for side in (0, 1)]
                    columns += [pa.array(groups, pa.int64()), pa.array(links, pa.int64()), pa.array(shown, pa.string())]
                    columns += [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (pair, times)]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return part


def parts(docs: DataFrame, path_a: str, path_b: str, most: int = SECTION) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_parts(path_a, path_b, most), PART)


def pair_counts(found: DataFrame, vocabulary_b: int) -> DataFrame:
    """pair, n: how many links hold it; best: whether no pair of the same B id has more."""
    links = found.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = links.groupBy("pair").agg(F.sum("times").alias("n")).withColumn("b", F.col("pair") % vocabulary_b)
    return counts


def _looked_up(tier):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = tier.value
        for batch in batches:
            at = batch.column(1).offsets.to_numpy().astype(np.int64)
            pair, times = (batch.column(c).flatten().to_numpy() for c in (1, 2))
            at = at - at[0]
            place = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
            hit = keys[place] == pair if len(keys) else np.zeros(len(pair), bool)
            sums = []
            for values in (np.where(hit, best[place] * times, 0), np.where(hit, n[place] * times, 0)) if len(keys) else [np.zeros(len(pair), np.int64)] * 2:
                total = np.zeros(len(pair) + 1, np.int64)
                np.cumsum(values, out=total[1:])
                sums.append(pa.array(total[at[1:]] - total[at[:-1]]))
            missed = np.zeros(len(pair) + 1, np.int64)
            np.cumsum(~hit, out=missed[1:])
            lists = [pa.ListArray.from_arrays(pa.array(missed[at], pa.int32()), pa.array(x[~hit], pa.int64())) for x in (pair, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sums, *lists], ["row", "n_best", "count_sum", "pairs", "times"])

    return look


def alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, frequent: int = FREQUENT, most: int = SECTION) -> DataFrame:
    """Per row doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    path_a, path_b = path_a or vocabulary_path(), path_b or vocabulary_path(PIECES)
    spark = docs.sparkSession
    vocabulary_b = len(_side(SentencePieces, path_b).entries)
    with scratch(spark) as keep:
        found = keep(stored(parts(docs, path_a, path_b, most), "aligned"))
        counts = stored(pair_counts(found, vocabulary_b), "pair-counts")
        # a row for each entry of B's vocabulary at most
        highest = F.broadcast(counts.groupBy("b").agg(F.max("n").alias("highest")))
        counts = keep(stored(counts.join(highest, "b").select("pair", "n", (F.col("n") == F.col("highest")).cast("long").alias("best")), "pair-ranks"))
    top = counts.orderBy(F.desc("n"), "pair").limit(frequent).toPandas().sort_values("pair")
    tier = spark.sparkContext.broadcast(tuple(top[c].to_numpy(np.int64) for c in ("pair", "n", "best")))
    looked = found.select("row", "pairs", "times").mapInArrow(_looked_up(tier), "row long, n_best long, count_sum long, pairs array<long>, times array<long>")
    rare = looked.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times")).join(counts, "pair")
    own = ["n_a", "n_b", "n_groups", "n_links"]
    nothing = [F.lit(0).cast("long").alias(c) for c in own]
    rows = (
        found.select("row", "doc_id", *own, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"), "groups_sha256")
        .unionByName(looked.select("row", F.lit(None).cast("long").alias("doc_id"), *nothing, "n_best", "count_sum", F.lit(None).cast("string").alias("groups_sha256")))
        .unionByName(rare.select("row", F.lit(None).cast("long").alias("doc_id"), *nothing, (F.col("best") * F.col("times")).alias("n_best"), (F.col("n") * F.col("times")).alias("count_sum"), F.lit(None).cast("string").alias("groups_sha256")))
    )
    sums = [F.sum(c).alias(c) for c in [*own, "n_best", "count_sum"]]
    return rows.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *sums, F.max("groups_sha256").alias("groups_sha256")).drop("row")


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(session(spark), sf_dir, "documents"))
