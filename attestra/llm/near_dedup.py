"""Near-dedup with SetSketch registers.

1. Each text's set of word shingles becomes ``REGISTERS`` 16-bit registers: the
   truncated logarithms (base 1.001) of exponential minima, one per hash function.
   Registers of a union are the registerwise maxima; two sets agree in a register with
   a probability close to their Jaccard similarity. Shingles are 128-bit digests made of
   BLAKE2 digests of their words. Texts with one and the same set (128-bit digest of it)
   are a class, which goes on as one node.
2. Bands of four registers are bucket keys. At similarity 0.8 a pair misses all
   32 buckets with probability (1 - 0.8**4)**32 < 1e-7.
3. In each bucket nodes are matched with the bucket's smallest node only. Matches of
   one component needn't be checked again: first each node's most frequent match is
   verified, then the matches across components. In buckets that still hold several
   components, the nodes outside the largest meet all in blocks, twice: the first time
   with their sketches, which leaves the nodes that have a partner at all (one row a node,
   not one a pair); the second time with their full sets, giving one link for a pair of
   components. A pair is looked at in the first band it shares.
4. Before sets are fetched, the sizes must allow 0.8 and the similarity estimated jointly
   from both sketches by maximum likelihood (sizes are known) must be within six standard
   errors of it (0.58; sets of equal size at similarity 0.8 fall below with probability
   1e-8). So full sets travel only for documents that have a likely partner.
5. A link counts only if the intersection of the full sets confirms it.

Nothing is capped: buckets of any size are dealt in blocks, never as all pairs, and
links inside a component add nothing to the result. The work in a bucket grows with its
nodes times those outside its largest component.

Defined results: texts without words (null, empty) have 0 shingles and are linked with
nothing; with fewer words than a shingle the whole sequence is the one shingle. Rows
that share a doc_id are one document. Rows without doc_id link others; they never name
a component, whose id is null if no row of it has one. ``deduplicated`` keeps one of them
where their component has no id, and none where it has one. Further columns are ignored
by the report and kept by ``deduplicated``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, attached, chained, deleted, digest, digests_of, fresh, mix, ngrams, scratch, session, slices, stored, table, utf8, whole_row, words_of
from .graphs import components

REGISTERS, ROWS = 128, 4
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: Linked from this similarity on, in hundredths; estimates from FLOOR on are verified.
LINK, FLOOR = 80, 0.58
#: Share of equal registers that a pair must have for its similarity to be estimated: six standard errors below 0.8.
EQUAL = 0.58
#: Weight of the nodes of a block of a bucket, on average; a node weighs its shingles and NODE.
BLOCK, NODE = 500_000, 64
#: Pairs of a block whose sketches are compared at once, about a kilobyte each.
BATCH = 10_000
#: Ids are broadcast up to this measured number (8 bytes each), else joined by shuffle.
BROADCAST_IDS = 500_000
#: Nodes of rows without doc_id lie above all ids.
NO_ID = 1 << 62

_rng = np.random.RandomState(20240917)
_MASKS = _rng.randint(0, 1 << 62, REGISTERS, dtype=np.int64).astype(np.uint64)
_FACTORS = (_rng.randint(0, 1 << 62, REGISTERS, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 4) -> list[np.ndarray]:
    """The distinct shingle digests of each document of a slice, (size, 2), in ascending order."""
    data = LOWER[data]
    start, end, doc, _ = words_of(data, offsets)
    words = digests_of(data, start, end)
    grams, first = ngrams(words, doc, n)
    docs = len(offsets) - 1
    counts = np.bincount(doc, minlength=docs)
    begin = np.concatenate([[0], np.cumsum(counts)])
    cuts = np.searchsorted(doc[first], np.arange(docs + 1)) if len(first) else np.zeros(docs + 1, np.int64)
    out = []
    for d in range(docs):
        if counts[d] >= n:
            own = grams[cuts[d] : cuts[d + 1]]
            out.append(own[np.unique(own[:, 0], return_index=True)[1]])
        elif counts[d]:
            out.append(chained(words[begin[d] : begin[d + 1]][None]) ^ np.uint64(counts[d]))
        else:
            out.append(np.zeros((0, 2), np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, REGISTERS) of 16 bits; rows of empty sets are 0."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    sizes = np.array([len(s) for s in sets])
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    x = np.concatenate([sets[i][:, 0] for i in full])
    begin = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    least = np.empty((len(full), REGISTERS), np.uint64)
    for k in range(REGISTERS):
        least[:, k] = np.minimum.reduceat((x ^ _MASKS[k]) * _FACTORS[k], begin)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    out[full] = np.clip(np.floor(1 - np.log(np.maximum(exponential, 1e-300)) / np.log(BASE)), 0, TOP).astype(np.uint16)
    return out


def _digests(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    np.seterr(over="ignore")
    for batch in batches:
        data, at = utf8(batch.column(1))
        for a, b in slices(at):
            sets = shingle_sets(data[at[a] : at[b]], at[a : b + 1] - at[a])
            kept = registers(sets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), _digests(sets), pa.array([r.tobytes() for r in kept], pa.binary())], ["doc_id", "n_shingles", "digest", "registers"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, wanted digest, text) -> (key, digest, shingles) where the text has the wanted digest, or none is named."""
    np.seterr(over="ignore")
    for batch in batches:
        data, at = utf8(batch.column(2))
        for a, b in slices(at):
            sets = shingle_sets(data[at[a] : at[b]], at[a : b + 1] - at[a])
            out = pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _digests(sets), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "digest", "shingles"])
            wanted = batch.column(1).slice(a, b - a).to_pylist()
            yield out.filter(pa.array([d is not None and w in (None, d) for w, d in zip(wanted, out.column(1).to_pylist())], pa.bool_()))


def _row_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    np.seterr(over="ignore")
    for batch in batches:
        data, at = utf8(batch.column(1))
        for a, b in slices(at):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _digests(shingle_sets(data[at[a] : at[b]], at[a : b + 1] - at[a]))], ["row", "digest"])


def _bands(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    np.seterr(over="ignore")
    for x in frames:
        if len(x):
            r = np.frombuffer(b"".join(x["registers"]), np.uint64).reshape(len(x), REGISTERS // ROWS)
            keys = mix(mix(r) + np.arange(1, r.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            yield pd.DataFrame({"key": keys.view(np.int64).ravel(), "band": np.tile(np.arange(r.shape[1], dtype=np.int32), len(x)), "node": np.repeat(x["node"].to_numpy(), r.shape[1])})


def likeliest(equal: np.ndarray, above: np.ndarray, below: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The Jaccard similarity that makes the registers' comparisons likeliest, for sets of m and n elements."""
    u, v = m / (m + n), n / (m + n)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    ln, c = np.log(BASE), (BASE - 1) / BASE

    def likelihood(j):
        p, q = (-np.log1p(-np.maximum(x, 0) * c) / ln for x in (u - v * j, v - u * j))
        return above * np.log(np.maximum(p, 1e-12)) + below * np.log(np.maximum(q, 1e-12)) + equal * np.log(np.maximum(1 - p - q, 1e-12))

    for _ in range(30):  # it is concave: golden sections of thirds
        a, b = low + (high - low) / 3, high - (high - low) / 3
        up = likelihood(a) < likelihood(b)
        low, high = np.where(up, a, low), np.where(up, high, b)
    return (low + high) / 2


def likely(r: np.ndarray, s: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the sketches (a pair per row) of sets of m and n elements leave it possible that the sets are linked."""
    equal, above = (r == s).sum(axis=1), (r > s).sum(axis=1)
    out = equal >= int(EQUAL * REGISTERS)
    k = np.flatnonzero(out)
    out[k] = likeliest(equal[k], above[k], REGISTERS - equal[k] - above[k], m[k].astype(float), n[k].astype(float)) >= FLOOR
    return out


def _likely(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in frames:
        if len(x):
            r, s = (np.frombuffer(b"".join(x[c]), np.uint16).reshape(len(x), REGISTERS) for c in ("r", "s"))
            yield x.loc[likely(r, s, x["m"].to_numpy(), x["n"].to_numpy()), ["a", "b", "votes"]]


def _met(unit: pd.DataFrame) -> Iterator[list[list[int]]]:
    """Strays of each block with their likely partners in other components, as (stray, partner) in batches; only in the first band that a pair shares.

    ``unit`` holds whole blocks, sorted by them."""
    r = np.frombuffer(b"".join(unit["registers"]), np.uint16).reshape(len(unit), REGISTERS)
    words = r.view(np.uint64)
    n, label, band, stray, whole = (unit[c].to_numpy() for c in ("n", "label", "band", "stray", "whole"))
    place = unit[PLACE].to_numpy()
    starts = np.append(np.flatnonzero(np.append(True, (place[1:] != place[:-1]).any(axis=1))), len(unit))
    batch: list[np.ndarray] = []
    size = 0

    def sifted() -> list[list[int]]:
        i, j = np.concatenate(batch).T
        ok = likely(r[i], r[j], n[i], n[j])
        batch.clear()
        return np.stack([i[ok], j[ok]], axis=1).tolist()

    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        others = a + np.flatnonzero(whole[a:b])
        for i in (a + np.flatnonzero(stray[a:b])).tolist():
            may = others[(label[others] != label[i]) & (np.minimum(n[others], n[i]) * 100 >= LINK * np.maximum(n[others], n[i]))]
            may = may[(words[may] == words[i]).argmax(axis=1) == band[i]] if len(may) else may
            if len(may):
                batch.append(np.stack([np.full(len(may), i), may], axis=1))
                size += len(may)
            if size > BATCH:
                yield sifted()
                size = 0
    if batch:
        yield sifted()


PLACE = ["key", "lane", "block"]


def _partnered(unit: pd.DataFrame) -> pd.DataFrame:
    """The nodes of each block that have a likely partner in it."""
    unit = unit.sort_values(PLACE, ignore_index=True)
    found = np.zeros(len(unit), bool)
    for pairs in _met(unit):
        found[np.array(pairs, np.int64).ravel()] = True
    return unit.loc[found, [*PLACE, "node"]].drop_duplicates()


def _linked_across(unit: pd.DataFrame) -> pd.DataFrame:
    """Links between strays and other nodes of their block, decided on the full sets; of a pair of components one link at most."""
    unit = unit.sort_values(PLACE, ignore_index=True)
    label, node, sets = unit["label"].tolist(), unit["node"].tolist(), unit["shingles"].tolist()
    union: dict[int, int] = {}

    def root(x: int) -> int:
        while x in union:
            x = union[x]
        return x

    links = []
    for pairs in _met(unit):
        for i, j in pairs:
            p, q = root(label[i]), root(label[j])
            if p != q and similar(sets[i], sets[j]):
                union[max(p, q)] = min(p, q)
                links.append((max(node[i], node[j]), min(node[i], node[j])))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def similar(p: bytes, q: bytes) -> bool:
    """Whether two sets of digests are linked."""
    p, q = (np.frombuffer(x, np.uint64).reshape(-1, 2) for x in (p, q))
    both = int((p[np.minimum(np.searchsorted(p[:, 0], q[:, 0]), len(p) - 1)] == q).all(axis=1).sum())
    return 100 * both >= LINK * (len(p) + len(q) - both)


def _confirmed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in frames:
        yield x.loc[[similar(p, q) for p, q in zip(x["p"], x["q"])], ["a", "b"]]


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) whose full sets are similar enough."""
    p, q = (sets.select(F.col("node").alias(a), F.col("shingles").alias(b)) for a, b in (("a", "p"), ("b", "q")))
    return stored(pairs.select("a", "b").distinct().join(p, "a").join(q, "b").mapInPandas(_confirmed, "a long, b long"), "confirmed")


def full_sets(wanted: DataFrame, docs: DataFrame, repeats: bool) -> DataFrame:
    """(node, shingles) of the nodes of ``wanted`` (node, digest); their texts are read again.

    repeats: whether doc_ids stand in several rows."""
    schema = "node long, digest binary, shingles binary"
    ids = wanted.where(F.col("node") < NO_ID)
    rows = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    sets = rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "node").select("node", "digest", "text").mapInArrow(_full_sets, schema)
    nameless = wanted.where(F.col("node") >= NO_ID)
    if not nameless.isEmpty():
        own = rows.where("node is null").select("node", F.lit(None).cast("binary").alias("digest"), "text").mapInArrow(_full_sets, schema)
        sets = sets.unionByName(own.drop("node").join(nameless, "digest").select("node", "digest", "shingles"))
        repeats = True
    return stored((sets.dropDuplicates(["digest"]) if repeats else sets).select("node", "shingles"), "sets")


def links(nodes: DataFrame, docs: DataFrame, repeats: bool = True) -> DataFrame:
    """Confirmed links that connect what is linked: (a, b), a > b; ``nodes``: node, n, digest, registers."""
    spark = docs.sparkSession
    with scratch(spark) as keep:
        bands = stored(nodes.select("node", "registers").mapInPandas(_bands, "key long, band int, node long"), "bands")
        heads = bands.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
        shared = stored(bands.join(heads.select("key", "head"), "key"), "buckets")
        deleted(spark, [bands._folder])
        sketched = stored(shared.select("node").distinct().join(nodes.select("node", "n", "digest", "registers"), "node"), "sketched")

        # each node's matches with the heads of its buckets, as far as sizes and sketches allow a link
        votes = shared.where("node > head").groupBy(F.col("node").alias("a"), F.col("head").alias("b")).agg(F.count(F.lit(1)).alias("votes"))
        sized = votes.join(sketched.select(F.col("node").alias("a"), F.col("n").alias("m")), "a").join(sketched.select(F.col("node").alias("b"), "n"), "b").where(F.least("m", "n") * 100 >= LINK * F.greatest("m", "n"))
        r, s = (sketched.select(F.col("node").alias(c), F.col("registers").alias(name)) for c, name in (("a", "r"), ("b", "s")))
        votes = stored(sized.join(r, "a").join(s, "b").mapInPandas(_likely, "a long, b long, votes long"), "votes")
        wanted = votes.select(F.col("a").alias("node")).unionByName(votes.select(F.col("b").alias("node"))).distinct()
        sets = full_sets(sketched.select("node", "digest").join(wanted, "node"), docs, repeats)
        first = votes.groupBy("a").agg(F.max_by("b", F.struct("votes", -F.col("b"))).alias("b"))
        found = confirmed(first, sets)

        labels = components(found)
        of = lambda df, c, name: df.join(labels.select(F.col("node").alias(c), F.col("label").alias("_l")), c, "left").withColumn(name, F.coalesce("_l", c)).drop("_l")
        rest = of(of(votes.select("a", "b"), "a", "la"), "b", "lb").where("la <> lb").select("a", "b").join(first, ["a", "b"], "left_anti")
        found = stored(found.unionByName(confirmed(rest, sets)), "found")

        labels = components(found)
        weight = F.col("n") + NODE
        labelled = of(shared.select("key", "band", "node"), "node", "label").join(sketched.select("node", "n"), "node")
        by = labelled.groupBy("key", "label").agg(F.sum(weight).alias("w"))
        by = by.groupBy("key").agg(F.max_by("label", F.struct("w", "label")).alias("most"), F.sum("w").alias("size"), F.max("w").alias("top")).where("size > top")
        open_ = stored(labelled.join(by, "key"), "open")
        lanes, blocks = (F.ceil(x / BLOCK).cast("int") for x in (F.col("size") - F.col("top"), F.col("size")))
        of_node = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
        stray, yes, no = F.col("label") != F.col("most"), F.lit(True), F.lit(False)
        small, large = open_.where(F.col("size") <= BLOCK), open_.where(F.col("size") > BLOCK)
        names = [*PLACE, "band", "node", "n", "label", "stray", "whole"]
        parts = [
            small.withColumns({"lane": F.lit(0), "block": F.lit(0), "stray": stray, "whole": yes}),
            large.where(stray).withColumns({"lane": of_node(lanes, 1), "stray": yes, "whole": no}).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))),
            large.withColumns({"block": of_node(blocks, 2), "stray": no, "whole": yes}).withColumn("lane", F.explode(F.sequence(F.lit(0), lanes - 1))),
        ]
        dealt = parts[0].select(names).unionByName(parts[1].select(names)).unionByName(parts[2].select(names))

        def units(rows: DataFrame) -> DataFrame:
            n = max(1, -(-int(rows.agg(F.sum(weight)).first()[0] or 0) // BLOCK))
            return rows.join(sketched.select("node", "registers"), "node").withColumn("unit", F.pmod(F.xxhash64(*PLACE), F.lit(n)))

        alive = stored(units(dealt).groupBy("unit").applyInPandas(_partnered, "key long, lane int, block int, node long"), "partnered")
        more = stored(dealt.join(alive, [*PLACE, "node"], "left_semi"), "partners")
        lacking = more.select("node").distinct().join(sets.select("node"), "node", "left_anti")
        if not lacking.isEmpty():
            sets = sets.unionByName(full_sets(sketched.select("node", "digest").join(lacking, "node"), docs, repeats))
        across = units(more.join(sets, "node")).groupBy("unit").applyInPandas(_linked_across, "a long, b long")
        return keep(stored(found.unionByName(across), "links"))


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest and component of every row; a component is its smallest node, all null for texts without words."""
    spark = docs.sparkSession
    with scratch(spark) as keep:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        sketches = stored(rows.mapInArrow(_sketches, "doc_id long, n_shingles long, digest binary, registers binary"), "sketches")
        full = sketches.where("digest is not null")
        classes = full.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
        nodes = stored(classes.select(F.coalesce("id", F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("digest"), 2)).alias("node"), "n", "digest", "copies", "registers"), "nodes")
        report = stored(sketches.select("doc_id", "n_shingles", "digest"), "report")
        deleted(spark, [sketches._folder])
        full = report.where("digest is not null")
        same_id = stored(full.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), (F.min("digest") != F.max("digest")).alias("differ")).where("doc_id is not null and rows > 1"), "same-id")
        found = links(nodes, docs, not same_id.isEmpty())
        differ = same_id.where("differ").select("doc_id")
        if not differ.isEmpty():  # rows of one doc_id with different texts are one document
            found = found.unionByName(full.join(differ, "doc_id").join(nodes.select("digest", "node"), "digest").select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
        labels = components(found)
        at = nodes.join(labels, "node", "left").select("digest", "copies", F.coalesce("label", "node").alias("component"))
        total = full.count()
        out = attached(full, at, ["digest"], "copies", total).unionByName(report.where("digest is null").withColumn("component", F.lit(None).cast("long")))
        return keep(stored(out.select("doc_id", "n_shingles", "digest", "component"), "near"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).when(F.col("component") < NO_ID, F.col("component"))
    return placed(docs).select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group stays, with all its columns."""
    at, gone = placed(docs), fresh(docs, "gone")
    ids = at.where("doc_id is not null and digest is not null and doc_id <> component").select(F.col("doc_id").alias(gone)).distinct()
    out = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, docs["doc_id"].cast("long") == F.col(gone), "left_anti")
    nameless = at.where("doc_id is null and digest is not null")
    if nameless.isEmpty():
        return out
    # rows without doc_id: the least digest of each component that has no id, once; and the texts without words
    stay = nameless.where(F.col("component") >= NO_ID).groupBy("component").agg(F.min("digest").alias("digest")).select("digest")
    own = docs.where("doc_id is null").select(whole_row(docs).alias("row"), "text")
    own = own.mapInArrow(_row_digests, T.StructType([own.schema["row"], T.StructField("digest", T.BinaryType())]))
    kept = own.join(stay, "digest").dropDuplicates(["digest"]).select("row.*").unionByName(own.where("digest is null").select("row.*"))
    return out.where("doc_id is not null").unionByName(kept)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(session(spark), sf_dir, "documents"))
