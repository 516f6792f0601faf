"""Quality rules with cross-document line frequency.

One pass over the bytes of each text gives the base figures and, for every distinct
line, the 128-bit digest of its normalised form (words lower-cased A-Z, single spaces)
with its words. Per host (``source``) and line the distinct documents that hold the line
are counted with map-side combining, so a line of a third of all rows is one row per task.
A line in more than ``LIMIT`` documents of its host is removed; a document that keeps
fewer than ``LEAST`` hundredths of its words is depleted and rejected.

Base rules, on the words ``[^\\x20\\x09-\\x0D]+`` of the whole text: fewer than 50 words,
or more than half of the words in 3-word windows that occur twice or more. Words, windows
and lines of a text are compared byte by byte, not by hashes.

Defined results: null and empty texts have no words and fail the base rules. A null
source is one host. Rows that share a doc_id are one document to the count of a line;
rows without doc_id are one document per text. Repeated rows each get a row. Further
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attached, codes_of, digest, per_doc, pieces_of, scratch, session, slices, stored, table, utf8, words_of

#: Documents of a host that may share a line; hundredths of words that a document keeps at least.
LIMIT, LEAST = 100, 20
MIN_WORDS, MOST_REPEATED = 50, 50

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def often(codes: np.ndarray) -> np.ndarray:
    """Which codes occur twice or more."""
    _, at, counts = np.unique(codes, return_inverse=True, return_counts=True)
    return counts[at] > 1


def figures(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], list[list[bytes]], list[list[int]]]:
    """Base figures per document; digests and words of its distinct normalised lines."""
    docs = len(offsets) - 1
    start, end, doc, inside = words_of(data, offsets)
    n_words = np.bincount(doc, minlength=docs)
    chars = per_doc(inside & ((data & 0xC0) != 0x80), offsets)
    symbols = per_doc(SYMBOLS[data], offsets)
    # words of 3-word windows that their document holds twice or more; pairs are numbered first, so that a window is two numbers
    words, m = codes_of(data, start, end), max(0, len(start) - 2)
    first = np.flatnonzero(doc[:m] == doc[2:]) if m else np.zeros(0, np.int64)
    _, pair = np.unique(words[first] * (len(words) + 1) + words[first + 1], return_inverse=True)
    _, window = np.unique(pair * (len(words) + 1) + words[first + 2], return_inverse=True)
    covered = np.zeros(len(words) + 3, bool)
    twice = first[often(window * docs + doc[first])]
    for k in range(3):
        covered[twice + k] = True
    repeated = np.bincount(doc, weights=covered[: len(words)], minlength=docs).astype(np.int64)
    # lines with a word: as they stand for repeats within the text, normalised across texts
    line_start = np.union1d(offsets[:-1], np.flatnonzero(data == 10) + 1)
    line = np.searchsorted(line_start, start, "right") - 1
    lines, counts = np.unique(line, return_counts=True)
    line_doc = doc[np.searchsorted(line, lines)] if len(lines) else np.zeros(0, np.int64)
    limit = np.append(line_start, len(data))
    stop = np.minimum(limit[lines + 1], offsets[line_doc + 1])
    stop = stop - ((stop > limit[lines]) & (data[np.maximum(stop, 1) - 1] == 10))
    coded = pieces_of(data, limit[lines], stop)
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    _, at = np.unique(code * docs + line_doc, return_index=True)
    new = np.zeros(len(lines), bool)
    new[at] = True
    dup_lines = np.bincount(line_doc, weights=~new, minlength=docs).astype(np.int64)
    normal = [digest(b" ".join(x.lower().split())) for x in coded.dictionary.to_pylist()]
    own: list[dict[bytes, int]] = [{} for _ in range(docs)]
    for d, c, n in zip(line_doc.tolist(), code.tolist(), counts.tolist()):
        own[d][normal[c]] = own[d].get(normal[c], 0) + n
    return [n_words, chars, symbols, dup_lines, repeated], [list(x) for x in own], [list(x.values()) for x in own]


def _lists(parts: list[list], kind: pa.DataType) -> pa.ListArray:
    return pa.array(parts, pa.list_(kind))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8(batch.column(2))
        for a, b in slices(at):
            own, off = data[at[a] : at[b]], at[a : b + 1] - at[a]
            base, lines, words = figures(own, off)
            texts = [digest(own[x:y].tobytes()) for x, y in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *[pa.array(x, pa.int64()) for x in base], pa.array(texts, pa.binary()), _lists(lines, pa.binary()), _lists(words, pa.int64())],
                ["doc_id", "host", *FIGURES, "text_digest", "lines", "line_words"],
            )


def quality_rules(docs: DataFrame, limit: int = LIMIT, least: int = LEAST) -> DataFrame:
    """doc_id, the figures, base_failed, kept; then n_removed_lines and n_kept_words."""
    with scratch(docs.sparkSession) as keep:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), "text")
        schema = "doc_id long, host string, " + ", ".join(f"{x} long" for x in FIGURES) + ", text_digest binary, lines array<binary>, line_words array<long>"
        measured = stored(rows.mapInArrow(_measured, schema), "measured")
        host = F.struct(F.col("host").isNull().alias("no"), F.coalesce("host", F.lit("")).alias("name")).alias("host")
        keyed = measured.select(host, F.coalesce("doc_id", F.lit(0)).alias("doc"), "text_digest", F.when(F.col("doc_id").isNull(), F.col("text_digest")).alias("nameless"), "lines", "line_words")
        lines = keyed.select("host", "doc", "text_digest", "nameless", F.inline(F.arrays_zip(F.col("lines").alias("line"), F.col("line_words").alias("words"))))
        # distinct documents first, spread over all tasks by document, then their number
        spread = lines.groupBy("host", "line", "doc", "nameless").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count("one").alias("documents"))
        common = stored(spread.where(F.col("documents") > limit), "common")
        held = attached(lines, common, ["host", "line"], "documents", int(measured.agg(F.sum(F.size("lines"))).first()[0] or 0))
        # rows alike in all of these have the same lines
        key = ["host", "doc", "nameless", "text_digest"]
        gone = held.groupBy(*key, "line").agg(F.first("words").alias("words")).groupBy(*key).agg(F.sum("words").alias("gone"), F.count(F.lit(1)).alias("n_removed_lines"))
        gone = gone.select(*[F.col(c).alias(f"_{c}") for c in key], "gone", "n_removed_lines")
        own = measured.drop("lines", "line_words").withColumns({"_own": host, "_id": F.coalesce("doc_id", F.lit(0)), "_none": F.when(F.col("doc_id").isNull(), F.col("text_digest"))})
        judged = own.join(gone, (F.col("_own") == F.col("_host")) & (F.col("_id") == F.col("_doc")) & F.col("_none").eqNullSafe(F.col("_nameless")) & (F.col("text_digest") == F.col("_text_digest")), "left").withColumns({
            "n_kept_words": F.col("n_words") - F.coalesce("gone", F.lit(0)), "n_removed_lines": F.coalesce("n_removed_lines", F.lit(0)),
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
        })
        return keep(stored(judged.select("doc_id", *FIGURES, "base_failed", (~F.col("base_failed") & (100 * F.col("n_kept_words") >= least * F.col("n_words"))).alias("kept"), "n_removed_lines", "n_kept_words"), "judged"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(session(spark), sf_dir, "documents"))
