"""Token counts by a map-side two-tier lookup.

Tier 1 is a compact hash table of frequent pre-tokens and their token lengths. Every
task counts the pre-tokens of all its texts and hands on its heaviest; their sums,
at most ``FREQUENT`` entries, are encoded once and broadcast (a bound that doesn't
grow with the data). Tier 2 is a cache in each Python worker: pre-tokens that the
table lacks are encoded once per worker by the tokenizer library, in batches, and
kept up to ``CACHE`` entries. No pre-token is ever shuffled but the bounded heads.
The result doesn't depend on what either tier holds.

Defined results: null and empty texts have 0 bytes and 0 tokens. Text between two
marks of the special token is split on its own, as the library does, and the mark is
one token. Texts with characters outside the common blocks, where Unicode versions
might split differently, are encoded whole by the library. Repeated rows are counted
each; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import session, slices, table, utf8

VOCABULARY = "byte_bpe_50k.json"
#: Entries of the broadcast table, of a task's head, and of a worker's cache.
FREQUENT, HEAD, CACHE = 20_000, 4_000, 300_000
#: Characters of a pre-token that either tier or the cache may hold; longer ones are encoded each time.
SHORT = 64
#: A task's counter is cut to its heavier half at this size.
COUNTER = 200_000
LIMIT = 1024

_here: dict = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def library(path: str):
    """The tokenizer of ``path``, once per process."""
    if ("library", path) not in _here:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _here["library", path] = Tokenizer.from_file(path)
    return _here["library", path]


def rules() -> tuple:
    """The pre-token pattern; the special mark; what finds characters outside the common blocks."""
    if "rules" not in _here:
        import re

        import public_tokenizers
        import regex

        _here["rules"] = regex.compile(public_tokenizers.PATTERN), "<|endoftext|>", re.compile("[^\t\n\r -~¡-ȶΑ-ΡΣ-ϿЀ-ҁ‐-‧‰-⁞€ぁ-ゖァ-ヺ一-龥가-힣]")
    return _here["rules"]


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    """The batch's texts, in runs of bounded bytes; null is empty."""
    values = batch.column(column)
    for first, last in slices(utf8(values)[1]):
        yield first, [x or "" for x in values.slice(first, last - first).to_pylist()]


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find, mark, odd = rules()
    seen: Counter = Counter()
    for batch in batches:
        for _, texts in _texts(batch, 0):
            for text in texts:
                for part in text.split(mark):
                    seen.update(find.findall(part))
            if len(seen) > COUNTER:
                seen = Counter({k: n for k, n in seen.most_common(COUNTER // 2) if len(k) <= SHORT})
    head = [(k, n) for k, n in seen.most_common(HEAD) if len(k) <= SHORT]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in head], pa.string()), pa.array([n for _, n in head], pa.int64())], ["piece", "n"])


def frequent(docs: DataFrame, path: str) -> dict[str, int]:
    """The broadcast tier: token length of the pre-tokens that are frequent over all texts."""
    top = docs.select("text").mapInArrow(_heads, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(FREQUENT)
    pieces = [r.piece for r in top.select("piece").collect()]
    return dict(zip(pieces, (len(e.ids) for e in library(path).encode_batch(pieces, add_special_tokens=False))))


def _counter(path: str, tier, limit: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, mark, odd = rules()
        encode = library(path).encode_batch
        known = dict(tier.value)
        for batch in batches:
            at = utf8(batch.column(1))[1]
            totals: list[int] = []
            for _, texts in _texts(batch, 1):
                pieces = [None if odd.search(text) else [p for part in text.split(mark) for p in find.findall(part)] if mark in text else find.findall(text) for text in texts]
                missing = list(set().union(*(p for p in pieces if p)).difference(known))
                if len(known) + len(missing) > CACHE:
                    known = dict(tier.value)
                    missing = list(set().union(*(p for p in pieces if p)).difference(known))
                known.update(zip(missing, (len(e.ids) for e in encode(missing, add_special_tokens=False))))
                size = known.__getitem__
                totals += [len(encode([text], add_special_tokens=False)[0].ids) if p is None else sum(map(size, p)) + (text.count(mark) if mark in text else 0) for text, p in zip(texts, pieces)]
                for piece in missing:
                    if len(piece) > SHORT:
                        del known[piece]
            n = pa.array(totals, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at[1:] - at[:-1]), n, pa.array([x > limit for x in totals], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return count


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    path = path or vocabulary_path()
    tier = docs.sparkSession.sparkContext.broadcast(frequent(docs, path))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_counter(path, tier, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(session(spark), sf_dir, "documents"))
