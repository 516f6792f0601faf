"""Drafts against what they rest on: telling phrases, risky lines, documents that gaps ask for, files that are due."""

from __future__ import annotations

import re
from heapq import nsmallest

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import word_markers
from .matching import quote_candidates
from .ranking import top_per_group

# Words that no phrase holds, phrases that tell nothing, words that make a phrase telling.
PHRASE_STOP_WORDS = [
    "about", "above", "after", "again", "against", "also", "because", "before", "being", "between", "cannot", "could", "creating", "depends", "entry",
    "failed", "finding", "findings", "from", "have", "highly", "into", "missing", "must", "only", "other", "remains", "should", "source", "sources",
    "state", "states", "that", "their", "there", "these", "this", "those", "through", "with", "without", "would",
]
LOW_VALUE_PHRASES = ["source backed", "source backed entry", "required findings", "required calculations", "memo statement", "artifact native"]
HINT_WORDS = [
    "automation", "breach", "calculation", "cap", "conflict", "control", "covenant", "deadline", "downtime", "exception", "failure", "guardrail",
    "manual", "mismatch", "pipeline", "reconciliation", "rollback", "safety", "threshold", "unresolved", "variance", "violation",
]
#: Where phrases end, and what a word of a phrase is.
SEGMENT_END, PHRASE_WORD = r"[\n.;:(){}\[\]|]+", "[a-z][a-z0-9'-]*"
_SEGMENTS, _WORDS, _STOPS, _HINTS = re.compile(SEGMENT_END), re.compile(PHRASE_WORD), frozenset(PHRASE_STOP_WORDS), frozenset(HINT_WORDS)
#: Numbers, dates and quarters that a claim rests on; words that don't tell one claim from another.
CLAIM_NUMBERS = r"(?i)\$?\b\d{1,3}(?:,\d{3})*(?:\.\d+)?%?\b|\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b|\bQ[1-4]\b"
CLAIM_STOP_WORDS = ["the", "and", "for", "with", "from", "that", "this", "based", "calculated", "total", "count", "per", "is", "as", "of", "to", "through", "source"]
#: Claims whose lines go.
RISKY_STATUS, RISKY_SEVERITY = ["unsupported", "overstated", "needs_source"], ["critical", "high", "medium"]


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def _told(text: str) -> tuple[set[str], bool]:
    """The phrases of a lower-cased text, and whether any holds a telling word."""
    found: set[str] = set()
    hinted = False
    for segment in _SEGMENTS.split(text):
        words = _WORDS.findall(segment)
        ends = [i for i, w in enumerate(words) if len(w) < 4 or w in _STOPS]
        for start, end in zip([-1, *ends], [*ends, len(words)]):
            if end - start > 2:  # words between two that no phrase holds
                one = words[start + 1 : end]
                two, three = one[1:], one[2:]
                found.update(map(" ".join, zip(one, two)), map(" ".join, zip(one, two, three)), map(" ".join, zip(one, two, three, one[3:])))
                hinted = hinted or not _HINTS.isdisjoint(one)
                found.difference_update(" ".join([w] * n) for w, x in zip(one, two) if w == x for n in (2, 3, 4))
    found.difference_update(LOW_VALUE_PHRASES)
    return found, hinted


def _hints(phrase: str) -> int:
    """What the telling words of a phrase add to its score."""
    n = sum(w in _HINTS for w in phrase.split(" "))
    return n * 10 + 8 if n else 0


def phrases(text: Column, k: int = 10) -> Column:
    """Array of (phrase, score): the k most telling runs of two to four words of a text, best first, ties by the phrase.

    Runs stay inside a segment, hold no stop word and no word under four letters, and are not one word repeated.
    A projection of the row alone: nothing is shuffled. A null text has none."""

    def best(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            found, hinted = _told(t)
            plain = [((gaps := p.count(" ")) * 5 + 5 + min(len(p) - gaps, 40), p) for p in found if len(p) <= 90]
            scored = [(-n - _hints(p), p) for n, p in plain] if hinted else [(-n, p) for n, p in plain]
            out.append([{"phrase": p, "score": -below} for below, p in nsmallest(k, scored)])
        return pd.Series(out, dtype=object)

    # lower-cased by Spark, as its letters decide
    return F.pandas_udf(best, "array<struct<phrase string, score bigint>>")(F.lower(F.coalesce(text, F.lit(""))))


def claim_numbers(claim: Column, most: int = 8) -> Column:
    """The first numbers, dates and quarters of a claim, lower-cased, each once."""
    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(claim, F.lit(CLAIM_NUMBERS), 0), F.lower)), 1, most)


def without_risky_lines(texts: DataFrame, claims: DataFrame) -> DataFrame:
    """text_id, text, quarantined (long): drafts whose lines that state a risky claim of their own report are replaced by a mark.

    ``texts``: text_id, text; ``claims``: text_id, seq, claim, status, severity, those reported for that text. A line
    states a claim if one holds the other in any case, or if the line holds all of the claim's numbers (one at
    least) and three of its words (all, if it has fewer). The first such claim by seq gives the mark its status.
    A report travels as one array beside its text, so lines and claims are never paired as rows. Blank lines and
    blank claims match nothing; lines end at \\n; a null text is empty."""
    risky = claims.withColumn("claim", stripped(F.col("claim"))).where(F.col("status").isin(RISKY_STATUS) & F.col("severity").isin(RISKY_SEVERITY) & (F.col("claim") != ""))
    marked = risky.select("text_id", F.struct("seq", "status", F.lower("claim").alias("claim"), claim_numbers(F.col("claim")).alias("numbers"), word_markers(F.col("claim"), CLAIM_STOP_WORDS).alias("words")).alias("r"))
    reports = marked.groupBy("text_id").agg(F.sort_array(F.collect_list("r")).alias("_risky"))

    def states(line: Column, r: Column) -> Column:
        words = F.size(F.filter(r["words"], lambda w: F.contains(line, w)))
        numbers = (F.size(r["numbers"]) > 0) & F.forall(r["numbers"], lambda n: F.contains(line, n))
        return F.contains(line, r["claim"]) | F.contains(r["claim"], line) | (numbers & (words >= F.least(F.lit(3), F.size(r["words"]))))

    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.struct(x.alias("line"), F.lower(stripped(x)).alias("low")))
    first = lambda x: F.when(x["low"] != "", F.get(F.filter(F.col("_risky"), lambda r: states(x["low"], r)), F.lit(0))["status"])
    judged = F.when(F.col("_risky").isNull(), F.transform(lines, lambda x: F.struct(x["line"].alias("line"), F.lit(None).cast("string").alias("status")))).otherwise(
        F.transform(lines, lambda x: F.struct(x["line"].alias("line"), first(x).alias("status")))
    )
    out = texts.select("text_id", "text").join(reports, "text_id", "left").select("text_id", judged.alias("_lines"))
    mark = lambda s: F.concat(F.lit("[SOURCE-CHECK QUARANTINED: "), s, F.lit(" final-output claim removed; see Source Support Caveats]"))
    kept = F.array_join(F.transform("_lines", lambda x: F.coalesce(mark(x["status"]), x["line"])), "\n")
    return out.select("text_id", kept.alias("text"), F.size(F.filter("_lines", lambda x: x["status"].isNotNull())).cast("long").alias("quarantined"))


def target_documents(items: DataFrame, docs: DataFrame, k: int = 3) -> DataFrame:
    """item_id, name, place: the first k documents of its board that a gap asks for.

    ``items``: item_id, board_id, requested and parents (arrays of names); ``docs``: board_id, name, place. A document
    is asked for if its name holds a requested one or is held by it, or if it is a parent's, in any case. An item
    that names nothing takes the board's first. Blank and null names name nothing. Names are matched once for all
    boards, through the rarest run of the one inside the other, so no board pairs its items with its documents."""
    c = F.col
    names = lambda a: F.array_distinct(F.filter(F.transform(F.coalesce(c(a), F.array().cast("array<string>")), F.lower), lambda n: F.trim(n) != ""))
    asked = items.select("item_id", "board_id", names("requested").alias("requested"), names("parents").alias("parents"))
    known = docs.select("board_id", "name", "place", F.lower("name").alias("low"))
    wanted = asked.select("item_id", "board_id", F.explode("requested").alias("want"))
    wants, lows = wanted.select("want").distinct(), known.where("trim(low) <> ''").select("low").distinct()
    as_quotes = lambda df, n: df.select(c(n).alias("quote_id"), c(n).alias("quote"))
    as_texts = lambda df, n: df.select(c(n).alias("text_id"), c(n).alias("text"))
    inside = quote_candidates(as_quotes(wants, "want"), as_texts(lows, "low")).select(c("quote_id").alias("want"), c("text_id").alias("low"))
    around = quote_candidates(as_quotes(lows, "low"), as_texts(wants, "want")).select(c("text_id").alias("want"), c("quote_id").alias("low"))
    pairs = inside.unionByName(around).where(F.contains("low", "want") | F.contains("want", "low")).distinct()
    by_name = wanted.join(pairs, "want").join(known, ["board_id", "low"]).select("item_id", "name", "place")
    by_parent = asked.select("item_id", "board_id", F.explode("parents").alias("low")).join(known, ["board_id", "low"]).select("item_id", "name", "place")
    first = top_per_group(known, ["board_id"], [c("place"), c("name")], k).select("board_id", "name", "place")
    untold = asked.where((F.size("requested") == 0) & (F.size("parents") == 0)).join(first, "board_id").select("item_id", "name", "place")
    found = by_name.unionByName(by_parent).unionByName(untold).distinct()
    return top_per_group(found, ["item_id"], [c("place"), c("name")], k).select("item_id", "name", "place")


def due_texts(expected: DataFrame, files: DataFrame) -> DataFrame:
    """board_id, file, text, exists: one row per file that is due; a file that isn't there, or has no text, is empty.

    ``expected``: board_id, file; ``files``: board_id, file, text. Of several readings of a file the largest text counts."""
    there = files.groupBy("board_id", "file").agg(F.max("text").alias("text"), F.lit(True).alias("exists"))
    found = expected.select("board_id", "file").distinct().join(there, ["board_id", "file"], "left")
    return found.select("board_id", "file", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("exists", F.lit(False)).alias("exists"))
