"""Boards out of snapshots, field by field; what workers hand in.

A snapshot is one VARIANT per board. Each of its six tables is a list of objects in it; every field is read by its own path and
repaired on its own: text from whatever is there, whole and real numbers from what can be made one, flags by truth, spans
from two whole numbers, lists with their members as text. What is missing, null or out of form takes the field's default,
and objects that are none are left out. Positions are kept, as the order of a list is the order of the board.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.reports import field, truthy, whole

c = F.col
# The fields of the six tables with their defaults, by kind of field.
TEXT, LIST, WHOLE, REAL, FLAG, SPAN = "text", "list", "whole", "real", "flag", "span"
TABLES = {
    "sources": {"id": (TEXT, ""), "name": (TEXT, ""), "path": (TEXT, ""), "kind": (TEXT, "document"), "size_bytes": (WHOLE, 0), "read_status": (TEXT, "unread"), "relevance": (TEXT, "unknown"), "relevance_reason": (TEXT, "")},
    "claims": {
        "id": (TEXT, ""), "kind": (TEXT, "observation"), "content": (TEXT, ""), "source_doc": (TEXT, None), "source_section": (TEXT, None), "evidence": (TEXT, ""), "source_span": (SPAN, None), "support_refs": (LIST, None), "contradicts_refs": (LIST, None),
        "target_refs": (LIST, None), "confidence": (REAL, 0.6), "verified": (FLAG, None), "superseded": (FLAG, False), "iteration": (WHOLE, 0), "created_by": (TEXT, ""),
    },
    "targets": {"id": (TEXT, ""), "need": (TEXT, ""), "materiality": (TEXT, "medium"), "status": (TEXT, "open"), "reason": (TEXT, ""), "claim_refs": (LIST, None), "created_iteration": (WHOLE, 0), "resolved_iteration": (WHOLE, None), "proposed_by": (TEXT, "seed"), "closure_basis": (LIST, None)},
    "obligations": {"id": (TEXT, ""), "text": (TEXT, ""), "origin": (TEXT, "instruction"), "coverage": (TEXT, "material"), "mandatory": (FLAG, True), "status": (TEXT, "open"), "reason": (TEXT, "")},
    "units": {"id": (TEXT, ""), "name": (TEXT, ""), "obligation_ref": (TEXT, ""), "anchor": (TEXT, ""), "claim_refs": (LIST, None), "status": (TEXT, "discovered"), "reason": (TEXT, "")},
    "events": {"iteration": (WHOLE, 0), "kind": (TEXT, ""), "summary": (TEXT, ""), "model": (TEXT, ""), "tokens": (WHOLE, 0), "tokens_in": (WHOLE, 0), "tokens_out": (WHOLE, 0)},
}
#: Kinds of findings; openings of findings of nothing; operators of a calculation; characters of a finding.
KINDS = ["observation", "analysis", "calculation", "strategy", "contradiction", "gap"]
NOTHING_FOUND = [
    "does not contain", "no mention of", "not found in", "the document does not", "there is no", "the provided text does not",
    "no information about", "the text does not", "no evidence of", "no reference to", "this document does not",
]
OPERATORS = ["=", "+", "×", "*", "/", "%", "−"]
LEAST = 20


def texts(v: Column, path: str) -> Column:
    """The members of a list as text; none where there is no list."""
    members = F.transform(field(v, path, "array<variant>"), lambda x: F.try_variant_get(x, "$", "string"))
    return F.coalesce(F.array_compact(members), F.array().cast("array<string>"))


def span(v: Column, path: str) -> Column:
    """(start, end) of a list of two whole numbers; null for anything else."""
    ends = F.transform(field(v, path, "array<variant>"), lambda x: F.try_variant_get(x, "$", "long"))
    good = (F.size(ends) == 2) & ~F.exists(ends, lambda x: x.isNull())
    return F.when(good, F.struct(F.get(ends, F.lit(0)).alias("start"), F.get(ends, F.lit(1)).alias("end")))


def repaired(v: Column, path: str, kind: str, default) -> Column:
    if kind == TEXT:
        return F.coalesce(field(v, path, "string"), F.lit(default).cast("string"))
    if kind == WHOLE:
        return field(v, path, "long") if default is None else whole(v, path, default)
    if kind == REAL:
        return F.coalesce(field(v, path, "double"), F.lit(default))
    if kind == LIST:
        return texts(v, path)
    if kind == SPAN:
        return span(v, path)
    there = F.schema_of_variant(field(v, path, "variant")) != "VOID"
    return F.when(there, truthy(v, path)).otherwise(F.lit(default).cast("boolean"))


def board_table(boards: DataFrame, name: str) -> DataFrame:
    """board_id, pos and the fields of one of ``TABLES``. ``boards``: board_id, snapshot (VARIANT)."""
    rows = boards.select("board_id", F.posexplode(field(c("snapshot"), name, "array<variant>")).alias("pos", "item")).where(F.schema_of_variant("item").startswith("OBJECT"))
    return rows.select("board_id", "pos", *[repaired(c("item"), key, kind, default).alias(key) for key, (kind, default) in TABLES[name].items()])


def findings(replies: DataFrame, sources: DataFrame) -> DataFrame:
    """reply_id, pos, kind, content, source, confidence, tags, outcome of what workers hand in.

    ``replies``: reply_id, board_id, reply (VARIANT with ``findings``); ``sources``: board_id, source (known names). Unknown kinds are
    observations; confidence is held inside 0 to 1, 0.6 where out of form; tags that are no text are left out. Outcomes: too_short
    (under 20 characters), refused (an observation that names an unknown source), gap (any other kind that does: it becomes a
    gap without a source, to be looked into), kept. A finding that names no source is kept; the gate judges it."""
    rows = replies.select("reply_id", "board_id", F.posexplode(field(c("reply"), "findings", "array<variant>")).alias("pos", "item")).where(F.schema_of_variant("item").startswith("OBJECT"))
    kind = field(c("item"), "type", "string")
    tags = F.filter(field(c("item"), "tags", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    read = rows.select(
        "reply_id", "board_id", "pos", F.when(kind.isin(KINDS), kind).otherwise("observation").alias("kind"), F.trim(F.coalesce(field(c("item"), "content", "string"), F.lit(""))).alias("content"), F.nullif(field(c("item"), "source_document", "string"), F.lit("")).alias("source"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(field(c("item"), "confidence", "double"), F.lit(0.6)))).alias("confidence"), F.coalesce(F.transform(tags, lambda x: F.try_variant_get(x, "$", "string")), F.array().cast("array<string>")).alias("tags"),
    )
    known = sources.select("board_id", "source", F.lit(True).alias("known")).distinct()
    seen = read.join(known, ["board_id", "source"], "left")
    lost = c("known").isNull() & c("source").isNotNull()
    outcome = F.when(F.length("content") < LEAST, "too_short").when(lost & (c("kind") == "observation"), "refused").when(lost, "gap").otherwise("kept")
    gap = outcome == "gap"
    return seen.select("reply_id", "pos", F.when(gap, "gap").otherwise(c("kind")).alias("kind"), "content", F.when(~gap, c("source")).alias("source"), "confidence", "tags", outcome.alias("outcome"))


def passes_gate(kind: Column, content: Column, source: Column, answers: Column | None = None) -> Column:
    """Whether a finding is worth a place: 20 characters, an observation sourced, a calculation with two digits and an operator,
    and no observation of having found nothing (unless it ``answers`` a question)."""
    low = F.lower(F.trim(content))
    noise = F.exists(F.array(*map(F.lit, NOTHING_FOUND)), lambda x: F.startswith(low, x)) & ~(F.lit(False) if answers is None else F.coalesce(answers, F.lit(False)))
    computed = (F.regexp_count(content, F.lit("[0-9]")) >= 2) & F.exists(F.array(*map(F.lit, OPERATORS)), lambda x: F.contains(content, x))
    observed = kind == "observation"
    ok = (F.length(F.trim(content)) >= LEAST) & (~observed | (source.isNotNull() & ~noise)) & ((kind != "calculation") | computed)
    return F.coalesce(ok, F.lit(False))
