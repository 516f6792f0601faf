"""Entries of boards: priorities, clean-up of reported items, placement of rows in files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import first_wins
from .ranking import top_per_group

#: Points of an entry's type in four rankings.
CALC_POINTS = {"calculation": 5, "analysis": 4, "strategy": 3, "gap": 3, "observation": 2}
GAP_POINTS = {"analysis": 4, "calculation": 4, "gap": 3, "strategy": 2, "observation": 1}
COMMIT_POINTS = {"calculation": 4, "analysis": 3, "strategy": 2, "observation": 1}
MAINTENANCE_POINTS = {"analysis": 5, "calculation": 5, "gap": 4, "strategy": 3, "observation": 2}
#: What a gap must ask for to be repaired, most urgent first.
REPAIRABLE = ["calculate", "compare", "reference_framework", "severity", "recommendation"]
GAP_TYPES = ["relation", "source_object", "severity", "authority"]
AUDIT_STATUS = ["supported", "unsupported", "overstated", "needs_source"]
LEVELS = ["critical", "high", "medium", "low"]


def points(kind: Column, table: dict[str, int], other: int) -> Column:
    """The table's points, or ``other``."""
    found = F.lit(None).cast("int")
    for name, value in table.items():
        found = F.when(kind == name, value).otherwise(found)
    return F.coalesce(found, F.lit(other))


def tagged(tags: Column, *prefixes: str) -> Column:
    """True if a tag starts with one of the prefixes; false without tags."""
    hit = lambda t: F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(t, p))
    return F.coalesce(F.exists(tags, hit), F.lit(False))


def tag_value(tags: Column, prefix: str) -> Column:
    """What follows the prefix in the first tag that has it, lower-cased; else empty."""
    found = F.get(F.filter(tags, lambda t: F.startswith(t, F.lit(prefix))), F.lit(0))
    return F.lower(F.coalesce(F.substring(found, len(prefix) + 1, 1 << 20), F.lit("")))


def for_calculation(entries: DataFrame, k: int = 120) -> DataFrame:
    """The k entries of each board most worth an arithmetic check; ties by place."""
    score = points(F.col("type"), CALC_POINTS, 1) + F.when(F.col("content").rlike("[0-9]"), 2).otherwise(0)
    return top_per_group(entries.withColumn("score", score), ["board_id"], [F.desc("score"), F.desc("confidence"), F.col("seq")], k)


def for_gaps(entries: DataFrame, k: int = 140) -> DataFrame:
    """The k active entries of each board that gap sensing looks at."""
    score = points(F.col("type"), GAP_POINTS, 0) + F.when(tagged(F.col("tags"), "state_conversion", "plan_coverage", "missing_work:", "materiality:"), 2).otherwise(0) + F.when(F.size("supports") > 0, 1).otherwise(0)
    active = entries.where("status = 'active'").withColumn("score", score)
    return top_per_group(active, ["board_id"], [F.desc("score"), F.desc("confidence"), F.desc(F.length("content")), F.col("seq")], k)


def for_commitment(entries: DataFrame, k: int = 30) -> DataFrame:
    """The k sourced entries of each board that a deliverable has to carry."""
    tags, sensed = F.col("tags"), F.coalesce(F.array_contains("tags", "debt_sensor"), F.lit(False))
    due = (sensed & (F.col("type") != "gap")) | tagged(tags, "state_conversion", "plan_coverage", "missing_work:", "materiality:critical", "materiality:high") | ((F.col("type") == "calculation") & F.col("content").rlike("[0-9]"))
    weight = F.when(sensed, 4).when(F.array_contains(tags, "materiality:critical"), 3).when(F.array_contains(tags, "materiality:high"), 2).otherwise(0)
    found = entries.where(F.col("source_doc").isNotNull() & due).withColumn("score", weight + points(F.col("type"), COMMIT_POINTS, 0))
    return top_per_group(found, ["board_id"], [F.desc("score"), F.desc("confidence"), F.desc(F.length("content")), F.col("seq")], k)


def for_maintenance(entries: DataFrame, k: int = 180) -> DataFrame:
    """The k active entries of each board to compact next; what came from compaction stands back."""
    kept = entries.where("status = 'active' and length(trim(content)) >= 30").where(F.col("type").isin(*MAINTENANCE_POINTS))
    score = points(F.col("type"), MAINTENANCE_POINTS, 1) + F.when(F.col("source_doc").isNotNull(), 2).otherwise(0) + F.when(F.size("supports") > 0, 1).otherwise(0) - F.when(F.array_contains("tags", "blackboard_maintenance"), 4).otherwise(0)
    return top_per_group(kept.withColumn("score", score), ["board_id"], [F.desc("score"), F.desc("confidence"), F.desc(F.least(F.length("content"), F.lit(1200))), F.col("seq")], k)


def audit_items(items: DataFrame, k: int = 50) -> DataFrame:
    """Reported claims of 12 characters at least, one per first 180 characters, status and severity repaired, the first k of a board."""
    claim = F.trim("claim")
    known = items.withColumn("claim", claim).where("length(claim) >= 12").withColumn("_key", F.lower(F.substring("claim", 1, 180)))
    one = first_wins(known, ["board_id", "_key"], [F.col("seq")]).drop("_key")
    fixed = lambda name, allowed, other: F.when(F.lower(F.trim(name)).isin(*allowed), F.lower(F.trim(name))).otherwise(other)
    one = one.withColumns({"status": fixed("status", AUDIT_STATUS, "needs_source"), "severity": fixed("severity", LEVELS, "medium")})
    return top_per_group(one, ["board_id"], [F.col("seq")], k)


def gap_items(items: DataFrame) -> DataFrame:
    """Reported gaps of a known type with a reason of 10 characters at least, one per type, subtype, parents and reason; 0.7 makes one actionable."""
    clean = items.withColumns({"subtype": F.coalesce(F.nullif(F.trim("subtype"), F.lit("")), F.lit("unknown")), "reason": F.trim("reason"), "confidence": F.coalesce("confidence", F.lit(0.0))})
    clean = clean.where(F.col("type").isin(*GAP_TYPES) & (F.length("reason") >= 10)).withColumns({"_parents": F.array_join(F.array_sort("parents"), ","), "_reason": F.substring("reason", 1, 120)})
    one = first_wins(clean, ["board_id", "type", "subtype", "_parents", "_reason"], [F.col("seq")]).drop("_parents", "_reason")
    return one.withColumn("status", F.when(F.col("confidence") >= 0.7, "actionable_gap").otherwise("diagnostic_only"))


def repair_gaps(entries: DataFrame, k: int) -> DataFrame:
    """Gaps in plan coverage to repair first: by materiality, kind of work, id."""
    tags = F.col("tags")
    found = entries.where((F.col("type") == "gap") & F.array_contains(tags, "plan_coverage")).withColumns({"materiality": tag_value(tags, "materiality:"), "work": tag_value(tags, "missing_work:")})
    found = found.where(F.col("materiality").isin("critical", "high") & F.col("work").isin(*REPAIRABLE))
    order = [F.when(F.col("materiality") == "critical", 0).otherwise(1), F.array_position(F.array(*map(F.lit, REPAIRABLE)), F.col("work")), F.col("id")]
    return top_per_group(found, ["board_id"], order, k)


def placements(rows: DataFrame, file_terms: DataFrame, files: DataFrame) -> DataFrame:
    """row_id, found, failure_mode of critical and high rows: is one of a row's terms in its file, elsewhere, or nowhere?

    ``rows``: row_id, board_id, importance, target_file (null: any), terms; ``file_terms``: board_id, file,
    term, the distinct terms that each file holds; ``files``: board_id, file."""
    asked = rows.where(F.col("importance").isin("critical", "high"))
    terms = asked.select("row_id", "board_id", "target_file", F.explode(F.array_distinct("terms")).alias("term"))
    hits = terms.join(file_terms, ["board_id", "term"]).groupBy("row_id").agg(F.bool_or(F.col("file") == F.col("target_file")).alias("here"), F.lit(True).alias("anywhere"))
    known = files.select("board_id", F.col("file").alias("target_file"), F.lit(True).alias("exists")).distinct()
    here, anywhere = F.coalesce("here", F.lit(False)), F.coalesce("anywhere", F.lit(False))
    untold = F.col("target_file").isNull()
    mode = (
        F.when(F.coalesce(F.size("terms"), F.lit(0)) <= 0, "no_verification_terms")
        .when(here | (untold & anywhere), F.lit(None))
        .when(untold, "content_missing")
        .when(anywhere, "wrong_file")
        .when(F.col("exists").isNull(), "artifact_missing")
        .otherwise("content_missing")
    )
    return asked.join(hits, "row_id", "left").join(known, ["board_id", "target_file"], "left").select("row_id", "board_id", mode.isNull().alias("found"), mode.alias("failure_mode"))


#: Fixed values. Words that don't tell one section name from another.
SECTION_STOP_WORDS = ["the", "a", "an", "of", "in", "for", "and", "or", "to", "with", "on", "by", "from", "key", "main", "general", "additional", "other", "summary", "overview", "section", "details"]
#: Fixed values. Plural endings in the order they are tried: pattern, what stands in its place; the pattern holds the least length.
PLURALS = [("^(..+)ies$", "$1y"), ("^(..+s)es$", "$1"), ("^(..+[^s])s$", "$1")]


def stemmed(word: Column) -> Column:
    """The word with the first plural ending of PLURALS that it has replaced."""
    out = word
    for pattern, put in reversed(PLURALS):
        out = F.when(word.rlike(pattern), F.regexp_replace(word, pattern, put)).otherwise(out)
    return out


def mentions(texts: DataFrame, names: DataFrame, least: int = 4) -> DataFrame:
    """(id, name) of the names of ``least`` characters that a text holds on word boundaries, in any case.

    Runs of as many words as names have meet in an equi join, then the full pattern decides. A name without a
    word has a word on either side, so it is all that stands between two words.
    """
    known = names.where(F.length("name") >= least).withColumn("words", F.size(words_of(F.col("name")))).withColumn("run", F.when(F.col("words") == 0, F.lower("name")).otherwise(F.array_join(words_of(F.col("name")), " ")))
    lengths = sorted(r["words"] for r in known.select("words").distinct().collect() if r["words"] is not None) or [1]
    runs = F.flatten(F.array(*(ngrams_of(F.col("text"), n) if n else F.regexp_extract_all(F.lower("text"), F.lit(r"(\W+)"), 1) for n in lengths)))
    found = texts.select("id", F.explode(F.array_distinct(runs)).alias("run")).join(known, "run").select("id", "name").distinct()
    pattern = F.concat(F.lit(r"(?i)\b\Q"), "name", F.lit(r"\E\b"))
    return found.join(texts.select("id", "text"), "id").where(F.regexp_like("text", pattern)).select("id", "name")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\w+)"), 1)


def ngrams_of(text: Column, n: int) -> Column:
    w = words_of(text)
    at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " "))


def resolution_atoms(atoms: DataFrame, scope: DataFrame, targets: DataFrame, kinds: list[str]) -> DataFrame:
    """target_id, atom_id, kind: atoms of a known kind inside the scope, one per id; a target without one gets a gap atom."""
    live = atoms.where(F.col("kind").isin(*kinds)).join(scope, "atom_id", "left_semi")
    one = first_wins(live, ["target_id", "atom_id"], [F.col("seq"), F.col("kind")]).select("target_id", "atom_id", "kind")
    bare = targets.select("target_id").join(one.select("target_id").distinct(), "target_id", "left_anti")
    return one.unionByName(bare.withColumn("kind", F.lit("gap")), allowMissingColumns=True)
