"""What a board's files have to carry: the build of commitments, and where the files carry them.

A commitment is an entry with a file, a form native to that file, a function, a section and the terms by which it can be
found. ``placed`` looks for the terms: a board's terms travel as one array beside each of its files (a board has ``LIMIT``
commitments of ``TERMS`` terms at most), so a file's text is read once, and only terms that stand in it become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import DOLLARS, all_matches, checkable_values, dollars
from .drafts import phrases, stripped
from .entries import for_commitment, tag_value
from .text import prose

c = F.col
LIMIT, TERMS, CONTEXT_WORDS, WINDOW = 30, 12, 6, 300
# Words in names of files, by kind; file endings of tables; words of contents that ask for slides or markup.
MEMO, WORKBOOK, TABLE_NAME = ["memo", "analysis", "report", "summary"], ["tracker", "schedule", "inventory", "workbook", "model"], ["model", "workbook", "schedule", "tracker"]
DRAFT, NO_DRAFT = ["draft", "agreement", "contract", "indenture", "lpa"], ["memo", "memorandum", "analysis", "issues", "notes", "summary", "report"]
MARKUP, ASKS_SLIDES, ASKS_MARKUP = ["redline", "markup", "rider"], ["slide", "deck", "presentation"], ["clause", "redline", "markup", "revise"]
TABLES = [".xlsx", ".csv"]
#: What stands in a file of drafting clauses.
CLAUSE_MARKS = ["revised language", "drafting note", "redline", "replace", "insert", "delete", "clause"]
#: Function in a workbook and elsewhere, section in a workbook and elsewhere, by the kind of gap.
BY_GAP = {
    "relation": ("workbook_cross_document_link", "memo_cross_document_link", "Sheet: Cross-Document Analysis", "Cross-Document Analysis"),
    "severity": ("workbook_risk_recommendation", "memo_risk_recommendation", "Sheet: Risk and Recommendations", "Risk and Recommendations"),
    "authority": ("workbook_source_authority", "memo_source_authority", "Sheet: Source Authority", "Source Authority"),
    "source_object": ("workbook_source_object", "memo_source_coverage", "Sheet: Source Coverage", "Source Coverage"),
}


def holds(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def ends(text: Column, endings: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, endings)), lambda w: F.endswith(text, w))


def pick(files: Column, test) -> Column:
    """The first file that passes; null without one."""
    return F.get(F.filter(files, lambda f: test(F.lower(f))), F.lit(0))


def target_file(files: Column, kind: Column, content: Column, gap: Column) -> Column:
    """The first rule that has a file decides; with one file only, it is that one; '' without files."""
    low, memo = F.lower(content), pick(files, lambda f: holds(f, MEMO))
    by_word = F.coalesce(*[pick(files, _has(w)) for w in MEMO])
    rules = [
        F.when(gap.isin("relation", "severity", "authority"), memo),
        F.when(gap == "source_object", F.coalesce(pick(files, lambda f: ends(f, TABLES)), pick(files, lambda f: holds(f, WORKBOOK)))),
        F.when(kind == "calculation", pick(files, lambda f: ends(f, TABLES) | holds(f, TABLE_NAME))),
        F.when(holds(low, ASKS_SLIDES), pick(files, lambda f: F.endswith(f, F.lit(".pptx")) | F.contains(f, F.lit("deck")))),
        F.when(holds(low, ASKS_MARKUP), pick(files, lambda f: holds(f, MARKUP))),
        F.when(gap == "", pick(files, lambda f: holds(f, DRAFT) & ~holds(f, NO_DRAFT))),
        by_word,
    ]
    return F.when(F.size(files) == 0, "").when(F.size(files) == 1, files[0]).otherwise(F.coalesce(*rules, F.get(files, F.lit(0))))


def _has(word: str):
    return lambda f: F.contains(f, F.lit(word))


def native_form(file: Column, kind: Column) -> Column:
    f = F.lower(file)
    drafting = holds(f, MARKUP + DRAFT) & ~holds(f, NO_DRAFT)
    return F.when(ends(f, TABLES), "workbook_row").when(F.endswith(f, F.lit(".pptx")) | F.contains(f, F.lit("deck")), "slide_bullet").when(drafting, "drafting_clause").when(kind == "calculation", "calculation_statement").otherwise("memo_statement")


def function_and_section(file: Column, kind: Column, form: Column, gap: Column) -> tuple[Column, Column]:
    sheet, calculation, f = form == "workbook_row", kind == "calculation", F.lower(file)
    function, section = F.when(form == "drafting_clause", "drafting_clause"), None
    for name, (in_sheet, elsewhere, sheet_section, plain_section) in BY_GAP.items():
        function = function.when(gap == name, F.when(sheet, in_sheet).otherwise(elsewhere))
        choice = F.when(sheet, sheet_section).otherwise(plain_section)
        section = F.when(gap == name, choice) if section is None else section.when(gap == name, choice)
    function = function.when(sheet, F.when(calculation, "workbook_calculation").otherwise("workbook_finding")).when(form == "slide_bullet", "slide_bullet").when(form == "calculation_statement", "memo_calculation")
    function = function.when(F.endswith(f, F.lit(".docx")) | holds(f, ["memo", "report", "analysis"]), "memo_analysis").otherwise("memo_statement")
    section = section.when(sheet, F.when(calculation, "Sheet: Required Calculations").otherwise("Sheet: Required Findings")).when(form == "slide_bullet", "Required Slides").when(form == "drafting_clause", "Required Drafting Changes")
    return function, section.when(calculation, "Required Calculations").otherwise("Required Findings")


def terms_of(content: Column, evidence: Column, most: int = 8) -> Column:
    """Values of the content, then six telling phrases of content and evidence, then short evidence itself; each once."""
    values = F.transform(checkable_values(content), lambda v: v["raw"])
    told = lambda x: F.transform(phrases(x), lambda p: p["phrase"])
    narrative = F.slice(F.array_distinct(F.concat(told(content), told(evidence))), 1, 6)
    whole = F.trim(F.coalesce(evidence, F.lit("")))
    own = F.when((whole != "") & (F.length(whole) <= 140), F.array(whole)).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.concat(values, narrative, own)), 1, most)


def commitments(entries: DataFrame, files: DataFrame, k: int = LIMIT) -> DataFrame:
    """board_id, seq, rank, importance, target_file, native_form, artifact_function, section, terms, source_ref.

    ``entries``: as ``for_commitment`` takes them, with section and evidence (of the source); ``files``: board_id, pos, file. The k
    best active candidates of each board; ``source_ref`` is the document, its section and the evidence, as far as known."""
    named = F.transform(F.array_sort(F.collect_list(F.struct("pos", "file"))), lambda x: x["file"])
    of_board = files.where("file <> ''").groupBy("board_id").agg(F.array_distinct(named).alias("files"))
    rows = for_commitment(entries.where("status = 'active'"), k).join(of_board, "board_id", "left")
    rows = rows.withColumn("files", F.coalesce("files", F.array().cast("array<string>"))).withColumn("gap", tag_value(c("tags"), "debt_type:"))
    rows = rows.withColumn("target_file", target_file(c("files"), c("type"), c("content"), c("gap"))).withColumn("native_form", native_form(c("target_file"), c("type")))
    function, section = function_and_section(c("target_file"), c("type"), c("native_form"), c("gap"))
    critical = F.array_contains("tags", "debt_sensor") | F.array_contains("tags", "materiality:critical") | F.array_contains("tags", "materiality:high")
    ref = F.concat_ws(" / ", "source_doc", F.nullif("section", F.lit("")), F.nullif(F.substring(F.trim("evidence"), 1, 160), F.lit("")))
    return rows.select(
        "board_id", "seq", "rank", F.when(critical, "critical").otherwise("high").alias("importance"), "target_file", "native_form", function.alias("artifact_function"),
        section.alias("section_name"), terms_of(c("content"), c("evidence")).alias("terms"), ref.alias("source_ref"), "content",
    )


def starts_of(text: Column, part: Column) -> Column:
    """Where ``part`` stands in ``text``, from 0, one behind the other; none for an empty part."""
    pieces = F.split(text, F.concat(F.lit("\\Q"), F.regexp_replace(part, r"\\E", ""), F.lit("\\E")), -1)
    none = F.array().cast("array<int>")
    # only the last start is looked at to give the next one
    starts = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), none, lambda a, p: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)) + F.length(part), F.lit(0)) + F.length(p))))
    return F.when(F.length(part) > 0, starts).otherwise(none)


def line_at(text: Column, start: Column) -> Column:
    before = F.substring_index(F.substring(text, F.lit(1), start), "\n", -1)
    return F.concat(before, F.substring_index(F.substring(text, start + 1, F.length(text)), "\n", 1))


def survives(value: Column, text: Column, context: Column) -> Column:
    """Whether a value stands in the prose of a text, with one of the context words (none: any) within 300 characters on
    either side; a dollar amount that doesn't stand there letter by letter survives as an equal amount too."""
    low, v = F.lower(text), F.lower(value)

    def good(start: Column) -> Column:
        first = F.greatest(start - WINDOW, F.lit(0))
        near = F.substring(low, first + 1, start - first + F.length(v) + WINDOW)
        return prose(line_at(low, start)) & ((F.size(context) == 0) | F.exists(context, lambda w: F.contains(near, F.lower(w))))

    amount = dollars(value)
    equal = amount.isNotNull() & ~F.contains(low, F.trim(v)) & F.exists(F.split(low, "\n"), lambda line: prose(line) & F.exists(all_matches(line, DOLLARS), lambda m: F.coalesce(dollars(m) == amount, F.lit(False))))
    return F.coalesce((value != "") & (F.exists(starts_of(low, v), good) | equal), F.lit(False))


def context_terms(text: Column) -> Column:
    """The first six words, letters only, of four letters or more, each once."""
    words = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}]", ""))
    return F.slice(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 4)), 1, CONTEXT_WORDS)


def placed(made: DataFrame, files: DataFrame) -> DataFrame:
    """board_id, seq, traceable, found_in_target, native_form_satisfied, found_elsewhere, evidence, line_no, cause: a row per commitment.

    ``files``: board_id, file, text. Evidence is the first term that survives in the target file (else in the first other file by
    name), with the number of the first line in which it survives on its own, null where it takes several lines. Causes
    of loss: wrong_format, artifact_ambiguous (no terms), native_form_missing, wrong_file, artifact_missing."""
    cut = F.slice(F.filter(F.array_distinct(F.transform("terms", lambda t: stripped(t))), lambda t: t != ""), 1, TERMS)
    own = made.withColumn("terms", cut).withColumn("context", context_terms(c("content")))
    asked = own.select("board_id", F.struct("seq", "terms", "context").alias("ask")).groupBy("board_id").agg(F.collect_list("ask").alias("asks"))
    texts = files.select("board_id", "file", F.coalesce("text", F.lit("")).alias("text"))
    # only what stands in the text, or could as an amount, goes on as a row
    met = texts.join(asked, "board_id").select("board_id", "file", "text", F.explode("asks").alias("ask"))
    may = F.filter(F.transform("ask.terms", lambda t, i: F.struct(i.alias("place"), t.alias("term"))), lambda x: F.contains(F.lower("text"), F.lower(x["term"])) | (dollars(x["term"]).isNotNull() & F.contains("text", F.lit("$"))))
    hits = met.select("board_id", "file", "text", "ask.seq", "ask.context", F.explode(may).alias("m")).where(survives(c("m.term"), c("text"), c("context")))
    first = hits.groupBy("board_id", "seq", "file").agg(F.min("m").alias("m"), F.first("context").alias("context")).join(texts, ["board_id", "file"])
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(survives(c("m.term"), x, c("context")), i))
    low, row = F.lower("text"), F.get(F.split("text", "\n"), c("line_no"))
    sheet = F.endswith(F.lower("file"), F.lit(".csv")) | F.exists(F.split(low, "\n"), lambda x: F.startswith(F.trim(x), F.lit("# sheet:")))
    table_row = (F.contains(row, F.lit("|")) | (F.endswith(F.lower("file"), F.lit(".csv")) & F.contains(row, F.lit(",")))) & ~F.startswith(F.lower(F.trim(row)), F.lit("# sheet:"))
    seen = first.withColumn("line_no", F.array_min(lines)).select(
        "board_id", "seq", "file", c("m.term").alias("evidence"), "line_no", (sheet & F.coalesce(table_row, F.lit(False))).alias("as_row"),
        F.exists(F.split(low, "\n"), lambda x: F.startswith(F.trim(x), F.lit("# slide"))).alias("as_slide"), holds(low, CLAUSE_MARKS).alias("as_clause"),
    )
    both = own.select("board_id", "seq", "target_file", "native_form", (F.size("terms") > 0).alias("traceable")).join(seen, ["board_id", "seq"], "left")
    there = c("file").isNotNull() & ((c("file") == c("target_file")) | (c("target_file") == ""))
    form = F.when(c("native_form") == "workbook_row", c("as_row")).when(c("native_form") == "slide_bullet", c("as_slide")).when(c("native_form") == "drafting_clause", c("as_clause")).otherwise(F.lit(True))
    best = F.min_by(F.struct("evidence", "line_no"), F.struct(~there, "file"))
    rows = both.groupBy("board_id", "seq", "target_file", "native_form", "traceable").agg(
        F.coalesce(F.bool_or(there), F.lit(False)).alias("found_in_target"), F.coalesce(F.bool_or(there & form), F.lit(False)).alias("native_form_satisfied"), F.count("file").alias("_files"), best.alias("b")
    )
    file = F.lower("target_file")
    wrong = F.when(c("target_file") == "", F.lit(False)).when(c("native_form") == "workbook_row", ~ends(file, TABLES)).when(c("native_form") == "slide_bullet", ~F.endswith(file, F.lit(".pptx"))).when(c("native_form") == "drafting_clause", ~holds(file, MARKUP + [".docx"])).otherwise(F.lit(False))
    elsewhere = ~c("found_in_target") & (c("_files") > 0)
    cause = F.when(wrong, "wrong_format").when(~c("traceable"), "artifact_ambiguous").when(c("found_in_target") & c("native_form_satisfied"), None).when(c("found_in_target"), "native_form_missing").when(elsewhere, "wrong_file").otherwise("artifact_missing")
    return rows.select("board_id", "seq", "target_file", "native_form", "traceable", "found_in_target", "native_form_satisfied", elsewhere.alias("found_elsewhere"), "b.evidence", "b.line_no", cause.alias("cause"))
