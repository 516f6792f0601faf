"""Commitments of boards and their places in files."""

from pyspark.sql import functions as F

from ..operators import commitments as C
from .registry import query
from .views import ORDER_TEXT, order_text, table

c = F.col

#: Fixed files by board (conversation): three in four kinds, one, or none.
FILES = ["Issues Memo.docx", "Model.xlsx", "Board Deck.pptx", "Draft Agreement.docx"]
ENTRIES_SQL = f"""e as (select conv_id as board_id, turn as seq, ['calculation', 'analysis', 'strategy', 'gap', 'observation'][turn % 5 + 1] as type, text as content, turn * 7 % 5 as confidence,
 case turn % 6 when 0 then 'relation' when 1 then 'source_object' else '' end as gap, turn % 6 < 2 as sensed, turn % 6 = 2 as critical, turn % 6 = 3 as planned from conversations where turn % 6 <> 5),
due as (select *, case when sensed then 4 when critical then 3 else 0 end + case type when 'calculation' then 4 when 'analysis' then 3 when 'strategy' then 2 when 'observation' then 1 else 0 end as score from e
 where (sensed and type <> 'gap') or critical or planned or (type = 'calculation' and regexp_matches(content, '[0-9]'))),
best as (select *, row_number() over (partition by board_id order by score desc, confidence desc, length(content) desc, seq) as rank from due qualify rank <= 30),
f as (select *, case board_id % 3 when 0 then {FILES!r} when 1 then ['Summary.docx'] else [] end as files, lower(content) as low from best),
t as (select *, case when len(files) = 0 then '' when len(files) = 1 then files[1] when gap = 'relation' then files[1] when gap = 'source_object' then files[2] when type = 'calculation' then files[2]
 when regexp_matches(low, 'slide|deck|presentation') then files[3] when gap = '' then files[4] else files[1] end as target_file from f),
n as (select *, case target_file when 'Model.xlsx' then 'workbook_row' when 'Board Deck.pptx' then 'slide_bullet' when 'Draft Agreement.docx' then 'drafting_clause' else case when type = 'calculation' then 'calculation_statement' else 'memo_statement' end end as native_form from t)"""


def _entries(spark, sf_dir):
    t = c("turn")
    none = F.array().cast("array<string>")
    tags = F.when(t % 6 == 0, F.array(F.lit("debt_sensor"), F.lit("debt_type:relation"))).when(t % 6 == 1, F.array(F.lit("x"), F.lit("debt_sensor"), F.lit("debt_type: Source_Object"))).when(t % 6 == 2, F.array(F.lit("materiality:critical"))).when(t % 6 == 3, F.array(F.lit("plan_coverage_repair"))).otherwise(none)
    kinds = F.array(*map(F.lit, ["calculation", "analysis", "strategy", "gap", "observation"]))
    return table(spark, sf_dir, "conversations").select(
        c("conv_id").alias("board_id"), t.alias("seq"), F.get(kinds, (t % 5).cast("int")).alias("type"), c("text").alias("content"), (t * 7 % 5).alias("confidence"), F.transform(tags, lambda x: F.regexp_replace(F.lower(x), ": ", ":")).alias("tags"),
        F.lit("doc").alias("source_doc"), F.lit("").alias("section"), F.substring_index("text", " ", 6).alias("evidence"), F.when(t % 6 == 5, "disputed").otherwise("active").alias("status"),
    )


def _files(spark, sf_dir):
    boards = table(spark, sf_dir, "conversations").select(c("conv_id").alias("board_id")).distinct()
    names = F.when(c("board_id") % 3 == 0, F.array(*map(F.lit, FILES))).when(c("board_id") % 3 == 1, F.array(F.lit("Summary.docx"))).otherwise(F.array().cast("array<string>"))
    return boards.select("board_id", F.posexplode(names).alias("pos", "file"))


@query("commitments", f"""with {ENTRIES_SQL} select board_id, seq, rank, case when sensed or critical then 'critical' else 'high' end as importance, target_file, native_form,
 case when native_form = 'drafting_clause' then 'drafting_clause' when gap = 'relation' then case when native_form = 'workbook_row' then 'workbook_cross_document_link' else 'memo_cross_document_link' end
  when gap = 'source_object' then case when native_form = 'workbook_row' then 'workbook_source_object' else 'memo_source_coverage' end when native_form = 'workbook_row' then case when type = 'calculation' then 'workbook_calculation' else 'workbook_finding' end
  when native_form = 'slide_bullet' then 'slide_bullet' when native_form = 'calculation_statement' then 'memo_calculation' when target_file like '%.docx' then 'memo_analysis' else 'memo_statement' end as artifact_function,
 case when gap = 'relation' then case when native_form = 'workbook_row' then 'Sheet: Cross-Document Analysis' else 'Cross-Document Analysis' end when gap = 'source_object' then case when native_form = 'workbook_row' then 'Sheet: Source Coverage' else 'Source Coverage' end
  when native_form = 'workbook_row' then case when type = 'calculation' then 'Sheet: Required Calculations' else 'Sheet: Required Findings' end when native_form = 'slide_bullet' then 'Required Slides' when native_form = 'drafting_clause' then 'Required Drafting Changes' when type = 'calculation' then 'Required Calculations' else 'Required Findings' end as section_name
 from n""")
def commitments(spark, sf_dir):
    made = C.commitments(_entries(spark, sf_dir), _files(spark, sf_dir))
    return made.select("board_id", "seq", "rank", "importance", "target_file", "native_form", "artifact_function", "section_name")


@query("placement_trace")
def placement_trace(spark, sf_dir):
    """Commitments of all boards in files that hold every third turn of the board each; tests compare ``placed`` with a plain search."""
    files = _files(spark, sf_dir)
    turns = table(spark, sf_dir, "conversations").select(c("conv_id").alias("board_id"), "turn", "text")
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    texts = turns.groupBy("board_id", (c("turn") % 3).cast("int").alias("pos")).agg(parts.alias("text"))
    return C.placed(C.commitments(_entries(spark, sf_dir), files), files.join(texts, ["board_id", "pos"]).select("board_id", "file", "text"))


@query("value_survives", f"""with {ORDER_TEXT} select o_orderkey, case o_orderkey % 4 when 0 then true when 1 then true when 2 then false else o_orderkey % 40 >= 10 end as survives from order_text""")
def value_survives(spark, sf_dir):
    """Totals as written, as an equal amount in other writing, as another amount; margins near a word that isn't there."""
    k, whole = c("o_orderkey"), F.regexp_extract("text", r"total \$(\d+)", 1)
    value = F.when(k % 4 == 0, F.concat(F.lit("$"), whole)).when(k % 4 == 1, F.concat(F.lit("$"), F.format_number(whole.cast("long"), 0))).when(k % 4 == 2, F.concat(F.lit("$"), (whole.cast("long") + 1).cast("string"), F.lit("9"))).otherwise(F.concat((k % 40).cast("string"), F.lit(".5%")))
    context = F.when((k % 4 == 3) & (k % 40 < 10), F.array(F.lit("nowhere"))).otherwise(F.array(F.lit("MARGIN"), F.lit("else")))
    return order_text(table(spark, sf_dir, "orders")).select("o_orderkey", C.survives(value, c("text"), context).alias("survives"))
