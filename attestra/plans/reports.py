"""Roll-ups of life-cycle reports, scans and sinks of run folders.

A task is 500 consecutive order keys; its reports are composed from its orders, with fields out of form. The SQL works
the figures out from the orders, without any JSON.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import reports as R
from ..sources import folders as D
from ..sources.shared import shared_folder
from .registry import query
from .views import table

c = F.col
TASK = 500


def _orders(spark, sf_dir) -> DataFrame:
    k = c("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.floor(k / TASK).alias("t"), k.alias("k"), "o_orderstatus", "o_orderpriority")


def _json(**fields: Column | str) -> Column:
    """A JSON object of JSON texts, without the fields whose text is null."""
    return F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), v if isinstance(v, Column) else F.lit(v)) for k, v in fields.items()]), F.lit("}"))


def _s(x: Column) -> Column:
    return F.concat(F.lit('"'), x.cast("string"), F.lit('"'))


def _n(x: Column) -> Column:
    return x.cast("string")


def _texts(spark, sf_dir) -> tuple[DataFrame, dict[str, Column]]:
    """Tasks with their lists of items, and the text of each kind of report over them."""
    k, status = c("k"), c("o_orderstatus")
    created = F.when(k % 3 == 0, '["e1", "e2"]').otherwise("[]")
    gap = _json(id=_s(F.concat(F.lit("d"), k)), type=F.when(k % 11 != 0, _s(c("o_orderpriority"))), status=F.when(status == "F", '"executed"').when(status == "O", '"actionable_gap"'), created_entry_ids=created)
    trace = _json(
        commitment_source=F.when(k % 5 != 0, '"debt_sensor"').otherwise('"derived"'), debt_sensor_id=_s(F.concat(F.lit("d"), k)), derived_work_id=_s(F.concat(F.lit("w"), k)),
        obligated=F.when(k % 4 == 0, "true").otherwise("0"), found_in_artifact=F.when(k % 8 == 0, '"yes"').otherwise("null"), death_mode=F.when(k % 6 == 0, '"dropped"').when(k % 6 == 2, '"merged"').otherwise('""'),
    )
    work = _json(id=_s(F.concat(F.lit("w"), k)), execution_eligible=F.when(k % 3 != 0, "1").otherwise("[]"), status=F.when(status == "P", '"executed"').when(status == "O", '"skipped"').otherwise("null"), created_entry_ids=created, death_mode=F.when(k % 10 == 0, '"own"'))
    placed = _json(
        target_file=F.when(k % 2 == 1, '"f.docx"').otherwise('""'), placement_traceable=F.when(k % 3 == 0, "true").otherwise("false"), found_in_target_file=F.when(k % 4 == 0, "1").otherwise("0.0"), native_form_satisfied=F.when(k % 8 == 0, "{\"x\": 1}").otherwise("{}"),
        found_elsewhere=F.when(k % 5 == 0, "true"), death_mode=F.when(k % 6 == 0, '"lost_in_draft"'), native_form=F.when(k % 7 != 0, _s(status)),
    )
    listed = lambda item: F.concat(F.lit("["), F.array_join(F.collect_list(item), ", "), F.lit(', "no object", null]'))
    by = _orders(spark, sf_dir).groupBy("t").agg(F.count(F.lit(1)).alias("n"), listed(gap).alias("gaps"), listed(F.when(k % 2 == 0, trace)).alias("traces"), listed(work).alias("works"), listed(placed).alias("places"))
    t, n = c("t"), c("n")
    texts = {
        "debt_sensors": _json(
            mode='"full"', items=c("gaps"), summary=F.when(t % 4 == 0, '{"selected": "7", "actionable": 3.9, "type_counts": {}, "status_counts": {"x": "4", "y": "bad"}}').when(t % 4 == 1, '"broken"'), relation_execution_summary=F.when(t % 5 == 0, '{"entries_created": 2}').when(t % 5 == 1, "[]"),
            created_severity_entry_ids=F.when(t % 5 == 1, '["a", "b", "c"]'), created_gap_entry_ids=F.when(t % 2 == 0, '["a", "b"]').otherwise("null"), lens_coordinator=F.when(t % 3 == 1, '{"selected_actionable": "4", "deferred": true}').when(t % 3 == 2, "{}"),
        ),
        R.TRACE: _json(items=c("traces")),
        "derived_work_items": _json(items=c("works")),
        "artifact_placement_trace": _json(items=c("places"), summary=F.when(t % 2 == 0, '{"selected": "5", "lost": 2, "death_modes": {"x": 1}}')),
        "source_custody": F.when(t % 6 == 5, '{"summary": [], "audits": "none"}').otherwise(_json(summary=_json(entries_quarantined=_n(n), invalid_documents=_json(a=_n(t % 3), b='"x"'), reasons=_json(unknown_name=_s(n))), audits='[1, 1, 1]')),
        "prompt_audit": _json(summary=_json(records=F.when(t % 2 == 1, _s(n)), forbidden_provenance_hits=_n(t % 3), forbidden_text_hits=F.when(t % 4 == 0, '"bad"').otherwise(_n(t % 5)), stages=_json(plan=_n(n), write='"2"')), records="[1, 2, 3]"),
        "blackboard_maintenance": _json(
            mode='"m"', candidate_entry_count=_n(n), created_entry_ids='["a", "b"]',
            summary=_json(consolidations_selected=_n(t % 5), entries_superseded='"3"', fallback_used=F.when(t % 2 == 0, '"yes"').otherwise("0"), fallback_cluster_count=_n(t % 3), state_quality=_json(before='{"state_mix_score": 0.25}', after='{"state_mix_score": "0.5"}', delta=_json(state_mix_score=_n((t % 3 - 1) / 4), reasoning_density="0.125", gap_density='"oops"'), compaction_ratio="0.5")),
        ),
        "source_claim_verification": _json(mode='"x"', summary=_json(files_checked="2", claims_checked=_n(n), risky_claims=_n(t % 4), status_counts=_json(ok=_n(n)), severity_counts=_json(high=_n(t % 4))), files=F.concat(F.lit('[{"fallback_used": true, "fallback_candidate_count": '), _n(t % 3), F.lit(', "evidence_entry_count": "4"}, "no object", {"fallback_used": 0, "fallback_candidate_count": 1.9, "evidence_entry_count": null}]'))),
    }
    return by, texts


def report_texts(spark, sf_dir) -> DataFrame:
    """t, kind, text."""
    by, texts = _texts(spark, sf_dir)
    return by.select("t", F.explode(F.map_from_arrays(F.array(*map(F.lit, texts)), F.array(*texts.values()))).alias("kind", "text"))


def _reports(spark, sf_dir) -> DataFrame:
    """A part for each kind: a roll-up composes only the reports of the kinds that it reads."""
    by, kinds = _texts(spark, sf_dir)
    texts = reduce(DataFrame.unionByName, [by.select("t", F.lit(kind).alias("kind"), text.alias("text")) for kind, text in kinds.items()])
    return texts.select(c("t").cast("string").alias("task_id"), "kind", F.parse_json("text").alias("report"))


def _shown(rollup: DataFrame) -> DataFrame:
    """Maps as sorted JSON text, to be compared."""
    maps = [f.name for f in rollup.schema.fields if f.dataType.typeName() == "map"]
    return rollup.select(*[R.sorted_json(c(x)).alias(x) if x in maps else c(x) for x in rollup.columns])


def _map_sql(rows: str, key: str, name: str) -> str:
    """A count map per task as sorted JSON text."""
    return f"{name} as (select t, '{{' || string_agg('\"' || key || '\": ' || n, ', ' order by key) || '}}' as {name} from (select t, {key} as key, count(*) as n from {rows} where {key} is not null group by all) group by t)"


BASE = f"o as (select o_orderkey // {TASK} as t, o_orderkey as k, o_orderstatus as st, o_orderpriority as pr from orders), tasks as (select t, count(*) as n from o group by t)"
DEBT_SQL = f"""with {BASE},
i as (select t, k, case when k % 11 <> 0 then pr else 'unknown' end as type, case st when 'F' then 'executed' when 'O' then 'actionable_gap' else 'unknown' end as status, k % 3 = 0 as made, k % 2 = 0 and k % 5 <> 0 as traced from o),
j as (select *, traced and k % 4 = 0 as obligated, traced and k % 8 = 0 as found, case when traced and k % 6 = 0 then 'dropped' when traced and k % 6 = 2 then 'merged' end as mode from i),
a as (select t, count(*) as n, count(*) filter (status = 'actionable_gap') as act, count(*) filter (status = 'actionable_gap' and not made) as unresolved, count(*) filter (obligated) as obligated, count(*) filter (found) as survived, count(*) filter (not found and made) as lost from j group by t),
{_map_sql("j", "type", "types")}, {_map_sql("j", "status", "statuses")}, {_map_sql("j", "mode", "modes")}
select cast(a.t as varchar) as task_id, case when a.t % 4 = 0 then 7 else n end as selected, case when a.t % 4 = 0 then 3 else act end as actionable, types as type_counts, case when a.t % 4 = 0 then '{{"x": 4, "y": 0}}' else statuses end as status_counts,
 case when a.t % 5 = 0 then 2 else 0 end as created_relation, 0 as created_source_object, case when a.t % 5 = 1 then 3 else 0 end as created_severity, 0 as created_authority, case when a.t % 2 = 0 then 2 else 0 end as gap_entries_created, unresolved,
 cast(a.t % 3 = 1 as int) as coordinator_tasks, case when a.t % 3 = 1 then 4 else 0 end as coordinator_selected, cast(a.t % 3 = 1 as int) as coordinator_deferred, obligated, survived as artifact_survived, lost, coalesce(modes, '{{}}') as death_modes, 'full' as mode,
 case a.t % 5 when 0 then 2 when 1 then 3 else 0 end as entries_created from a left join types y using (t) left join statuses s using (t) left join modes m using (t)"""


@query("report_gaps", DEBT_SQL)
def report_gaps(spark, sf_dir):
    return _shown(R.gap_sensors(_reports(spark, sf_dir)))


DERIVED_SQL = f"""with {BASE},
j as (select t, k, case st when 'P' then 'executed' when 'O' then 'skipped' else 'unknown' end as status, case when k % 10 = 0 then 'own' when k % 6 = 0 then 'dropped' when k % 6 = 2 then 'merged' end as mode, k % 4 = 0 as obligated, k % 8 = 0 as found from o),
a as (select t, count(*) as selected, count(*) filter (k % 3 <> 0) as executable, count(*) filter (status = 'executed') as executed, 2 * count(*) filter (k % 3 = 0) as made, count(*) filter (obligated) as obligated, count(*) filter (found) as survived, count(*) filter (not found and status = 'executed') as lost from j group by t),
{_map_sql("j", "status", "statuses")}, {_map_sql("j", "mode", "modes")}
select cast(a.t as varchar) as task_id, selected, executable, executed, made as entries_created, obligated, survived as artifact_survived, lost, coalesce(modes, '{{}}') as death_modes, statuses as status_counts from a left join statuses using (t) left join modes using (t)"""


@query("report_derived", DERIVED_SQL)
def report_derived(spark, sf_dir):
    return _shown(R.derived_work(_reports(spark, sf_dir)))


PLACEMENT_SQL = f"""with {BASE},
j as (select t, k, case when k % 6 = 0 then 'lost_in_draft' end as mode, case when k % 7 = 0 then 'unknown' else st end as form from o),
a as (select t, count(*) as n, count(*) filter (k % 2 = 1) as targeted, count(*) filter (k % 3 = 0) as traceable, count(*) filter (k % 4 = 0) as found, count(*) filter (k % 8 = 0) as native, count(*) filter (k % 5 = 0) as elsewhere from j group by t),
b as (select *, case when t % 2 = 0 then 5 else n end as selected from a), {_map_sql("j", "mode", "modes")}, {_map_sql("j", "form", "forms")}
select cast(b.t as varchar) as task_id, selected, targeted, traceable, found as found_in_target_file, native as native_form_satisfied, elsewhere as found_elsewhere, case when b.t % 2 = 0 then '{{"x": 1}}' else coalesce(modes, '{{}}') end as death_modes, forms as native_forms,
 case when b.t % 2 = 0 then 2 else selected - native end as lost, greatest(0, selected - traceable) as untraceable from b left join modes using (t) left join forms using (t)"""


@query("report_placement", PLACEMENT_SQL)
def report_placement(spark, sf_dir):
    return _shown(R.artifact_placement(_reports(spark, sf_dir)))


CUSTODY_SQL = f"""with {BASE} select cast(t as varchar) as task_id, case when t % 6 = 5 then 0 else 3 end as audits, case when t % 6 = 5 then 0 else n end as entries_quarantined,
 case when t % 6 = 5 then '{{}}' else '{{"a": ' || t % 3 || ', "b": 0}}' end as invalid_documents, case when t % 6 = 5 then '{{}}' else '{{"unknown_name": ' || n || '}}' end as reasons from tasks"""


@query("report_custody", CUSTODY_SQL)
def report_custody(spark, sf_dir):
    return _shown(R.source_custody(_reports(spark, sf_dir)))


AUDIT_SQL = f"""with {BASE} select cast(t as varchar) as task_id, case when t % 2 = 1 then n else 3 end as records, t % 3 as forbidden_provenance_hits, case when t % 4 = 0 then 0 else t % 5 end as forbidden_text_hits, '{{"plan": ' || n || ', "write": 2}}' as stages from tasks"""


@query("report_audit", AUDIT_SQL)
def report_audit(spark, sf_dir):
    return _shown(R.prompt_audit(_reports(spark, sf_dir)))


MAINTENANCE_SQL = f"""with {BASE}, m as (select t, n, (t % 3 - 1) / 4 as delta from tasks),
sums as (select count(*) as tasks, sum(n) as candidate_entry_count, sum(t % 5) as consolidations_selected, 2 * count(*) as entries_created, 3 * count(*) as entries_superseded, count(*) filter (t % 2 = 0) as fallback_tasks, sum(t % 3) as fallback_cluster_count,
 0.25 * count(*) as state_mix_score_before, 0.5 * count(*) as state_mix_score_after, sum(delta) as state_mix_score_delta, 0.125 * count(*) as reasoning_density_delta, 0 as gap_density_delta, 0.5 * count(*) as compaction_ratio, count(*) filter (delta > 0) as positive_state_score_tasks,
 0.25 as avg_state_mix_score_before, 0.5 as avg_state_mix_score_after, round(sum(delta) / count(*), 4) as avg_state_mix_score_delta, 0.125 as avg_reasoning_density_delta, 0 as avg_gap_density_delta, 0.5 as avg_compaction_ratio from m)
select metric, cast(null as varchar) as key, value from (select cast(columns(*) as double) from sums) unpivot (value for metric in (columns(*)))"""


@query("report_maintenance_totals", MAINTENANCE_SQL)
def report_maintenance_totals(spark, sf_dir):
    return R.maintenance_totals(R.maintenance(_reports(spark, sf_dir)))


CLAIMS_SQL = f"""with {BASE} select cast(t as varchar) as task_id, 2 as files_checked, n as claims_checked, t % 4 as risky_claims, '{{"ok": ' || n || '}}' as status_counts, '{{"high": ' || t % 4 || '}}' as severity_counts, 'x' as mode, 1 as fallback_files, t % 3 + 1 as fallback_candidate_count, 4 as evidence_entry_count from tasks"""


@query("report_claims", CLAIMS_SQL)
def report_claims(spark, sf_dir):
    return _shown(R.source_claims(_reports(spark, sf_dir)))


@query("report_gap_totals", f"""with {BASE}, j as (select t, k, case when k % 2 = 0 and k % 5 <> 0 then case k % 6 when 0 then 'dropped' when 2 then 'merged' end end as mode from o)
select 'death_modes' as metric, mode as key, cast(count(*) as double) as value from j where mode is not null group by mode union all select 'tasks', null, cast(count(*) as double) from tasks union all select 'obligated', null, cast(count(*) as double) from o where k % 20 in (4, 8, 12, 16)""")
def report_gap_totals(spark, sf_dir):
    return R.totals(R.gap_sensors(_reports(spark, sf_dir))).where(c("metric").isin("death_modes", "tasks", "obligated"))


def _run_folder(spark, sf_dir, name: str) -> str:
    """All reports as files of a run folder: <t % 7>/task-<t>/swarm/<kind>.json."""
    folder = shared_folder(spark, name)
    path = F.concat(_n(c("t") % 7), F.lit("/task-"), _n(c("t")), F.lit("/swarm/"), "kind", F.lit(".json"))
    D.written(report_texts(spark, sf_dir).select(path.alias("path"), c("text").alias("content")), folder, "files")
    return folder


@query("report_scan", f"with {BASE} select (t % 7) || '/task-' || t as task_id, case when t % 2 = 1 then n else 3 end as records, t % 3 as forbidden_provenance_hits from tasks")
def report_scan(spark, sf_dir):
    """Reports are written to a run folder, found there again and rolled up."""
    reports = R.scanned_reports(spark, _run_folder(spark, sf_dir, "reports"))
    return R.prompt_audit(reports).select("task_id", "records", "forbidden_provenance_hits")


@query("rollup_csv", f"""with {BASE} select cast(t as varchar) as task_id, 'source_custody' as report, case when t % 6 = 5 then 0 else n end as selected, 0 as actionable, 0 as executed, 0 as entries_created, 0 as lost, case when t % 6 = 5 then 0 else n end as unresolved, '' as death_modes,
 case when t % 6 = 5 then '{{}}' else '{{"a": ' || t % 3 || ', "b": 0}}' end as type_counts, case when t % 6 = 5 then '{{}}' else '{{"unknown_name": ' || n || '}}' end as status_counts, case when t % 6 = 5 then 'audits=0' else 'audits=3' end as notes from tasks""")
def rollup_csv(spark, sf_dir):
    """All task rows go to CSV through the two-step writer; those of one report are read back."""
    folder, rows = shared_folder(spark, "rollup-csv"), R.task_rows(_reports(spark, sf_dir))
    D.written(rows, folder, "csv")
    read = spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(rows.schema).csv(folder).drop("batch")
    return read.where("report = 'source_custody'").fillna("", ["death_modes"])


@query("report_append", "select event_type as kind, case when event_id % 3 = 0 then 'first' else 'second' end as stage, count(*) as items, cast(sum(event_id % 7) as bigint) as hits from events group by all")
def report_append(spark, sf_dir):
    """Two stages append their audits to one log, one of them twice under one name; the summary is a query over the log."""
    folder = shared_folder(spark, "audits")
    events = table(spark, sf_dir, "events")
    rows = events.select(F.to_json(F.struct(c("event_type").alias("kind"), F.when(c("event_id") % 3 == 0, "first").otherwise("second").alias("stage"), (c("event_id") % 7).alias("hits"))).alias("value"), (c("event_id") % 3 == 0).alias("first"))
    for name, part in (("first", c("first")), ("second", ~c("first")), ("second", ~c("first"))):
        D.written(rows.where(part).select("value"), folder, batch=name)
    log = spark.read.schema("kind string, stage string, hits long").json(folder)
    return log.groupBy("kind", "stage").agg(F.count(F.lit(1)).alias("items"), F.sum("hits").alias("hits"))


@query("event_log_sink", "select event_id, event_type as kind, user_id as board_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def event_log_sink(spark, sf_dir):
    """All events as one JSON text per line through the two-step writer, read back."""
    folder = shared_folder(spark, "event-log")
    rows = table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", c("event_type").alias("kind"), c("user_id").alias("board_id"), F.get_json_object("props", "$.k").cast("long").alias("k"))).alias("value"))
    D.written(rows, folder, batch="events")
    return spark.read.schema("event_id long, kind string, board_id long, k long").json(folder).drop("batch")


def _task_folder(spark, sf_dir) -> str:
    """A file for each document: in one of several folders of its task (100 documents), or at its top."""
    folder, k = shared_folder(spark, "tasks"), c("doc_id")
    task = F.floor(k / 100)
    place = F.element_at(F.array(*map(F.lit, ["docs/", "documents/a/", "", "other/"])), (task % 3 + k % 2 + 1).cast("int"))
    name = F.when(k % 50 == 7, F.concat(F.lit("task"), F.when(k % 100 == 7, ".json").otherwise(".exe"))).otherwise(F.concat(F.lit("doc_"), _n(k), F.element_at(F.array(*map(F.lit, [".txt", ".MD", ".bin"])), (k % 3 + 1).cast("int"))))
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("t"), _n(task), F.lit("/"), place, name).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    D.written(rows, folder, "files")
    return folder


FILES_SQL = """f as (select doc_id // 100 as task, (doc_id // 100) % 3 + doc_id % 2 as place, case when doc_id % 100 = 7 then 'json' when doc_id % 50 = 7 then 'exe' else ['txt', 'md', 'bin'][doc_id % 3 + 1] end as ext, case when doc_id % 50 = 7 then 'task' || case when doc_id % 100 = 7 then '.json' else '.exe' end else 'doc_' || doc_id || ['.txt', '.MD', '.bin'][doc_id % 3 + 1] end as name, strlen(coalesce(text, '')) as size from documents)"""


@query("src_scan", f"with {FILES_SQL} select 't' || task as task, name, ext, size from f where ext in ('txt', 'md', 'json')")
def src_scan(spark, sf_dir):
    folder = _task_folder(spark, sf_dir)
    return D.scanned(spark, folder).select(F.regexp_extract(D.below(c("path"), folder), "^[^/]+", 0).alias("task"), "name", "ext", "size")


@query("src_discover", f"with {FILES_SQL}, r as (select *, case place when 0 then 3 when 1 then 2 when 2 then 4 end as rank from f), w as (select *, min(rank) over (partition by task) as best from r) select 't' || task as task, name, size from w where rank = best and ext in ('txt', 'md', 'json') and (rank < 4 or name <> 'task.json')")
def src_discover(spark, sf_dir):
    folder = _task_folder(spark, sf_dir)
    return D.discovered(D.listed(spark, folder), folder).select("task", "name", "size")


@query("score_files", "select doc_id % 5 || '/scenario-' || doc_id || '/x' as task, doc_id % 5 || '/x' as task_key, quality + 1 - toxic as n_passed, case when doc_id % 4 = 0 then 0 else 3 end as n_criteria, quality = 1 and doc_id % 4 <> 1 as all_pass, case when doc_id % 4 = 0 then 0.0 else round(100 * (quality + 1 - toxic) / 3, 1) end as rate from labels where doc_id % 7 <> 0")
def score_files(spark, sf_dir):
    """A score file for each label, some of them broken; found and read."""
    folder, k = shared_folder(spark, "scores"), c("doc_id")
    good = _json(n_passed=_s(c("quality") + 1 - c("toxic")), n_criteria=F.when(k % 4 == 0, '"none"').otherwise("3.5"), all_pass=F.when(k % 4 != 1, F.when(c("quality") == 1, "true").otherwise("false")))
    rows = table(spark, sf_dir, "labels").select(F.concat(_n(k % 5), F.lit("/scenario-"), _n(k), F.lit("/x/scores.json")).alias("path"), F.when(k % 7 == 0, "{broken").otherwise(good).alias("content"))
    D.written(rows, folder, "files")
    return D.scores(spark, folder)
