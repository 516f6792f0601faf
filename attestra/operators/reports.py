"""Roll-ups of life-cycle reports: one row per task and report, totals over tasks, count maps.

A report is a VARIANT (task_id, kind, report), as its writers are free in form: every field is repaired on its own where it
is read. Whole numbers take what can be made one ("5", 5.7 and true are 5, 5 and 1; "5.7" isn't), else their default; count
maps keep all keys, with 0 for values out of form; where a report has a figure of its own it goes before what its items say.
Items that are no objects don't count. Each function gives a row per task; ``totals`` sums the columns and maps of any of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

c = F.col
TRACE = "commitment_survival_trace"
# The ways in which gap items are executed; what stands for nothing in a report.
EXECUTIONS = ["relation", "source_object", "severity", "authority"]
NOTHING = ["null", "false", "0", '""', "[]", "{}"]
#: The columns of a task row, with their defaults.
ROW = {"selected": 0, "actionable": 0, "executed": 0, "entries_created": 0, "lost": 0, "unresolved": 0}
MAPS = ["death_modes", "type_counts", "status_counts"]


def field(v: Column | str, path: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def whole(v, path: str, default=0) -> Column:
    return F.coalesce(field(v, path, "long"), default if isinstance(default, Column) else F.lit(default).cast("long"))


def number(v, path: str) -> Column:
    return F.coalesce(field(v, path, "double"), F.lit(0.0))


def truthy(v, path: str) -> Column:
    """Whether there is something at the path that isn't null, false, zero or empty."""
    return F.coalesce(~F.to_json(field(v, path, "variant")).isin(NOTHING), F.lit(False))


def said(v, path: str) -> Column:
    """What is there as text; null where it is nothing."""
    return F.when(truthy(v, path), field(v, path, "string"))


def length(v, path: str) -> Column:
    return F.coalesce(F.size(field(v, path, "array<variant>")), F.lit(0)).cast("long")


def count_map(v, path: str) -> Column:
    """A map of whole numbers; empty where there is none."""
    read = F.transform_values(field(v, path, "map<string,variant>"), lambda _, x: F.coalesce(F.try_variant_get(x, "$", "long"), F.lit(0).cast("long")))
    return F.coalesce(read, F.create_map().cast("map<string,long>"))


def objects(reports: DataFrame, kind: str, path: str, known: str) -> DataFrame:
    """task_id, pos, item: the objects of a list in reports of a kind, in order. What has the ``known`` field is an object without a further look."""
    rows = reports.where(c("kind") == kind).select("task_id", F.posexplode(field("report", path, "array<variant>")).alias("pos", "item"))
    return rows.where(field("item", known, "variant").isNotNull() | F.schema_of_variant("item").startswith("OBJECT"))


def of_kind(reports: DataFrame, kind: str) -> DataFrame:
    """The reports of a kind that hold anything; the others count as missing. One with an item isn't written out to be judged."""
    return reports.where((c("kind") == kind) & (field("report", "items[0]", "variant").isNotNull() | (F.to_json("report") != "{}"))).select("task_id", "report")


def alike(items: DataFrame, **fields: Column) -> DataFrame:
    """task_id, the fields and n: how many items of a task are alike in all of them. Sums and maps both come from these rows."""
    return items.select("task_id", *[v.alias(k) for k, v in fields.items()]).groupBy("task_id", *fields).agg(F.count(F.lit(1)).alias("n"))


def counted(rows: DataFrame, **keys: Column) -> DataFrame:
    """task_id and a count map per name, of keys that aren't null, from rows that stand for n items. Keys are counted before they are gathered: a map has a row each."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), k.cast("string").alias("key")) for n, k in keys.items()]))
    n = rows.select("task_id", "n", pairs.alias("p")).where("p.key is not null").groupBy("task_id", "p.name", "p.key").agg(F.sum("n").alias("n"))
    entry = F.struct("key", "n")
    return n.groupBy("task_id").agg(*[F.map_from_entries(F.array_sort(F.collect_list(F.when(c("name") == k, entry)))).alias(k) for k in keys])


def joined(rows: DataFrame, *others: DataFrame) -> DataFrame:
    """Left joins on task_id; missing maps are empty, missing numbers 0."""
    out = reduce(lambda a, b: a.join(b, "task_id", "left"), others, rows)
    for f in out.schema.fields:
        if isinstance(f.dataType, T.MapType):
            out = out.withColumn(f.name, F.coalesce(f.name, F.create_map().cast("map<string,long>")))
        elif isinstance(f.dataType, T.LongType):
            out = out.withColumn(f.name, F.coalesce(f.name, F.lit(0).cast("long")))
    return out


def traced(items: DataFrame, reports: DataFrame, id_field: str, source: str | None = None) -> DataFrame:
    """Items (task_id, id, ...) with what the task's survival trace says of their id (its last word) as ``obligated``, ``found``
    and ``lost_by``; nothing where it says nothing. Of a trace only these three travel."""
    said_of = objects(reports, TRACE, "items", id_field)
    if source:
        said_of = said_of.where(F.coalesce(field("item", "commitment_source", "string") == source, F.lit(False)))
    word = F.struct(truthy("item", "obligated").alias("obligated"), truthy("item", "found_in_artifact").alias("found"), said("item", "death_mode").alias("lost_by"))
    last = said_of.select("task_id", written(id_field).alias("id"), "pos", word.alias("word")).groupBy("task_id", "id").agg(F.max_by("word", "pos").alias("word"))
    no = lambda name: F.coalesce(f"word.{name}", F.lit(False)).alias(name)
    return items.join(last, ["task_id", "id"], "left").select(*[x for x in items.columns if x != "id"], no("obligated"), no("found"), "word.lost_by")


def written(name: str) -> Column:
    """A field of an item as JSON text, to be compared; null where it is missing."""
    return F.coalesce(F.to_json(field("item", name, "variant")), F.lit("null"))


def total(flag: Column | str, name: str) -> Column:
    """How many items have a flag, of rows that stand for n items."""
    return F.sum(F.when(c(flag) if isinstance(flag, str) else flag, c("n")).otherwise(0)).alias(name)


def first_of(own: Column, else_: Column) -> Column:
    """A map, or the other one where it is empty."""
    return F.when(F.size(own) > 0, own).otherwise(else_)


def gap_sensors(reports: DataFrame) -> DataFrame:
    """Selected and actionable gap items, what executing them created, and what became of them in the files."""
    own = of_kind(reports, "debt_sensors")
    items = objects(reports, "debt_sensors", "items", "id").select(
        "task_id", written("id").alias("id"), F.coalesce(said("item", "type"), F.lit("unknown")).alias("type"), F.coalesce(said("item", "status"), F.lit("unknown")).alias("status"), truthy("item", "created_entry_ids").alias("created")
    )
    items = alike(traced(items, reports, "debt_sensor_id", "debt_sensor"), **{k: c(k) for k in ("type", "status", "created", "obligated", "found", "lost_by")})
    actionable = c("status") == "actionable_gap"
    sums = items.groupBy("task_id").agg(
        F.sum("n").alias("n_items"), total(actionable, "n_actionable"), total(actionable & ~c("created"), "unresolved"),
        total("obligated", "obligated"), total("found", "survived"), total(~c("found") & c("created"), "lost"),
    )
    maps = counted(items, own_types=c("type"), own_statuses=c("status"), death_modes=c("lost_by"))
    rows = joined(own, sums, maps)
    made = {k: whole("report", f"{k}_execution_summary.entries_created") for k in EXECUTIONS}
    made = {f"created_{k}": F.when(n != 0, n).otherwise(length("report", f"created_{k}_entry_ids")) for k, n in made.items()}
    coordinated = F.coalesce(F.schema_of_variant(field("report", "lens_coordinator", "variant")).startswith("OBJECT"), F.lit(False)) & truthy("report", "lens_coordinator")
    when_coordinated = lambda name: F.when(coordinated, whole("report", f"lens_coordinator.{name}")).otherwise(0).cast("long")
    rows = rows.select(
        "task_id", whole("report", "summary.selected", c("n_items")).alias("selected"), whole("report", "summary.actionable", c("n_actionable")).alias("actionable"),
        first_of(count_map("report", "summary.type_counts"), c("own_types")).alias("type_counts"), first_of(count_map("report", "summary.status_counts"), c("own_statuses")).alias("status_counts"),
        *[v.alias(k) for k, v in made.items()], length("report", "created_gap_entry_ids").alias("gap_entries_created"), "unresolved", coordinated.cast("long").alias("coordinator_tasks"),
        when_coordinated("selected_actionable").alias("coordinator_selected"), when_coordinated("deferred").alias("coordinator_deferred"), "obligated", c("survived").alias("artifact_survived"), "lost", "death_modes", F.coalesce(field("report", "mode", "string"), F.lit("")).alias("mode"),
    )
    return rows.withColumn("entries_created", sum((c(k) for k in list(made)[1:]), c(list(made)[0])))


def derived_work(reports: DataFrame) -> DataFrame:
    """Derived work items: executable, executed, what they created and what became of it."""
    own = of_kind(reports, "derived_work_items")
    items = objects(reports, "derived_work_items", "items", "id").select(
        "task_id", written("id").alias("id"), truthy("item", "execution_eligible").alias("executable"), F.coalesce(said("item", "status"), F.lit("unknown")).alias("status"), length("item", "created_entry_ids").alias("created"), said("item", "death_mode").alias("mode")
    )
    items = traced(items, reports, "derived_work_id").withColumn("mode", F.coalesce("mode", "lost_by"))
    items = alike(items, **{k: c(k) for k in ("executable", "status", "created", "mode", "obligated", "found")})
    executed = c("status") == "executed"
    sums = items.groupBy("task_id").agg(
        F.sum("n").alias("selected"), total("executable", "executable"), total(executed, "executed"), F.sum(c("created") * c("n")).alias("entries_created"),
        total("obligated", "obligated"), total("found", "artifact_survived"), total(~c("found") & executed, "lost"),
    )
    maps = counted(items, death_modes=c("mode"), status_counts=c("status"))
    return joined(own.select("task_id"), sums, maps)


def artifact_placement(reports: DataFrame) -> DataFrame:
    """Placements: targeted, traceable, found in their file, in native form, elsewhere, lost."""
    own = of_kind(reports, "artifact_placement_trace")
    flags = {"targeted": "target_file", "traceable": "placement_traceable", "found_in_target_file": "found_in_target_file", "native_form_satisfied": "native_form_satisfied", "found_elsewhere": "found_elsewhere"}
    items = alike(objects(reports, "artifact_placement_trace", "items", "target_file"), mode=said("item", "death_mode"), form=F.coalesce(said("item", "native_form"), F.lit("unknown")), **{name: truthy("item", path) for name, path in flags.items()})
    sums = items.groupBy("task_id").agg(F.sum("n").alias("n_items"), *[total(name, f"n_{name}") for name in flags])
    maps = counted(items, own_modes=c("mode"), own_forms=c("form"))
    rows = joined(own, sums, maps).select(
        "task_id", "report", whole("report", "summary.selected", c("n_items")).alias("selected"), *[whole("report", f"summary.{name}", c(f"n_{name}")).alias(name) for name in flags],
        first_of(count_map("report", "summary.death_modes"), c("own_modes")).alias("death_modes"), first_of(count_map("report", "summary.native_forms"), c("own_forms")).alias("native_forms"),
    )
    rows = rows.withColumn("lost", whole("report", "summary.lost", c("selected") - c("native_form_satisfied")))
    return rows.withColumn("untraceable", F.greatest(F.lit(0).cast("long"), c("selected") - c("traceable"))).drop("report")


def prompt_audit(reports: DataFrame) -> DataFrame:
    """Prompt records, and forbidden content in them, by stage."""
    hits = {n: whole("report", f"summary.{n}") for n in ("forbidden_provenance_hits", "forbidden_text_hits")}
    return of_kind(reports, "prompt_audit").select("task_id", whole("report", "summary.records", length("report", "records")).alias("records"), *[v.alias(k) for k, v in hits.items()], count_map("report", "summary.stages").alias("stages"))


def source_custody(reports: DataFrame) -> DataFrame:
    """Entries quarantined, by document and by reason."""
    return of_kind(reports, "source_custody").select(
        "task_id", length("report", "audits").alias("audits"), whole("report", "summary.entries_quarantined").alias("entries_quarantined"),
        count_map("report", "summary.invalid_documents").alias("invalid_documents"), count_map("report", "summary.reasons").alias("reasons"),
    )


def maintenance(reports: DataFrame) -> DataFrame:
    """Consolidation of boards, with the state's quality before and after."""
    s = "summary.state_quality"
    return of_kind(reports, "blackboard_maintenance").select(
        "task_id", whole("report", "candidate_entry_count").alias("candidate_entry_count"), whole("report", "summary.consolidations_selected").alias("consolidations_selected"),
        whole("report", "summary.entries_created", length("report", "created_entry_ids")).alias("entries_created"), whole("report", "summary.entries_superseded", length("report", "superseded_entry_ids")).alias("entries_superseded"),
        truthy("report", "summary.fallback_used").cast("long").alias("fallback_tasks"), whole("report", "summary.fallback_cluster_count").alias("fallback_cluster_count"),
        number("report", f"{s}.before.state_mix_score").alias("state_mix_score_before"), number("report", f"{s}.after.state_mix_score").alias("state_mix_score_after"), number("report", f"{s}.delta.state_mix_score").alias("state_mix_score_delta"),
        number("report", f"{s}.delta.reasoning_density").alias("reasoning_density_delta"), number("report", f"{s}.delta.gap_density").alias("gap_density_delta"), number("report", f"{s}.compaction_ratio").alias("compaction_ratio"),
        (number("report", f"{s}.delta.state_mix_score") > 0).cast("long").alias("positive_state_score_tasks"), F.coalesce(field("report", "mode", "string"), F.lit("")).alias("mode"),
    )


def source_claims(reports: DataFrame) -> DataFrame:
    """Claims checked against sources, by status and severity, and the files that needed a fallback."""
    own = of_kind(reports, "source_claim_verification")
    files = objects(reports, "source_claim_verification", "files", "fallback_used").groupBy("task_id").agg(
        F.sum(truthy("item", "fallback_used").cast("long")).alias("fallback_files"), F.sum(whole("item", "fallback_candidate_count")).alias("fallback_candidate_count"), F.sum(whole("item", "evidence_entry_count")).alias("evidence_entry_count")
    )
    plain = [whole("report", f"summary.{n}").alias(n) for n in ("files_checked", "claims_checked", "risky_claims")]
    maps = [count_map("report", f"summary.{n}").alias(n) for n in ("status_counts", "severity_counts")]
    return joined(own.select("task_id", *plain, *maps, F.coalesce(field("report", "mode", "string"), F.lit("")).alias("mode")), files)


ROLLUPS = {
    "debt_sensors": gap_sensors, "derived_work": derived_work, "artifact_placement": artifact_placement, "source_custody": source_custody,
    "prompt_audit": prompt_audit, "blackboard_maintenance": maintenance, "source_claim_verification": source_claims,
}


def sorted_json(m: Column) -> Column:
    """A count map as JSON text with its keys in order, as in {"a": 1, "b": 2}."""
    name = lambda e: F.regexp_replace(F.to_json(F.array(e["key"])), r"^\[|\]$", "")
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(name(e), F.lit(": "), e["value"].cast("string"))), ", "), F.lit("}"))


#: How each roll-up fills a task row: the row's columns, and the parts of its note.
FILLS = {
    "debt_sensors": ({k: k for k in ("selected", "actionable", "entries_created", "lost", "unresolved", *MAPS)}, {"mode": "mode", "gap_entries": "gap_entries_created", "obligated": "obligated", "survived": "artifact_survived"}),
    "derived_work": ({k: k for k in ("selected", "executed", "entries_created", "lost", "death_modes", "status_counts")}, {"executable": "executable", "obligated": "obligated", "survived": "artifact_survived"}),
    "artifact_placement": ({"selected": "selected", "lost": "lost", "death_modes": "death_modes", "type_counts": "native_forms"}, {"targeted": "targeted", "traceable": "traceable", "found_target": "found_in_target_file", "native_satisfied": "native_form_satisfied", "found_elsewhere": "found_elsewhere"}),
    "source_custody": ({"selected": "entries_quarantined", "unresolved": "entries_quarantined", "type_counts": "invalid_documents", "status_counts": "reasons"}, {"audits": "audits"}),
    "prompt_audit": ({"selected": "records", "unresolved": "forbidden_provenance_hits + forbidden_text_hits", "type_counts": "stages"}, {"forbidden_provenance_hits": "forbidden_provenance_hits", "forbidden_text_hits": "forbidden_text_hits"}),
    "blackboard_maintenance": ({"selected": "consolidations_selected", "entries_created": "entries_created"}, {"mode": "mode", "candidates": "candidate_entry_count", "superseded": "entries_superseded", "fallback_used": "if(fallback_tasks = 1, 'True', 'False')", "fallback_clusters": "fallback_cluster_count", "state_score_delta": "format_string('%.4f', state_mix_score_delta)"}),
    "source_claim_verification": ({"selected": "claims_checked", "unresolved": "risky_claims", "type_counts": "status_counts", "status_counts": "severity_counts"}, {"mode": "mode", "files_checked": "files_checked", "fallback_files": "fallback_files", "fallback_candidates": "fallback_candidate_count"}),
}


def task_rows(reports: DataFrame) -> DataFrame:
    """task_id, report, six counts, three count maps as JSON text ('' where a report has none), notes: a row per task and report."""

    def rows(kind: str) -> DataFrame:
        fills, note = FILLS[kind]
        counts = [F.expr(fills.get(k, str(default))).cast("long").alias(k) for k, default in ROW.items()]
        maps = [(sorted_json(c(fills[k])) if k in fills else F.lit("")).alias(k) for k in MAPS]
        notes = F.concat_ws("; ", *[F.concat(F.lit(f"{k}="), F.expr(x).cast("string")) for k, x in note.items()])
        return ROLLUPS[kind](reports).select("task_id", F.lit(kind).alias("report"), *counts, *maps, notes.alias("notes"))

    return reduce(DataFrame.unionByName, map(rows, ROLLUPS))


def totals(rollup: DataFrame) -> DataFrame:
    """metric, key, value: each column of a roll-up summed over tasks, each map by key, and the number of tasks.
    One explode and one sum, whatever the columns, combined before the shuffle."""
    entry = lambda name, key, value: F.struct(F.lit(name).alias("metric"), key.cast("string").alias("key"), value.cast("double").alias("value"))
    entries_of = lambda name: F.transform(F.map_entries(name), lambda e: entry(name, e["key"], e["value"]))
    nobody = F.lit(None)
    parts = [F.array(entry("tasks", nobody, F.lit(1)))]
    for f in rollup.schema.fields:
        if isinstance(f.dataType, T.MapType):
            parts.append(entries_of(f.name))
        elif isinstance(f.dataType, (T.LongType, T.DoubleType)):
            parts.append(F.array(entry(f.name, nobody, c(f.name))))
    return rollup.select(F.explode(F.flatten(F.array(*parts))).alias("x")).groupBy("x.metric", "x.key").agg(F.sum("x.value").alias("value"))


#: What maintenance averages over tasks, to four decimals.
AVERAGED = ["state_mix_score_before", "state_mix_score_after", "state_mix_score_delta", "reasoning_density_delta", "gap_density_delta", "compaction_ratio"]


def maintenance_totals(rollup: DataFrame) -> DataFrame:
    """``totals`` of maintenance, with avg_ rows."""
    sums = totals(rollup)
    tasks = rollup.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"))
    averages = sums.where(c("metric").isin(AVERAGED)).join(F.broadcast(tasks)).select(F.concat(F.lit("avg_"), "metric").alias("metric"), "key", F.round(c("value") / c("n"), 4).alias("value"))
    return sums.unionByName(averages)


def scanned_reports(spark, folder: str) -> DataFrame:
    """task_id, kind, report of the report files below a results folder: <task>/swarm/<kind>.json; broken ones count as missing."""
    from ..sources.folders import json_files

    files = json_files(spark, folder, [f"{FILES[k]}.json" for k in ROLLUPS] + [f"{TRACE}.json"])
    parts = F.regexp_extract("path", "^(?:(.*)/)?swarm/([^/]+)[.]json$", 1)
    rows = files.where(c("path").rlike("^(.*/)?swarm/[^/]+[.]json$"))
    return rows.select(parts.alias("task_id"), F.regexp_extract("path", "([^/]+)[.]json$", 1).alias("kind"), c("json").alias("report"))


#: The file of each roll-up's reports.
FILES = {"debt_sensors": "debt_sensors", "derived_work": "derived_work_items", "artifact_placement": "artifact_placement_trace", "source_custody": "source_custody", "prompt_audit": "prompt_audit", "blackboard_maintenance": "blackboard_maintenance", "source_claim_verification": "source_claim_verification"}
