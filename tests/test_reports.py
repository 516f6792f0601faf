"""Roll-ups of reports with items out of form, and what is composed for them."""

import json

from pyspark.sql import functions as F

from attestra.operators import reports as R
from attestra.plans import reports as P


def rollup(spark, rows):
    reports = spark.createDataFrame([(t, k, json.dumps(r)) for t, k, r in rows], "task_id string, kind string, report string").withColumn("report", F.parse_json("report"))
    return {(r.report, r.task_id): r for r in R.task_rows(reports).collect()}


def test_task_rows_of_odd_items(spark):
    gap = {"id": 1, "type": "x", "status": "actionable_gap"}
    got = rollup(spark, [
        ("a", "debt_sensors", {"items": [gap, gap, {"id": None, "created_entry_ids": ["e"]}, {}, [1], "no", None, {"id": "1"}]}),
        ("a", R.TRACE, {"items": [
            {"commitment_source": "debt_sensor", "debt_sensor_id": 1, "death_mode": "first", "found_in_artifact": True}, {"commitment_source": "debt_sensor", "debt_sensor_id": 1, "death_mode": "last", "obligated": 1},
            {"commitment_source": "other", "debt_sensor_id": 1, "death_mode": "other"}, {"commitment_source": "debt_sensor", "death_mode": "none", "found_in_artifact": "y", "derived_work_id": "w"}, "odd",
        ]}),
        ("a", "derived_work_items", {"items": [{"id": "w", "status": "executed", "created_entry_ids": [1, 2]}, {"id": "v", "status": "executed", "created_entry_ids": [1], "death_mode": "own"}, {"id": "w", "execution_eligible": True, "death_mode": "own"}]}),
        ("b", "debt_sensors", {}), ("b", "artifact_placement_trace", {"items": []}), ("c", "debt_sensors", {"items": "none"}), ("c", "artifact_placement_trace", {"items": [{"native_form": "f"}, {"native_form": "f", "native_form_satisfied": 1}, {}, 5]}),
    ])
    debt = got["debt_sensors", "a"]
    assert (debt.selected, debt.actionable, debt.unresolved, debt.lost, debt.notes) == (5, 2, 2, 0, "mode=; gap_entries=0; obligated=2; survived=2")
    assert (debt.type_counts, debt.status_counts, debt.death_modes) == ('{"unknown": 3, "x": 2}', '{"actionable_gap": 2, "unknown": 3}', '{"last": 2, "none": 2}')
    work = got["derived_work", "a"]
    assert (work.selected, work.executed, work.entries_created, work.lost, work.death_modes, work.status_counts, work.notes) == (3, 2, 3, 1, '{"none": 1, "own": 2}', '{"executed": 2, "unknown": 1}', "executable=1; obligated=0; survived=2")
    assert ("debt_sensors", "b") not in got and got["debt_sensors", "c"].selected == 0 and got["artifact_placement", "b"].selected == 0
    placed = got["artifact_placement", "c"]
    assert (placed.selected, placed.lost, placed.type_counts) == (3, 2, '{"f": 2, "unknown": 1}')


def test_a_roll_up_composes_only_its_reports(spark):
    plan = R.source_custody(P._reports(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
