"""Run folders: listing with pruning, the writer's two steps, what failed tasks and replays leave."""

import json
import os

import pytest
from pyspark.sql import functions as F

from attestra.sources import folders as D


def files(spark, at, *rows):
    D.written(spark.createDataFrame(list(rows), "path string, content string"), at, "files")


def everything(at):
    return sorted(os.path.relpath(os.path.join(d, f), at) for d, _, names in os.walk(at) for f in names)


def test_listing_prunes_by_extension(spark, tmp_path):
    at = str(tmp_path / "run")
    files(spark, at, *[(f"t{k}/deep/er/f{k}.{ext}", "x" * k) for k in range(30) for ext in ("txt", "TXT", "exe")], ("top.md", "m"), (".hidden", "h"), ("none", None))
    assert D.listed(spark, at).count() == 93
    got = D.scanned(spark, at)
    paths = [r.path for r in got.collect()]
    assert paths == sorted(paths) and len(paths) == 61 and {r.ext for r in got.collect()} == {"txt", "md"}
    assert D.listed(spark, at).where("ext = 'md' and size = 1").count() == 1
    reader = D.FolderReader({"path": at, "parallel": 8})
    left = list(reader.pushFilters([D.In(("ext",), ("md", "txt")), D.EqualTo(("size",), 1)]))
    assert len(left) == 1 and reader.wanted == {"md", "txt"}  # the listing itself leaves the others out
    parts = reader.partitions()
    assert sum(p.deep for p in parts) == 30 and sum(not p.deep for p in parts) == 1
    assert {n for p in parts for b in reader.read(p) for n in b.column("name").to_pylist()} == {r.name for r in got.collect()}


def test_failed_tasks_leave_no_row(spark, tmp_path):
    at = str(tmp_path / "log")
    rows = spark.range(100).repartition(4).select(F.to_json(F.struct("id")).alias("value"))
    D.written(rows, at, batch="one")
    once = everything(at)
    D.written(rows, at, batch="one")  # replayed
    assert everything(at) == once and spark.read.text(at).count() == 100
    broken = rows.select(F.when(F.col("value").contains("77"), F.raise_error(F.lit("no"))).otherwise(F.col("value")).alias("value"))
    with pytest.raises(Exception):
        D.written(broken, at, batch="two")
    assert everything(at) == once
    D.written(rows.limit(0), at, batch="none")
    D.written(rows, at)
    assert sorted(r.id for r in spark.read.schema("id long").json(at).collect()) == sorted([*range(100)] * 2)


def test_only_files_of_committed_attempts_count(tmp_path):
    import pyarrow as pa

    at = str(tmp_path / "log")
    writer = D.FolderWriter({"path": at, "batch": "b"})
    batch = lambda *x: iter([pa.RecordBatch.from_arrays([pa.array(x)], ["value"])])
    writer.write(batch("lost attempt"))
    kept = [writer.write(batch("a", "b")), writer.write(batch()), None]
    writer.commit(kept)
    assert [open(os.path.join(at, f)).read() for f in everything(at)] == ["a\nb\n"]


def test_csv_round_trip(spark, tmp_path):
    at = str(tmp_path / "csv")
    rows = [("a", 1, '{"x": 1, "y, z": 2}'), ("b", 2, 'say "so"\nnext'), ("c", None, "")]
    D.written(spark.createDataFrame(rows, "task string, n long, m string").coalesce(2), at, "csv")
    got = spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema("task string, n long, m string").csv(at)
    assert sorted((r.task, r.n, r.m or "") for r in got.collect()) == rows


def test_documents_of_tasks(spark, tmp_path):
    at = str(tmp_path / "tasks")
    files(
        spark, at, ("a/docs/1.txt", ""), ("a/documents/sub/2.md", ""), ("a/3.txt", ""), ("b/task.json", "{}"), ("b/4.json", "{}"), ("b/5.exe", ""), ("b/other/6.txt", ""),
        ("c/source_documents/7.exe", ""), ("c/8.txt", ""), ("stray.txt", ""),
    )
    got = sorted((r.task, r.name) for r in D.discovered(D.listed(spark, at), at).collect())
    assert got == [("a", "2.md"), ("b", "4.json")]  # the first folder that is there wins, even if nothing in it is read


def test_scores_and_broken_json(spark, tmp_path):
    at = str(tmp_path / "scores")
    files(spark, at, ("x/scenario-1/scores.json", "﻿" + json.dumps({"n_passed": 2, "n_criteria": 3})), ("y/scores.json", "{broken"), ("z/scores.json", "[1]"), ("w/scores.json", json.dumps({"all_pass": True, "n_passed": "none"})))
    got = {r.task: (r.task_key, r.n_passed, r.n_criteria, r.rate, r.all_pass) for r in D.scores(spark, at).collect()}
    assert got == {"x/scenario-1": ("x", 2, 3, 66.7, False), "w": ("w", 0, 0, 0.0, True)}


def test_many_folders_are_few_tasks(spark, tmp_path):
    """A task lists several folders; a wide folder is listed whole; hidden files stay out, names are as they are on disk."""
    from attestra.sources import folders as D

    for i in range(200):
        at = tmp_path / str(i % 2) / f"scenario-{i}" / "x y%20"
        at.mkdir(parents=True)
        (at / "scores.json").write_bytes(b'\xef\xbb\xbf{"n_passed": %d, "n_criteria": 400}' % i)
    for hidden in (".h/scores.json", "_h/x/scores.json", "0/other.json", "0/_k=1/scores.json"):
        (tmp_path / hidden).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / hidden).write_text('{"n_passed": 1}')
    reader = D.FolderReader({"path": str(tmp_path), "parallel": "16"})
    parts = reader.partitions()
    names = lambda parts: sorted(p for part in parts for b in reader.read(part) for p in b.column("path").to_pylist())
    assert len(parts) <= 16 and len(names(parts)) == 204
    wide = D.WIDE
    try:
        D.WIDE, D.ROWS = 50, 7
        assert names(reader.partitions()) == names(parts)
    finally:
        D.WIDE, D.ROWS = wide, 10_000
    got = {(r.task, r.task_key, r.n_passed) for r in D.scores(spark, str(tmp_path)).collect()}
    assert got == {(f"{i % 2}/scenario-{i}/x y%20", f"{i % 2}/x y%20", i) for i in range(200)} | {("0/_k=1", "0/_k=1", 1)}
