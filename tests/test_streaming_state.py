"""Keyed state: out-of-order rows, restarts from the checkpoint, timers, the binding barrier under replays."""

import random
from datetime import datetime, timedelta

from attestra.streaming import events as E
from attestra.streaming import rounds as R
from attestra.streaming import signals as S

ENTRY = "board_id string, entry_id string, type string, ts timestamp, seq long, opens array<struct<type:string,priority:string,content:string>>, addresses array<string>, supersedes array<string>"
T = lambda days: datetime(2024, 1, 1) + timedelta(days=days)
ASK = [("question", "medium", "why?")]
END = ("z", "end", "x", T(60), 99, [], [], [])


def add(spark, at, schema, *rows):
    spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{at}/in")


def test_signals_survive_restarts_and_late_supersedes(spark, tmp_path):
    at = str(tmp_path)
    need = [("artifact_requirement", "high", "table"), ("question", "low", " "), ("question", "low", "a"), ("question", "low", "b"), ("question", "low", "c"), ("question", "low", "sixth")]
    rows = [
        ("b", "e1", "observation", T(0), 1, ASK, [], []),
        ("b", "e2", "observation", T(1), 2, need, ["e1/0", "nowhere/0"], []),
        ("b", "e3", "observation", T(1.5), 3, [], ["e2/0"], []),  # an observation doesn't answer a requirement
        ("b", "e4", "analysis", T(1.6), 4, None, ["e2/0", "e2/2"], None),
        ("b", "e5", "analysis", T(2), 5, [], ["e1/0"], ["e2"]),  # addresses what is addressed, then reopens it
        ("b", "e6", "analysis", T(30), 6, [], ["e2/3"], ["e4", "e4"]),  # e2/3 has expired by then
        (None, "e7", "analysis", T(30), 7, ASK, [], []),
    ]
    runs = [[rows[1], rows[0]], [rows[4], rows[2]], [rows[3]], rows[5:], [END]]
    for batch in runs:  # rows come out of order between runs as well; each run goes on from the checkpoint
        add(spark, at, ENTRY, *batch)
        stream = spark.readStream.schema(ENTRY).parquet(f"{at}/in")
        out = E.poured(S.signal_stream(stream, late="1 day"), f"{at}/out", S.CHANGES)
    batch = S.signal_changes(spark.createDataFrame([*rows, END], ENTRY))
    assert sorted(map(str, out.collect())) == sorted(map(str, batch.collect()))
    got = {r.signal_id: (r.status, r.addressed_by) for r in S.signal_states(batch).collect()}
    # e4 had addressed e2/2 in time; after e6 superseded it the signal was open again, and expired
    assert got == {"e1/0": ("expired", None), "e2/0": ("open", None), "e2/2": ("expired", None), "e2/3": ("expired", None), "e2/4": ("expired", None)}


def test_signal_rounds_end_on_an_empty_table(spark):
    assert S.signal_changes(spark.createDataFrame([], ENTRY)).count() == 0


def test_round_state_equals_its_batch_twin(spark, tmp_path):
    rng, at = random.Random(3), str(tmp_path)
    schema = "board_id string, ts timestamp, seq long, tokens long, bulk_tokens long, progress boolean, open_items long, converge boolean"
    rows = [(f"b{k % 7}", T(k / 10), k, rng.randint(0, 90), rng.choice([0, 0, 0, 200]), rng.random() < 0.7, rng.randint(0, 4), rng.random() < 0.2) for k in range(200)]
    for part in (rows[:90], rows[90:], [("z", T(99), 999, 0, 0, True, 0, False)]):
        shuffled = list(part)
        rng.shuffle(shuffled)
        add(spark, at, schema, *shuffled)
        out = E.poured(R.round_stream(spark.readStream.schema(schema).parquet(f"{at}/in"), R.RunState(400)), f"{at}/out", f"board_id string, {R.REPORT}")
    want = R.round_report(spark.createDataFrame(rows, schema), R.RunState(400)).collect()
    assert sorted(map(str, out.where("board_id <> 'z'").collect())) == sorted(map(str, want))
    assert {r.stop for r in want} >= {"budget", "diminishing_returns"} and any(r.budget > 400 for r in want)


def test_binding_waits_its_turn_and_replays_change_nothing(spark, tmp_path):
    claims = [("b", f"c{k:03}", k, str(k % 3)) for k in range(25)]
    targets = spark.createDataFrame([("b", "0"), ("b", "1")], "board_id string, target_id string")
    replies = lambda x: x.selectExpr("board_id", "claim_id", "content as target_id").union(x.selectExpr("board_id", "'never offered'", "'0'"))
    barrier = R.BindingBarrier(str(tmp_path), targets, replies, calls=2, size=5)
    batch = lambda n: spark.createDataFrame(claims[n * 10 : n * 10 + 10], "board_id string, claim_id string, seq long, content string")
    read = lambda: [sorted(map(str, barrier.table(spark, t).collect())) for t in ("edges", "waiting", "judged")]
    for n in range(3):
        barrier(batch(n), n)
        once = read()
        barrier(batch(n), n)  # the batch failed behind its last write and is run again
        assert read() == once
    waiting, said = [], []
    for n in range(3):  # a plain queue
        waiting += claims[n * 10 : n * 10 + 10]
        offered = waiting[:10]
        bound = [x for x in offered if x[3] in "01"]
        waiting = [x for x in waiting if x not in bound]
        said.append((n, len(offered), len(bound), len(waiting), -(-len(offered) // 5), 0))
    got = sorted((r.batch_id, r.offered, r.bound, r.unbound, r.calls, r.open) for r in barrier.table(spark, "judged").collect())
    assert got == said
