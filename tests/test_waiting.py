"""Rows that wait in a key's state, without a stream."""

import random
from datetime import datetime, timedelta, timezone
from types import SimpleNamespace

from pyspark.sql import Row

from attestra.streaming import ordered
from attestra.streaming.rounds import RunState

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def state_of(p: RunState) -> tuple[list, set]:
    """The processor over plain values."""
    waiting, timers, value = [], set(), []
    p.handle = SimpleNamespace(registerTimer=timers.add)
    p.key, p.fields, p.kept = ["board_id"], p.names(p.ROW), p.names(p.STATE)
    put = lambda rows: waiting.__setitem__(slice(None), rows)
    p.waiting = SimpleNamespace(get=lambda: iter(list(waiting)), put=put, appendList=waiting.extend, clear=waiting.clear, exists=lambda: bool(waiting))
    p.state = SimpleNamespace(get=lambda: value[0] if value else None, update=lambda v: value.__setitem__(slice(None), [v]), exists=lambda: bool(value))
    return waiting, timers


def test_only_rounds_that_may_count_wait():
    """A board of 200 rows in batches out of order keeps no more of them than it has rounds, and reports the same rounds."""
    rng = random.Random(5)
    rows = [Row(ts=T0 + timedelta(seconds=k // 2), seq=k, tokens=1, bulk_tokens=0, progress=True, open_items=k % 5, converge=False) for k in range(200)]
    rng.shuffle(rows)
    p = RunState(1000)
    waiting, timers = state_of(p)
    for at in range(0, 200, 40):
        assert list(p.handleInputRows(("b",), iter(rows[at : at + 40]), None)) == []
        assert len(waiting) <= p.rounds
    assert min(timers) <= T0.timestamp() * 1000
    out = []
    for now in (2, 100):  # the watermark passes some of them first
        out += p.handleExpiredTimer(("b",), SimpleNamespace(getCurrentWatermarkInMs=lambda: int(T0.timestamp() * 1000) + now * 1000), None)
    assert [(r.seq, r.round) for r in out] == [(k, k + 1) for k in range(12)] and out[-1].stop == "max_rounds"
    assert not waiting


def test_rows_behind_those_that_count_are_not_handed_on(spark, monkeypatch):
    schema = "board_id string, ts timestamp, seq long, tokens long"
    rows = [(f"b{k % 3}" if k % 4 else None, T0 + timedelta(seconds=(k * 37) % 50), 2**53 + k, 1) for k in range(300)]
    kept = ordered.thinned(spark.createDataFrame(rows, schema), ["board_id"], ["ts", "seq"], 5)
    want = {b: sorted(r for r in rows if r[0] == b)[:5] if b else sorted((r for r in rows if r[0] is None), key=lambda r: r[1:])[:5] for b in ("b0", "b1", "b2", None)}
    got = [(r.board_id, r.ts.replace(tzinfo=timezone.utc) if r.ts.tzinfo is None else r.ts, r.seq, r.tokens) for r in kept.collect()]
    assert sorted(r[2] for r in got) == sorted(r[2] for x in want.values() for r in x)
    monkeypatch.setattr(ordered, "HELD", 7)
    few = ordered.thinned(spark.createDataFrame(rows, schema), ["board_id"], ["ts", "seq"], 5)
    assert {r.seq for r in few.collect()} >= {r[2] for x in want.values() for r in x}
