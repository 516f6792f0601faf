"""Timers of keyed state, without a stream."""

from datetime import datetime, timezone
from types import SimpleNamespace

from pyspark.sql import Row

from attestra.streaming.ordered import InOrder, micros


def test_a_batch_of_rows_sets_one_timer():
    timers, kept = [], []
    p = InOrder()
    p.handle = SimpleNamespace(registerTimer=timers.append)
    p.fields = ["seq"]
    p.waiting = SimpleNamespace(appendList=kept.extend, appendValue=kept.append)
    times = [datetime(2024, 1, 1, 0, 0, s, tzinfo=timezone.utc) for s in (5, 3, 9)]
    assert list(p.handleInputRows(("k",), iter([Row(ts=t, seq=i) for i, t in enumerate(times)]), None)) == []
    assert timers == [micros(times[1]) // 1000 - 1] and kept == [(micros(t), i) for i, t in enumerate(times)]
