"""Many small keys that share the state of a part, without a stream."""

import json
import random
from types import SimpleNamespace

from pyspark.sql import Row

from attestra.streaming.ordered import CALL, EPOCH, micros
from attestra.streaming.signals import ADDRESS, KEY, OPEN, REOPEN, LifeCycle

SECOND = 1_000_000


def part_of(p: LifeCycle) -> tuple[dict, list, set]:
    """The processor over plain lists, the calls to them, its timers."""
    held, calls, timers = {}, [], set()

    def listed(name, schema):
        rows = held.setdefault(name, [])
        told = lambda what, do: lambda *x: (calls.append((name, what)), do(*x))[1]
        return SimpleNamespace(get=told("get", lambda: iter(list(rows))), appendValue=told("add", rows.append), clear=told("clear", rows.clear))

    def valued(name, schema):
        rows = held.setdefault(name, [])
        return SimpleNamespace(get=lambda: rows[-1] if rows else None, update=lambda v: rows.__setitem__(slice(None), [v]))

    p.key = KEY
    p.init(SimpleNamespace(getListState=listed, getValueState=valued, registerTimer=timers.add))
    return held, calls, timers


def pack(rows: list[dict]) -> Row:
    return Row(first=min(r["at"] for r in rows), n=len(rows), rows=",".join(map(json.dumps, rows)))


def plain(rows: list[dict], p: LifeCycle, end: int) -> list[tuple]:
    """Each signal's rows in order, one at a time."""
    out, states = [], {}
    for r in sorted(rows, key=lambda r: (r["at"], r["seq"], r["step"])):
        k = (r["board_id"], r["signal_id"])
        states[k], said = p.apply(states.get(k), r)
        out += [(*k, x["at"], x["step"], x["status"]) for x in said]
    for k, s in states.items():
        out += [(*k, x["at"], x["step"], x["status"]) for x in p.idle(s, end)[1]]
    return sorted(out)


def test_signals_of_a_part_share_calls_to_the_state():
    rng, p = random.Random(8), LifeCycle(50)
    held, calls, timers = part_of(p)
    rows = []
    for k in range(4000):
        step = rng.choice([OPEN, ADDRESS, ADDRESS, REOPEN])
        rows.append({"at": (k // 3) * SECOND // 4, "seq": k, "step": step, "entry_id": f"e{rng.randint(0, 9)}", "may_answer": rng.random() < 0.5, "type": rng.choice(["question", "artifact_requirement"]), "priority": rng.choice(["high", "low", None]), "board_id": "é\"b" if k % 2 else "b", "signal_id": f"{rng.randint(0, 400)}/0"})
    out, batches = [], 8
    for n in range(batches):  # rows of neighbouring batches are mixed, and the watermark follows behind
        some = rows[n * 500 : n * 500 + 500]
        rng.shuffle(some)
        list(p.handleInputRows((0,), iter([pack(some[:1]), pack(some[1:])]), None))
        if timers and n % 2:
            wm = (rows[max(0, (n - 1) * 500)]["at"]) // 1000
            out += p.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: wm), None)
    end = rows[-1]["at"] // 1000 + 200_000
    out += p.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: end), None)
    got = sorted((r.board_id, r.signal_id, micros(r.at), r.step, r.status) for r in out)
    assert got == plain(rows, LifeCycle(50), end * 1000 + 999) and len({g[4] for g in got}) == 3
    assert len(calls) < 100 and not held["waiting"]
    live = p.listed(p.states)
    assert len(live) <= 2 * len({tuple(k) for k, _ in live})


def test_a_row_no_later_than_what_was_applied_is_left_out():
    p = LifeCycle(50)
    part_of(p)
    row = {"at": 10 * SECOND, "seq": 1, "step": OPEN, "entry_id": "e", "may_answer": False, "type": "question", "priority": "high", "board_id": "b", "signal_id": "e/0"}
    list(p.handleInputRows((0,), iter([pack([row])]), None))
    at = SimpleNamespace(getCurrentWatermarkInMs=lambda: 20_000)
    assert [r.status for r in p.handleExpiredTimer((0,), at, None)] == ["open"]
    late, same = {**row, "at": 20 * SECOND, "signal_id": "f/0"}, {**row, "at": 20 * SECOND + 1, "signal_id": "g/0"}
    list(p.handleInputRows((0,), iter([pack([late, same])]), None))
    later = SimpleNamespace(getCurrentWatermarkInMs=lambda: 30_000)
    assert [(r.signal_id, micros(r.at)) for r in p.handleExpiredTimer((0,), later, None)] == [("g/0", 20 * SECOND + 1)]


def test_packs_hold_every_row_of_their_part_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from attestra.streaming import ordered

    monkeypatch.setattr(ordered, "HELD", 100)
    monkeypatch.setattr(ordered, "PARTS", 90)
    p = LifeCycle()
    p.key = KEY
    rows = spark.range(1000).select(F.timestamp_millis(c := F.col("id") * 7 % 1000).alias("ts"), F.lit("b").alias("board_id"), F.concat(F.lit("s,\"]é"), (c % 300).cast("string")).alias("signal_id"), F.when(F.col("id") != 5, 2**53 + F.col("id")).alias("seq"), F.lit(0).alias("step"), F.lit("e").alias("entry_id"), F.lit(None).cast("boolean").alias("may_answer"), F.lit(None).cast("string").alias("type"), F.lit("low").alias("priority"))
    packs = p.packed(rows).collect()
    got = [(r.part, x) for r in packs for x in json.loads(f"[{r.rows}]")]
    assert len(packs) < 1000 and sorted(x["seq"] or 0 for _, x in got) == sorted(r.seq or 0 for r in rows.collect())
    assert len({(x["signal_id"], part) for part, x in got}) == len({x["signal_id"] for _, x in got})
    for r in packs:
        ats = [x["at"] for x in json.loads(f"[{r.rows}]")]
        assert (min(ats), max(ats), len(ats)) == (r.first, micros(r.ts), r.n) and len(ats) <= CALL and r.ts.astimezone(EPOCH.tzinfo) >= EPOCH
