"""Ledger operations and confidence against plain replays of random orders of events."""

import random

import pytest

from attestra.operators import confidence as C
from attestra.operators import ledger as L


def replay(targets, ops, binds):
    state = {(b, t): {"status": s, "materiality": m, "need": n, "absorbed_by": None, "basis": None} for b, t, s, m, n in targets}
    bound = {k: [] for k in state}
    for row in sorted([(x[1], "op", x) for x in ops] + [(x[3], "bind", x) for x in binds], key=lambda x: x[0]):
        if row[1] == "bind":
            b, claim, t, _ = row[2]
            if (b, t) in state and claim not in bound[b, t]:
                bound[b, t].append(claim)
            continue
        b, _, op, t, others, value = row[2]
        x = state.get((b, t))
        if x is None:
            continue
        value = (value or "").strip()
        if op == "merge":
            if x["status"] != "open":
                continue
            for o in others:
                y = state.get((b, o))
                if y is None or o == t or y["status"] != "open":
                    continue
                for claim in bound[b, o]:
                    if claim not in bound[b, t]:
                        bound[b, t].append(claim)
                y.update(status="waived", absorbed_by=t, basis=None)
            if value:
                x["need"] = value
        elif op == "reopen":
            if x["status"] == "closed":
                x.update(status="open", absorbed_by=None, basis=None)
        elif op in ("waive", "close", "block"):
            x.update(status=L.STATUS[op], absorbed_by=None, basis=sorted(bound[b, t]) if op == "close" else None)
        elif op == "reprioritize" and value in L.LEVELS:
            x["materiality"] = value
        elif op == "rephrase" and value:
            x["need"] = value
    return state, {(b, claim, t) for (b, t), claims in bound.items() for claim in claims}


@pytest.mark.parametrize("seed", [1, 2])
def test_ledger_equals_a_replay(spark, seed):
    rng = random.Random(seed)
    targets = [(b, f"t{k}", rng.choice(["open", "open", "open", "closed"]), "medium", f"need {k}") for b in "abcd" for k in range(12)]
    ops, binds = [], []
    for seq in range(320):
        b, t = rng.choice("abcd"), f"t{rng.randrange(13)}"
        if rng.random() < 0.35:
            binds.append((b, f"c{rng.randrange(30)}", t, seq))
        else:
            ops.append((b, seq, rng.choice(["merge", "merge", "waive", "close", "close", "block", "reopen", "reopen", "reprioritize", "rephrase"]), t, [f"t{rng.randrange(13)}" for _ in range(rng.randrange(4))], rng.choice(["high", "low", " new words ", "", None])))
    out, edges = L.replayed(
        spark.createDataFrame(targets, "board_id string, target_id string, status string, materiality string, need string"),
        spark.createDataFrame(ops, "board_id string, seq long, op string, target_id string, others array<string>, value string"), spark.createDataFrame(binds, "board_id string, claim_id string, target_id string, seq long"),
    )
    state, bound = replay(targets, ops, binds)
    got = {(r.board_id, r.target_id): {"status": r.status, "materiality": r.materiality, "need": r.need, "absorbed_by": r.absorbed_by, "basis": r.closure_basis} for r in out.collect()}
    assert got == state and {tuple(r) for r in edges.collect()} == bound
    assert any(x["absorbed_by"] for x in state.values()) and any(x["basis"] for x in state.values())


def test_confidence_equals_a_replay(spark):
    rng = random.Random(5)
    rows, value = [], {}
    for b in "abc":
        for k in range(60):
            pick = lambda n: [f"e{rng.randrange(k + 3)}" for _ in range(rng.randrange(n))]  # noqa: B023,E731
            rows.append((b, f"e{k}", k, rng.choice(["d1", "d2", None]), pick(5), pick(3) if rng.random() < 0.4 else [], rng.choice([0.6, 0.95, 0.15])))
    for i, (b, e, seq, document, supports, contradicts, confidence) in enumerate(rows):
        value[b, e] = round(confidence * 1e6)
        here = {x[1]: x for x in rows[: i + 1] if x[0] == b}
        for t in supports:
            if t in here:
                same = sum(t in x[4] and x[3] is not None and x[3] == here[t][3] for x in here.values())
                value[b, t] = min(C.TOP, value[b, t] + (C.SMALL_RAISE if same > C.FEW else C.RAISE))
        once = False
        for t in contradicts:
            if t in here:
                value[b, t] = max(C.FLOOR, value[b, t] - C.LOWER)
                if not once:
                    value[b, e], once = max(C.FLOOR, value[b, e] - C.LOWER), True
                for x in here.values():
                    if t in x[4]:
                        value[b, x[1]] = max(C.FLOOR, value[b, x[1]] - C.WEAKEN)
    entries = spark.createDataFrame(rows, "board_id string, entry_id string, seq long, document string, supports array<string>, contradicts array<string>, confidence double")
    for block in (C.BLOCK, 3):
        got = {(r.board_id, r.entry_id): round(r.confidence * 1e6) for r in C.confidences(entries, block).collect()}
        assert got == value
    assert C.confidences(entries.limit(0)).count() == 0


def test_a_round_of_the_ledger_is_one_pass(spark, monkeypatch):
    """What targets and those that absorb them were before comes out of one window, without a join."""
    from attestra.operators import graph, ledger

    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return graph.cut(df)

    monkeypatch.setattr(ledger, "cut", kept)
    targets = spark.createDataFrame([("b", t, "open") for t in ("x", "y", "z")], "board_id string, target_id string, status string")
    ops = [(1, "merge", "x", ["y", "x", "q"]), (2, "merge", "y", ["z"]), (3, "close", "x", []), (4, "merge", "z", ["x"]), (5, "reopen", "x", []), (6, "merge", "z", ["x", "y"]), (7, "reopen", "z", [])]
    ops = spark.createDataFrame([("b", *o) for o in ops], "board_id string, seq long, op string, target_id string, others array<string>")
    got = {(r.target_id, r.seq, r.pos, r.op, r.keep) for r in ledger.status_events(targets, ops).collect()}
    assert got == {("y", 1, 0, "absorb", "x"), ("x", 3, 0, "close", None), ("x", 5, 0, "reopen", None), ("x", 6, 0, "absorb", "z")}
    assert len(plans) > 2 and all(p.count("Window [") == 1 and "Join" not in p for p in plans[1:])
