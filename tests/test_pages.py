"""Balanced pages against a plain dealing; the ordered tier of evidence against a plain table of common runs."""

import random
import re

from attestra.operators import matching as M
from attestra.operators import pages as P


def rotate(items, iteration, stride, take):
    at = (max(iteration, 1) - 1) * stride % len(items) if items else 0
    return (items[at:] + items[:at])[:take]


def test_balanced_page(spark):
    rng, limit = random.Random(4), 9
    boards = [(b, rng.randrange(6)) for b in "abcdefgh"]
    targets, candidates, sources = [], [], []
    for b, _ in boards:
        for k in range(rng.randrange(7)):
            targets.append((b, f"t{k}", k, rng.random() < 0.8, rng.random() < 0.4))
            candidates += [(b, f"t{k}", i, f"s{rng.randrange(14)}") for i in range(rng.randrange(12))]
        sources += [(b, i, f"s{rng.randrange(16)}", rng.random() < 0.3) for i in range(rng.randrange(25))]
    got = P.balanced_page(
        spark.createDataFrame(boards, "board_id string, iteration int"), spark.createDataFrame(targets, "board_id string, target_id string, pos int, open boolean, material boolean"),
        spark.createDataFrame(candidates, "board_id string, target_id string, pos int, source_id string"), spark.createDataFrame(sources, "board_id string, pos int, source_id string, read boolean"), limit,
    )
    pages = {}
    for r in sorted(got.collect(), key=lambda r: (r.board_id, r.slot)):
        pages.setdefault(r.board_id, []).append((r.slot, r.source_id, r.part))
    for b, iteration in boards:
        known = {}
        for x in sources:
            if x[0] == b:
                known.setdefault(x[2], x[3])
        lists = {t: [x[3] for x in candidates if x[0] == b and x[1] == t] for t in (x[1] for x in targets if x[0] == b)}
        order = [x[1] for x in sorted((x for x in targets if x[0] == b and x[3] and lists[x[1]]), key=lambda x: (not x[4], x[2]))]
        stride = max(1, limit // max(1, len(order)))
        queues = {t: rotate([s for s in lists[t] if known.get(s) is False], iteration, stride, 10**9) for t in order}
        page, moved = [], True
        order = rotate(order, iteration, 1, 10**9)
        while moved and len(page) < limit:
            moved = False
            for t in order:
                fresh = [s for s in queues[t] if s not in page]
                if fresh and len(page) < limit:
                    page.append(fresh[0])
                    moved = True
        want = [(s, "target") for s in page]
        for read, part in ((False, "unread"), (True, "read")):
            rest = [s for s in known if known[s] is read and s not in page]
            want += [(s, part) for s in rotate(rest, iteration, limit, limit - len(want))] if len(want) < limit else []
        assert pages.get(b, []) == [(i, *x) for i, x in enumerate(want)], b


def test_evidence_tiers(spark):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "of", "42", "x1", "omega", "to", "sigma"]
    items, docs = [], []
    for k in range(25):
        text = [rng.choice(words) for _ in range(rng.randint(1, 14))]
        items.append((k, " ".join(text), rng.choice([None, "", " ".join(rng.sample(words, 3)), "alpha 42"])))
        for _ in range(4):
            own = [w for w in text if rng.random() < 0.9]
            if rng.random() < 0.3:
                rng.shuffle(own)
            at = rng.randrange(len(own) + 1)
            docs.append((len(docs), rng.choice([" ", ", "]).join(["Start", *own[:at], *rng.choices(words, k=rng.randrange(3)), *own[at:], "end"])))
    docs += [(1000 + k, f"So {x[1].upper()} it is") for k, x in enumerate(items)] + [(2000, None), (2001, "")]
    tokens = lambda x: re.findall("[a-z0-9]+", (x or "").lower())
    telling = lambda x: [t for t in tokens(x) if len(t) >= 3 or re.search("[0-9]", t)]

    def common(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    want = set()
    for i, text, content in items:
        e = telling(text)
        for d, held in docs:
            if held and text.lower() in held.lower():
                want.add((i, d, "exact"))
            elif e and min(common(e, tokens(held)) / len(e), len(set(e) & set(tokens(held))) / len(set(e))) >= 0.8 and not (set(telling(content)) & set(e)) - set(tokens(held)):
                want.add((i, d, "ordered"))
    got = M.evidence_tiers(spark.createDataFrame(items, "item_id int, text string, content string"), spark.createDataFrame(docs, "doc_id int, text string"))
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert sum(x[2] == "ordered" for x in want) > 20


def test_pages_are_dealt_once_whatever_the_batches(spark):
    """What is left over and the page itself come from one dealing, and a board's rows may come in several batches."""
    boards = spark.createDataFrame([(b, 1) for b in "abcd"], "board_id string, iteration int")
    targets = spark.createDataFrame([(b, f"t{k}", k, True, False) for b in "abcd" for k in range(3)], "board_id string, target_id string, pos int, open boolean, material boolean")
    candidates = spark.createDataFrame([(b, f"t{k}", i, f"s{3 * i + k}") for b in "abcd" for k in range(3) for i in range(4)], "board_id string, target_id string, pos int, source_id string")
    sources = spark.createDataFrame([(b, i, f"s{i}", i >= 14) for b in "abcd" for i in range(20)], "board_id string, pos int, source_id string, read boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = P.balanced_page(boards, targets, candidates, sources, 18)
        assert "InPandas" not in got._jdf.queryExecution().toString()
        pages = {(r.board_id, r.slot): (r.source_id, r.part) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert pages == {(b, i): (f"s{i}", "target" if i < 12 else "unread" if i < 14 else "read") for b in "abcd" for i in range(18)}


def test_section_items_take_more_tasks_for_more_claims(spark, monkeypatch):
    """A claim that a target holds twice, one without id, a binding one; tasks hold a bounded number of rows."""
    from attestra.operators import ranking
    from attestra.operators.pages import section_items

    sections = spark.createDataFrame([("b", 1, "k1", 0, "t0"), ("b", 1, "k1", 1, "t1"), ("b", 2, "k2", 0, "t1")], "board_id string, section_no int, key string, target_pos int, target_id string")
    claims = [("b", "t1", 5, "c1"), ("b", "t0", 7, "c1"), ("b", "t0", 3, "c1"), ("b", "t0", 4, None), ("b", "t1", 6, "c2"), ("b", "t1", 1, "c9")] + [("b", "t0", 10 + i, f"d{i}") for i in range(60)]
    claims = spark.createDataFrame(claims, "board_id string, target_id string, pos long, claim_id string")
    coverage = spark.createDataFrame([("b", 0, "k1", "o1")], "board_id string, pos int, key string, obligation_id string")
    units = spark.createDataFrame([("b", "o1", 0, "u1", ["c1", "c5", "c9"]), ("b", "o1", 1, "u2", ["c5"]), ("b", "o1", 2, "u3", [])], "board_id string, obligation_id string, pos int, unit_id string, claim_ids array<string>")
    requirements = spark.createDataFrame([("b", "c9")], "board_id string, claim_id string")
    monkeypatch.setattr(ranking, "TASK_ROWS", 5)
    got = section_items(sections, claims, coverage, units, requirements)
    assert got.rdd.getNumPartitions() >= 14
    rows = {(r.section_no, r.target_id or r.unit_id, tuple(r.canonical), tuple(r.context), tuple(r.requirements), r.at.b) for r in got.collect() if not (r.canonical or [""])[0].startswith("d")}
    assert rows == {
        (1, "t0", ("c1",), (), (), 3), (1, "t0", (), (), (), 4), (1, "t1", ("c2",), (), (), 6), (2, "t1", ("c1",), (), (), 5), (2, "t1", ("c2",), (), (), 6),
        (1, "u1", ("c5",), ("c1",), ("c9",), 0), (1, "u2", (), ("c5",), (), 1), (1, "u3", (), (), (), 2),
    }
