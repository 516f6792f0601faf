"""Every registered query with an SQL oracle gives the oracle's rows at the smallest scale."""

import os

import duckdb
import random

import pytest
from pyspark.sql import functions as F

from attestra.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return round(v, 9)
    return v if v is None or isinstance(v, (bool, int)) else str(v)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    relation = duck.sql(registry.ORACLE_SQL[name])
    assert columns == sorted(relation.columns)
    at = [relation.columns.index(c) for c in columns]
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert mine == sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)


def test_chunks_keep_order_and_caps(spark):
    from pyspark.sql import functions as F

    from attestra.operators.ranking import packed

    rows = [(d, i, (i * 37 + d) % 500) for d in range(5) for i in range(40)]
    out = packed(spark.createDataFrame(rows, "d int, i int, size int"), "d", "i", F.col("size"), 1200, 8).collect()
    sizes = {(d, i): s for d, i, s in rows}
    assert {(r.d, r.i) for r in out} == set(sizes)
    for d in range(5):
        own = sorted((r.i, r.chunk) for r in out if r.d == d)
        assert [c for _, c in own] == sorted(c for _, c in own)
        for chunk in {c for _, c in own}:
            mine = [i for i, c in own if c == chunk]
            assert len(mine) <= 8 and (len(mine) == 1 or sum(sizes[d, i] for i in mine) <= 1200)


@pytest.mark.parametrize("parts", [1, 7])
def test_partitions_dont_change_admission(spark, parts):
    from attestra.operators.matching import admission

    texts = spark.createDataFrame([(1, "one two three four five six seven eight nine ten 11"), (2, "Alpha  beta\ngamma delta epsilon zeta eta theta iota kappa")], "text_id int, text string").repartition(parts)
    claims = spark.createDataFrame(
        [(1, "x", "three four five six seven"), (2, "x", "ALPHA beta gamma delta"), (3, "has 12", "nine ten 11"), (4, "x", ""), (5, "x", "not in any of the texts at all"), (6, "x", "ree four fi")],
        "claim_id int, content string, evidence string",
    ).repartition(parts)
    got = {r.claim_id: (r.reason, r.tier, r.start_char, r.end_char) for r in admission(claims, texts, 1).collect()}
    assert got[1] == ("admitted", 1, 8, 33)
    assert got[2][:2] == ("admitted", 3) and got[2][2:] == (0, 23)
    assert got[3][0] == "unsupported_digits" and got[4][0] == "empty_evidence" and got[5][0] == "unsupported_quote"
    assert got[6][0] == "admitted"


def test_consolidation_is_the_leader_pass(spark):
    """Longest first; a row goes to the first kept row that shares 85 % of its words, unless the guard rolls its board back."""
    import re

    from attestra.plans.entries import consolidated

    vocabulary = [f"word{i}" for i in range(90)]
    rows = []
    for b in range(4):
        for i in range(20 if b else 6):
            base = vocabulary[(i // (4 if b == 1 else 2)) * 7 % 40 :][:20]
            rows.append((len(rows), b, f"{b}/{i % 2 if b == 3 else 0}", " ".join(base[: 20 - i % 3] + ["x" * (i % 5 + 4)])))
    rows += [(900, 2, "2/0", ""), (901, 2, "2/0", None)]
    rows = [r if r[3] is not None else (*r[:3], "") for r in rows]
    expected = {}
    for b in {r[1] for r in rows}:
        mine, led = [r for r in rows if r[1] == b], {}
        for g in {r[2] for r in mine}:
            kept = []
            for r in sorted((r for r in mine if r[2] == g), key=lambda r: (-len(r[3]), r[0])):
                words = {w for w in re.split(r"\W+", r[3].lower()) if len(w) > 3}
                near = [k for k, other in kept if words and len(words & other) * 100 >= len(words | other) * 85]
                led[r[0]] = near[0] if near else r[0]
                if not near:
                    kept.append((r[0], words))
        gone = sum(k != v for k, v in led.items())
        expected |= led if len(mine) < 15 or gone * 10 <= len(mine) * 3 else {k: k for k in led}
    items = spark.createDataFrame(rows, "item_id int, board_id int, grp string, summary string")
    assert {r.item_id: r.leader for r in consolidated(items.repartition(5)).collect()} == expected
    assert any(k != v for k, v in expected.items())


def test_sections_follow_the_first_similar_name(spark):
    from attestra.plans.entries import merged_sections

    names = [f"Topic{chr(97 + i)} alpha{chr(97 + i)} cost" for i in range(22)] + ["Payment terms fees", "Payment term fee", "Payment terms fees dates", "Payment fees dates schedules"]
    rows = [(1, n) for i, n in enumerate(names) for _ in range(60 - i)] + [(2, "Payment terms fees"), (2, "Payment term fee")]
    got = {(r.board_id, r.name): r.merged for r in merged_sections(spark.createDataFrame(rows, "board_id int, name string")).collect()}
    assert got[1, "Payment term fee"] == got[1, "Payment terms fees dates"] == "Payment terms fees"
    # reached through a merged name, as names go where the name that takes them in went
    assert got[1, "Payment fees dates schedules"] == "Payment terms fees"
    assert got[2, "Payment term fee"] == "Payment term fee" and len(got) == 28


def test_quotes_of_any_length_are_found(spark):
    """All quotes of 1 to 12 words, and of odd cuts, against all texts by brute force, with the default run length."""
    from attestra.operators.matching import admission, locate_quotes

    texts = {1: "The Borrower shall pay all fees within 30 days  of the\nClosing Date, and no later than 31 December 2024.", 2: "pay all fees", 3: "ΟΔΟΣΑ ok", 4: "x", 5: "Each lender shall pay all costs of the closing. " * 3}
    words = texts[1].split()
    quotes = [" ".join(words[i : i + k]) for k in range(1, 13) for i in range(len(words) - k + 1)]
    quotes += ["orrower sha", "ees with", "o", "ALL FEES", "e\nC", "pay all costs", "pay all cash", "ΟΔΟΣ", "x", "zz", "Date, and no late", "fees costs", " 30 days ", ""]
    flat = lambda s: " ".join(s.split())
    tier = lambda q, t: 1 if q.strip(" ") in t else 2 if flat(q) in flat(t) else 3 if flat(q).lower() in flat(t).lower() else None
    expected = {(i, k): tier(q, t) for i, q in enumerate(quotes) for k, t in texts.items() if q and tier(q, t)}
    given = spark.createDataFrame(list(enumerate(quotes)), "quote_id int, quote string")
    rows = spark.createDataFrame(list(texts.items()), "text_id int, text string")
    got = locate_quotes(given, rows).collect()
    assert {(r.quote_id, r.text_id): r.tier for r in got} == expected and len(got) == len(expected)
    for r in got:
        assert flat(texts[r.text_id][r.start_char : r.end_char]).lower() == flat(quotes[r.quote_id]).lower()
    claims = spark.createDataFrame([(1, "30 days", "30 days"), (2, "x", "no later than 31 December"), (3, "x", "days later")], "claim_id int, content string, evidence string")
    assert {r.claim_id: r.reason for r in admission(claims, rows).collect()} == {1: "admitted", 2: "admitted", 3: "unsupported_quote"}


def test_all_supporting_pairs_are_found(spark, duck):
    """Against brute force over all items and documents, whatever their ids and languages."""
    import re

    from attestra.operators.matching import supporting

    items = duck.sql("select item_id, text from benchmark").fetchall()
    docs = duck.sql("select doc_id, text from documents").fetchall()
    items += [(10_000 + d, t[30:90]) for d, t in docs[:12]] + [(20_000 + d, " ".join(t.split()[:9] + ["zzzz"])) for d, t in docs[:12]] + [(30_000, "?!"), (30_001, "no such passage anywhere 99999")]

    def tokens(s):
        return set(re.findall("[a-z0-9]+", s.lower()))

    held_by, expected = {d: tokens(t) for d, t in docs}, set()
    for i, ev in items:
        asked = {t for t in tokens(ev) if len(t) >= 3 or re.search("[0-9]", t)}
        for d, sl in docs:
            whole, held = ev.lower() in sl.lower(), len(asked & held_by[d])
            if whole or asked and 10 * held >= 8 * len(asked):
                expected.add((i, d, whole, held, len(asked)))
    got = supporting(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected
    assert any(i % 40 != d % 40 for i, d, *_ in expected)


def test_all_windows_are_scored_with_all_terms(spark, duck):
    """Against brute force over all items and documents; terms inside longer words count."""
    import re

    from attestra.operators.text import scored_windows

    items = [(i, t) for i, t in duck.sql("select item_id, text from benchmark order by item_id limit 15").fetchall()] + [(901, "sent icens zzzzz"), (902, "a b c")]
    docs = duck.sql("select doc_id, text from documents order by doc_id limit 60").fetchall() + [(9_001, ""), (9_002, "Presentlicensed"), (9_003, "x" * 898 + "licensed")]
    expected = set()
    for i, text in items:
        terms = set(re.findall("[a-z]{4,}", text.lower()))
        for d, t in docs:
            found = [(-sum(x in t.lower()[a : a + 900] for x in terms), a) for a in range(0, max(len(t), 1), 450)]
            best = sorted(f for f in found if f[0])[:3]
            expected |= {(i, d, a, -h, len(terms), r) for r, (h, a) in enumerate(best, 1)}
    got = scored_windows(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected
    assert {(901, 9_002), (901, 9_003)} <= {(i, d) for i, d, *_ in expected}


def test_windows_are_scored_without_rows_for_pairs(spark, duck, monkeypatch):
    """Texts are scored where they are, in pieces of any size; with more terms than go to all tasks joins give the same."""
    from attestra.operators import text as T

    items = spark.createDataFrame([(i, t) for i, t in duck.sql("select item_id, text from benchmark order by item_id limit 15").fetchall()] + [(901, "sent icens zzzzz"), (902, None)], "item_id long, text string")
    texts = duck.sql("select doc_id, text from documents order by doc_id limit 40").fetchall()
    docs = spark.createDataFrame(texts + [(9_001, ""), (9_002, None), (9_003, " ".join(t for _, t in texts))], "doc_id long, text string").coalesce(1)
    rows = lambda df: sorted(map(tuple, df.collect()))
    plan = T.scored_windows(items, docs)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    whole, joined = rows(T.scored_windows(items, docs)), T.scored_windows(items, docs, most=3)
    assert joined.schema.simpleString() == T.scored_windows(items, docs).schema.simpleString() and whole == rows(joined)
    monkeypatch.setattr(T, "SPAN", 3)
    monkeypatch.setattr(T, "HITS", 50)
    monkeypatch.setattr(T, "WORDS", 5)
    assert rows(T.scored_windows(items, docs)) == whole


def test_names_of_any_number_of_words_are_met(spark):
    from attestra.operators.entries import mentions

    texts = [(1, "See Annual Report 2024 final.pdf, please."), (2, "annual report 2024"), (3, "a????b and Acme"), (4, "????"), (5, None)]
    names = ["annual report 2024 final.pdf", "annual report", "please", "????", "ACME", "see annual report 2024 final.pdf, please", "ann", "annual report 2024 fin"]
    got = mentions(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(n,) for n in names], "name string"))
    assert {(r.id, r.name) for r in got.collect()} == {(1, names[0]), (1, names[1]), (2, names[1]), (1, "please"), (3, "????"), (3, "ACME"), (1, names[5])}


@pytest.fixture
def quick_cut(spark, monkeypatch):
    """Cuts without files, as walks of many rounds take long otherwise."""
    from attestra.operators import graph

    monkeypatch.setattr(graph, "cut", lambda df: spark.createDataFrame(df.collect(), df.schema).coalesce(1))


def test_walks_go_on_to_the_end(spark, quick_cut):
    from attestra.operators.graph import depths, reachable

    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 68)] + [(67, 3)], "src int, dst int").coalesce(1)
    assert reachable(spark.createDataFrame([(66, 66)], "start int, id int").coalesce(1), edges).count() == 67
    found = depths(edges, spark.createDataFrame([(0,)], "id int").coalesce(1))
    assert {r.id: r.depth for r in found.collect()} == {i: i for i in range(68)}


def test_a_circle_of_supports_is_an_error(spark, quick_cut):
    from attestra.operators.graph import depths

    with pytest.raises(ValueError, match="cycle"):
        depths(spark.createDataFrame([(1, 0), (2, 1), (3, 2), (2, 3)], "src int, dst int"), spark.createDataFrame([(0,)], "id int"))


def test_a_name_is_registered_once():
    with pytest.raises(ValueError, match="twice"):
        registry.query("top_calc")(None)
    assert {"top_calc", "board_top_calc"} <= set(registry.QUERIES)


def test_custody_runs_forward_in_a_round_and_back_by_one_and_is_capped(spark):
    from attestra.operators import custody

    schema = "board_id int, pos int, invalid boolean, valid boolean"
    rng = random.Random(4)
    entries, supports, mentions = [], [], []
    for board in range(6):
        for pos in range(40):
            entries.append((board, pos, rng.random() < 0.1, rng.random() < 0.2))
            supports += [(board, pos, rng.randrange(45)) for _ in range(rng.randrange(3))]
            if rng.random() < 0.05:
                mentions.append((board, pos))
    for least in (3, 9, 200):
        want = set()
        for board in range(6):
            own = [e for e in entries if e[0] == board]
            gone = {e[1]: 0 for e in own if e[2]}
            direct = len(gone)
            most = max(least, int(0.15 * (len(own) - direct)))
            for k in range(1, 4):
                for _, pos, invalid, valid in own:
                    held = any(s == pos and t in gone and t != pos for b, s, t in supports if b == board) or direct and (board, pos) in mentions
                    if pos not in gone and not valid and held and len(gone) < most:
                        gone[pos] = k
            want |= {(board, pos, k) for pos, k in gone.items()}
        got = custody.quarantined(spark.createDataFrame(entries, schema), spark.createDataFrame(supports, "board_id int, pos int, support int"), spark.createDataFrame(mentions, "board_id int, pos int"), least=least)
        assert {(r.board_id, r.pos, r.round) for r in got.collect()} == want


def test_headings_that_repeat_the_name_go(spark):
    from pyspark.sql import functions as F

    from attestra.operators.text import without_heading

    rows = [("\n\n## 2.1 **Risk  Review**\n\n body \n", "risk review", "body"), ("Sheet: Costs\r\na\r\nb", "Costs", "a\nb"), ("Other\nbody", "Costs", "Other\nbody"), ("Costs", "Costs", ""), (None, "x", ""), ("a\nb", None, "a\nb"), ("", "", "")]
    out = spark.createDataFrame(rows, "text string, name string, want string").select(without_heading(F.col("text"), F.col("name")).alias("got"), "want").collect()
    assert [r.got for r in out] == [r.want for r in out]


def test_signals_are_absorbed_by_the_first_that_stays(spark):
    import re

    from attestra.operators.dedup import merged_signals

    rng = random.Random(3)
    base = [[rng.choice("abcdefghij") * 3 for _ in range(12)] for _ in range(3)]
    rows = [(0, "t", None, 1), (1, "t", "", 2), (2, None, "one two", 0), (3, None, "One two", 3), (4, "t", "one two", 1)]
    for i in range(5, 90):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(12)] = rng.choice("klm")
        rows.append((i, rng.choice("tu"), " ".join(words), rng.randrange(4)))

    def grams(text):
        words = re.sub(r"[^\w\s]", "", (text or "").lower()).split()
        return {" ".join(words[k : k + 3]) for k in range(len(words) - 2)} or {(text or "").lower().strip()}

    kept = []
    for i, kind, text, priority in rows:
        own = grams(text)
        for k in kept:
            if k[1] == kind and 2 * len(own & k[4]) >= len(own | k[4]):
                k[2], k[3] = max(k[2], priority), k[3] + 1
                break
        else:
            kept.append([i, kind, priority, 1, own])
    out = merged_signals(spark.createDataFrame(rows, "id long, type string, content string, priority int").repartition(3))
    assert sorted(tuple(r) for r in out.select("id", "type", "priority", "merged").collect()) == [tuple(k[:4]) for k in kept]
    assert 10 < len(kept) < 70


def test_risky_lines_are_met_by_text_or_by_numbers_and_words(spark):
    from attestra.operators.drafts import without_risky_lines

    texts = [(1, "Intro\n\nRevenue grew 12% in Q3 across northern markets\nclean line"), (2, "Revenue grew 12% in Q3 across northern markets"), (3, None), (4, "")]
    claims = [
        (1, 2, "Markets in northern regions: revenue up, Q3", "overstated", "high"), (1, 1, "revenue GREW 12%", "supported", "high"), (1, 3, " ", "unsupported", "high"),
        (1, 4, "clean line and more", "needs_source", "low"), (2, 2, "GREW 12% in q3", "unsupported", "medium"), (2, 5, "northern markets", "overstated", "high"), (3, 1, "x", "unsupported", "high"),
    ]
    out = without_risky_lines(spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame(claims, "text_id int, seq int, claim string, status string, severity string"))
    mark = "[SOURCE-CHECK QUARANTINED: {} final-output claim removed; see Source Support Caveats]".format
    assert {r.text_id: (r.text, r.quarantined) for r in out.collect()} == {1: (f"Intro\n\n{mark('overstated')}\nclean line", 1), 2: (mark("unsupported"), 1), 3: ("", 0), 4: ("", 0)}


def test_telling_phrases(spark):
    from attestra.operators.drafts import phrases

    rows = [(1, "Covenant breach; manual rollback (of the) Covenant breach. risk risk"), (2, None), (3, ""), (4, "Source backed entry")]
    got = {r.i: [tuple(p) for p in r.p] for r in spark.createDataFrame(rows, "i int, t string").selectExpr("i", "t").select("i", phrases(F.col("t")).alias("p")).collect()}
    assert got == {1: [("covenant breach", 52), ("manual rollback", 52)], 2: [], 3: [], 4: []}


def test_targets_of_gaps(spark):
    from attestra.operators.drafts import target_documents

    docs = [("a", n, i) for i, n in enumerate(["Loan Agreement.pdf", "notes.txt", "loan.xlsx", "Term Sheet", "b"])] + [("z", "loan other", 0), ("a", None, 9)]
    items = [(1, "a", ["LOAN"], None), (2, "a", [], []), (3, "a", ["the term sheet of May"], ["NOTES.TXT"]), (4, "a", ["", None], None), (5, "z", ["nothing"], []), (6, "none", None, None), (7, "a", ["B"], [])]
    out = target_documents(spark.createDataFrame(items, "item_id int, board_id string, requested array<string>, parents array<string>"), spark.createDataFrame(docs, "board_id string, name string, place int"))
    got = {}
    for r in sorted(out.collect()):
        got.setdefault(r.item_id, set()).add(r.name)
    first = {"Loan Agreement.pdf", "notes.txt", "loan.xlsx"}
    assert got == {1: {"Loan Agreement.pdf", "loan.xlsx"}, 2: first, 3: {"notes.txt", "Term Sheet"}, 4: first, 7: {"b"}}


def test_a_frontier_that_fits_has_no_violations(spark):
    from attestra.operators.boards import frontier_violations

    targets = spark.createDataFrame([("a", "t")], "board_id string, target_id string")
    sources = spark.createDataFrame([("a", f"s{i}", i, i < 4) for i in range(5)], "board_id string, source_id string, place int, is_document boolean")
    listed = "board_id string, target_id string, place int, source_id string, priority string, reason string, batch_index int, response_rank int"
    good = [("a", "t", 0, "s0", "definite", "r", 0, 0), ("a", "t", 1, "s2", "definite", "", 1, 0), ("a", "t", 2, "s1", "maybe", "r", 0, 1)]
    spare = spark.createDataFrame([("a", "s3")], "board_id string, source_id string")
    check = lambda rows, rest: sorted((r.kind, r.target_id, r.place, r.source_id) for r in frontier_violations(targets, sources, spark.createDataFrame(rows, listed), rest, 2, 1).collect())
    # two of batch 0 are over a cap of one
    assert check(good, spare) == [("over_cap", "t", None, None)]
    assert check([*good[:2], ("a", "t", 2, "s2", "maybe", None, 0, 1)], spare) == [("malformed", "t", 2, "s2"), ("over_cap", "t", None, None), ("repeated", "t", 2, "s2"), ("uncovered", None, None, "s1"), ("wrong_batch", "t", 2, "s2")]
    assert check([good[0], ("a", "x", 0, "s4", "maybe", "r", 0, 0)], spare.union(spare)) == [("dead_target", "x", 0, "s4"), ("fallback_repeated", None, None, "s3"), ("uncovered", None, None, "s1"), ("uncovered", None, None, "s2"), ("unknown_source", "x", 0, "s4")]
    assert check([good[1], ("a", "t", 2, "s0", "definite", "r", 0, 0)], spare.limit(0)) == [("out_of_order", "t", 2, "s0"), ("uncovered", None, None, "s1"), ("uncovered", None, None, "s3")]
    assert check([(*good[1][:2], 0, *good[1][3:]), ("a", "t", 1, "s0", "definite", "r", 0, 0)], spare)[0] == ("out_of_order", "t", 1, "s0")
