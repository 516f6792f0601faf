"""Each training-data operator against brute force on a small table with all the odd cases."""

import hashlib
import math
import os
import random
import re
import time
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from attestra.llm import dom, exact_dedup, graphs, html_extraction, line_dedup, mixing, near_dedup, packing, quality_classifier, quality_rules, suffix_dedup, tokens

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n int, label string, rank int, count int, a int, digest string, _h int, _lines int, _gone int, gone int, _pd int, _copies int, copies int, row int, own int, `id` int, `tie` int"


def lower(s):
    return s.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def make_rows():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = say(120), say(60)
    texts = [None, "", "   \n\t ", "one", "Two words", "Two words", "TWO WORDS", "a b c", "é日本 über", "x " * 300, "a" * 900, base, base.upper(), base + " end", "pre " + base, passage, say(30) + passage + say(30), say(10) + "\n" + passage + "\n" + say(50), "<|endoftext|> it's  12 ok<|endoftext|>"]
    for k in range(12):  # near copies
        w = base.split()
        for _ in range(k // 4 + 1):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    texts += [say(rng.randint(1, 200)) + "\n" + "Shared line of every site." + "\n" + say(20) for _ in range(60)]
    texts.append(say(30_000))
    rows = []
    for i, t in enumerate(texts):
        rows.append((i * 3 + 1, t, None if i % 9 == 4 else "en", None if i % 7 == 3 else f"s{i % 11}", None, "k", i, "l", i, i, i, "d", *[i] * 11))
    # two letters in the order of the Thue-Morse sequence and its opposite: polynomial hashes modulo powers of two can't tell them apart
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    for i, t in enumerate([one, two, one + "\n" + two, f"{one} x y {two} x y"]):
        rows.append((9001 + i, t, "en", "s1", None, "k", i, "l", i, i, i, "d", *[i] * 11))
    rows.append(rows[11])  # a repeated row
    return rows


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nameless(spark):
    """No row has an id; copies, near copies and equal sizes among them."""
    return spark.createDataFrame([(None, *r[1:]) for r in ROWS], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append(r)
    return out


def test_exact_dedup(docs, empty, nameless):
    got = by_id(exact_dedup.exact_dedup(docs))
    groups = defaultdict(list)
    for r in ROWS:
        groups[lower(r[1] or "")].append(r[0])
    assert sum(map(len, got.values())) == len(ROWS)
    for r in ROWS:
        t = lower(r[1] or "")
        for x in got[r[0]]:
            assert (x.keep_id, x.group_size, x.kept, x.text_sha256) == (max(groups[t]), len(groups[t]), r[0] == max(groups[t]), hashlib.sha256(t.encode()).hexdigest())
    left = exact_dedup.deduplicated(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(max(g) for g in groups.values())
    assert sorted(lower(r.text or "") for r in exact_dedup.deduplicated(nameless).collect()) == sorted(groups)
    assert {(r.keep_id, r.kept) for r in exact_dedup.exact_dedup(nameless).collect()} == {(None, True)}
    assert exact_dedup.exact_dedup(empty).count() == 0 == exact_dedup.deduplicated(empty).count()


def test_exact_dedup_against_history(spark, docs):
    past = spark.createDataFrame([(bytearray(hashlib.sha256(b"one").digest()), 7, 3)], "digest binary, winner long, copies long")
    got = by_id(exact_dedup.exact_dedup(docs, past))
    assert [(x.keep_id, x.group_size, x.kept) for x in got[10]] == [(7, 3, False)]


def test_a_minimal_perfect_hash_has_every_slot_once():
    for n in (1, 2, 5, 300, 3000):
        keys = [hashlib.sha256(b"%d" % i).digest() for i in range(n)]
        assert sorted(exact_dedup.build_block(keys)[1].tolist()) == list(range(n))


def test_suffix_dedup(docs, empty):
    got = by_id(suffix_dedup.suffix_dedup(docs))
    texts = [(r[1] or "").encode() for r in ROWS]
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    for r, t in zip(ROWS, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        kept = hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()
        for x in got[r[0]]:
            assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == (len(t), sum(gone), spans, kept)
    assert sum(map(len, got.values())) == len(ROWS)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_suffix_dedup_of_anchors_with_many_runs(docs, monkeypatch):
    plain = sorted(map(tuple, suffix_dedup.suffix_dedup(docs).collect()))
    for name, value in (("GROUP", 1), ("FEW", 0), ("ROW_RUNS", 3), ("ROW_BYTES", 50)):
        monkeypatch.setattr(suffix_dedup, name, value)
        if name != "FEW":
            assert sorted(map(tuple, suffix_dedup.suffix_dedup(docs).collect())) == plain
    monkeypatch.setattr(suffix_dedup, "GROUP", 20_000)
    assert sorted(map(tuple, suffix_dedup.suffix_dedup(docs).collect())) == plain


def test_anchors_of_a_text_are_the_same_beside_long_texts():
    rng = np.random.RandomState(1)
    short, long = rng.randint(97, 100, 3000).astype(np.uint8), rng.randint(97, 100, 3_000_000).astype(np.uint8)
    own = suffix_dedup.runs(short, np.array([0, len(short)]))
    both = suffix_dedup.runs(np.concatenate([long, short]), np.array([0, len(long), len(long) + len(short)]))
    assert [both[k][both["doc"] == 1].tolist() for k in ("start", "length", "at", "anchor")] == [own[k].tolist() for k in ("start", "length", "at", "anchor")]


def test_the_loser_tree_merges_in_order_with_common_prefixes():
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    pieces = [sorted(strings[i::5]) for i in range(5)]
    got = list(suffix_dedup.merge([suffix_dedup.front_decode(suffix_dedup.front_code(p)) for p in pieces]))
    assert [g[0] for g in got] == sorted(strings)
    assert all(y[1] == len(os.path.commonprefix([x[0], y[0]])) for x, y in zip(got, got[1:]))
    assert all(pieces[k][i] == s for s, _, k, i in got)


def test_token_counts_and_packing(docs, empty):
    library = tokens.library(tokens.vocabulary_path())
    ids = {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids for r in ROWS}
    got = by_id(tokens.token_counts(docs))
    for r in ROWS:
        for x in got[r[0]]:
            assert (x.n_bytes, x.n_tokens, x.over_limit) == (len((r[1] or "").encode()), len(ids[r[0]]), len(ids[r[0]]) > 1024)
    packed = packing.best_fit(docs).collect()
    places, pieces = defaultdict(list), defaultdict(list)
    for x in packed:
        places[x.sequence_id].append((x.offset, x.length))
        pieces[x.doc_id].append(x)
        own = np.array(ids[x.doc_id] + [0], "<u4")
        assert zlib.crc32(own[x.start : x.start + x.length].tobytes()) == x.ids_crc32
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist() and sum(n for _, n in own) <= 2048
    for r in ROWS:
        assert sum(x.length for x in pieces[r[0]]) == (len(ids[r[0]]) + 1) * sum(q[0] == r[0] for q in ROWS)
    assert len(places) <= -(-sum(x.length for x in packed) // 2048) + 1
    assert tokens.token_counts(empty).count() == 0 == packing.best_fit(empty).count()


def best_fit_decreasing(counts, capacity):
    gaps, n = [], 0
    for length in sorted(counts.elements(), reverse=True):
        k = bisect_left(gaps, length)
        left = gaps.pop(k) if k < len(gaps) else capacity
        n += left == capacity
        insort(gaps, left - length)
    return n


@pytest.mark.parametrize("draw", [
    lambda rng: rng.choice([rng.randint(1, 60), rng.randint(1, 2048)]),  # short and long
    lambda rng: rng.choice([700, 700, rng.randint(600, 1100)]),  # a third of all of one length, few fit together
    lambda rng: rng.choice([1, 2048, 2047]),  # full, nearly full and least
])
def test_rounds_place_all_and_waste_little(spark, draw):
    rng = random.Random(1)
    counts = Counter(draw(rng) for _ in range(5000))
    placed = packing.rounds(spark.createDataFrame(list(counts.items()), "length long, count long"), 2048)
    used, ranks = defaultdict(list), Counter()
    for length, a, b, first, offset in placed.tolist():
        assert ranks[length] == a  # each rank once
        ranks[length] = b
        for k in range(b - a):
            used[first + k].append((offset, length))
    assert ranks == counts
    for own in used.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist() and sum(n for _, n in own) <= 2048
    assert len(used) <= 1.01 * best_fit_decreasing(counts, 2048) + 1


def test_mixing(docs, empty, nameless):
    rows = mixing.balanced(docs).collect()
    size = lambda t: len(WORD.findall(t or ""))
    total = Counter()
    for r in ROWS:
        total[r[3]] += size(r[1])
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight, full, aim = {s: i % 3 + 1 for i, s in enumerate(order)}, set(), {}
    while True:
        rest = [s for s in order if s not in full]
        left = sum(total.values()) - sum(3 * total[s] for s in full)
        aim = {s: 3 * total[s] for s in full} | {s: left * weight[s] / sum(weight[q] for q in rest) for s in rest}
        over = {s for s in rest if aim[s] > 3 * total[s] + 1e-9}
        if not over:
            break
        full |= over
    taken, largest = Counter(), Counter()
    assert len(rows) == len(ROWS)
    for x in rows:
        assert x.source_size == total[x.source] and abs(x.target - aim[x.source]) < 1e-6 and 0 <= x.copies <= 3
        taken[x.source] += x.copies * x.size
        largest[x.source] = max(largest[x.source], x.size)
    for s in order:
        assert abs(taken[s] - aim[s]) <= largest[s], (s, taken[s], aim[s])
    assert sorted(map(tuple, mixing.balanced(docs).collect())) == sorted(map(tuple, rows))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(x.copies for x in rows)
    counts = Counter((r.doc_id, r.source, size(r.text)) for r in out.collect())
    given = Counter()
    for x in rows:
        given[x.doc_id, x.source, x.size] += x.copies
    assert counts == +given
    unnamed = mixing.balanced(nameless).collect()
    assert all(x.target == pytest.approx(aim[x.source]) for x in unnamed) and mixing.mixed(nameless).count() == sum(x.copies for x in unnamed)
    assert mixing.mix(empty).count() == 0 == mixing.mixed(empty).count()


def test_running_sums_are_those_of_one_sorted_pass(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, "a", "b"]), i, rng.randint(0, 9)) for i in range(500)]
    rng.shuffle(rows)
    got = mixing.running(spark.createDataFrame(rows, "g string, o int, v long"), ["g"], [mixing.F.col("o")], ["v"]).collect()
    assert len(got) == 500 and all(r.before_v == sum(v for g, o, v in rows if g == r.g and o < r.o) for r in got)


def test_a_solve_that_does_not_end_is_an_error(docs, monkeypatch):
    monkeypatch.setattr(mixing, "PASSES", 1)
    with pytest.raises(RuntimeError):
        mixing.balanced(docs)


def test_components_of_a_long_chain(spark, monkeypatch):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (901, 900)], "a long, b long")
    assert {r.node: r.label for r in graphs.components(chain).collect()} == {i: 0 for i in range(201)} | {900: 900, 901: 900}
    monkeypatch.setattr(graphs, "ROUNDS", 2)
    with pytest.raises(RuntimeError):
        graphs.components(chain)


def test_near_dedup(docs, empty, nameless):
    sets = {}
    for r in ROWS:
        w = WORD.findall(lower(r[1] or ""))
        sets[r[0]] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    got = by_id(near_dedup.near_dedup(docs))
    assert sum(map(len, got.values())) == len(ROWS)
    for i, s in sets.items():
        for x in got[i]:
            assert (x.n_shingles, x.component_id, x.kept) == (len(s), find(i), find(i) == i)
    left = near_dedup.deduplicated(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {find(i) for i in sets}
    wordless = sum(not sets[r[0]] for r in ROWS)
    assert near_dedup.deduplicated(nameless).count() == len({find(i) for i in sets if sets[i]}) + wordless
    assert near_dedup.deduplicated(nameless.unionByName(docs)).count() == left.count() + wordless
    assert near_dedup.near_dedup(empty).count() == 0


def test_estimates_come_near_the_similarity():
    rng = np.random.RandomState(2)
    x = rng.randint(0, 1 << 62, 4000).astype(np.uint64)
    for share in (0.2, 0.5, 0.8, 0.95):
        k = int(2000 * share)
        a, b = x[:2000], np.concatenate([x[:k], x[2000 : 4000 - k]])
        r = near_dedup.registers([np.stack([np.unique(v)] * 2, axis=1) for v in (a, b)]).astype(int)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        e, above = (r[0] == r[1]).sum(), (r[0] > r[1]).sum()
        found = near_dedup.likeliest(*(np.array([float(v)]) for v in (e, above, 128 - e - above, 2000, 2000)))[0]
        assert abs(found - true) < 0.15


def test_a_link_at_the_threshold_with_an_unlucky_estimate_is_found():
    """Two sets of 90 that share 80 of 100 elements; the registers agree in 82 of 128 places, so the estimate is 0.64."""
    x = np.random.RandomState(4).randint(0, 1 << 62, (3000, 100), dtype=np.int64).astype(np.uint64)[1986]
    sets = [np.stack([v, v], axis=1) for v in (np.sort(x[:90]), np.sort(np.concatenate([x[:80], x[90:]])))]
    r = near_dedup.registers(sets)
    bands = np.flatnonzero((r.view(np.uint64)[0] == r.view(np.uint64)[1]))
    assert (r[0] == r[1]).sum() == 82 and len(bands) and near_dedup.similar(*(s.tobytes() for s in sets))
    unit = pd.DataFrame({"key": 1, "lane": 0, "block": 0, "band": bands[0], "node": [1, 2], "label": [1, 2], "n": 90, "registers": [v.tobytes() for v in r], "shingles": [v.tobytes() for v in sets], "stray": [False, True], "whole": True})
    assert near_dedup._partnered(unit)["node"].tolist() == [1, 2]
    assert near_dedup._linked_across(unit).values.tolist() == [[2, 1]]


def test_pairs_at_the_threshold_meet_in_a_bucket_and_pass_the_gate():
    """Recall against all pairs, measured on sets of 5 to 200 shingles with a similarity of 0.8 or a little more."""
    rng = np.random.RandomState(9)
    met = total = 0
    for n in (5, 9, 18, 45, 90, 180):
        for _ in range(60):
            x = rng.randint(0, 1 << 62, 2 * n, dtype=np.int64).astype(np.uint64)
            k = -(-8 * n // 9)  # k shared of n each: k / (2 n - k) >= 0.8
            r = near_dedup.registers([np.stack([v, v], axis=1) for v in (np.sort(x[:n]), np.sort(np.concatenate([x[:k], x[n : 2 * n - k]])))])
            shared = (r.view(np.uint64)[0] == r.view(np.uint64)[1]).any()
            met += bool(shared and near_dedup.likely(r[:1], r[1:], np.array([n]), np.array([n]))[0])
            total += 1
    assert met == total == 360


def test_gates_before_the_full_sets_lose_less_than_the_bands():
    below = lambda n: sum(math.comb(128, k) * 0.8**k * 0.2 ** (128 - k) for k in range(n))
    assert below(int(near_dedup.EQUAL * 128)) + below(math.ceil(near_dedup.FLOOR * 128)) + (1 - 0.8**4) ** 32 < 1e-7


def test_quality_rules(docs, empty):
    got = by_id(quality_rules.quality_rules(docs))
    for r in ROWS:
        t = r[1] or ""
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        bad = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        for x in got[r[0]]:
            assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), bad)
            assert x.kept <= (not bad)
    assert quality_rules.quality_rules(empty).count() == 0


def test_common_lines_of_a_host_are_removed_and_depleted_texts_rejected(spark):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    common = " ".join(f"c{k}" for k in range(60))
    rows = [(i, f"{common}\n{body(i)}", "h") for i in range(8)] + [(100, f"{common}\nown words", "h"), (101, f"{common}\nother words", "g")] + [(200 + i, common + "\nsame copy", "copies") for i in range(9)]
    rows += [(300, common + "\nof one id", "one")] * 9 + [(None, common + "\nof no id", "none")] * 9 + [(None, f"{common}\nno id {i}", "many") for i in range(9)] + [(400 + i, common, None) for i in range(9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = by_id(quality_rules.quality_rules(frame, limit=5))
    assert all(got[i][0].kept and got[i][0].n_kept_words == 60 for i in range(8))
    assert not got[100][0].kept and got[101][0].kept
    assert not any(got[200 + i][0].kept or got[400 + i][0].kept for i in range(9))  # distinct documents count, copies among them
    assert len(got[300]) == 9 and all(x.kept for x in got[300])  # rows of one id are one document
    assert sorted(x.kept for x in got[None]) == [False] * 9 + [True] * 9
    # the whole of it by hand
    held = defaultdict(set)
    for d, t, h in rows:
        for x in set(t.split("\n")):
            held[h, x].add(t if d is None else d)
    for r, (d, t, h) in zip(sorted(map(tuple, quality_rules.quality_rules(frame, limit=5).select("n_kept_words", "n_words").collect())), sorted((sum(len(x.split()) for x in set(t.split("\n")) if len(held[h, x]) <= 5), len(t.split()), 0) for d, t, h in rows)):
        assert r == (d, t)


def test_line_dedup(docs, empty):
    got = by_id(line_dedup.line_dedup(docs, 5))
    blank = " \t\r\x0b\x0c"
    sites = defaultdict(set)
    for r in ROWS:
        for x in (r[1] or "").split("\n"):
            if r[3] is not None:
                sites[x.strip(blank)].add(r[3])
    for r in ROWS:
        lines = (r[1] or "").split("\n")
        full = [x for x in lines if x.strip(blank)]
        kept = [x for x in lines if not (x.strip(blank) and len(sites[x.strip(blank)]) >= 5)]
        text = "\n".join(kept)
        for x in got[r[0]]:
            assert (x.n_lines, x.n_removed, x.n_chars_kept, x.text_sha256) == (len(full), len(lines) - len(kept), len(text), hashlib.sha256(text.encode()).hexdigest())
    assert line_dedup.line_dedup(empty, 5).count() == 0
    assert line_dedup.cleaned(docs, 5).columns == docs.columns


def test_quality_classifier_separates_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_classifier.classified(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert sum(r.predicted == r.quality for r in got) / len(got) >= 0.95
    good, bad = [r.score for r in got if r.quality], [r.score for r in got if not r.quality]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) >= 0.98


def test_compiled_rules_score_as_a_plain_evaluation(docs):
    frame = docs.select(quality_classifier.F.struct("doc_id").alias("row"), "text")
    rules = quality_classifier.Rules(-0.4, [((("words", ">", 4.5), ("word_length", "<=", 6.0)), 1.25), ((("distinct_share", "<=", 0.9),), -0.5), ((("symbol_share", ">", 0.0), ("lines_share", ">", 0.0)), 2.0), ((("stop_share", "<=", 0.01), ("upper_share", ">", 0.5)), -1.5)])
    rows = quality_classifier.measured(frame).withColumn("score", rules.score()).collect()
    texts = {r[0]: r[1] or "" for r in ROWS}
    assert len(rows) == len(ROWS)
    for r in rows:
        t = texts[r.row.doc_id]
        w, n = WORD.findall(t), max(1, len(WORD.findall(t)))
        count = lambda chars: sum(c in chars for c in t)
        own = {"words": len(w), "word_length": len(t) / n, "distinct_share": len(set(w)) / n, "symbol_share": count("#*$%&<>@~^=_\\") / max(1, len(t)), "bar_share": count("|") / n, "shout_share": count("!") / n, "upper_share": sum("A" <= c <= "Z" for c in t) / max(1, len(t)), "digit_share": sum("0" <= c <= "9" for c in t) / max(1, len(t)), "stop_share": count(".?") / n, "lines_share": count("\n") / n}
        assert own == pytest.approx({k: r[k] for k in own})
        total = -0.4
        for rule, weight in rules.weighted:
            if all(own[name] <= limit if sign == "<=" else own[name] > limit for name, sign, limit in rule):
                total += weight
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)))


def test_rules_are_the_paths_of_the_trees():
    tree = "RandomForest\n  Tree 0 (weight 1.0):\n    If (feature 2 <= 0.5)\n     If (feature 0 <= 3.0)\n      Predict: 0.0\n     Else (feature 0 > 3.0)\n      Predict: 1.0\n    Else (feature 2 > 0.5)\n     Predict: 1.0\n"
    assert set(quality_classifier.paths(tree)) == {(("2", "<=", 0.5),), (("0", "<=", 3.0), ("2", "<=", 0.5)), (("0", ">", 3.0), ("2", "<=", 0.5)), (("2", ">", 0.5),)}


def test_quality_classifier_of_odd_tables(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_classifier.classified(docs, none).collect()} == {0.5}
    nulls = spark.createDataFrame([(1, None, 0), (None, 1, 0), (4, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(r.score > 0.99 for r in quality_classifier.classified(docs, nulls).collect())
    assert quality_classifier.classified(empty, nulls).count() == 0
    assert quality_classifier.accepted(docs, none).columns == docs.columns


def test_html_extraction(spark):
    body = "".join(f"<p>Paragraph {i} of the text, long enough to read &amp; keep.<br>Next &lt;line&gt;</p>" for i in range(5))
    page = f"<html><head><title>T</title><script>var t='</p>';</script><style>p{{}}</style></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><!-- x --><div class='ad'>Buy this now.</div><article><h1>A  title</h1>{body}</article><footer>&copy; Someone</footer></body></html>"
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<nav><a>Only a menu</a></nav>"), (None, "v", page), (1, "u", page)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_extraction.extract(pages, html_extraction.fit(pages)).collect()
    want = "\n\n".join(["A title"] + [f"Paragraph {i} of the text, long enough to read & keep. Next <line>" for i in range(5)])
    texts = {r.page_id: r.text for r in got}
    assert len(got) == 6 and texts[1] == want == texts[None] and texts[2] == texts[3] == "" == texts[4]
    assert all(r.n_chars == len(r.text) for r in got)
    nothing = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extraction.extract(nothing, html_extraction.fit(nothing)).count() == 0


def test_the_field_learns_composed_pages():
    words = [f"word{i}" for i in range(300)]
    train = [(p, y) for p, y in html_extraction.composed(words, 150) if p]
    field = html_extraction.train([html_extraction.features(p) for p, _ in train], [y for _, y in train])
    wrong = total = 0
    for page, labels in html_extraction.composed(words, 80, seed=5):
        got = field.decode(html_extraction.features(page))
        wrong, total = wrong + sum(a != b for a, b in zip(got, labels)), total + len(labels)
    assert wrong / total < 0.01


def test_viterbi_finds_the_likeliest_of_all_label_sequences():
    rng = np.random.RandomState(6)
    for n in (1, 2, 3, 7, 9):
        for _ in range(20):
            field = html_extraction.Field(rng.normal(size=12), rng.normal(size=(2, 2)))
            rows = [rng.choice(12, rng.randint(1, 5), replace=False).tolist() for _ in range(n)]
            value = lambda y: sum(field.weights[r].sum() for r, v in zip(rows, y) if v) + sum(field.pairs[a, b] for a, b in zip(y, y[1:]))
            best = max(([k >> i & 1 for i in range(n)] for k in range(1 << n)), key=value)
            assert field.decode(rows) == best
    assert html_extraction.Field(np.zeros(3), np.zeros((2, 2))).decode([]) == []


def test_training_raises_the_likelihood_to_its_maximum():
    """The gradient, worked out over all label sequences, is that of the penalty where the training ends."""
    rng = np.random.RandomState(3)
    pages = [[rng.choice(6, 2, replace=False).tolist() for _ in range(n)] for n in (1, 2, 4, 5, 3, 4)]
    labels = [rng.randint(0, 2, len(p)).tolist() for p in pages]
    field = html_extraction.train(pages, labels, steps=3000)
    grad, pairs = np.zeros(len(field.weights)), np.zeros((2, 2))
    for page, own in zip(pages, labels):
        every = [[k >> i & 1 for i in range(len(page))] for k in range(1 << len(page))]
        value = np.array([sum(field.weights[r].sum() for r, v in zip(page, y) if v) + sum(field.pairs[a, b] for a, b in zip(y, y[1:])) for y in every])
        p = np.exp(value - value.max())
        for y, share in [*zip(every, -p / p.sum()), (own, 1.0)]:
            for r, v in zip(page, y):
                grad[r] += share * v
            for a, b in zip(y, y[1:]):
                pairs[a, b] += share
    assert np.allclose(grad / len(pages), html_extraction.RIDGE * field.weights / 10, atol=3e-3) and np.allclose(pairs / len(pages), html_extraction.RIDGE * field.pairs / 10, atol=3e-3)


@pytest.mark.parametrize("page", ["<a " * 1_700_000, "<div>x" * 300_000 + "x" * 3_000_000, "<a \"x' " * 700_000 + ">", "<div>" * 400_000 + "</span>" * 400_000, "<b><div>" + "<i>x" * 500_000 + "</b>" * 500_000, "<!" * 2_500_000, "<script>a</script " * 250_000, "word " * 1_000_000], ids=range(8))
def test_long_pages_of_hostile_markup_take_linear_time(page):
    began = time.process_time()
    parts = html_extraction.leaves(page)
    assert len(html_extraction.features(parts)) == len(parts)
    assert time.process_time() - began < 40


def test_blocks_of_broken_pages():
    text = lambda page: [b.text for b in dom.blocks(page)]
    assert text("<p>a<p>b</div>c<b>d") == ["a", "b", "cd"]
    assert text("<script>x<p>y</script>z<!-- <p>q --> w") == ["z w"]
    assert text("1 < 2 &amp; 3 <td>4") == ["1 < 2 & 3", "4"]
    assert text("") == [] == text(None)
